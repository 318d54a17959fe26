"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import (
    chat_format,
    collocations,
    embedding_dedup,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    sharding,
    substring_dedup,
    topk_search,
)

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of the packing query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> Column:
    """The fold of documents that nothing is learned from; a null id is in none."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return F.coalesce(fold == 2, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = exact_dedup.exact_dedup(
        _table(spark, sf_dir, "documents"), carry={"text_sha256": digest})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(
        _table(spark, sf_dir, "documents"), sharding.even_tree(SHARDS),
        sharding.even_tree(SHARDS + 1, base=SHARDS),
        carry={"text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         "slot", "grown_shard")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_removed").alias("n_removed"),
        F.array_join("line_dedup.removed", ",").alias("removed"), "text")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out())
    return language_id.identify(
        docs.select("doc_id", "text", held_out().alias("held_out")), model
    ).select("doc_id", "held_out", "language.*")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render_perspectives(_table(spark, sf_dir, "conversations")).select(
        "conv_id", "part", "perspective", "n_turns", "text", "masked_chars",
        F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["length"])), ",")
        .alias("masks"))


#: The mixing query's tree and targets; sources are dealt to two domains by a hash of their names.
MIX_WEIGHTS = {
    "domain": {"web": 0.6, "books": 0.4},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {"src0": 0.5},
}
MIX_SHARE = 0.5
MIX_EPOCHS = 4


def mix_levels() -> dict[str, Column]:
    web = F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 1) < "8"
    return {"domain": F.when(web, "web").otherwise("books"), "lang": F.col("lang"),
            "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE,
                       MIX_EPOCHS, seed=5)
    return mixed.select("doc_id", "mix.*")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_inner_products(
        _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def planted_repetition(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts repeat a stretch of their words from some word on.

    With h = crc32(doc_id), g = h div 10 and n words: if h % 10 = 0 the words from a = g % n on become the p words
    from there over and over, p = 1 + (n - a) div (3 + g % 8).
    """
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn(
        "__n", F.coalesce(F.size("__words"), F.lit(0)))
    g, n, a = F.floor(h / 10), F.col("__n"), F.col("__a")
    placed = chosen.withColumn("__a", F.when(n > 0, (g % n).cast("int"))).withColumn(
        "__p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("__words", a + 1, F.col("__p")),
                                     F.ceil((n - a) / F.col("__p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("__words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return placed.withColumn("text", F.when(n > 0, changed).otherwise(F.col("text"))).select(
        *docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(planted_repetition(docs), digest=True)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(longest, F.lit(0))
    length = -best["shorter"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        length.alias("length"), best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
        .alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER in_order AS rank,
         coalesce(sum(strlen(role) + strlen(text) + {chat_format.MARK_BYTES}) OVER (
           in_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         // {chat_format.PART_BYTES} AS part
  FROM said WINDOW in_order AS (PARTITION BY conv_id ORDER BY turn, role, text)
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM numbered WHERE role <> 'system'
), carried AS (
  SELECT * FROM numbered JOIN (
    SELECT conv_id, min(rank) AS opening FROM numbered WHERE role <> 'system' GROUP BY conv_id
  ) USING (conv_id) WHERE part = 0 AND rank < opening
), turns AS (
  SELECT conv_id, part, rank, role, text FROM numbered
  UNION ALL
  SELECT conv_id, later.part, rank, role, text
  FROM carried JOIN (SELECT DISTINCT conv_id, part FROM numbered WHERE part > 0) AS later USING (conv_id)
), segments AS (
  SELECT conv_id, CAST(part AS BIGINT) AS part, perspective, rank, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant'
                                WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END || chr(10) AS lead,
         text || '<|im_end|>' || chr(10) AS body
  FROM turns JOIN speakers USING (conv_id)
), placed AS (
  SELECT *, sum(length(lead) + length(body)) OVER (
              PARTITION BY conv_id, part, perspective ORDER BY rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(body) AS begins
  FROM segments
)
SELECT conv_id, part, perspective, count(*) AS n_turns,
       string_agg(lead || body, '' ORDER BY rank) AS text,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS masked_chars,
       coalesce(string_agg(CASE WHEN own THEN CAST(begins AS VARCHAR) || ':'
                                || CAST(length(body) AS VARCHAR) END, ',' ORDER BY rank), '') AS masks
FROM placed GROUP BY conv_id, part, perspective
"""


def _filled(level: str, path: str, above: str, weight: str) -> str:
    """SQL of one level's budgets: each child takes its share of what its parent has, up to its
    capacity; the level of filling is the highest that any order of full children gives."""
    parents = path.rpartition(", ")[0]
    within = f"PARTITION BY {parents}" if parents else ""
    source = f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"
    return f"""
  SELECT {path}, least(cap, w * max(fill) OVER ({within})) AS budget
  FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER onwards AS fill
    FROM (SELECT {path}, sum(cap) AS cap, any_value({weight}) AS w FROM leaves GROUP BY {path})
    {source}
    WINDOW before AS ({within} ORDER BY cap / w, {level} NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           onwards AS ({within} ORDER BY cap / w, {level} NULLS FIRST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  )"""


def _weights_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END :: DOUBLE"


OP10_SQL = f"""
WITH rows AS (
  SELECT doc_id,
         CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
         lang, source,
         len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), words AS (SELECT * FROM rows WHERE tokens > 0
), leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply,
         {MIX_EPOCHS}.0 * sum(tokens) :: DOUBLE AS cap,
         {_weights_sql('domain')} AS w0, {_weights_sql('lang')} AS w1, {_weights_sql('source')} AS w2
  FROM words GROUP BY domain, lang, source
), whole AS (
  SELECT least(floor(sum(supply) * {MIX_SHARE}), sum(cap)) :: DOUBLE AS budget FROM leaves
), domains AS ({_filled('domain', 'domain', 'whole', 'w0')}
), langs AS ({_filled('lang', 'domain, lang', 'domains', 'w1')}
), sources AS ({_filled('source', 'domain, lang, source', 'langs', 'w2')}
), plan AS (
  SELECT *, budget // supply AS full_epochs, budget % supply AS rest
  FROM (SELECT domain, lang, source, supply, CAST(floor(budget + 1e-6) AS BIGINT) AS budget
        FROM sources JOIN leaves USING (domain, lang, source))
), placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto
  FROM (SELECT *, md5('5|' || CAST(full_epochs AS VARCHAR) || '|' || key) AS place
        FROM words JOIN plan USING (domain, lang, source))
)
SELECT doc_id, domain, lang, source,
       unnest(range(full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch, tokens
FROM placed
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM documents
), places AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM pieces CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k
), counts AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM places GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE k > 1 AND a >= 100
), cuts AS (
  SELECT lang, phrase, k, a, cut, string_split(phrase, ' ') AS words
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, n,
         CAST((1000 :: HUGEINT * c.a * n) // (l.a :: HUGEINT * r.a) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY
           (1000 :: HUGEINT * c.a * n) // (l.a :: HUGEINT * r.a), cut) AS place
  FROM cuts c JOIN totals USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(words[1 : cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(words[cut + 1 :], ' ')
), kept AS (
  SELECT * FROM scored s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = s.lang AND d.k > s.k AND 100 * d.a >= 100 * s.a
      AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept
QUALIFY rank <= 2000
"""

OP12_SQL = """
WITH grid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER () AS place
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(
    embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT)
           AS score
  FROM grid q JOIN grid c ON len(q.v) = len(c.v) AND q.place <> c.place
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scores
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op9_chat_formatting": OP9_SQL, "op10_mixing": OP10_SQL,
            "op11_phrase_collocations": OP11_SQL, "op12_topk_search": OP12_SQL}
