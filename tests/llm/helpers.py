"""Small tables with the awkward cases every operator must take."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Columns that carry names the operators use inside.
CLASHING = ["id", "node", "size", "line", "n", "row", "component", "shard", "bucket", "__id",
            "__hash", "word", "mask", "tokens", "length", "start"]


def documents(spark, texts, clash=True):
    """Documents from texts or (doc_id, text, lang, source) rows, with clashing extra columns."""
    rows = []
    for i, t in enumerate(texts):
        row = t if isinstance(t, tuple) else (i, t, "en", f"src{i % 3}")
        rows.append((*row, None if row[1] is None else len(row[1])))
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clash:
        df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])
    return df


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def awkward_texts():
    """Nulls, empty and blank texts, repeats, a very long text, texts of one word."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 60_000)
    return [
        (1, base, "en", "a"), (2, base, "en", None), (2, base, "en", "a"), (2, base, "en", "a"),
        (None, base, None, None), (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "a"),
        (5, "", "en", "a"), (6, "  \n \n", "de", "b"), (7, "word", "de", "b"), (8, "word", "de", "b"),
        (9, long, "en", "a"), (10, long + " more", "en", "b"), (None, words(rng, 80), "en", "c"),
        (11, "\x00 odd\x0bsigns é中\U0001f600 <|endoftext|>", "fr", "c"), (-3, "!!! ...", "en", "c"),
    ]
