"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm import textnum
from cohortwise.llm.common import ship_package, written

UNDETERMINED = "und"
BUCKETS = 1 << 13
ROWS_PER_LANGUAGE = 600  # bounds of the training sample
SAMPLE_ROWS = 30_000
_SPACE = 32
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[: _SPACE] = _SPACE
_FLAT[48:58] = 48


def subword_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte n-grams (2 to 4 bytes, within a word and its two edges) by text."""
    run = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    at = _FLAT[np.frombuffer(b"".join(run) + b"    ", dtype=np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(run), dtype=np.int64) * BUCKETS, [len(t) for t in run])
    n = len(row)
    gap = at == _SPACE
    counts = np.zeros(len(run) * BUCKETS, dtype=np.int64)
    gram = at[:n].copy()
    inside = np.ones(n, dtype=bool)  # no space between the two ends
    for size in (2, 3, 4):
        last = size - 1
        gram = gram | (at[last : n + last] << np.uint32(8 * last))
        if size > 2:
            inside = inside & ~gap[last - 1 : n + last - 1]
        good = np.flatnonzero(inside & ~(gap[:n] & gap[last : n + last]) if size == 2 else inside)
        hashed = ((gram[good] + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(19)
        counts += np.bincount(row[good] + hashed, minlength=len(counts))
    return counts.reshape(len(run), BUCKETS)


def _averages(texts: list[str]) -> np.ndarray:
    counts = subword_counts(texts).astype(np.float32)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _runs(texts: pd.Series) -> list[list[str]]:
    """Texts in runs of bounded length and number; a null is an empty text."""
    runs: list[list[str]] = [[]]
    total = 0
    for t in texts:
        t = t or ""
        if runs[-1] and (total + len(t) > textnum.CHUNK_BYTES or len(runs[-1]) >= 128):
            runs.append([])
            total = 0
        runs[-1].append(t)
        total += len(t)
    return runs


@dataclass
class LanguageModel:
    """Scores of hashed subwords by language, with the calibration that was fitted."""

    languages: list[str]
    table: np.ndarray = field(repr=False)  # bucket x language: embeddings times softmax weights
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        return _softmax((averages @ self.table + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dimensions: int = 16,
        epochs: int = 6, rate: float = 60.0, batch: int = 32, seed: int = 7,
        reject_share: float = 0.001, unsure: float = 0.4) -> LanguageModel | None:
    """Train by stochastic gradient descent; fit temperature and rejection on a fifth kept apart.

    ``features`` holds (bucket, weight) arrays by text.  The threshold is what all but
    ``reject_share`` of the held-apart texts reach, in the lowest ``unsure`` of the way from chance
    (1 / languages) to certainty.  Too few texts to hold such a share say less, so the threshold is
    then nearer to chance, by the root of how many of them it would be.  None if there is nothing to learn from.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    answer = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(labels))
    apart = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    embeddings = rng.normal(0, 0.1, (BUCKETS, dimensions)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dimensions, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i, features[r][0]] = features[r][1]
        return x

    steps, done = epochs * (-(-len(train) // batch)), 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            x = dense(rows)
            hidden = x @ embeddings
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), answer[rows]] -= 1
            error /= len(rows)
            now = rate * (1 - done / steps)
            step = x.T @ (error @ weights.T)
            weights -= 0.05 * now * (hidden.T @ error)
            bias -= 0.01 * now * error.sum(axis=0)
            embeddings -= now * step
            done += 1

    model = LanguageModel(languages, (embeddings @ weights).astype(np.float32), bias)
    if len(apart):
        logits = np.concatenate([dense(apart[i : i + 256]) @ model.table + bias
                                 for i in range(0, len(apart), 256)])
        truth = answer[apart]

        def loss(t: float) -> float:
            p = _softmax(logits / t)[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-12)).mean())

        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        scores = _softmax(logits / model.temperature).max(axis=1)
        chance = 1 / len(languages)
        held = min(1.0, len(scores) * reject_share)
        over = (float(np.quantile(scores, reject_share)) - chance) * held**0.5
        model.threshold = chance + min(over, unsure * (1 - chance))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE,
          sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learn from a sample of the rows with ``learn``, a label, and a letter in the text.

    Every label is learned.  About ``rows_per_language`` rows of each are drawn by a hash of id and
    text, fewer where all of them would be more than ``sample_rows``, but one at least; rows
    equal in id and text are drawn as one.  Executors reduce each whole text to at most ``BUCKETS``
    counts; these are what the driver gets, never texts.  The model has 32 KB a label.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                       F.col(id_col).alias("id"), learn.alias("learn")).where(
        F.col("learn") & F.col("lang").isNotNull() & has_letter(F.col("text")))
    draw = F.xxhash64("id", "text")
    position = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    counts = written(rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.min(position).alias("least")))
    languages = counts.count()
    if not languages:
        return None
    wanted = max(1, min(rows_per_language, sample_rows // languages))
    # The first row of a label is always drawn, so that none is lost to chance.
    drawn = rows.withColumn("draw", draw).withColumn("position", position).join(counts, "lang").where(
        (F.col("position") < F.lit(float(wanted)) / F.col("n"))
        | (F.col("position") == F.col("least")))
    once = drawn.groupBy("lang", "position", "draw").agg(F.first("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("position", "draw"))
    drawn = once.withColumn("turn", turn).where(F.col("turn") <= 2 * wanted).select("lang", "text")

    ship_package(docs.sparkSession)

    def reduce(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                found = np.concatenate([_averages(run) for run in _runs(part["text"])])
                buckets = [np.flatnonzero(x) for x in found]
                yield pd.DataFrame({
                    "lang": part["lang"].to_numpy(),
                    "buckets": [b.astype(np.int32).tobytes() for b in buckets],
                    "weights": [x[b].tobytes() for x, b in zip(found, buckets, strict=True)]})

    sample = drawn.mapInPandas(reduce, "lang string, buckets binary, weights binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["weights"])))
    return fit([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32))
                for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
             into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score (0 to 1), rejected.

    The whole text counts, and nothing else.  A text that is null or has no letter is ``und`` with
    score 0 and is rejected; any other gets the most probable learned language, and is rejected
    if its calibrated probability is under the model's threshold.  Without a model (nothing to
    learn from) every text is ``und``.  Other columns, ``und`` among the labels, repeated rows and
    very long texts are as they are; a text is worked on whole, in memory of a few times its size.
    """
    lettered = has_letter(F.col(text_col))
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                    F.lit(True).alias("rejected"))
    if model is None:
        return docs.withColumn(into, none)

    ship_package(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        runs = _runs(texts) if len(texts) else []
        found = [model.probabilities(_averages(run)) for run in runs]
        p = np.concatenate(found) if found else np.zeros((0, len(model.languages)))
        return pd.DataFrame({"lang_pred": np.array(model.languages, dtype=object)[p.argmax(axis=1)],
                             "score": p.max(axis=1).astype(float)})

    made = best(F.col(text_col))
    out = docs.withColumn(into, made)
    guess = F.struct(
        F.col(into)["lang_pred"].alias("lang_pred"), F.col(into)["score"].alias("score"),
        (F.col(into)["score"] < F.lit(model.threshold)).alias("rejected"))
    return out.withColumn(into, F.when(lettered, guess).otherwise(none))
