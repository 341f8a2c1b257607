"""Quality scores: kernel ridge regression on document statistics by random Fourier features, calibrated by isotonic regression.

1. Statistics of labelled training rows (at most LABELLED_ROWS, those with the smallest hashes of doc_id), written once.
2. Scaling, by their means and deviations; random Fourier features approximate a Gaussian kernel on what is scaled.
3. Normal equations, summed in each partition and then over partitions, row by row of the matrix; solving them takes a
   matrix of FEATURES + 1 squared, whatever the number of rows.
4. Isotonic calibration on counts of scores in BINS bins, by pooling adjacent violators.

Scores never use labels, lang, source or doc_id.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches

LABELLED_ROWS = 200_000
FEATURES, RIDGE, BINS = 256, 1e-3, 1000
#: Scores are binned between these; the labels are 0 and 1.
LOW, HIGH = -0.5, 1.5

KINDS = {
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": map(ord, ".,;:?"),
    "shout": map(ord, "!"),
    "bar": map(ord, "|/\\_-=+<>~^"),
    "mark": map(ord, "#$%&*@"),
    "quote": map(ord, "\"'`()[]{}"),
    "high": range(128, 256),
}
BYTES = np.zeros((256, len(KINDS)))
for _k, _codes in enumerate(KINDS.values()):
    BYTES[list(_codes), _k] = 1
NAMES = (*KINDS, "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeats", "capital_words", "log_lines", "distinct_lines", "line_length")


def statistics(text: str) -> list[float]:
    """Numbers about a text, all finite, all zero but for none of an empty text."""
    if not text:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(data, minlength=256) @ BYTES / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    counts = Counter(words)
    return [
        *np.sqrt(shares).tolist(),
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p((len(text) - text.count(" ")) / n),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
    ]


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of y by weight over ascending x, by pooling adjacent violators: block centres and values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def train_fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    values: np.ndarray

    def mapped(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases), np.ones((len(rows), 1))], axis=1)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Quality:
        """Without labelled rows of both kinds every text scores 1: nothing is known against it.

        Of labels of one doc_id that contradict each other, poor counts; of its rows, the first text.
        """
        spark = docs.sparkSession
        small_batches(docs.sparkSession)
        known = labels.where(train_fold() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("y"))
        known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows))

        def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"x": [statistics(t) for t in batch["text"]], "y": batch["y"]})

        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
        rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
        rows = saved(rows.mapInPandas(describe, "x array<double>, y double"), "quality-statistics")
        d = len(NAMES)
        rng = np.random.default_rng(7)
        model = cls(np.zeros(d), np.ones(d), rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]))
        moments = rows.agg(F.count("*"), F.sum("y"), *(F.avg(F.col("x")[i]) for i in range(d)), *(F.stddev_pop(F.col("x")[i]) for i in range(d))).first()
        n, positive = moments[0], moments[1]
        if not n or not 0 < positive < n:
            return model
        model.mean, model.scale = np.array(moments[2 : 2 + d]), np.maximum(np.array(moments[2 + d :]), 1e-3)
        shared = spark.sparkContext.broadcast(model)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((FEATURES + 1, FEATURES + 2))
            for batch in batches:
                z = shared.value.mapped(np.stack(batch["x"]))
                total += z.T @ np.column_stack([z, batch["y"]])
            yield pd.DataFrame({"i": np.arange(FEATURES + 1), "row": list(total)})

        def total(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(parts["row"]), axis=0)]})

        sums = rows.mapInPandas(partial, "i int, row array<double>").groupBy("i").applyInPandas(total, "i int, row array<double>")
        normal = np.stack([r["row"] for r in sorted(sums.collect(), key=lambda r: r["i"])])
        ridge = RIDGE * n * np.eye(FEATURES + 1) / FEATURES
        ridge[-1, -1] = 0
        model.weights = np.linalg.solve(normal[:, :-1] + ridge, normal[:, -1])
        fitted = spark.sparkContext.broadcast(model)

        def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                s = fitted.value.mapped(np.stack(batch["x"])) @ fitted.value.weights
                yield pd.DataFrame({"bin": np.clip((s - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int), "y": batch["y"]})

        bins = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
        model.centres, model.values = pooled(LOW + (bins["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS, bins["y"].to_numpy(), bins["n"].to_numpy(float))
        return model

    def score(self, text: Column) -> Column:
        """The calibrated probability of label 1, between 0 and 1; a null text scores as an empty one."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.array([statistics(t) for t in batch]).reshape(len(batch), len(NAMES))
                yield pd.Series(np.clip(np.interp(model.mapped(x) @ model.weights, model.centres, model.values), 0, 1))

        return run(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a row without doc_id is not held out. Repeated rows score alike."""
    model = Quality.fit(docs, labels, labelled_rows)
    out = docs.select("doc_id", F.coalesce(~train_fold(), F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that score 0.5 or more. A null text is judged as an empty one, repeated rows alike; an empty table stays empty."""
    return docs.where(Quality.fit(docs, labels).score(F.col("text")) >= 0.5)
