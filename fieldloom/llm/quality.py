"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

 1. Every text becomes a vector of FEATURES statistics (sizes, character classes, repetition), transformed to be
    closer to normal. Vectors are written once to the shared folder (`accepted` writes them next to their rows).
 2. Labelled rows give, for each class, a count, sums and products of vectors: one aggregate of a fixed number
    of rows, whatever the input.
 3. On the driver each class covariance is shrunk towards the pooled one and that towards its diagonal; its
    Cholesky factor is cached. A score is the logistic of the difference of the two Mahalanobis log densities, with
    priors, divided by the temperature that fits the labelled rows' classes best.

No sample is taken: all labelled rows outside the held-out fold are used. Nothing but the text enters a score.

Defined results: null and empty texts have the vector of an empty text and get its score; a null doc_id is not held
out and has no label; a label that is null or not 0 or 1 is ignored; repeated labels count each; with fewer
than two labelled rows of a class the score is the share of label 1 among labelled rows (one half without any);
an empty table gives no rows; other columns are ignored by `scores` and kept by `accepted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns, fresh_path, materialised, small_batches, utf8

FEATURES = (
    "bytes", "words", "word_length", "upper", "digits", "blanks", "lines", "stops", "commas", "other_marks", "wide",
    "distinct_words", "top_word", "distinct_pairs", "repeated_pairs", "packed", "lone_marks", "marked_words", "capital_words", "line_repeats",
)
DIM = len(FEATURES)
SHRINK, RIDGE, THRESHOLD, FOLDS = 0.1, 1e-3, 0.3, 5
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SOFT = b".,;:'\"-()"
HARD = np.array([b for b in MARKS if b not in SOFT])
ENDS = tuple(bytes([b]) for b in HARD)
PACK = 1 << 16


def packed_share(raw: bytes) -> float:
    """Compressed over plain size, in pieces, so that a long text takes as much memory as a piece."""
    return sum(len(zlib.compress(raw[i : i + PACK], 1)) for i in range(0, len(raw), PACK)) / len(raw)


def statistics(raw: bytes | None) -> np.ndarray:
    x = np.zeros(DIM)
    if not raw:
        return x
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = len(words)
    lines = [w for w in raw.split(b"\n") if w.strip()]
    share = lambda k, of: np.sqrt(k / of) if of else 0.0
    x[:11] = (
        np.log1p(n), np.log1p(m), np.log1p(n / m if m else n), share(count[65:91].sum(), n), share(count[48:58].sum(), n), share(count[32], n), share(count[10], n),
        share(count[46], n), share(count[44], n), share(count[HARD].sum(), n), share(count[128:].sum(), n),
    )
    if m:
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, m)
        pairs = codes[1:] * len(known) + codes[:-1]
        distinct = len(np.unique(pairs))
        x[11] = np.log(len(known)) / np.log1p(m)
        x[12] = share(np.bincount(codes).max(), m)
        x[13] = np.log1p(distinct) / np.log1p(m)
        x[14] = share(len(pairs) - distinct, m)
        x[16] = share(sum(len(w) == 1 and w in MARKS for w in words), m)
        x[17] = share(sum(w.endswith(ENDS) for w in words), m)
        x[18] = share(sum(w[:1].isupper() for w in words), m)
    x[15] = packed_share(raw)
    x[19] = share(len(lines) - len(set(lines)), len(lines))
    return x


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x of each text, materialised."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([statistics(t) for t in utf8(texts)], pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialised(docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, x array<double>"))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0, F.lit(False))


@dataclass
class Model:
    """Class means, Cholesky factors and log determinants; weights of the linear rescaling of vectors."""

    means: np.ndarray
    factors: list[np.ndarray]
    log_det: np.ndarray
    log_prior: np.ndarray
    temperature: float = 1.0
    constant: float | None = None

    def __post_init__(self) -> None:
        #: What whitens a vector: the inverse of each factor, taken once.
        self.whiteners = [np.linalg.inv(f) for f in self.factors]

    def margin(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in (0, 1):
            z = self.whiteners[k] @ (x - self.means[k]).T
            logs.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=0)))
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """label, x -> for each label the sum of outer products of (1, x), as one bounded aggregate."""
    d = DIM + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
        for labels, xs in columns(batches, "label", "x"):
            x = np.hstack([np.ones((len(labels), 1)), xs.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)])
            y = labels.to_numpy(zero_copy_only=False)
            for k in sums:
                sums[k] += x[y == k].T @ x[y == k]
        at = np.arange(d * d)
        for k, s in sums.items():
            if s.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s.ravel())], ["label", "at", "value"])

    rows = labelled.select("label", "x").mapInArrow(partial, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    out = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in rows:
        out[r["label"]][r["at"]] = r["value"]
    return {k: v.reshape(d, d) for k, v in out.items()}


def fit(sums: dict[int, np.ndarray], shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    n = np.array([sums[k][0, 0] for k in (0, 1)])
    if (n < 2).any():
        return Model(np.zeros((2, DIM)), [np.eye(DIM)] * 2, np.zeros(2), np.zeros(2), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = np.stack([sums[k][0, 1:] / n[k] for k in (0, 1)])
    scatter = [sums[k][1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(scatter) / n.sum()
    floor = np.diag(np.maximum(np.diag(pooled), 1e-9))
    factors, log_det = [], []
    for k in (0, 1):
        cov = (1 - shrink) * scatter[k] / n[k] + shrink * (0.5 * pooled + 0.5 * floor) + ridge * floor
        factors.append(np.linalg.cholesky(cov))
        log_det.append(2 * np.log(np.diag(factors[-1])).sum())
    return Model(means, factors, np.array(log_det), np.log(n / n.sum()))


def _scored(vecs: DataFrame, model: Model, *keep: str) -> DataFrame:
    schema = ", ".join(f"{c} {vecs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(model.score(x))], [*keep, "score"])

    return vecs.mapInArrow(score, f"{schema}, score double")


def tempered(model: Model, labelled: DataFrame) -> Model:
    """The temperature among powers of two with the least log loss on the labelled rows."""
    if model.constant is not None:
        return model
    grid = [2.0**k for k in range(8)]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for labels, xs in columns(batches, "label", "x"):
            sign = 2 * labels.to_numpy(zero_copy_only=False) - 1
            margin = sign * model.margin(xs.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))
            total += [np.logaddexp(0, -margin / t).sum() for t in grid]
        yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array(total)], ["t", "loss"])

    rows = labelled.select("label", "x").mapInArrow(losses, "t double, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
    if rows:
        model.temperature = min(rows, key=lambda r: (r["loss"], r["t"]))["t"]
    return model


def train(vecs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on all labelled rows outside the held-out fold."""
    y = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    labelled = materialised(vecs.join(y, "doc_id").select("label", "x"))
    return tempered(fit(moments(labelled)), labelled)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document."""
    vecs = vectors(docs)
    out = _scored(vecs, train(vecs, labels), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, as they are. Rows are judged as they pass: no text is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in columns(batches, "own", "text"):
            yield pa.RecordBatch.from_arrays([own, pa.array([statistics(t) for t in utf8(texts)], pa.list_(pa.float64()))], ["own", "x"])

    # under a name of their own, so that no column of the input can clash
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), F.col("text").alias("text"))
    path = fresh_path(spark, "measured")
    packed.mapInArrow(measure, f"own {packed.schema['own'].dataType.simpleString()}, x array<double>").write.option("compression", "zstd").parquet(path)
    measured = spark.read.parquet(path)
    model = train(measured.select("own.doc_id", "x"), labels)
    return _scored(measured, model, "own").filter(F.col("score") >= threshold).select("own.*")
