"""Quality classifier: random Fourier features, partition-summed normal equations, isotonic calibration."""
from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, chosen, free_name, in_arrow, slices, stored, words

#: Bytes of text that a task works on at a time.
SLICE = 2 << 20
#: Groups of bytes whose share of the text is a statistic.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#$%&*+=<>@^_|~\\/{}[]", b"'\"()-", bytes(range(128, 256)))
STATISTICS = len(CLASSES) + 9


def statistics(body: bytes | None) -> list[float]:
    """Numbers that describe a text: shares of byte classes, lengths, repetition, line shape. All zero for an empty one."""
    if not body:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    shares = counts / len(body)
    used = shares[shares > 0]
    found, raw, lines = words(body), body.split(), body.split(b"\n")
    n = len(found)
    common = Counter(found).most_common(1)[0][1] if n else 0
    capital = sum(map(bytes.isupper, raw))
    return [
        *(float(shares[list(c)].sum()) for c in CLASSES),
        float(np.log1p(len(body))), float(-(used * np.log(used)).sum()),
        len(set(found)) / n if n else 0.0, common / n if n else 0.0,
        sum(map(operator.eq, found, found[1:])) / n if n else 0.0,
        sum(map(len, found)) / n if n else 0.0,
        capital / len(raw) if raw else 0.0,
        1 - len(set(lines)) / len(lines), float(np.log1p(len(body) / len(lines))),
    ]


@dataclass(frozen=True)
class Model:
    """What a score needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier(standard(x, self.mean, self.scale), self.frequencies, self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def fourier(z: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features: their inner products approximate a Gaussian kernel. A constant is added."""
    waves = np.cos(z @ frequencies + phases) * np.sqrt(2 / len(phases))
    return np.hstack([waves, np.ones((len(z), 1))])


def pooled(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic fit: neighbouring means that fall are pooled until they rise."""
    blocks: list[list[float]] = []
    for value, count in zip(values, counts, strict=True):
        blocks.append([value, count, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _summed(df: DataFrame, part) -> np.ndarray | None:
    """Sum over all partitions of the flat array that ``part`` makes of a partition; what meets here is bounded by parts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.frombuffer(b"".join(as_bytes(batch.column(0))), "<f8").reshape(batch.num_rows, -1)
            got = part(x, batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    out = None
    for row in in_arrow(df, run, "part binary").toLocalIterator():
        got = np.frombuffer(row["part"], "<f8")
        out = got.copy() if out is None else out + got
    return out


def described(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    """``x`` (packed statistics) and further columns of each row."""
    body = free_name("__text", docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, SLICE):
            packed = [np.array(statistics(b), "<f8").tobytes() for b in as_bytes(batch.column(0))]
            yield pa.record_batch([pa.array(packed, pa.binary()), *batch.columns[1:]], ["x", *batch.schema.names[1:]])

    rows = docs.select(F.col(text).alias(body), *others)
    return in_arrow(rows, run, T.StructType([T.StructField("x", T.BinaryType()), *rows.schema.fields[1:]]))


def fit(given: DataFrame, parts: int = 16, features: int = 256, ridge: float = 1.0, width: float = 4.0, bins: int = 512, seed: int = 7) -> Model:
    """A model from rows of packed statistics ``x``, a 0/1 label ``y`` and a flag ``c`` for calibration.

    Each of ``parts`` partitions sends its sums: moments for scaling first, then the normal equations of the
    ridge fit from rows not flagged, then a histogram of raw scores of the flagged rows, on which pooling of
    falling neighbours makes the calibration. Without rows every score is 0.5.
    """
    d = STATISTICS
    moments = _summed(given.select("x", "y").coalesce(parts), lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    random = np.random.default_rng(seed)
    frequencies, phases = random.normal(0, 1 / width, (d, features)), random.uniform(0, 2 * np.pi, features)
    if moments is None:
        return Model(np.zeros(d), np.ones(d), frequencies, phases, np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = moments[1:d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1:] / moments[0] - mean ** 2, 1e-9))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi = fourier(standard(x, mean, scale), frequencies, phases)
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    size = features + 1
    sums = _summed(given.filter("NOT c").select("x", "y").coalesce(parts), equations)
    if sums is None:
        sums = _summed(given.select("x", "y").coalesce(parts), equations)
    weights = np.linalg.solve(sums[:size * size].reshape(size, size) + ridge * np.eye(size), sums[size * size:])
    middle = (np.arange(bins) + 0.5) / bins * 2 - 0.5  # raw scores are near 0 to 1; those beyond fall into the end bins

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = fourier(standard(x, mean, scale), frequencies, phases) @ weights
        at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, y, bins)])

    counted = _summed(given.filter("c").select("x", "y").coalesce(parts), histogram)
    if counted is None:
        counted = _summed(given.select("x", "y").coalesce(parts), histogram)
    seen = counted[:bins] > 0
    levels = pooled(counted[bins:][seen] / counted[:bins][seen], counted[:bins][seen])
    return Model(mean, scale, frequencies, phases, weights, middle[seen], np.clip(levels, 0, 1))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, from its statistics alone.

    0 to 1, higher: label 1 likelier. Null and empty texts have all statistics zero and so one common score.
    A given column of that name is refused.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have {name}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, text, SLICE):
            x = np.array([statistics(b) for b in as_bytes(batch.column(batch.schema.get_field_index(text)))]).reshape(batch.num_rows, STATISTICS)
            yield pa.record_batch([*batch.columns, pa.array(own.score(x))], [*batch.schema.names, name])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def remainder(doc: Column) -> Column:
    """crc32 of the id as text, mod 3: 1 is held out, 0 fits, 2 calibrates."""
    return F.crc32(doc.cast("string").cast("binary")) % 3


def fit_labels(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, parts: int = 16, **options) -> Model:
    """A model from the labelled documents that are not held out. Of several labels of one id the largest holds.

    At most about ``max_rows`` labelled ids take part, those with the smallest hashes; all if there are fewer.
    Statistics are taken of the texts with such ids before they meet the labels, so no text is shuffled.
    """
    known = labels.select(F.col(doc).alias("doc"), F.col(label).alias("y")).filter(F.col("doc").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc")) != 1))
    known = known.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.max("y").cast("double").alias("y"))
    picked = chosen(F.xxhash64("doc"), max_rows / max(known.count(), 1))
    some = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (remainder(F.col("doc")) != 1) & picked)
    rows = described(some, "text", F.col("doc")).join(known.filter(picked), "doc")
    return fit(stored(rows.select("x", "y", (remainder(F.col("doc")) == 2).alias("c")).repartition(parts), "statistics"), parts, **options)
