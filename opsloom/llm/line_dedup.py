"""Line dedup over levelled sorted runs of line hashes."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, in_arrow, shared_folder, slices, stored

#: Bytes of text that a task works on at a time.
SLICE = 2 << 20
RUN = "k1 long, k2 long, n long, top long"


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a lower-cased line without the blanks at its ends; none if it has fewer than ``least`` code points."""
    line = line.strip()
    if len(line) < least or len(line) < 4 * least and len(line.decode()) < least:
        return None
    return blake2b(line, digest_size=16).digest()


def lines_of(docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """``doc, k1, k2``: the distinct line keys of each row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            keys, rows = [], []
            for i, body in enumerate(as_bytes(batch.column(1))):
                found = {line_key(line, least) for line in body.lower().split(b"\n")} - {None} if body else ()
                keys.extend(found)
                rows.extend([i] * len(found))
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc", "k1", "k2"])

    return in_arrow(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")), run, "doc long, k1 long, k2 long")


class LineRuns:
    """Levelled sorted runs: tables of line keys with the documents counted and the largest document seen.

    A run is bucketed by key and sorted within its buckets, so the merge joins against it move no row of
    it. Batches come in falling order of documents. A new batch is merge-anti-joined with every run: keys
    that a run already holds often enough are settled (their document is known, and it is larger) and are
    not written again; the rest of the batch is a new run of the lowest level. When a level has ``fan_in``
    runs, they are merged into one of the next, so a key is rewritten once per level, not once per batch.
    """

    def __init__(self, spark: SparkSession, enough: int, fan_in: int = 2, buckets: int | None = None) -> None:
        self.spark, self.enough, self.fan_in = spark, enough, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folders: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        folder = shared_folder(self.spark, "run")
        name = "line_run_" + folder.rsplit("-", 1)[1]
        rows.repartition(self.buckets, "k1", "k2").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", folder).saveAsTable(name)
        self.folders[name] = folder
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Counts and largest documents over several runs.

        Their files are read as one table: a union of bucketed tables counts as partitioned by key, but
        what is written from it need not be read by bucket, and sums would stay apart.
        """
        rows = self.spark.read.schema(RUN).parquet(*[self.folders[n] for n in names])
        return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, lines: DataFrame) -> None:
        """One batch of ``doc, k1, k2``, whose documents are smaller than those of all batches before."""
        fresh = lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        for name in (n for level in self.levels for n in level):
            fresh = fresh.join(self.spark.table(name).filter(F.col("n") >= self.enough), ["k1", "k2"], "left_anti")
        level, run = 0, self._write(fresh)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            run = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def frequent(self) -> DataFrame:
        """``k1, k2, top`` of the keys found often enough."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long, top long")
        return self._merged(names).filter(F.col("n") >= self.enough).select("k1", "k2", "top")

    def close(self) -> None:
        """Forget the tables' names; the files stay in the shared folder, which the cluster cleans."""
        for name in self.folders:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 4, fan_in: int = 2,
                names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the counts of lines before and of dropped ones.

    Lines are split at line feeds; a null or empty text is one empty line and stays as it is. The key of a line is the line
    without ASCII blanks at its ends, ASCII letters lower-cased. A key of at least ``least_chars`` code points
    found in at least ``least_docs`` documents loses all its lines except in the rows with the largest id that holds it.
    A document that loses all its lines becomes the empty text. Repeats inside one document count once and fall
    or stay together. Rows with equal ids are one document; rows without an id count for none and keep all their lines.
    A given column with one of the ``names`` is refused.

    The keys are taken from the texts once and stored by batch (ranges of ids); ``LineRuns`` settles them. A
    text meets its own dropped keys only, by an equi-join on the id.
    """
    clash = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"documents already have {sorted(clash)}")
    spark = docs.sparkSession
    found = lines_of(docs, doc, text, least_chars).filter("doc IS NOT NULL")
    # A key counts once for each id: where ids repeat, the keys of their rows are made distinct first.
    ids = docs.select(F.col(f"`{doc}`").cast("long").alias("doc")).filter("doc IS NOT NULL")
    again = stored(ids.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "repeated")
    if not again.isEmpty():
        found = found.join(again, "doc", "left_anti").unionByName(found.join(again, "doc", "left_semi").distinct())
    cuts = docs.agg(F.percentile_approx(F.col(doc).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted({*(cuts or [])})
    batch = F.lit(len(cuts))
    for i, cut in enumerate(cuts):
        batch = F.when(F.col("doc") > cut, F.least(batch, F.lit(len(cuts) - 1 - i))).otherwise(batch)
    keys = stored(found.withColumn("batch", batch), "lines", by="batch")
    runs = LineRuns(spark, least_docs, fan_in)
    try:
        for i in range(len(cuts) + 1):
            runs.add(keys.filter(F.col("batch") == i))
        frequent = stored(runs.frequent(), "frequent")
    finally:
        runs.close()
    own, drop = free_name("__doc", docs.columns), free_name("__drop", docs.columns)
    drops = (keys.join(frequent, ["k1", "k2"]).filter(~F.col("doc").eqNullSafe(F.col("top")))
             .groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias(drop)).withColumnRenamed("doc", own))
    joined = docs.join(drops, docs[doc].cast("long") == drops[own], "left").drop(own)
    return _without(joined, docs.schema, text, least_chars, names)


def _without(joined: DataFrame, given: T.StructType, text: str, least: int, names: tuple[str, str]) -> DataFrame:
    place, fields = given.fieldNames().index(text), given.fields

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            own = list(batch.columns[:len(fields)])
            bodies, listed = as_bytes(own[place]), batch.column(len(fields))
            ends = np.cumsum(pc.list_value_length(listed).fill_null(0).to_numpy())
            keys = np.stack([c.to_numpy() for c in listed.flatten().flatten()], 1).astype("<i8")
            lines, dropped, done = [], [], 0
            for i, (body, end) in enumerate(zip(bodies, ends.tolist(), strict=True)):
                lines.append(body.count(b"\n") + 1 if body else 1)
                dropped.append(0)
                if done < end and body:
                    packed = keys[done:end].tobytes()
                    gone = {packed[at:at + 16] for at in range(0, len(packed), 16)}
                    split = body.split(b"\n")
                    kept = [line for line in split if line_key(line.lower(), least) not in gone]
                    dropped[i] = len(split) - len(kept)
                    bodies[i] = b"\n".join(kept)
                done = end
            own[place] = pa.array(bodies, pa.binary()).cast(pa.string())
            yield pa.record_batch([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*given.fieldNames(), *names])

    return in_arrow(joined, run, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], *[T.StructField(n, T.LongType()) for n in names]]))
