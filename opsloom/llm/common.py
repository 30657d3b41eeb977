"""What the operators of this folder share: stored tables, Arrow passes and the word rule."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes: letters are lower-cased, letters and digits stay, the rest parts words. Bytes above belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words in the text as it is, for offsets.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault("base", "file://" + tempfile.mkdtemp(prefix="opsloom-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: a lost executor costs no recomputation."""
    folder = shared_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of an Arrow batch that a task gets at a time, unless the session sets its own limit.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` over small batches: the executor and its Python worker each hold one, whatever the texts' lengths."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts hold about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit or batch.num_rows < 2:
            yield batch
            continue
        size = start = 0
        for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                size, start = 0, i
            size += n
        yield batch.slice(start)


def chosen(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the given share of all hashes."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(hashed, 1) < F.lit(int(share * 2.0 ** 63))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it while a given column has that name (letter case aside)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
