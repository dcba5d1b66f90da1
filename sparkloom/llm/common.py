"""Pieces shared by the text operators: shipping code, cutting Arrow batches, folding bytes.

Texts travel as UTF-8 bytes. A null text counts as empty everywhere. Columns that ride along are packed into one struct
with names of its own, so extra columns of any name do no harm; one that has the name of an operator's result is
replaced by it.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a task; numpy temporaries are a small multiple of it.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, whatever its rows hold; a longer row stands alone.
BATCH_BYTES = 4 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: One byte to one byte: A-Z to lower case, letters, digits and non-ASCII kept, all else to a space.
WORD_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: One byte to one byte: A-Z to lower case, ASCII white space to a space, all else kept.
SPACE_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, once a session, so that no shared folder or installation is needed.

    The session's bound on the bytes of an Arrow batch is lowered to `BATCH_BYTES` where it is larger; plans are made when a caller
    acts on them, so that bound has to stay. Rows alone do not bound a batch of long texts.
    """
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(most, None)
    if have is None or not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_loom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="loom-"), "sparkloom_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / "sparkloom").rglob("*.py")):
            archive.write(path, path.relative_to(root).as_posix())
    sc.addPyFile(target)
    sc._loom_shipped = True


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size; `let_go` frees it on the executors."""
    shared = spark.sparkContext.broadcast(value)
    spark.sparkContext.__dict__.setdefault("_loom_shared", []).append(shared)
    return shared


@contextmanager
def lent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """Broadcast a value for what is acted on inside; then driver and executors let go of it. No plan that is acted on later may need it."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def let_go(spark: SparkSession) -> None:
    """Free what was broadcast so far on executors. A plan that still needs it fetches it again from the driver."""
    for shared in spark.sparkContext.__dict__.pop("_loom_shared", ()):
        shared.unpersist()


def tidy() -> None:
    """At the end of a task: give freed memory back, as Python workers live on and JVM and workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. A local folder stands in only where that setting is absent and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_loom_folder", None) or tempfile.mkdtemp(prefix="loom-shared-")
        spark.sparkContext._loom_folder = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is acted on inside are let go once it is done."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files behind it are let go once it is written, so the disk holds one step at a time.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the folder of a materialised step that nothing reads any more."""
    path = df._loom_path
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of `column`; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> pa.Array:
    """The same buffers, as bytes."""
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in as_bytes(batch.column(column)).to_pylist()]


def column(name: str):
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, keep: Sequence[str], **more) -> DataFrame:
    """One struct, `kept`, of the columns that ride along, beside `more`, whose names hence cannot clash with theirs."""
    return df.select(F.struct(F.lit(None).alias("none"), *(column(k).alias(f"k{i}") for i, k in enumerate(keep))).alias("kept"), *(c.alias(n) for n, c in more.items()))


def unpacked(df: DataFrame, keep: Sequence[str], *more) -> DataFrame:
    """The columns that ride along, under their own names, then `more`."""
    return df.select(*(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)), *more)


def kept_field(df: DataFrame) -> T.StructField:
    """The field of `kept` in a schema of results."""
    return df.schema["kept"]


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    text: str = "text",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Add columns computed from whole texts. `make` runs once a task and gives a function of a list of texts of about `most` bytes.

    Columns of `keep` that have the name of a result are replaced by the result.
    """
    ship_code(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    keep = [k for k in keep if k.lower() not in taken]
    inside = keep.index(text) if text in keep else -1
    sent = packed(df, keep) if inside >= 0 else packed(df, keep, text=column(text).cast("string"))
    inside = inside if inside < 0 or isinstance(df.schema[text].dataType, T.StringType) else None
    if inside is None:
        sent, inside = packed(df, keep, text=column(text).cast("string")), -1
    schema = T.StructType([kept_field(sent), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column("text") if inside < 0 else batch.column("kept").field(inside + 1)
            whole = pa.RecordBatch.from_arrays([batch.column("kept"), as_bytes(texts)], names=["kept", "text"])
            for part in slices(whole, "text", most):
                yield pa.RecordBatch.from_arrays([part.column("kept"), *work(texts_of(part))], names=schema.names)
        del work
        tidy()

    return unpacked(sent.mapInArrow(run, schema), keep, *(F.col(f.name) for f in fields))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def fold_words(text: bytes) -> list[bytes]:
    """Words of the ASCII-lower-cased text: runs of letters, digits and non-ASCII bytes."""
    return text.translate(WORD_FOLD).split()


def split_words(text: bytes) -> list[bytes]:
    """Words of the ASCII-lower-cased text between ASCII white space."""
    return text.translate(SPACE_FOLD).split()


WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
