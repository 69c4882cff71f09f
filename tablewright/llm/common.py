"""Helpers that several corpus operators share."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one step inside a task, so that temporary arrays stay small however large a batch is.
STEP_BYTES = 1 << 20
#: Bytes of one batch on its way to Python, unless one row has more; Spark's own bound is 64 MB.
BATCH_BYTES = 1 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark removes a job's shuffle files with the job, not when the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What operators keep in a Python worker between tasks; workers outlive a stage.
KEPT: list[dict] = []


def kept() -> dict:
    """A new table of things that a worker keeps until tasks of another kind let go of them."""
    KEPT.append({})
    return KEPT[-1]


def let_go() -> None:
    """Drop what earlier stages left in this worker."""
    for things in KEPT:
        things.clear()


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; where the session names no bound of its own, batches to Python get BATCH_BYTES at most."""
    if BATCH_KEY not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a default one on one machine, and an error on a cluster."""
    name, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not name and context.getCheckpointDir() is None and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(name or "/tmp/tablewright-shared")
    return name or context.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and any executor may be lost."""
    path, conf = path or scratch(df.sparkSession, kind), df.sparkSession.conf
    before = conf.getAll.get(CLEANUP_KEY)
    conf.set(CLEANUP_KEY, "true")
    try:
        bounded(df).write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP_KEY, before) if before is not None else conf.unset(CLEANUP_KEY)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    """Give a table of the shared folder its lasting name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(new).getParent())
    if not files.rename(path(old), path(new)):
        raise OSError(f"{old} can't become {new}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, where a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def steps(batch: pa.RecordBatch, column: str):
    """The batch in slices of about STEP_BYTES of the column; a longer value is a slice of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for at, n in enumerate(sizes):
        if held and held + (n or 0) > STEP_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """function: from a pyarrow batch of df's columns to one of the schema's; it gets slices of bounded size.

    The slices follow the column named text.
    """

    def run(batches):
        for out in itertools.chain.from_iterable((function(part) for part in steps(b, "text")) for b in batches):
            if out.num_rows:
                yield out

    return bounded(df).mapInArrow(run, schema)


def letters_only(keep_digits: bool = True) -> bytes:
    """A byte table: A-Z to a-z; bytes of other scripts stay; all else to a space."""
    digits = range(0x30, 0x3A) if keep_digits else ()
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 or b in digits else 0x20 for b in range(256))


#: A byte table that only lowers A-Z.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mapped(texts: pa.Array, bytes_to: bytes) -> pa.Array:
    """The texts with each byte replaced by the table's, all at once; nulls become empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(texts) else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)).tobytes()), pa.py_buffer(data.to_pybytes().translate(bytes_to)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and where each text's words begin (one more than texts)."""
    lists = pa.compute.ascii_split_whitespace(texts)
    flat = pa.compute.list_flatten(lists)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)), dtype=np.int64)])
    full = np.asarray(pa.compute.greater(pa.compute.binary_length(flat), 0))  # a text's edges can give empty words
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


#: Rows of a key of two numbers that may be sent to every executor, some 50 bytes each.
BROADCAST_ROWS = 400_000


def wrapped(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, th, row): the rows as structs, so that their own columns can have any names; th: a hash of the text."""
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of()).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def without(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs whose (id, hash of the text) isn't in `gone` (id, th); that list is sent around only if it is short."""
    gone = stored(gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return wrapped(docs, id_column).join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti").select("row.*")
