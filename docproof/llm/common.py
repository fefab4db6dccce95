"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an operator takes from a batch at a time; a longer text is taken alone.
BATCH_BYTES = 16 << 20
#: Only for local sessions that name no shared folder (tests): one folder each, gone when Python ends.
_OWN_FOLDERS: dict[str, str] = {}
#: Tables that this process has stored and not released, by path: the catalog's name, or None, and the scope.
_TABLES: dict[str, tuple[str | None, str | None]] = {}
#: Scopes that are open in this thread, the innermost last.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds in bytes, cut so that the strings of ``column`` hold ``most`` bytes or stand alone."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        at, held = 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if k > at and held + (n or 0) > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n or 0
        yield batch.slice(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else that of setCheckpointDir; a local session without one gets a temporary folder, a cluster the warehouse if executors share it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        return f"{warehouse}/tables"
    app = context.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return _OWN_FOLDERS[app]


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables stored within belong to ``name``, for ``release``."""
    before = _SCOPES.set((*_SCOPES.get(), name))
    try:
        yield
    finally:
        _SCOPES.reset(before)


def _remember(path: str, table: str | None) -> None:
    _TABLES[path] = table, _SCOPES.get()[-1] if _SCOPES.get() else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remember(path, None)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stored``, in buckets by ``key``: a join on it alone moves the other side only.

    There are as many buckets as shuffle partitions, so rows that a shuffle has dealt by ``key`` are written where they are.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    _remember(path, table)
    return spark.table(table)


def release(spark: SparkSession, name: str, read_by: DataFrame) -> None:
    """Delete the tables of a scope, but for those that ``read_by`` reads. Results that read the others must be written before."""
    files = read_by.inputFiles()
    for path, (table, owner) in list(_TABLES.items()):
        if owner != name or any(path.rsplit("/", 1)[1] in f for f in files):
            continue
        if table:
            spark.sql(f"drop table if exists {table}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        del _TABLES[path]


def path_of(name: str) -> str:
    """Where the machine keeps the public tokenizer file ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)
