"""Reading inputs and cutting lineage.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors share, so that a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

#: Most rows and bytes of one Arrow batch, which a worker and its executor hold several copies of.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Spark's switch for deleting a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local one if the session is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/quire-checkpoints"


def _bounded(spark: SparkSession) -> None:
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if spark.conf.get(size).lower() != f"{BATCH_BYTES}b":
        spark.conf.set(size, f"{BATCH_BYTES}b")


def mapped(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches that are bounded in rows and bytes (a single longer text is one batch)."""
    _bounded(df.sparkSession)
    return df.mapInArrow(f, schema)


def arrow_column(spark: SparkSession, f: Callable, kind: str, *inputs: Column) -> Column:
    """A vectorised function of columns, over bounded batches; no other column of the row leaves the JVM.

    It is declared non-deterministic so that the optimizer never evaluates it twice, in a filter and in a projection.
    """
    _bounded(spark)
    return F.arrow_udf(f, kind).asNondeterministic()(*inputs)


def is_whole(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def id_key(docs: DataFrame, name: str = "doc_id") -> Column:
    """``name`` as a long: its value where it is a whole number, a hash of its text otherwise; null stays null."""
    column = F.col(name)
    if is_whole(docs.schema[name].dataType):
        return column.cast("long")
    return F.when(column.isNotNull(), F.xxhash64(column.cast("string")))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with no lineage behind it.

    The shuffle files of the write go with its end, not when the driver happens to collect its garbage. The table is
    dropped when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later step reads."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _remove(df.sparkSession, path)
