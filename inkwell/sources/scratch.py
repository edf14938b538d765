"""Where rows are: tables that end a lineage, written to the folder that all executors share, and small inputs dealt to all cores."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the scratch() blocks that are open, the innermost last, and the tables that each has registered.
_open: list[str] = []
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. On a single machine where the session
    names none (tests), a temporary one is set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is saved() within goes when the block ends. A DataFrame made within must be written there."""
    _open.append(f"{shared_dir(spark)}/inkwell/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = _open.pop()
        for table in _tables.pop(folder, []):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, folder)


def tidied(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives. If it saves tables on the way, its rows are written and those tables go; else it is left as it is."""
    try:
        outer = _open[-1] if _open else f"{shared_dir(spark)}/inkwell"
    except ValueError:  # no shared folder: only what saves nothing can be made
        return make()
    with scratch(spark):
        df = make()
        path = spark._jvm.org.apache.hadoop.fs.Path(_open[-1])
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return df
        kept = f"{outer}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(kept)
    return spark.read.schema(df.schema).parquet(kept)


def saved_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As saved(), with the folder, for tables that are removed once the next one is written."""
    spark = df.sparkSession
    folder = _open[-1] if _open else f"{shared_dir(spark)}/inkwell"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage
    ends there, and a lost executor takes nothing with it."""
    return saved_at(df, name, codec)[0]


def saved_by(df: DataFrame, name: str, key: str, parts: int = 0, codec: str = "zstd") -> DataFrame:
    """As saved(), in buckets of a key: what is then joined or grouped by it, whatever else it is grouped by, is not exchanged again."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{_open[-1] if _open else f'{shared_dir(spark)}/inkwell'}/{table}"
    if _open:
        _tables.setdefault(_open[-1], []).append(table)
    df.repartition(parts, key).write.bucketBy(parts, key).option("compression", codec).option("path", path).saveAsTable(table)
    return spark.table(table)


def saved_under(df: DataFrame, name: str, column: str) -> DataFrame:
    """As saved(), with a folder for each value of a column, so that a filter on it reads those folders only."""
    spark = df.sparkSession
    path = f"{_open[-1] if _open else f'{shared_dir(spark)}/inkwell'}/{name}-{uuid.uuid4().hex}"
    # Salted, so that a value that most rows have is written by several tasks.
    df.repartition(column, (F.rand(1) * 4).cast("int")).write.partitionBy(column).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes in fewer partitions than there are: a small file of one row group, say. An input
    of many partitions is left as it is, so a large one is not exchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
