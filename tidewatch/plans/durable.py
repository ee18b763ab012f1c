"""Written intermediate tables, which survive the loss of executors."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Of all files written here: texts take about half the disk of Spark's default.
CODEC = "zstd"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`. Only a local master may leave it unset."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tidewatch-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs in here go when it ends. Otherwise they stay until the driver happens to
    collect its garbage, so that those of all steps of a job lie on disk together."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut lineage with known size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[tuple[DataFrame, int]]:
    """`df` as a written table that is removed again, and the number of its rows."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    seen = Observation()
    with shuffles_removed(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, compression=CODEC)
    try:
        yield spark.read.schema(df.schema).parquet(path), seen.get.get("rows", 0)
    finally:
        removed(spark, path)


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """Reads that run in here never put two files into one task, so that each task keeps a file's order."""
    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get(most))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def removed(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path`, none where it does not exist."""
    system, at = file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    if not system.exists(at):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(at) if f.isDirectory())
