"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every operator relies on; all can be set on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # Zone-less stamps in files are UTC instants: read as such, their filters reach the scan.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # Newest-n reads keep n rows per key before the shuffle, up to the row cap.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build(app: str = "marketloom", master: str | None = None,
          shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. On a cluster leave `master` to spark-submit
    and `shuffle_partitions` to AQE's initial partition number."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. A package that
    came in an archive (`--py-files`) is there already."""
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_marketloom_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "marketloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._marketloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    """One scratch folder per local process, where no shared one is named."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/marketloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, the result
    survives lost executors, and later readers prune columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
