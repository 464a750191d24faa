"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CUT = "cut-"  # begins the name of a folder that cut_lineage wrote

# Runtime settings the plans rely on; all are dynamic, so an existing session can take them.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join partitions even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("briefloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("BRIEFLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="briefloom-ck-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again.

    The plan starts anew at the files, and so do its size estimates: a checkpoint keeps the estimate of the plan it
    cut, and in a loop of joins that number doubles its digits every round. Columns are written under plain names, so
    any names will do.
    """
    spark = df.sparkSession
    plain = [f"c{i}" for i in range(len(df.columns))]
    place = f"{shared_folder(spark).rstrip('/')}/{CUT}{uuid.uuid4().hex}"
    written = df.toDF(*plain)
    written.write.parquet(place)
    return spark.read.schema(written.schema).parquet(place).toDF(*df.columns)


def cut_each(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``cut_lineage`` of a few tables at once, none of which reads another: their plans are made side by side."""
    for df in tables.values():
        shared_folder(df.sparkSession)
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        return dict(zip(tables, pool.map(cut_lineage, tables.values()), strict=True))


def discard(*cuts: DataFrame) -> None:
    """Remove the files of tables that ``cut_lineage`` returned and that no plan still to run reads."""
    for df in cuts:
        spark = df.sparkSession
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if place.rsplit("/", 1)[1].startswith(CUT):
                path = spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
