"""Session construction with the settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quern", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC timestamps and adaptive execution.

    ``cores`` makes a local session of so many threads. Without it, master,
    memory and the number of shuffle partitions are what spark-submit or the
    cluster's defaults say; set the last to suit the input, for adaptive
    execution only lowers it.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",  # the code pages of old exports
        "spark.ui.showConsoleProgress": "false",
    }
    if cores:
        builder = builder.master(f"local[{cores}]")
        settings |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The path of a new folder that all executors see: below spark.checkpoint.dir, or on this machine for a local session. It goes when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='quern-')}/quern/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a scratch folder: what was computed by chance or place stays so, also when executors are lost."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
