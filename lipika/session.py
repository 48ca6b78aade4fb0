"""Session settings and the folder that all executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Rows in an Arrow batch: texts are long, and a worker holds a batch's texts and what it makes of them.
BATCH_ROWS = 200


def session(app: str = "lipika", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return _qualified(spark, named.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lipika-"))
        spark.sparkContext.setCheckpointDir(_OWN[0])
    return _OWN[0]


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: without one it is a path of the default file system, for readers besides Spark too."""
    if "://" in path:
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file:///") else found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for a table or for files under the shared folder."""
    return posixpath.join(shared_dir(spark), f"lipika-{label}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, below_mb: int = 24) -> DataFrame:
    """A scan of a small table dealt over all cores: its few row groups would be as many tasks. Larger ones stay as they are."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files; nothing is read
    return df.repartition(spark.sparkContext.defaultParallelism) if size < below_mb << 20 else df


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from now on; smaller ones stay as they are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
