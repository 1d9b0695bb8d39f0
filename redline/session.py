"""Session set-up and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "redline", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # call-site capture costs several driver round trips per column expression
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-redline-", dir="/tmp")) / "redline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one is invented only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-redline-", dir="/tmp")
    return _local_dir


_local_dir: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and continue from the files.

    Loops keep a flat plan, lost executors re-read files instead of recomputing, and the planner sees
    real sizes (a plain checkpoint keeps the estimates of the plan it replaces, which explode in loops).
    """
    path = f"{checkpoint_dir(df.sparkSession)}/redline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.redline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``cut_lineage`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "redline_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Re-split an input that arrives in fewer pieces than the cluster has cores; larger inputs pass untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
