"""Session helpers shared by every operator: session defaults, shared scratch folder, table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def build_session(app: str = "cladeworks", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults the operators are written for (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="cladeworks-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return _local_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor.

    ``write`` returns the written table. ``drop`` removes a table no later plan reads; tables that a
    returned DataFrame still reads are removed when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cw-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cw_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_cw_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table scan with at least as many partitions as there are cores, for work that is heavy per byte.

    A table of one small file is one partition; its rows are dealt out once. Scans of many partitions stay
    as they are. Only for plain scans: the partitions of a plan with shuffles are not known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def reduce_partitions(spark: SparkSession) -> int:
    """Number of reduce partitions the cluster is set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cladeworks-zip-")  # on the driver only; Spark hands the file on
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
