"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: list[str] = []
_shipped: set[str] = set()
_scratch: list[str] = []


def local_session(cores: str = "8", app: str = "symlake") -> SparkSession:
    """Single-machine session for tests and benchmarks. On a cluster use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``. Only a local session may go without:
    it gets a temporary folder that is removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="symlake-scratch-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return _local_dirs[0]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application. Clusters that already get it through
    ``--py-files`` lose nothing."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="symlake-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "symlake_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("symlake", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


class Scratch:
    """Tables of one iterative job. A written table cuts lineage, survives lost executors and carries the size
    that lets the optimizer decide about broadcasting."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/symlake/{name}-{uuid.uuid4().hex[:12]}"
        _scratch.append(self.base)
        self._schemas: dict = {}

    def path(self, step: str) -> str:
        return f"{self.base}/{step}"

    def save(self, df: DataFrame, step: str) -> tuple[DataFrame, int]:
        """Write ``df`` and return it re-read, with its row count taken on the way."""
        saved, n, _ = self.save_noting(df, step, {})
        return saved, n

    def save_noting(self, df: DataFrame, step: str, notes: dict[str, Column]) -> tuple[DataFrame, int, dict]:
        """As ``save``, with the values of the aggregates ``notes``, also taken on the way."""
        seen = Observation()
        self._schemas[step] = df.schema
        df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in notes.items()]).write.mode("overwrite").parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step)), seen.get["n"], seen.get

    def read(self, *steps: str) -> DataFrame:
        """Several steps of one schema as a single scan."""
        return self.spark.read.schema(self._schemas[steps[0]]).parquet(*[self.path(s) for s in steps])


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application's iterative jobs wrote to the shared folder. Call it when their results have been
    written elsewhere: results read from there until then. Returns the number of folders deleted."""
    n = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
