"""Session, table access and lineage cutting, shared by every operator."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lantern", cores: str = "8", shuffle: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, unless their workers find it anyway.

    They do where the folder of the package is the working directory or on PYTHONPATH.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    known = {Path(p).resolve() for p in [".", *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    if root in known or sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="lantern-")) / "lantern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "lantern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in storage that outlives an executor.

    The folder is the one the session names in spark.checkpoint.dir, which every executor shares.
    Only a local session that names none gets a temporary one; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lantern-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of cut, for tables that are written once and read often."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut(spark.range(1))
    return sc._jsc.sc().getCheckpointDir().get()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_derived: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def files_state(spark: SparkSession, base: str, tables: tuple[str, ...]) -> str:
    """Names, lengths and times of the files that tables consist of."""
    seen = hashlib.sha256()
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.update(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}\n".encode())
    return seen.hexdigest()


def derived(spark: SparkSession, base: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries derive from tables of a data directory alike, built once while they stay as they are.

    It is written to the shared checkpoint folder; `release` or a changed file lets it go.
    """
    key, state = (spark.sparkContext.applicationId, base, name), files_state(spark, base, tables)
    if key not in _derived or _derived[key][0] != state:
        _derived[key] = state, cut(build())
    return _derived[key][1]


def release() -> None:
    """Forgets every derived table."""
    _derived.clear()


#: Operators of a plan whose rows come out of a shuffle, or of several sources.
_SHUFFLED = {"Aggregate", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "Distinct", "Union", "Deduplicate"}


def _operators(plan) -> set[str]:
    found, todo = set(), [plan]
    while todo:
        node = todo.pop()
        found.add(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Costly row-local work (parsers, tokenizers) over a table of few, small files would leave cores
    idle. A scan of many splits, the normal case at scale, passes through without a shuffle; what
    comes out of a shuffle is partitioned by key into a fixed number, which is not coalesced again.
    The key should be unique; without one the rows are dealt out in turn.
    Counting the partitions of such a plan would run it, so its operators are looked at instead.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if _operators(df._jdf.queryExecution().optimizedPlan()) & _SHUFFLED:
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)
