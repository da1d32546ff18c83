"""Session set-up and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; a running session is kept as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make sure that Python workers can import this package: once a session it is sent to them as an archive.

    It isn't where workers on this machine find it by themselves, through PYTHONPATH or the working folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    root = package.parent
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.master.startswith("local") and any(p and root == Path(p).resolve() for p in found):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    sc.addPyFile(path)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the cluster names one.

    Only an unset value on one machine, as in tests, is replaced by a folder of our own; on a cluster it is an error,
    as executors would write to disks that others can't read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move ``old`` to ``new`` unless ``new`` exists; tells whether it moved."""
    fs, p = _fs(spark, old)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    return not fs.exists(to) and fs.rename(p, to)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one; it goes when the session's process ends."""
    path = f"{scratch_root(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(_clean, spark, app)
    _WRITTEN[app].append(path)
    return path


def materialise(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The result has no lineage before the written files, so a lost executor costs no
    recomputation of the steps above and non-deterministic columns stay fixed. The files
    go when the session's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    w = df.write.mode("error")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean(spark: SparkSession, app: str) -> None:
    try:
        for path in _WRITTEN.pop(app, []):
            remove(spark, path)
    except Exception:  # the session may be gone already
        pass


def cores_hint(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def testdata_root() -> str:
    return os.environ.get("MARLSTONE_DATA", "/root/testdata")
