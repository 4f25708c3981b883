"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Session settings every codelake job relies on.  Shuffle partitions are a
# local default; on a cluster the caller's session keeps its own value and
# AQE coalesces small partitions at runtime.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of the flatten job carry whole files: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.ui.enabled": "false",
    # joins / aggregates keyed by (repo, path, x) reuse a (repo, path)
    # hash partitioning instead of re-shuffling: per-file data is bounded
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # checkpoint files of tables that went out of scope are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "codelake", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the codelake defaults.

    ``master`` is only applied when given (tests and bench use ``local[N]``);
    on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, so that their Python workers find it
    from any working directory (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codelake-pkg-")
    with zipfile.PyZipFile(os.path.join(folder, "codelake.zip"), "w") as z:
        for d, dirs, names in os.walk(root):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("codelake", os.path.relpath(full, root)))
    sc.addPyFile(os.path.join(folder, "codelake.zip"))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there).  Where it is unset, a local master gets a scratch folder of its
    own; on a cluster there is no safe default, so that raises.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _SCRATCH.get(sc.applicationId) or sc.getCheckpointDir()
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="codelake-ckpt-")
        _SCRATCH[sc.applicationId] = d
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


# scratch folder by application, for local sessions without a setting
_SCRATCH: dict[str, str] = {}


def stage_parquet(df, name: str = "table", partition_by: str | None = None):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: lineage is cut, a lost executor re-reads files, and later
    scans get column pruning and row-group filtering on what they select.
    Used for the syntax-node table, which every Python operator filters.
    With ``partition_by`` a reader of one of that column's values reads only
    its files."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _STAGED.append(path)
    # a table without rows has no folders to tell the schema from
    return (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)


_STAGED: list[str] = []


def drop_staged(spark) -> int:
    """Delete the Parquet tables this process staged (through the Hadoop
    FileSystem of each path, so shared cluster storage works too).  Call
    when the results are written; returns the number of tables removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _STAGED:
        p = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n
