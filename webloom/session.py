"""SparkSession construction with the settings every job here relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied when a session is built here; an existing cluster session keeps its own.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are large: bound the rows per Arrow batch handed to the Python parse.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Python tasks run side by side: one numpy thread each.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "webloom", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a ``local[...]`` master, where every task shares
    one disk, may fall back to a scratch folder; any other master must name a shared folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: master {master} needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="webloom-ckpt-", dir=os.environ.get("WEBLOOM_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def dealt_for_parsing(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` in ``partitions`` tasks, or as many as the session's ``webloom.parse.partitions`` states; as it is without either.
    Spark packs files into splits by bytes, which can starve a stage whose cost is Python time: state a number of
    tasks where an archive has few splits (or lower ``spark.sql.files.maxPartitionBytes``, which needs no shuffle)."""
    n = partitions or int(df.sparkSession.conf.get("webloom.parse.partitions", None) or 0)
    return df.repartition(n) if n else df


def dealt_by_rows(df: DataFrame, rows_a_task: int = 5000) -> DataFrame:
    """``df`` dealt out in tasks of about ``rows_a_task`` rows, for narrow rows that become pages: a table of a few MB can
    be one split whose pages take minutes to parse. Starts one count; select the columns that are needed first."""
    return df.repartition(max(1, -(-df.count() // rows_a_task)))


_SCRATCH: list = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    _SCRATCH.append((spark, path))
    return path


def _drop_scratch() -> None:
    for spark, path in _SCRATCH:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has gone: the cluster owns the folder
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back, so that several consumers share one
    run of what is above and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows that a session without a statement of its own hands to Python (Spark: 64 MB): an executor
#: holds a batch, and room to grow, for every task, in the JVM and once more in Python.
BATCH_BYTES = "4m"
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages by bytes, unless it states a bound by itself. Rows
    and results are the same; Spark reads the setting as a stage starts, so it stays set."""
    if not set(BATCH_SETTINGS) & set(spark.conf.getAll):
        spark.conf.set(BATCH_SETTINGS[0], BATCH_BYTES)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``webloom`` importable in Python workers (as ``spark-submit --py-files`` would):
    zip the package once per application and ``addPyFile`` it; Spark distributes it to executors."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="webloom-pyfiles-")
    zpath = os.path.join(out_dir, "webloom.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
