"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SETTLED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(
    app: str = "undertone", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with UTC, AQE and skew handling on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset, so that
    spark-submit and the cluster defaults decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Every timestamp rule here assumes UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and state, taken from the session.

    A machine-local folder is made only in local mode and only where the
    session names none; on a cluster that would not survive a lost executor.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="undertone-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For results several later steps read: they are computed once, survive the
    loss of executors, and come back columnar with their true size, so that the
    planner's join choices rest on measured bytes.
    """
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _SETTLED[written] = path
    return written


def discard(table: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once everything made of it is written itself."""
    path = _SETTLED.pop(table, None)
    if path is not None:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
