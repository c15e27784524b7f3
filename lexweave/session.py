"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
WHOLE_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lexweave", cores: int | str = "*", memory: str = "8g",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # tables partitioned by document join on (document, position) without another shuffle
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only under a local master; a cluster without
    the setting is an error, because a lost executor would take such files with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = context.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="lexweave-")
    return _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixed partitions, no lineage, survives executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str, default: str):
    """A session setting for the plans made within a block."""
    former = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, former)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet to the shared scratch folder and read back (for several readers).

    The table stands for the shuffles it came from, so their files are removed once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, SHUFFLE_CLEANUP, "true", "false"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Remove the files of a table that ``materialised`` wrote and nothing reads again."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
