"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on.  AQE coalesces small partitions, splits skewed join
# partitions and turns joins into broadcast joins once it has seen real sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a JSON key that is given twice the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

ARROW_BYTES = 16 << 20  # of a batch that Spark hands to a worker


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("murmur")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", "/tmp/murmur-checkpoints")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small table before costly work on its texts.

    A file is read in units of row groups, so a small table may come as a single task. Tables of
    more than one read unit per core are left alone: they have splits enough, and moving them
    would cost more than it brings.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    unit = spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB").lower().rstrip("b")
    scale = {"k": 2**10, "m": 2**20, "g": 2**30}.get(unit[-1], 1)
    limit = cores * int(unit.rstrip("kmg")) * scale
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session does not tell the size
        return df
    return df.repartition(cores, key) if size <= limit else df


def small_arrow_batches(df: DataFrame) -> None:
    """Have Spark cut what it hands to Python workers by bytes; by rows alone texts could be any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _checkpoint_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and read it back from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, so a lost executor
    costs nothing.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_checkpoint_dir(spark))
    return df.checkpoint()
