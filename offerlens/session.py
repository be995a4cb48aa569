"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


BROADCAST_BYTES = 1 << 20  # no table above this is broadcast; a cluster may ask for less
PARTITION_BYTES = 16 << 20  # what a task reads of a shuffle, where keys let it; a cluster may ask for less


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as 10MB, 256k or 10485760b."""
    digits = size.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits[:-1] if unit else digits) << unit


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job expects; the cluster's own choices stay untouched.

    UTC makes day and week arithmetic independent of the host.  The adaptive settings let Spark split a hot join
    partition even when that costs one more exchange, which is the right trade when a key holds a large share of rows.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # A table is broadcast through the driver by its size in files, and files of numbers and repeated texts hold rows that are ten
    # times larger in memory; a plan with many lookups broadcasts several at once.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "10")
    if _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) > BROADCAST_BYTES:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    # Rows of few values are many times larger in memory than in shuffle files, by whose size Spark merges partitions.
    if _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) > PARTITION_BYTES:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
    # Files may come in the host's older encodings, which Spark 4 reads only on request.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark


def local_session(app: str = "offerlens", cores: str = "8", partitions: int = 8, memory: str = "8g",
                  folder: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir; in local mode, where it is unset, an own
    temporary folder (one per application); None on a cluster that names no folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="offerlens-")
    return _LOCAL_FOLDERS[app]


_LOCAL_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}  # the intermediate tables of each application


def materialized(df: DataFrame) -> DataFrame:
    """Compute an intermediate table once for all its readers.

    The table is written to the shared folder and read back: lineage ends there, so a lost executor costs nothing
    upstream, and readers see its real size and only the columns they need.  On a cluster without such a folder it is
    persisted (spilling to disk) and lost blocks are recomputed from lineage.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    path = f"{folder}/offerlens-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt by key over all shuffle partitions of the session, before each of them becomes many rows: a small table comes
    in few tasks, and Spark would merge small partitions again, by a size that says nothing about what they become."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written so far, and say how many; to be called when the results built
    on them are written or no longer needed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
