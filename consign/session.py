"""Session construction and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Settings every job relies on: text dates compare in UTC, AQE re-plans joins
# and coalesces/splits skewed shuffle partitions at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster, on top of BASE_CONF.  Scan splits of 256 MiB
# keep a task's input well inside executor memory; AQE starts from many
# shuffle partitions (``shuffle_partitions_for``) and coalesces them towards
# the advisory size, and splits any partition five times the median and over
# 256 MiB (a hot key's share of a sort-merge join).  The broadcast threshold
# stays at Spark's size-checked default: AQE broadcasts a side only when its
# measured size is under it.  Checkpoint files (D6's bucketed ops) are
# removed once nothing references them.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shuffle_partitions_for(shuffle_bytes: int, target_bytes: int = 256 << 20,
                           floor: int = 200) -> int:
    """Shuffle partitions for the largest shuffle a job does (bytes after pruning).

    AQE only merges partitions, never adds them, so start from enough for the
    biggest stage.  The D6 bucket count defaults to the same number.
    """
    return max(floor, -(-shuffle_bytes // target_bytes))


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "consign", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Shuffle partitions before adaptive execution merges the small ones, and the most bytes in
# a partition of a join's smaller side for which a task holds them in a hash table.
START_PARTITIONS, HASHED_BYTES = 200, 64 << 20


def scaled_shuffles(spark: SparkSession) -> None:
    """Let the partitions of shuffles follow their measured size, whatever ``spark.sql.shuffle.partitions`` is.

    A fixed number makes partitions that grow with the tables, and past a task's memory every sort
    spills all its rows.  Adaptive execution only merges partitions, so shuffles start with many; merged, they
    have its advisory size.  They are as many as a map task writes straight to its files
    (``spark.shuffle.sort.bypassMergeThreshold``); with more it would sort its rows first, and spill them.  A join whose smaller side is small in every partition is then hashed, so that the
    larger side is not sorted.  Settings that a user made (more partitions, another threshold) stay.
    """
    if int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
           or spark.conf.get("spark.sql.shuffle.partitions")) < START_PARTITIONS:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(START_PARTITIONS))
    if spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") in ("0", "0b"):
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", f"{HASHED_BYTES}b")


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every write within as soon as the write ends.

    Otherwise they stay until the driver happens to collect its garbage, and a job of several writes holds all of
    them at once.  A write's shuffles are its own: no later job reads them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_PRIVATE_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``, else from the context's checkpoint
    folder.  Only when neither is set *and* the job runs in one process
    (``local[...]`` -- tests) a private folder is made and kept for the
    application.  On a cluster an unset folder is an error: a machine-local
    path would not be seen by other executors and would vanish with the
    driver's machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001  (no SparkContext on a Connect session)
            d = None
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not re.match(r"local($|\[)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        app = spark.conf.get("spark.app.id", "app")
        if app not in _PRIVATE_DIR:
            _PRIVATE_DIR[app] = "file://" + tempfile.mkdtemp(prefix="consign-ckpt-")
        d = _PRIVATE_DIR[app]
    return d.rstrip("/")


def checkpointed(df):
    """``df.checkpoint()`` into the shared folder, which is registered if none is yet."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder; Spark makes it when it writes there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def spread(df, min_partitions: int | None = None):
    """Round-robin a narrow input over the cluster before CPU-heavy row work.

    Meant for leaves (a table or folder scan), where reading the planned
    partition count is cheap.  A scan of one large Parquet row group (or one
    JSON file) is a single task;
    parsing and coercing its rows would then use one core.  Only an input with
    at most half the target partitions is spread: large inputs arrive
    already split (JSON lines and Parquet by ``maxPartitionBytes``), and a
    full shuffle of them for less than 2x parallelism is not worth it, so the
    shuffle is paid only on inputs small enough for it to be cheap.  The check
    reads the planned partition count; no data reaches the driver.
    Round-robin repartitioning sorts locally first, so it is deterministic
    under retry.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() * 2 <= target
    except Exception:  # noqa: BLE001  (no RDD API on a Connect session: leave as is)
        return df
    return df.repartition(target) if narrow else df


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def broadcast_threshold(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (negative: broadcasting is off)."""
    v = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b") or "").strip().lower()
    m = re.fullmatch(r"(-?\d+)\s*([a-z]*)", v)
    if not m or m.group(2) not in _UNITS:
        return -1
    return int(m.group(1)) * _UNITS[m.group(2)]


def fits_broadcast(df) -> bool:
    """Is ``df`` small enough to broadcast under the session's threshold?

    A check through the public API: one global aggregate adds up the size of
    the rows the way a broadcast holds them (8 bytes per field plus the bytes
    of each string).  It is partial per task, so one row per task is
    shuffled and one row reaches the driver.  (A ``limit`` first would funnel
    up to ``limit`` rows from every task into a single one.)
    """
    limit = broadcast_threshold(df.sparkSession)
    if limit <= 0:
        return False
    width = None
    for f in df.schema.fields:
        w = F.lit(8)
        if isinstance(f.dataType, (StringType, BinaryType)):
            w = w + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        width = w if width is None else width + w
    r = df.agg(F.sum(width if width is not None else F.lit(0)).alias("b")).first()
    return (r["b"] or 0) <= limit
