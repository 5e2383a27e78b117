"""Session settings this package relies on, and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# applications that have the package's code
_SHIPPED: set[str] = set()
# what each application came with, by setting
_GIVEN: dict[tuple[str, str], str] = {}

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
PARTITION = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
HASH_JOIN = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing is left to the caller.

    The package is also sent to the workers, once per context, for the few
    operators that run Python there.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    shuffle_joins(spark)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # code only, on the driver: Spark serves the file to the executors
        folder = tempfile.mkdtemp(prefix="skemata-code-")
        context.addPyFile(
            shutil.make_archive(os.path.join(folder, "skemata"), "zip", root, "skemata")
        )
        _SHIPPED.add(context.applicationId)
    return spark


def _given(spark: SparkSession, key: str) -> str:
    return _GIVEN.setdefault((spark.sparkContext.applicationId, key), spark.conf.get(key))


def _threshold(spark: SparkSession) -> str:
    return _given(spark, BROADCAST)


def shuffle_joins(spark: SparkSession) -> None:
    """No join broadcasts a side unless the code asks for it, and tasks stay small.

    Spark takes a relation exploded from documents to be about as large as the
    documents' key column, so by its guess it would gather millions of rows on the driver.
    Shuffled sizes are those after compression: the names of a catalog take far more in a task.
    """
    for key in (BROADCAST, PARTITION):
        _given(spark, key)
    spark.conf.set(BROADCAST, "-1")
    spark.conf.set(PARTITION, "8MB")
    # hash instead of sort-merge where every partition is small at run time
    spark.conf.set(HASH_JOIN, "16MB")
    # sides that are both dealt by database meet where they are, on whatever more keys
    spark.conf.set(ALL_KEYS, "false")


def broadcast_by_guess(spark: SparkSession) -> None:
    """The session's own threshold and partitions again, for joins of written tables."""
    for key in (BROADCAST, PARTITION):
        spark.conf.set(key, _given(spark, key))
    spark.conf.set(HASH_JOIN, "64MB")
    spark.conf.set(ALL_KEYS, "true")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder


def name_folder(spark: SparkSession, folder: str = "/tmp/checkpoints/skemata") -> SparkSession:
    """Names a shared folder where the session has none, as in tests on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs no old stage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder by columns, and read from there: compressed, and a
    fraction of a checkpoint.  Partitions and their order are not kept."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
