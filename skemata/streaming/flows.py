"""Streams of schema documents, keyed changes and log lines.

Every flow reads what is there and stops (``availableNow``) unless another
trigger is given.  Outputs written by ``foreachBatch`` go to a folder named
after the batch, so a batch that runs again replaces its own output only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from skemata.functions.rules import classify
from skemata.operators.canonical import canonicalise
from skemata.operators.embed import latest_by_key
from skemata.operators.labels import pattern_hits
from skemata.operators.snapshots import deterministic_id
from skemata.scale import number_rows, skew_join
from skemata.schemas import RAW_DOCUMENT

AVAILABLE_NOW = {"availableNow": True}


def document_stream(
    spark: SparkSession, folder: str, multi_line: bool = False, **options: str
) -> DataFrame:
    """Raw documents arriving as JSON files."""
    docs = (
        spark.readStream.schema(RAW_DOCUMENT)
        .option("multiLine", multi_line)
        .options(**options)
        .json(folder)
    )
    key = deterministic_id(
        F.col("_metadata.file_path"), F.to_json(F.struct("database_type", "schema", "tables", "views"))
    )
    return docs.select(key.alias("database_id"), *docs.columns)


def ingest_columns(documents: DataFrame) -> DataFrame:
    """Column rows of arriving documents, with keys and flags (stateless)."""
    return canonicalise(documents).columns


def label_columns(documents: DataFrame) -> DataFrame:
    """Rule labels of arriving columns (stateless)."""
    columns = ingest_columns(documents)
    return columns.withColumn("__c", classify(F.col("column_name"))).select(
        "database_id", "table_name", "column_name", "column_ordinal", "__c.*"
    )


def label_patterns(documents: DataFrame) -> DataFrame:
    """Pattern evidence of arriving columns, one row per hit (stateless)."""
    return pattern_hits(ingest_columns(documents))


def append(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def each_batch(
    stream: DataFrame,
    action: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(action)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def _batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def _written_before(spark: SparkSession, out: str, batch_id: int, schema: StructType) -> DataFrame:
    """Rows of the batches before one, with their ``batch_id``."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if batch_id == 0 or not files.exists(folder):
        return spark.createDataFrame([], full)
    read = spark.read.schema(full).option("basePath", out)
    return read.parquet(out).filter(F.col("batch_id") < batch_id)


# ----------------------------------------------------------------------- upsert


def _last_fold(batch_id: int, every: int) -> int:
    """The newest batch up to one that holds the state of all before it; 0 is the first."""
    return max(0, (batch_id + 1) // every * every - 1)


def upsert_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    checkpoint: str,
    fold_every: int = 8,
) -> StreamingQuery:
    """Keyed upsert as one small delta per batch: only the last row of each key.

    Every ``fold_every``-th batch writes the whole state instead, made of the last such
    state and the deltas since, so that a reader never folds more deltas than that.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = latest_by_key(batch, keys, order)
        if (batch_id + 1) % fold_every == 0:
            earlier = _written_before(batch.sparkSession, out, batch_id, schema).filter(
                F.col("batch_id") >= _last_fold(batch_id - 1, fold_every)
            )
            rows = earlier.unionByName(delta.withColumn("batch_id", F.lit(batch_id)))
            delta = latest_by_key(rows, keys, ["batch_id", *order]).drop("batch_id")
        delta.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return each_batch(stream, write, checkpoint)


def upserted(
    spark: SparkSession, out: str, keys: Sequence[str], order: Sequence[str], fold_every: int = 8
) -> DataFrame:
    """State after all batches: the later batch wins, then the order columns."""
    deltas = spark.read.option("basePath", out).parquet(out)
    newest = deltas.agg(F.max("batch_id")).first()[0]
    since = deltas.filter(F.col("batch_id") >= _last_fold(newest or 0, fold_every))
    return latest_by_key(since, keys, ["batch_id", *order]).drop("batch_id")


# ------------------------------------------------------------ unchanged snapshots


def changed_only(
    batch: DataFrame, last: DataFrame, keys: Sequence[str], order: str, content: str
) -> DataFrame:
    """Rows whose content differs from the row before them with the same key.

    ``last`` holds the newest earlier row of each key.  Rows are numbered
    without gathering a key in one task, and each row meets its predecessor in
    an equi-join.  A return to an older content counts as a change.
    """
    rows = batch.select(*keys, order, content)
    numbered = number_rows(rows, keys, [order], "__n")
    before = numbered.select(
        *keys, (F.col("__n") + 1).alias("__n"), F.col(content).alias("__was")
    )
    first = last.select(
        *keys, F.lit(0).cast("bigint").alias("__n"), F.col(content).alias("__was")
    )
    both = skew_join(numbered, before.unionByName(first), [*keys, "__n"], "left", [order])
    return both.filter(~F.col(content).eqNullSafe(F.col("__was"))).select(*keys, order, content)


def changed_stream(
    stream: DataFrame, keys: Sequence[str], order: str, content: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Writes only snapshots that differ from the last one of their key.

    The last content of each key is kept beside the output, one state per batch, so a
    batch reads that state and not what was written before.
    """
    schema = stream.select(*keys, order, content).schema
    state = f"{out.rstrip('/')}-last"

    def write(batch: DataFrame, batch_id: int) -> None:
        last = (
            _written_before(batch.sparkSession, state, batch_id, schema)
            .filter(F.col("batch_id") == batch_id - 1)
            .drop("batch_id")
        )
        rows = batch.select(*keys, order, content)
        latest_by_key(last.unionByName(rows), keys, [order]).write.mode("overwrite").parquet(
            _batch_folder(state, batch_id)
        )
        changed_only(rows, last, keys, order, content).write.mode("overwrite").parquet(
            _batch_folder(out, batch_id)
        )

    return each_batch(stream, write, checkpoint)


# --------------------------------------------------------------------- log tail


def log_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving log lines, one folder per batch; no line is dropped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return each_batch(stream, write, checkpoint)


def log_buffer(spark: SparkSession, out: str) -> DataFrame:
    """All lines so far."""
    return spark.read.option("basePath", out).parquet(out).drop("batch_id")
