"""Continuous ingestion of JSON-lines change files with Structured Streaming.

The same transform functions as the batch path (``operators.ingest``) run on
every micro-batch inside ``foreachBatch``.  A micro-batch is one write: accepted
and rejected requests together to ``<out>/batch_id=<id>/state=...`` with mode
overwrite, so a batch that is replayed after a failure replaces its own output and nothing
else.  With a ledger folder, the accepted rows of the batch are then appended to the
stored table by key, which a replay may repeat.  Progress lives in the
checkpoint folder, which must be on shared storage.

The unique SKU (J6) holds over all batches by a second, stateful query over the claims
of the batches (``claim_skus``): its state store has one row a SKU, the first claim by
(batch, seq, source), and a micro-batch touches the rows of its own SKUs only.
Accepted output of earlier batches is not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import ingest
from ..schemas import ENVELOPE_READ
from ..sources.commits import stored
from ..sources.ledger import COMPRESSION, SCHEMAS, append_new_rows
from ..sources.payloads import read_payload_stream

TABLE_OF = {"sale": "sales", "expense": "expenses", "lot": "lots", "inventory": "inventory"}

TRANSFORMS = {
    "sale": lambda df, _existing: ingest.ingest_sales(df),
    "expense": lambda df, _existing: ingest.ingest_expenses(df),
    "lot": lambda df, _existing: ingest.ingest_lots(df),
    "inventory": lambda df, existing: ingest.ingest_inventory(df, existing),
}


STATES = ("accepted", "rejected")


def _table_type(spark: SparkSession, entity: str) -> StructType:
    """The columns of a micro-batch's output, from the transform over no requests."""
    empty = spark.createDataFrame([], ENVELOPE_READ)
    return TRANSFORMS[entity](empty, spark.createDataFrame([], "sku string")).checked.schema


def read_output(spark: SparkSession, out_dir: str, entity: str) -> DataFrame:
    """Every request of every batch: the accepted rows' columns, reason, batch_id, state."""
    schema = StructType([*_table_type(spark, entity).fields, StructField("batch_id", LongType()),
                         StructField("state", StringType())])
    if stored(lambda: spark.read.schema(schema).parquet(out_dir)) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out_dir)


CLAIM = StructType([StructField("sku", StringType()), StructField("seq", LongType()), StructField("source", StringType()),
                    StructField("batch_no", LongType()), StructField("attempt", StringType())])
SEED = -1  # the batch of the SKUs that are stored when the stream first runs


def claim_skus(claims: DataFrame, batch_id: int, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """The claims (sku, seq, source) of a batch that no earlier batch, and no ``existing`` row, made first.

    The claims are added to a folder that a streaming aggregation follows: per SKU the least (batch, seq,
    source), kept in its state store.  A later batch has a greater number, so a SKU's row never
    changes once it is set, and a replayed batch, whose claims come again as another attempt,
    finds what it found before.  A claim is granted if it is its SKU's row.
    """
    spark = claims.sparkSession
    if existing is not None and stored(lambda: spark.read.schema("sku string").parquet(f"{folder}/seeded")) is None:
        seed = existing.select("sku", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("source"))
        seed.write.parquet(f"{folder}/claims/batch_no={SEED}/attempt={uuid.uuid4().hex}")
        spark.createDataFrame([], "sku string").write.mode("overwrite").parquet(f"{folder}/seeded")
    claims.select("sku", "seq", "source").write.parquet(f"{folder}/claims/batch_no={batch_id}/attempt={uuid.uuid4().hex}")

    def granted(touched: DataFrame, _: int) -> None:
        # The last of several runs holds all of the batch's SKUs, as every attempt does.
        (touched.select("sku", "first.*").where(F.col("batch_no") == batch_id).select("sku", "seq", "source")
         .write.mode("overwrite").parquet(f"{folder}/granted/batch_no={batch_id}"))

    first = (spark.readStream.schema(CLAIM).option("cleanSource", "delete").parquet(f"{folder}/claims")
             .groupBy("sku").agg(F.min(F.struct("batch_no", "seq", "source")).alias("first")))
    (first.writeStream.outputMode("update").foreachBatch(granted).option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("sku string, seq long, source string").parquet(f"{folder}/granted/batch_no={batch_id}")


def write_batch(spark: SparkSession, entity: str, existing: DataFrame | None, out_dir: str,
                batch: DataFrame, batch_id: int, ledger_root: str | None = None) -> None:
    """One micro-batch: transform, overwrite this batch's own output, append to the ledger.

    ``existing`` is the inventory stored when the stream first runs; from then on the stream is the one
    that adds SKUs.
    """
    if entity == "inventory":
        lines = ingest.inventory_lines(batch)
        claims = ingest.first_claims(lines)
        granted = claim_skus(claims, batch_id, f"{out_dir.rstrip('/')}-skus", existing)
        checked = ingest.decided(lines, claims.join(granted.select("sku"), "sku", "left_semi")).checked
    else:
        checked = TRANSFORMS[entity](batch, None).checked
    path = f"{out_dir}/batch_id={batch_id}"
    state = F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    (checked.withColumn("state", state).write.mode("overwrite").option("compression", COMPRESSION)
     .partitionBy("state").parquet(path))
    if ledger_root is not None:
        rows = read_output(spark, out_dir, entity).where((F.col("batch_id") == batch_id) & (F.col("state") == "accepted"))
        table = TABLE_OF[entity]
        missing = [f for f in SCHEMAS[table].fields if f.name not in rows.columns]
        append_new_rows(rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}), ledger_root, table)


def start_ingest_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                        entity: str = "sale", existing: DataFrame | None = None,
                        max_files_per_trigger: int | None = None, available_now: bool = True,
                        ledger_root: str | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    For ``inventory`` the unique-SKU rule (J6) runs per micro-batch against
    ``existing`` plus the SKUs of earlier micro-batches (``claim_skus``, in
    ``<out_dir>-skus``).
    """
    if entity not in TRANSFORMS:
        raise ValueError(f"unknown entity {entity!r}")
    stream = read_payload_stream(spark, source_dir, max_files_per_trigger)
    w = (stream.writeStream
         .foreachBatch(lambda batch, batch_id: write_batch(spark, entity, existing, out_dir,
                                                           batch, batch_id, ledger_root))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_stream_output(spark: SparkSession, out_dir: str, part: str = "accepted", entity: str = "sale") -> DataFrame:
    """The accepted or rejected requests of every batch so far."""
    r = ingest.Ingested(read_output(spark, out_dir, entity).where(F.col("state") == part).drop("batch_id", "state"))
    return r.accepted if part == "accepted" else r.rejected
