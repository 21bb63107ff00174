"""R1 on hand-made request files: the inventory stream applies the unique-SKU rule
(J6) across micro-batches, equals the batch path, and a replayed batch is idempotent."""

import json
import os
import time

from consign.operators import ingest
from consign.session import scratch_path
from consign.streaming.ingest_stream import read_stream_output, start_ingest_stream, write_batch
from tests.test_ingest_changes import _inventory

ITEM = {"title": "t", "category": "c", "cost_usd": 1.5, "quantity": 2}
FILES = [[(1, "A"), (2, "B")], [(3, "A"), (4, "C"), (5, "OLD")], [(6, "C"), (7, "D")]]


def _write_files(root):
    os.makedirs(root)
    for i, reqs in enumerate(FILES):
        path = os.path.join(root, f"req-{i}.json")
        with open(path, "w") as fh:
            for seq, sku in reqs:
                fh.write(json.dumps({"source": "dev", "seq": seq, "entity": "inventory", "target_id": None,
                                     "arrived_at": "2024-02-01 00:00:00",
                                     "body": json.dumps(dict(ITEM, sku=sku))}) + "\n")
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))  # arrival order = file order


def test_inventory_stream_unique_sku_across_batches(spark):
    src, out = scratch_path(spark, "inv-req"), scratch_path(spark, "inv-out")
    _write_files(src)
    existing = _inventory(spark, [("i0", "OLD")])
    q = start_ingest_stream(spark, src, out, scratch_path(spark, "inv-ckpt"), "inventory",
                            existing=existing, max_files_per_trigger=1)
    q.awaitTermination()
    got = {(r.seq, r.sku) for r in read_stream_output(spark, out, "accepted", "inventory").collect()}
    rej = {(r.seq, r.reason) for r in read_stream_output(spark, out, "rejected", "inventory").collect()}
    assert got == {(1, "A"), (2, "B"), (4, "C"), (7, "D")}
    assert rej == {(3, "insert_failed"), (5, "insert_failed"), (6, "insert_failed")}
    batch = ingest.ingest_inventory(spark.read.schema(ingest_schema()).json(src), existing)
    assert {(r.seq, r.sku) for r in batch.accepted.collect()} == got


def test_replayed_batch_keeps_its_rows(spark):
    src, out = scratch_path(spark, "inv-req"), scratch_path(spark, "inv-out")
    _write_files(src)
    first = spark.read.schema(ingest_schema()).json(os.path.join(src, "req-0.json"))
    for _ in range(2):  # the second call is a replay of batch 0
        write_batch(spark, "inventory", None, out, first, 0)
    got = {(r.seq, r.sku) for r in read_stream_output(spark, out, "accepted", "inventory").collect()}
    assert got == {(1, "A"), (2, "B")}
    assert read_stream_output(spark, out, "rejected", "inventory").count() == 0


def ingest_schema():
    from consign.schemas import ENVELOPE
    return ENVELOPE


def test_stream_feeds_the_ledger_once(spark):
    """A replayed batch with one huge request: the quarantine has it, the ledger every other row once."""
    from consign.sources import ledger as L
    from tests.conftest import envelopes
    out, root = scratch_path(spark, "exp-out"), scratch_path(spark, "exp-ledger")
    good = {"date": "2024-01-01", "category": "c", "type": "mileage", "miles": 10, "rate_usd_per_mile": 0.5}
    huge = good | {"miles": 9e15, "rate_usd_per_mile": 1e12}
    first = envelopes(spark, [(1, "expense", None, good), (2, "expense", None, huge)])
    for batch, n in ((first, 0), (first, 0), (envelopes(spark, [(3, "expense", None, good)]), 1)):
        write_batch(spark, "expense", None, out, batch, n, root)
    assert [r.seq for r in read_stream_output(spark, out, "rejected", "expense").collect()] == [2]
    assert L.read_table(spark, root, "expenses").count() == 2
    assert L.read_table(spark, root, "expenses").select("id").distinct().count() == 2


def test_output_of_no_batch_is_empty(spark):
    for entity in ("sale", "expense", "lot", "inventory"):
        assert read_stream_output(spark, scratch_path(spark, "none"), "accepted", entity).count() == 0
