import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from consign.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="consign-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


def envelopes(spark, rows, source="test"):
    """rows: (seq, entity, target_id, body) -> envelope DataFrame (test helper)."""
    data = [(source, seq, ent, tgt, "2024-02-01 00:00:00",
             body if isinstance(body, str) or body is None else json.dumps(body))
            for seq, ent, tgt, body in rows]
    return spark.createDataFrame(data, "source string, seq long, entity string, target_id string, "
                                       "arrived_at string, body string")
