"""What a ledger folder holds, by its commits.

Data files are written first, to folders of their own; one small table then says that they
count.  A commit is the folder ``commits/n=<number>``: its rows are added, replaced and
removed batches of files, and a reader sees all of them or none.  A job that
dies leaves files that no commit names, and so changes nothing.

Commits are numbered without gaps.  A writer adds the number after the last it has seen;
if another has taken it, ``Conflict`` is raised and the writer looks again.  (Folders are not
created atomically everywhere, so two writers may both come through: of one number's
commits the one with the least id counts, and the other writer finds that out by
reading its commit back.)
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROW = StructType([StructField(c, StringType()) for c in ("id", "action", "snapshot", "tbl", "item")])
COMMITS = StructType([*ROW.fields, StructField("n", LongType())])

# A snapshot begins with SNAPSHOT rows, a batch of each table; APPEND adds a batch; REPLACE makes a
# batch the only one of its table (or none, without an item); REMOVE takes one file out.
SNAPSHOT, APPEND, REPLACE, REMOVE = "snapshot", "append", "replace", "remove"


class Conflict(RuntimeError):
    """Another writer committed in between."""


@dataclass
class State:
    """The ledger after its ``n``-th commit."""

    n: int = 0
    snapshot: str | None = None
    batches: dict[str, list[str]] = field(default_factory=dict)
    removed: dict[str, list[str]] = field(default_factory=dict)

    def of(self, table: str) -> tuple:
        return self.snapshot, self.batches.get(table, []), self.removed.get(table, [])


def stored(read) -> DataFrame | None:
    """What ``read()`` opens, or None if nothing is stored there yet; any other error is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def state(spark: SparkSession, root: str) -> State:
    """The ledger as its commits have it now.

    The rows since the current snapshot reach the driver: one for each batch and removed file, not for
    each ledger row (a compaction or a new snapshot starts afresh).
    """
    rows = stored(lambda: spark.read.schema(COMMITS).parquet(f"{root}/commits"))
    st = State()
    if rows is None:
        return st
    rows = rows.join(rows.groupBy("n").agg(F.min("id").alias("id")), ["n", "id"], "left_semi")
    begin = rows.where(F.col("action") == SNAPSHOT).agg(F.max("n")).first()[0] or 0
    for r in rows.where(F.col("n") >= begin).orderBy("n", "action", "tbl", "item").collect():
        st.n = max(st.n, r.n)
        if r.snapshot != st.snapshot:
            st.snapshot, st.batches, st.removed = r.snapshot, {}, {}
        if r.action == REMOVE:
            st.removed.setdefault(r.tbl, []).append(r.item)
        elif r.action == REPLACE:
            st.batches[r.tbl], st.removed[r.tbl] = [r.item] if r.item else [], []
        elif r.item:
            st.batches.setdefault(r.tbl, []).append(r.item)
    return st


def commit(spark: SparkSession, root: str, seen: State, rows: list[tuple]) -> None:
    """Add (action, snapshot, table, item) rows as the commit after ``seen``."""
    own, path = uuid.uuid4().hex, f"{root}/commits/n={seen.n + 1}"
    try:
        spark.createDataFrame([(own, *r) for r in rows], ROW).coalesce(1).write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(path) from e
    if spark.read.schema(ROW).parquet(path).agg(F.min("id")).first()[0] != own:
        raise Conflict(path)
