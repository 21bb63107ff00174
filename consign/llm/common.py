"""Shared helpers: tables, scratch tables, runs of a sorted partition, connected components."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable by Python workers that do not find it on their path.

    Workers see the driver's PYTHONPATH and, on one machine, its working folder.
    Otherwise the package goes as a zip file through the shared folder, once an application.
    """
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local["):
        paths.append(os.getcwd())
    if app in _SHIPPED or any(os.path.realpath(p) == str(root) or (Path(p) / "consign" / "llm").is_dir() for p in paths):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted((root / "consign").rglob("*.py")):
            z.write(f, f.relative_to(root))
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package") + "/consign.zip")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: later jobs start from
    files that outlive any executor.  Returns the table and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def group_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal keys in a partition sorted by them, each as a dict of arrays.

    Holds one batch and one run at a time.
    """
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if rest is not None and len(rest):
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        at = np.flatnonzero(change)
        for a, b in zip(at[:-1], at[1:]):
            yield {c: v[a:b] for c, v in cols.items()}
        rest = pdf.iloc[at[-1]:]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node that each can reach."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        low = low[low]
        if np.array_equal(before, low):
            break
    while not np.array_equal(low, low[low]):
        low = low[low]
    return low


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges as (node, smallest node of its part in the batch)."""
    for pdf in batches:
        ids, flat = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        low = forest(len(ids), flat[:len(pdf)], flat[len(pdf):])
        keep = low != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[keep], "b": ids[low[keep]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is
    the smallest node reachable.

    Alternating stars: every node ties its larger neighbours to its smallest
    one, then its smaller neighbours, until nothing changes.  The smallest neighbours are a
    grouped minimum (one row per node and task is shuffled) and a table of their own, so that the join
    with the edges has an exchange on either side, which adaptive execution splits: a hub's
    edges need not lie in one task.  Tables are in the shared folder, each deleted when the next stands.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b")
    down = F.col("a") > F.col("b")
    pairs = (edges.mapInPandas(_local_forest, "a long, b long")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pairs, path = scratch_table(pairs, "links")
    seen = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low, low_path = scratch_table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "links-low")
        large, large_path = scratch_table(both.join(low, "a").filter(~down).select(F.col("b").alias("a"), F.col("m").alias("b"))
                                          .filter(down).distinct(), "links-large")
        least, least_path = scratch_table(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        small = large.join(least, "a")
        small = (small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        nxt, nxt_path = scratch_table(small, "links")
        mark = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())
        drop_scratch(spark, path, low_path, large_path, least_path)
        pairs, path = nxt, nxt_path
        if mark == seen:
            break
        seen = mark
    star = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select("component", "component").distinct())
