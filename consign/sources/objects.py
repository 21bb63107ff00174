"""Photo objects (S9, D10) and log text.

Photo rows come from object metadata: path, length and modification time.  Two sources
give it: a listing of a folder (``binaryFile``; its ``content`` column is dropped,
and the source then never reads file bytes), whose file index is held by the driver,
and a manifest table (an inventory report of the store), which is a plain scan and the
one to use for millions of objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..functions import text
from ..operators.ingest import created_at


MANIFEST = StructType([StructField("path", StringType()), StructField("length", LongType()),
                       StructField("modificationTime", TimestampType())])
BAD_KEY = "bad_key"


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """The objects below a folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .load(root).drop("content"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The objects that a stored manifest (Parquet) names."""
    return spark.read.schema(MANIFEST).parquet(path)


@dataclass
class Catalogued:
    photos: DataFrame   # rows in the Photos table's shape
    misfits: DataFrame  # (path, reason) of objects whose key is not an upload's


def photo_catalogue(objects: DataFrame) -> Catalogued:
    """S9 + D10: photo rows from stored objects, by the key that an upload gives them.

    ``inventory/<item>/<id>_<name>``: item, id and name are read from the path's last
    three segments, the content type from the name's extension (X14).
    """
    key = F.regexp_extract("path", "(?:^|/)(inventory/[^/]+/[^/_]+_[^/]+)$", 1)
    rows = objects.select("path", "length", "modificationTime", key.alias("key"))
    item, file = text.key_parts(F.col("key"))
    name = F.regexp_replace(file, "^[^_]*_", "")
    photos = rows.where(F.col("key") != "").select(
        F.regexp_extract(file, "^([^_]*)_", 1).alias("id"), item.alias("inventory_id"), F.col("key").alias("r2_key"),
        text.content_type_for(text.file_extension(name)).alias("content_type"),
        F.col("length").cast("bigint").alias("size_bytes"),
        created_at(F.date_format(F.col("modificationTime"), "yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    return Catalogued(photos, rows.where(F.col("key") == "").select("path", F.lit(BAD_KEY).alias("reason")))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log directory as lines (``value``).  The reference's
    ``tail -n 400`` cap is dropped: lines have no global order across files."""
    return spark.read.text(path)


def error_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """P10: the diagnostics error scan over every line."""
    return lines.where(text.is_error_line(F.col(col))).select(F.col(col).alias("line"))
