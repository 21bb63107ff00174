"""Text helpers: file names, object keys, money text, line endings, log scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the log error pattern of the diagnostics script (grep -Eni).
ERROR_LINE_PATTERN = "(?i)✗|error|failed|failure| 4[0-9]{2} | 5[0-9]{2} "

# Extension -> content type for stored photos; anything else is
# application/octet-stream, as an upload without a type is stored.
CONTENT_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "heic": "image/heic", "bmp": "image/bmp", "svg": "image/svg+xml",
    "html": "text/html", "htm": "text/html", "txt": "text/plain", "json": "application/json",
    "pdf": "application/pdf",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def file_extension(name: Column) -> Column:
    """``(name.split('.').pop() || '').toLowerCase()``."""
    return F.lower(F.coalesce(F.element_at(F.split(name, "\\.", -1), -1), F.lit("")))


def safe_file_name(name: Column) -> Column:
    """Characters outside ``[a-zA-Z0-9._-]`` -> '_'; empty -> 'upload'."""
    n = F.coalesce(F.nullif(name, F.lit("")), F.lit("upload"))
    return F.regexp_replace(n, "[^a-zA-Z0-9._-]", "_")


def photo_key(inventory_id: Column, photo_id: Column, name: Column) -> Column:
    """``inventory/{invId}/{id}_{safeName}``."""
    return F.concat(F.lit("inventory/"), inventory_id, F.lit("/"), photo_id, F.lit("_"),
                    safe_file_name(name))


def key_parts(key: Column) -> tuple[Column, Column]:
    """Split ``a/id/fname``; if either part is missing or empty, both NULL."""
    parts = F.split(key, "/", -1)
    item = F.try_element_at(parts, F.lit(2))
    fname = F.try_element_at(parts, F.lit(3))
    ok = key.isNotNull() & (key != "") & (F.coalesce(item, F.lit("")) != "") \
        & (F.coalesce(fname, F.lit("")) != "")
    return F.when(ok, item), F.when(ok, fname)


def content_type_for(ext: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(m, ext), F.lit(DEFAULT_CONTENT_TYPE))


def money_text(c: Column) -> Column:
    """``'$' + (n/100).toFixed(2)`` built from integers, so no float rounding.

    Negative amounts print as ``$-1.50``; no thousands separator.
    """
    a = F.abs(c)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit("$"), sign, F.floor(a.cast("decimal(38,0)") / F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((a % 100).cast("string"), 2, "0"))


def strip_cr_bom(text: Column) -> Column:
    """Drop a CR before each line end (``sed 's/\\r$//'``), then a leading BOM."""
    no_cr = F.regexp_replace(text, "\r(?=\n|\\z)", "")
    return F.regexp_replace(no_cr, "^\uFEFF", "")


def is_error_line(line: Column) -> Column:
    """P10: the diagnostics scan predicate, case-insensitive."""
    return line.rlike(ERROR_LINE_PATTERN)
