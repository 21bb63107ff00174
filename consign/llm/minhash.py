"""Document fingerprints by one-permutation MinHash (operator 9), DataFrame functions only.

Every five-word shingle is hashed once.  The top eight bits of the hash are its bin,
and each of the 256 bins keeps its smallest hash.  An empty bin borrows by optimal
densification: bin j asks the bins p(j, 1), p(j, 2), ... of a fixed random
sequence and takes the first that is not empty (after ``PROBES`` of them, the
non-empty bin that is first in a random order of j's own), so two texts with the
same non-empty bins borrow alike.  A bin's hash is mixed with the bin's number, so that
bins that borrowed from one bin do not all agree or differ together, and its four
low bits are stored: one hex digit a bin, 256 digits a document.  Unrelated bins agree in one case out of
sixteen; ``likeness`` corrects for that: (agreeing share - 1/16) / (1 - 1/16),
at least 0.

How the smallest hash of every bin is found without exploding the shingles: the
largest hash of each bin is added as a sentinel, the array is sorted, and the
first entry of each bin stays.  A bin whose first entry is its sentinel is empty.

Defined cases: a null text is the empty text; a text of one to four words is one
shingle; a text without words has the fingerprint of 256 zeros, which is like
itself (1) and no more than by chance like others; equal texts have equal
fingerprints; texts of any length are whole, one row at a time; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, PROBES, SHINGLE = 256, 4, 8, 5
_LOW = (1 << 56) - 1  # of a hash, what is below the bin


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_SENTINELS = "array(" + ", ".join(f"{_signed((b << 56) | _LOW)}L" for b in range(BINS)) + ")"
_WORDS = r"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
_SHINGLES = (f"CASE WHEN size(hs) = 0 THEN CAST(array() AS array<bigint>) WHEN size(hs) < {SHINGLE} THEN array(xxhash64(hs)) "
             f"ELSE transform(sequence(1, size(hs) - {SHINGLE - 1}), i -> xxhash64(slice(hs, i, {SHINGLE}))) END")
_FIRST = ("filter(ordered, (x, i) -> i = 0 OR "
          "shiftrightunsigned(x, 56) != shiftrightunsigned(ordered[i - 1], 56))")
_PROBED = ", ".join(f"known[CAST(pmod(xxhash64(j, {a}), {BINS}) AS int)]" for a in range(1, PROBES + 1))
_LAST = "known[array_min(transform(full, q -> struct(xxhash64(j, q) AS h, q AS q))).q]"
_PACK = ("transform(sequence(0, 15), q -> aggregate(slice(filled, q * 16 + 1, 16), 0L, "
         "(acc, x) -> shiftleft(acc, 4) | (x & 15L)))")


def packed(text: str) -> Column:
    """The fingerprint of a text column (its name) as 16 longs of 16 four-bit bins each."""
    known = f"transform({_FIRST}, x -> IF((x & {_LOW}L) = {_LOW}L, NULL, x))"
    full = f"filter(sequence(0, {BINS - 1}), j -> known[j] IS NOT NULL)"
    filled = f"transform(known, (x, j) -> xxhash64(coalesce(x, {_PROBED}, {_LAST}), j))"
    body = f"IF(size(full) = 0, array_repeat(0L, 16), {_let('filled', filled, _PACK)})"
    body = _let("known", known, _let("full", full, body))
    body = _let("ordered", f"sort_array(concat({_SHINGLES}, {_SENTINELS}))", body)
    return F.expr(_let("hs", f"transform({_WORDS.format(text=f'coalesce(`{text}`, {chr(39) * 2})')}, w -> xxhash64(w))",
                       body))


def as_text(fp: Column) -> Column:
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1, without the agreement by chance."""
    ones = F.lit(0x1111111111111111)

    def differing(z: Column) -> Column:
        z = z.bitwiseOR(F.shiftright(z, 1)).bitwiseOR(F.shiftright(z, 2)).bitwiseOR(F.shiftright(z, 3))
        return F.bit_count(z.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = F.lit(1.0) - differ / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (share - F.lit(chance)) / F.lit(1.0 - chance))


def _numbers(values: list, kind: str) -> str:
    """SQL for a constant array.  One text that Spark folds, not a literal for each number: their
    number grows with the cluster's partitions, and the plan is built in one call."""
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS array<{kind}>)" if values else f"CAST(array() AS array<{kind}>)"


def _bucket_of(edges: list[int], id_col: str) -> Column:
    """How many edges lie below the id, by binary search over a constant array."""
    if not edges:
        return F.lit(0)
    steps = len(edges).bit_length()
    padded = edges + [(1 << 63) - 1] * ((1 << steps) - 1 - len(edges))
    halves = _numbers([1 << (steps - 1 - s) for s in range(steps)], "int")
    return F.expr(f"coalesce(aggregate({halves}, 0, (at, half) -> "
                  f"IF(element_at({_numbers(padded, 'bigint')}, at + half) < {id_col}, at + half, at)), 0)")


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Each row of ``docs`` (id long, h long, ...) with ``columns`` of the next one, as ``next_<column>``.

    The order is by descending id, then by h; null ids come last, and after the last
    row comes the first.  Rows are dealt into ranges of ids that end at ids
    of the table (about four for each shuffle partition); the rows with the topmost
    id of a range are sent to the range above as well, where they follow its last
    row.  So one exchange is enough, and no range is larger than its share.
    """
    spark = docs.sparkSession
    n = 4 * (parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = _numbers([i / n for i in range(1, n)], "double")
    found = docs.agg(F.expr(f"percentile_approx(id, {shares}, {10 * n})").alias("q"), F.max("id").alias("m")).first()
    edges = sorted({*(found["q"] or []), found["m"]} - {None})
    own = _bucket_of(edges, "id")
    end = F.expr(f"element_at({_numbers(edges, 'bigint')}, _own + 1)") if edges else F.lit(None)
    above = F.pmod(F.col("_own") + 1, F.lit(max(1, len(edges))))
    top = F.col("id") == end if edges else F.lit(True)
    place = F.when(F.coalesce(top, F.lit(False)),
                   F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("copy")),
                           F.struct(above.cast("int").alias("b"), F.lit(True).alias("copy")))
                   ).otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("copy"))))
    rows = docs.withColumn("_own", own.cast("int")).select(*docs.columns, F.explode(place).alias("_place"))
    rows = rows.select(*docs.columns, F.col("_place.b").alias("_bucket"), F.col("_place.copy").alias("_copy"))
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("id").desc_nulls_last(), "h")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return rows.filter("NOT _copy").drop("_bucket", "_copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited text and the likeness of their fingerprints.

    The edited text ends in the beginning of the next document (``with_next``) in place of
    its last third.  Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text", packed("text").alias("fp"))
    rows = with_next(rows, ["text", "fp"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("*", packed("edited").alias("edited_fp"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited", as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
