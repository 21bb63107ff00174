"""JavaScript-compatible value coercion as native Spark expressions.

Request bodies are parsed into VARIANT (``try_parse_json``).  ``expand`` reads
each body field once per row into typed columns (kind, double, string, trimmed
string, boolean); the JS rules (``Number(v)``, ``String(v || d)``, falsiness,
``??``) are then SQL text over those columns, handed to the JVM in one
``F.expr`` call each -- building them node by node from Python would cost one
py4j round trip per node.  Missing keys and JSON ``null`` stay apart, as the
reference's ``b.x ?? d`` / ``b.x || d`` / ``Number(b.x)`` rules need.

No Python UDF: everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points JavaScript's String.prototype.trim removes
# (WhiteSpace and LineTerminator of ECMA-262).
JS_WS_CODEPOINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
                    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
                    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
JS_WS_CHARS = "".join(map(chr, JS_WS_CODEPOINTS))
# The same set as a SQL string literal (``\uXXXX`` escapes), for SQL text.
_JS_WS_SQL = "'" + "".join("\\u%04X" % c for c in JS_WS_CODEPOINTS) + "'"
# Fixed value: a finite decimal StringNumericLiteral after trimming (no backslashes,
# so it can sit in SQL text).
JS_DECIMAL = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Largest integer a double still holds exactly (2^53 - 1).
MAX_SAFE = 9007199254740991.0
_MAX = "9007199254740991D"
_INF = "CAST('Infinity' AS DOUBLE)"

# JSON kinds of a body field, computed once per field and row.
MISSING, JNULL, NUMBER, STRING, BOOLEAN, OTHER = range(6)


def with_body(df: DataFrame, body: str = "body", v: str = "v") -> DataFrame:
    """``df`` with the raw text column ``body`` as VARIANT ``v``; malformed JSON -> NULL (acts like ``{}``).

    As a JavaScript server reads a request: one leading byte-order mark is
    skipped, the last of several equal keys wins, and anything after the value
    makes the text malformed.  Spark's parser stops at the end of the first
    value, so the text is parsed once, as the first element of an array whose second
    is the text's own 64-bit hash.  Whatever in the text ends the array or the element
    early (``]``, ``],[1``, a second value) leaves another second element or none, since a
    text cannot spell its own hash.  (Equal keys need the first session setting below, which
    only changes what was an error.  The second: the JVM never compiles a method of more than
    8000 bytes, and a stage that reads a dozen fields is one such method, interpreted row by row;
    past that length Spark runs the stage's operators one by one, each in short methods.)
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    bom = "\ufeff"
    df = df.withColumn("_text", F.expr(f"CASE WHEN startswith(`{body}`, '{bom}') THEN substring(`{body}`, 2) ELSE `{body}` END"))
    df = df.withColumn("_all", F.expr("try_parse_json(concat('[', _text, ',', CAST(xxhash64(_text) AS STRING), ']'))"))
    return df.withColumn(v, F.expr("CASE WHEN try_variant_get(_all, '$[1]', 'bigint') = xxhash64(_text) "
                                   "THEN try_variant_get(_all, '$[0]', 'variant') END")).drop("_all", "_text")


def field(v: Column, name: str) -> Column:
    """``b[name]`` as VARIANT; SQL NULL when missing or the body is not an object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def js_trim(s: Column) -> Column:
    """``String.prototype.trim``: Spark's ``trim`` with the JS whitespace set
    (plain ``trim`` strips only spaces).  A character-set trim, no regex."""
    return F.trim(s, F.lit(JS_WS_CHARS))


class VField:
    """One body field seen through JavaScript eyes, as column names: ``k`` its JSON
    kind, ``d`` its double (numbers only), ``s`` its string (strings, ``true`` and ``false``), ``b`` its
    boolean, ``t`` the JS-trimmed string (strings only)."""

    def __init__(self, prefix: str):
        q = lambda suf: f"`{prefix}{suf}`"
        self.k, self.d, self.s, self.b, self.t = q("_k"), q("_d"), q("_s"), q("_b"), q("_t")


def expand(df: DataFrame, v: str, names, prefix: str = "_f_") -> tuple[DataFrame, dict]:
    """Add per-field columns for ``names`` of the VARIANT column ``v``;
    return (df, {name: VField}).

    Two projections, each one ``selectExpr`` call: each field's kind by its type name
    (``schema_of_variant``: VOID for JSON null, STRING, BOOLEAN, OBJECT/ARRAY, else a number
    type; no serialisation, unlike ``to_json``) and its one reading, a double or a
    string; then boolean and trimmed-string readings (a character-set ``trim``, no regex).
    The field's VARIANT is a common subexpression of the first projection: it is read from the
    body once, and never copied into a row.
    Decimals, whole numbers and doubles become the double that their text reads as in JS.
    """
    q = lambda n, suf: f"`{prefix}{n}{suf}`"
    x = lambda n: f"try_variant_get(`{v}`, '$.{n}', 'variant')"
    c = lambda n: f"schema_of_variant({x(n)})"
    # The first condition is the one that is always evaluated; what it holds is worked out once.
    kind = lambda n: (
        f"CASE WHEN {c(n)} IS NULL THEN {MISSING} WHEN {c(n)} = 'VOID' THEN {JNULL} "
        f"WHEN {c(n)} = 'STRING' THEN {STRING} WHEN {c(n)} = 'BOOLEAN' THEN {BOOLEAN} "
        f"WHEN startswith({c(n)}, 'OBJECT') OR startswith({c(n)}, 'ARRAY') THEN {OTHER} ELSE {NUMBER} END")
    df = df.selectExpr("*", *[e for n in names for e in (
        f"{kind(n)} AS {q(n, '_k')}",
        f"CASE WHEN {kind(n)} = {NUMBER} THEN try_variant_get({x(n)}, '$', 'double') END AS {q(n, '_d')}",
        f"CASE WHEN {kind(n)} IN ({STRING}, {BOOLEAN}) THEN try_variant_get({x(n)}, '$', 'string') END AS {q(n, '_s')}")])
    df = df.selectExpr("*", *[e for n in names for e in (
        f"CASE WHEN {q(n, '_k')} = {BOOLEAN} THEN {q(n, '_s')} = 'true' END AS {q(n, '_b')}",
        f"CASE WHEN {q(n, '_k')} = {STRING} THEN trim(BOTH {_JS_WS_SQL} FROM {q(n, '_s')}) END "
        f"AS {q(n, '_t')}")])
    return df, {n: VField(f"{prefix}{n}") for n in names}


def sql_lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(x)!r}D"


# ------------------------------------------------------------ rule SQL text

def _num_sql(f: VField, default: str) -> str:
    parsed = f"try_cast({f.t} AS DOUBLE)"
    return (f"(CASE {f.k} WHEN {MISSING} THEN {default} WHEN {JNULL} THEN 0D "
            f"WHEN {NUMBER} THEN (CASE WHEN isnan({f.d}) OR abs({f.d}) = {_INF} THEN {default} "
            f"ELSE {f.d} END) "
            f"WHEN {BOOLEAN} THEN (CASE WHEN {f.b} THEN 1D ELSE 0D END) "
            f"WHEN {STRING} THEN (CASE WHEN {f.t} = '' THEN 0D "
            f"WHEN {f.t} RLIKE '{JS_DECIMAL}' AND abs({parsed}) < {_INF} THEN {parsed} "
            f"ELSE {default} END) "
            f"ELSE {default} END)")


def _falsy_sql(f: VField) -> str:
    return (f"({f.k} IN ({MISSING}, {JNULL}) OR ({f.k} = {STRING} AND {f.s} = '') "
            f"OR ({f.k} = {BOOLEAN} AND NOT {f.b}) OR ({f.k} = {NUMBER} AND {f.d} = 0D))")


def _number_text_sql(f: VField) -> str:
    d = f.d
    # Spark prints 1.0E-7 and 1.5E21 where JS prints 1e-7 and 1.5e+21.  One cast to text, one pattern a case.
    return (f"(CASE WHEN abs({d}) <= {_MAX} AND {d} = CAST(CAST({d} AS BIGINT) AS DOUBLE) "
            f"THEN CAST(CAST({d} AS BIGINT) AS STRING) "
            f"WHEN abs({d}) >= 1e21 OR abs({d}) < 1e-6 "
            f"THEN regexp_replace(lower(replace(CAST({d} AS STRING), '.0E', 'E')), 'e([0-9])', 'e+$1') "
            f"WHEN abs({d}) > {_MAX} THEN CAST(CAST({d} AS DECIMAL(38,0)) AS STRING) "
            f"ELSE regexp_replace(CAST(CAST({d} AS DECIMAL(38,22)) AS STRING), '[.]?0+$', '') END)")


def _text_sql(f: VField, default, trim: bool) -> str:
    s = f.t if trim else f.s
    raw = (f"(CASE {f.k} WHEN {STRING} THEN {s} WHEN {BOOLEAN} THEN 'true' "
           f"WHEN {NUMBER} THEN {_number_text_sql(f)} ELSE '' END)")
    return f"(CASE WHEN {_falsy_sql(f)} THEN {sql_lit(default)} ELSE {raw} END)"


def _round_sql(y: str) -> str:
    return (f"(CASE WHEN abs({y}) <= {_MAX} THEN CAST(floor({y}) AS BIGINT) + "
            f"(CASE WHEN {y} - floor({y}) >= 0.5D THEN 1L ELSE 0L END) END)")


# ------------------------------------------------------------- Column API

def num(f: VField, default=0) -> Column:
    """X1, ``num(v, d)``: ``Number(v)`` if finite, else ``d``; missing -> ``d``.

    null -> 0, '' -> 0, true/false -> 1/0, numeric text -> its value.  Objects
    and arrays fall to the default (pinned deviation; JS would coerce ``[5]``).
    Text passes a decimal-literal guard first: Spark's cast alone would also
    accept ``1d``, ``1f``, ``Infinity`` and ``NaN``.
    """
    return F.expr(_num_sql(f, sql_lit(default)))


def is_falsy(f: VField) -> Column:
    """JS falsiness of a body field: missing, null, '', 0, false."""
    return F.expr(_falsy_sql(f))


def js_text(f: VField, default: str | None = "", trim: bool = False) -> Column:
    """``String(b.x || default)`` (optionally ``.trim()``).

    Numbers and booleans print as JS does; objects and arrays become ''
    (pinned deviation: JS would print ``[object Object]``).
    """
    return F.expr(_text_sql(f, default, trim))


def js_or_null(f: VField) -> Column:
    """``b.x || null`` stored into a TEXT column."""
    return js_text(f, None, trim=False)


def is_missing(f: VField) -> Column:
    return F.expr(f"({f.k} = {MISSING})")


def is_json_null(f: VField) -> Column:
    return F.expr(f"({f.k} = {JNULL})")


def is_number(f: VField) -> Column:
    return F.expr(f"({f.k} = {NUMBER})")


def is_string(f: VField) -> Column:
    return F.expr(f"({f.k} = {STRING})")


def is_boolean(f: VField) -> Column:
    return F.expr(f"({f.k} = {BOOLEAN})")


def as_double(f: VField) -> Column:
    return F.expr(f.d)


def as_string(f: VField) -> Column:
    return F.expr(f.s)


def deductible_flag(f: VField) -> Column:
    """``String(b.deductible ?? '1') === '0' ? 0 : 1``."""
    return F.expr(f"(CASE WHEN ({f.k} = {STRING} AND {f.s} = '0') "
                  f"OR ({f.k} = {NUMBER} AND {f.d} = 0D) THEN 0L ELSE 1L END)")


def cents(f: VField) -> Column:
    """X2, ``cents(usd) = Math.round(num(usd, 0) * 100)`` on a body field."""
    return F.expr(_round_sql(f"({_num_sql(f, '0D')} * 100D)"))


def cost_precedence(cc: VField, cu: VField) -> Column:
    """X11: finite *number* cost_cents, else finite number cost_usd x 100 (JS round), else 0.

    Fractions of a cent are floored (the column is an integer); a cost_cents that no
    integer holds exactly is NULL, not replaced by cost_usd.
    """
    return F.expr(f"(CASE WHEN {cc.k} = {NUMBER} AND abs({cc.d}) < {_INF} "
                  f"THEN (CASE WHEN abs({cc.d}) <= {_MAX} THEN CAST(floor({cc.d}) AS BIGINT) END) "
                  f"WHEN {cu.k} = {NUMBER} AND abs({cu.d}) < {_INF} "
                  f"THEN {_round_sql(f'({cu.d} * 100D)')} ELSE 0L END)")


def quantity_or_one(f: VField) -> Column:
    """``Number(q) || 1`` with ``q`` defaulting to 1 when missing."""
    n = _num_sql(f, "1D")
    return F.expr(f"(CASE WHEN {n} = 0D THEN 1D ELSE {n} END)")


# ---------------------------------------------------- plain-column helpers

def round_half_up_cents(usd: Column) -> Column:
    """X2 on a double: ``Math.round(usd*100)``, half toward +inf.

    ``floor(y) + (y - floor(y) >= 0.5)``; not ``round`` (half away from zero)
    and not ``floor(y + 0.5)`` (wrong at 0.49999999999999994).  Beyond 2^53 the
    result is NULL, so callers can reject instead of storing a wrong amount.
    """
    y = usd.cast("double") * F.lit(100.0)
    fl = F.floor(y)
    out = fl + F.when(y - fl >= F.lit(0.5), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.abs(y) <= F.lit(MAX_SAFE), out.cast("bigint"))


def floor_clamp(n: Column, low: int) -> Column:
    """``Math.max(low, Math.floor(n))`` as bigint (NULL past 2^53)."""
    return F.when(F.abs(n) <= F.lit(MAX_SAFE), F.greatest(F.lit(low).cast("bigint"), F.floor(n)))


def mileage_amount(type_: Column, miles: Column, rate_cents: Column) -> Column:
    """``type === 'mileage' ? miles * rate : null`` (miles, rate never null); NULL when the
    product overflows, so that one request cannot fail a job."""
    return F.when(type_ == F.lit("mileage"), F.try_multiply(miles, rate_cents)).cast("bigint")


def normalize_status(s: Column) -> Column:
    """Lower-case; outside the four statuses -> 'active'."""
    low = F.lower(F.coalesce(s, F.lit("")))
    return F.when(low.isin("staged", "draft", "active", "sold"), low).otherwise(F.lit("active"))


def sku_upper(s: Column) -> Column:
    """``String(sku || '').trim().toUpperCase()`` on a text column."""
    return F.upper(js_trim(F.coalesce(s, F.lit(""))))


def default_if_empty(s: Column, default: str) -> Column:
    """X5 on a text column: '' or NULL -> default."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def is_json_null_value(v: Column) -> Column:
    """True when a whole VARIANT value is JSON ``null``."""
    return F.coalesce(F.is_variant_null(v), F.lit(False))
