"""Aggregates and the period profit-and-loss report.

Every aggregate is a hash aggregate with a partial (map-side) phase, so the
shuffle carries one row per group per task; global aggregates shuffle a
handful of rows whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money_text
from ..schemas import DEFAULT_FROM, DEFAULT_TO, INVENTORY_STATUSES
from .filters import in_report_range


def _sum0(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def inventory_by_status(inventory: DataFrame) -> DataFrame:
    """A1: item count per status over the whole table (no date filter)."""
    return inventory.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def _status_counts(status: Column, counted: Column) -> list[Column]:
    """One conditional count for each status of the table's CHECK, and one for all others."""
    known = status.isin(*INVENTORY_STATUSES)
    return ([F.count_if(counted & (status == s)).alias(f"_{s}") for s in INVENTORY_STATUSES]
            + [F.count_if(counted & ~F.coalesce(known, F.lit(False))).alias("_other")])


def _present() -> Column:
    """The statuses that occur, in name order, from the columns of ``_status_counts``."""
    names = sorted([*INVENTORY_STATUSES, "other"])
    return F.filter(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"_{s}").alias("cnt")) for s in names]),
                    lambda x: x["cnt"] > 0)


def inventory_status_map(inventory: DataFrame) -> DataFrame:
    """A5: the status counts as one ``map<string,bigint>`` row.

    One global aggregate with a counter for each of the four statuses; rows with any
    other status (the older schemas have no CHECK) are counted as ``other``,
    so the map's size does not depend on the data.
    """
    counts = inventory.agg(*_status_counts(F.col("status"), F.lit(True)))
    return counts.select(F.map_from_entries(_present()).alias("inventory_by_status"))


def sales_measures() -> dict[str, Column]:
    """What the reports sum of a sale."""
    return {"gross": F.col("sold_price_cents"), "ship": F.col("buyer_shipping_cents"),
            "costs": (F.col("platform_fees_cents") + F.col("promo_fee_cents")
                      + F.col("shipping_label_cost_cents") + F.col("other_costs_cents")),
            "qty": F.col("qty")}


def expense_measures() -> dict[str, Column]:
    """What the reports sum of an expense; ``deductible`` and ``type`` are not looked at."""
    return {"amount": F.col("amount_cents"), "mileage": F.col("calc_amount_cents")}


def by_month(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """The roll-up of a table: the sums of its measures for each month (NULL where a month has no value of one)."""
    return df.groupBy("month").agg(*[F.sum(c).alias(m) for m, c in measures.items()])


def rolled_range(df: DataFrame, months: DataFrame, measures: dict[str, Column], frm: str | None = None,
                 to: str | None = None) -> DataFrame:
    """Rows whose measures add up to those of a report range of ``df``: the roll-up's rows of every month that
    lies in the range as a whole, and the table's own rows of the months at its two ends.

    Months are the first seven characters of text dates, so all dates of a month lie between a bound
    of another month and the other bound, whatever text they are.
    """
    frm, to = frm or DEFAULT_FROM, to or DEFAULT_TO
    whole = (F.col("month") >= F.lit(frm)) & (F.col("month") < F.lit(to[:7]))
    ends = df.where(F.col("month").isin(sorted({frm[:7], to[:7]})) & ~whole & F.col("date").between(F.lit(frm), F.lit(to)))
    return ends.select(*[c.alias(m) for m, c in measures.items()]).unionByName(months.where(whole).select(*measures))


def sales_totals(sales: DataFrame, frm: str | None = None, to: str | None = None) -> DataFrame:
    """A2: sums over a report range; SUM over no rows -> 0."""
    m = sales_measures()
    return in_report_range(sales, frm, to).agg(
        _sum0(m["gross"]).alias("gross_cents"), _sum0(m["ship"]).alias("buyer_ship_cents"),
        _sum0(m["costs"]).alias("costs_cents"), _sum0(m["qty"]).alias("total_qty"))


def expense_totals(expenses: DataFrame, frm: str | None = None, to: str | None = None) -> DataFrame:
    """A3: amount and mileage sums; ``deductible`` and ``type`` are not filtered."""
    m = expense_measures()
    return in_report_range(expenses, frm, to).agg(_sum0(m["amount"]).alias("expenses_cents"),
                                                  _sum0(m["mileage"]).alias("mileage_cents"))


def report_summary(inventory: DataFrame, sales: DataFrame, expenses: DataFrame, frm: str | None = None,
                   to: str | None = None) -> DataFrame:
    """A4 via J9: stock counts by status, and revenue, total expenses and net for a period; one row.

    Cost of goods is *not* subtracted here (unlike the per-sale profit view), and the
    counts are of the whole inventory, whatever the period.  All three scans are
    projected to the same measures (NULL where a table has no such measure) and
    unioned, so one global aggregate with a partial phase per task computes
    everything: no join, and the shuffle carries one buffer row per task.
    ``inventory_by_status`` is text, ``status=count`` in name order.
    """
    pick = lambda df, m: in_report_range(df, frm, to).select(*[c.alias(n) for n, c in m.items()])
    return _summary(inventory, pick(sales, sales_measures()), pick(expenses, expense_measures()))


def report_summary_rolled(inventory: DataFrame, sales: DataFrame, sales_months: DataFrame, expenses: DataFrame,
                          expenses_months: DataFrame, frm: str | None = None, to: str | None = None) -> DataFrame:
    """The same report from the stored roll-ups: of Sales and Expenses only the months at the period's ends are read."""
    return _summary(inventory, rolled_range(sales, sales_months, sales_measures(), frm, to),
                    rolled_range(expenses, expenses_months, expense_measures(), frm, to))


def _summary(inventory: DataFrame, sold: DataFrame, spent: DataFrame) -> DataFrame:
    """The report from rows of measures."""
    measures = ("gross", "ship", "costs", "amount", "mileage")

    def rows(df: DataFrame, stock: bool = False) -> DataFrame:
        cols = [(F.col(m) if m in df.columns and not stock else F.lit(None).cast("bigint")).alias(f"_{m}") for m in measures]
        return df.select(*cols, F.lit(stock).alias("_stock"),
                         (F.col("status") if stock else F.lit(None).cast("string")).alias("_status"))

    t = rows(sold).unionByName(rows(spent)).unionByName(rows(inventory, stock=True)).agg(
        (_sum0("_gross") + _sum0("_ship")).alias("rev"), _sum0("_costs").alias("costs"), _sum0("_amount").alias("exp"),
        _sum0("_mileage").alias("miles"), *_status_counts(F.col("_status"), F.col("_stock")))
    total = F.col("costs") + F.col("exp") + F.col("miles")
    by_status = F.array_join(F.transform(_present(), lambda x: F.concat(x["status"], F.lit("="), x["cnt"].cast("string"))), ",")
    return t.select(by_status.alias("inventory_by_status"), F.col("rev").alias("revenue_cents"),
                    total.alias("total_expenses_cents"), (F.col("rev") - total).alias("net_cents"))


def report_summary_text(summary: DataFrame) -> DataFrame:
    """X18 over A4: the report's status line and its money lines as text."""
    return summary.select(F.concat(F.lit("Inventory by status: "), F.col("inventory_by_status")).alias("status_text"),
                          money_text(F.col("revenue_cents")).alias("revenue_text"),
                          money_text(F.col("total_expenses_cents")).alias("expenses_text"),
                          money_text(F.col("net_cents")).alias("net_text"))
