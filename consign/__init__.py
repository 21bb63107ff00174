"""consign: resale-ledger analytics on Spark.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` built from
native Spark SQL expressions, joins and aggregates.  Nothing collects to the
driver; Catalyst and AQE choose the physical plan.
"""

__all__ = ["session", "schemas"]
