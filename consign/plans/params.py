"""Parameters of the registered queries (shared by Spark plans and SQL oracles)."""

# Sales end in 2001 and expenses are in 2024; the report period spans both.
REPORT_FROM = "2000-01-01"
REPORT_TO = "2024-01-15"
# Optional-bound list ranges.
SALES_FROM = "1996-03-01"
SALES_TO = "1998-06-30"
EXPENSES_FROM = "2024-01-05"
EXPENSES_TO = ""  # no upper bound
LOT_ID = "lot-98"          # the largest lot at sf0.01 (558 items): the 500 cap bites
PHOTO_ITEM = "inv-7"
PHOTO_ID = "ph-57"
LIST_CAP = 200
LIST_CAP_OLD = 100
LOT_ITEMS_CAP = 500
