"""Canonical sales schema, star schema and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical flat sales fact, one row per transaction line.
SALES_SCHEMA = T.StructType([
    T.StructField("Transaction_ID", T.StringType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("Month_Name", T.StringType()),
    T.StructField("Quarter", T.StringType()),
    T.StructField("Product_Name", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Customer", T.StringType()),
    T.StructField("Units_Sold", T.IntegerType()),
    T.StructField("Unit_Price", T.DoubleType()),
    T.StructField("Revenue", T.DoubleType()),
    T.StructField("ABC_Class", T.StringType()),
])
SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

DIM_PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("base_price", T.DoubleType()),
    T.StructField("abc_class", T.StringType()),
])
DIM_CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("region", T.StringType()),
])
DIM_DATE_SCHEMA = T.StructType([
    T.StructField("date_id", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("month_name", T.StringType()),
])
FACT_SALES_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()),
    T.StructField("txn_code", T.StringType()),
    T.StructField("date_id", T.IntegerType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("units_sold", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Raw column name -> canonical name (case-sensitive).
COLUMN_ALIASES = {
    "transaction_id": "Transaction_ID",
    "txn_id": "Transaction_ID",
    "id": "Transaction_ID",
    "date": "Date",
    "transaction_date": "Date",
    "product": "Product_Name",
    "product_name": "Product_Name",
    "category": "Category",
    "region": "Region",
    "customer": "Customer",
    "client": "Customer",
    "units": "Units_Sold",
    "quantity": "Units_Sold",
    "unit_price": "Unit_Price",
    "price": "Unit_Price",
}

# Category -> unit price used when a raw file has no price column.
PRICE_TABLE = {
    "Engine": 12000.0,
    "Avionics": 8000.0,
    "Airframe": 6000.0,
    "Landing Gear": 5000.0,
    "Cabin": 3000.0,
    "Other": 4000.0,
}
PRICE_FALLBACK = sum(PRICE_TABLE.values()) / len(PRICE_TABLE)

# Defaults for missing text columns and the first default date.
DEFAULT_PRODUCT = "Unknown Product"
DEFAULT_CATEGORY = "Other"
DEFAULT_REGION = "Other"
DEFAULT_CUSTOMER = "Unknown Customer"
DEFAULT_FIRST_DATE = "2022-01-01"

# Columns a nightly batch must carry to pass validation.
BATCH_REQUIRED = ["Transaction_ID", "Date", "Year", "Month", "Product_Name",
                  "Category", "Customer", "Region", "Units_Sold", "Unit_Price", "Revenue"]

# ABC class limits on the cumulative revenue share (inclusive), in percent.
ABC_A_LIMIT = 70.0
ABC_B_LIMIT = 90.0

# RFM segment ladder on the summed score (lower bound inclusive).
SEGMENTS = [(10, "Champions"), (8, "Loyal Customers"), (6, "Potential Loyalists"), (4, "At Risk")]
SEGMENT_ELSE = "Lost"

# Churn risk ladder on the probability (lower bound inclusive).
RISK_HIGH = 0.65
RISK_MEDIUM = 0.35

# Elasticity interpretation ladder (slope strictly above the cut).
ELASTICITY_LABELS = [(-0.5, "Highly inelastic"), (-1.0, "Inelastic"), (-1.5, "Unit elastic")]
ELASTICITY_ELSE = "Elastic"
ELASTICITY_MIN_MONTHS = 6
ELASTICITY_SENTENCES = [
    (-0.5, "A 10% price increase reduces demand by only {pct}% — strong pricing power."),
    (-1.0, "A 10% price increase reduces demand by {pct}% — moderate sensitivity."),
]
ELASTICITY_SENTENCE_ELSE = "A 10% price increase reduces demand by {pct}% — price-sensitive segment."

# Flat SQL view: canonical -> snake_case names; other columns keep their names.
SQL_VIEW_RENAMES = {
    "Transaction_ID": "txn_code",
    "Product_Name": "product_name",
    "ABC_Class": "abc_class",
    "Units_Sold": "units_sold",
    "Unit_Price": "unit_price",
    "Month_Name": "month_name",
}

# Export names the export operator knows.
EXPORTABLE = ["kpis", "products", "customers", "rfm", "elasticity", "abc"]

# Minimum row count under which a loaded fact counts as empty.
MIN_ROWS = 100
