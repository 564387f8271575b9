"""Raw sales files -> canonical fact: read (S1-S3), rename (S4), fill (S5), parse
dates (S7), ABC class (S6, see ``operators.abc``), batch validation (S14).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.columns import quarter_label
from tarmac.operators.scale import file_order_id, ordered_row_id
from tarmac.schema import (
    BATCH_REQUIRED, COLUMN_ALIASES, DEFAULT_CATEGORY, DEFAULT_CUSTOMER, DEFAULT_FIRST_DATE, DEFAULT_PRODUCT,
    DEFAULT_REGION, MIN_ROWS, PRICE_FALLBACK, PRICE_TABLE, SALES_COLUMNS, SALES_SCHEMA,
)


def read_sales_parquet(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA) -> DataFrame:
    """The canonical fact from Parquet with a fixed schema (no inference)."""
    return spark.read.schema(schema).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """S2 + S3: a raw sales file; ``.parquet`` by extension (or folder of parquet), else CSV
    with header and inferred types."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def map_columns(df: DataFrame) -> DataFrame:
    """Rename known aliases to canonical names (case-sensitive); unknown
    columns are kept. Two aliases for one target are coalesced in alias order.
    """
    targets: dict[str, list[str]] = {}
    for src, dst in COLUMN_ALIASES.items():
        if src in df.columns:
            targets.setdefault(dst, []).append(src)
    used = {s for srcs in targets.values() for s in srcs}
    cols = []
    for c in df.columns:
        if c in used:
            dst = COLUMN_ALIASES[c]
            srcs = targets[dst]
            if c != srcs[0]:
                continue  # merged into the first alias
            if dst in df.columns and dst not in used:
                continue  # canonical column already present; keep it, drop alias
            expr = F.col(srcs[0]) if len(srcs) == 1 else F.coalesce(*[F.col(s) for s in srcs])
            cols.append(expr.alias(dst))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def parse_date(c) -> F.Column:
    """A date from a date, timestamp or text column; unparsable text -> null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_date(col.cast("string")), F.to_date(F.try_to_timestamp(col.cast("string"))))


def _price(category: str) -> F.Column:
    """S5f: the price of a category from the fixed table, else the mean of the table."""
    entries = [F.lit(x) for pair in PRICE_TABLE.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.col(category)), F.lit(PRICE_FALLBACK))


# Column -> its default, in layers: the expressions of a layer may use the columns of the layers before it.
_BY_POSITION = {
    "Transaction_ID": lambda: F.format_string("TXN-%05d", F.col("_pos") + 1),
    "Date": lambda: F.date_add(F.lit(DEFAULT_FIRST_DATE).cast("date"), F.col("_pos").cast("int")),
}
_DEFAULT_LAYERS = [
    {
        **{c: lambda text=text: F.lit(text) for c, text in [
            ("Product_Name", DEFAULT_PRODUCT), ("Category", DEFAULT_CATEGORY), ("Region", DEFAULT_REGION),
            ("Customer", DEFAULT_CUSTOMER)]},
        "Units_Sold": lambda: F.lit(1),
        "ABC_Class": lambda: F.lit(None).cast("string"),
        "Year": lambda: F.year(parse_date("Date")),
        "Month": lambda: F.month(parse_date("Date")),
        "Month_Name": lambda: F.date_format(parse_date("Date"), "MMM"),
        "Quarter": lambda: quarter_label(parse_date("Date")),
    },
    {"Unit_Price": lambda: _price("Category")},
    {"Revenue": lambda: F.col("Units_Sold") * F.col("Unit_Price")},
]


def fill_defaults(df: DataFrame) -> DataFrame:
    """Missing canonical columns get their defaults; present ones stay as they are.

    S5a id and S5b date follow a dense row id (W8): the one that ``numbered`` gave the raw rows, in file order, or
    one in the order of the frame's partitions where the frame comes from elsewhere;
    S5c calendar columns follow Date; S5d text defaults; S5e units 1; S5f price
    by category; S5g Revenue = units x price; S5h ABC_Class null.
    """
    def absent(frame, layer):
        return {c: make() for c, make in layer.items() if c not in frame.columns}

    if any(c not in df.columns for c in _BY_POSITION):
        placed = df if "_pos" in df.columns else ordered_row_id(df, None, "_pos", start=0)
        df = placed.withColumns(absent(placed, _BY_POSITION))
    df = df.drop("_pos")
    for layer in _DEFAULT_LAYERS:
        missing = absent(df, layer)
        df = df.withColumns(missing) if missing else df
    return df


def conform(df: DataFrame) -> DataFrame:
    """S4 + S5 + S7 + NaN -> null: the 14 canonical columns with canonical types,
    unknown extra columns kept after them."""
    out = fill_defaults(map_columns(df))
    typed = []
    for f in SALES_SCHEMA.fields:
        c = F.col(f.name)
        if f.name == "Date":
            c = parse_date(c)
        elif isinstance(f.dataType, T.DoubleType):
            c = c.cast("double")
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
        else:
            c = c.cast(f.dataType)
        typed.append(c.alias(f.name))
    extra = [F.col(c) for c in out.columns if c not in SALES_COLUMNS]
    return out.select(*typed, *extra)


def numbered(raw: DataFrame) -> DataFrame:
    """``raw``, as read from its files, plus ``_pos``, the row's place in file order, if S5a or S5b will need it."""
    names = map_columns(raw).columns
    return file_order_id(raw, "_pos") if any(c not in names for c in _BY_POSITION) else raw


def load_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """S3 + S4-S7 + S6: read any raw sales file and return the canonical fact with ABC classes."""
    from tarmac.operators.abc import with_abc_class
    fact = conform(numbered(read_raw(spark, path)))
    return with_abc_class(fact).select(*SALES_COLUMNS, *[c for c in fact.columns if c not in SALES_COLUMNS])


def load_and_save_raw(spark: SparkSession, path: str, out_path: str) -> DataFrame:
    """S3 + S4-S7 + S8 + S6 in one pass over the raw file: conform it, write the
    canonical fact (partitioned by Year) and its product classes under ``out_path``,
    and return the stored fact with ``ABC_Class``. Unlike ``load_raw_sales`` the raw
    text is parsed once, not once for the classes and once for the rows."""
    from tarmac.sources.fact import materialize_fact, read_fact
    materialize_fact(conform(numbered(read_raw(spark, path))).select(*SALES_COLUMNS), out_path)
    return read_fact(spark, out_path)


def require_min_rows(df: DataFrame, n: int = MIN_ROWS) -> bool:
    """True when the fact holds at least ``n`` rows (counts at most n)."""
    return df.limit(n).count() >= n


def validate_batch(df: DataFrame, required: list[str] = BATCH_REQUIRED) -> DataFrame:
    """Five rules -> rows (rule, violations, passed).

    Missing columns are schema metadata (U2); the four data rules run as one
    aggregate. Duplicate ids = rows - distinct ids (Spark plans the distinct
    count as a two-level aggregate, so a huge batch is fine).
    """
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    rules = [("required_columns", F.lit(len(missing)).cast("long"))]
    if not missing:
        rev, units, price, tid = F.col("Revenue"), F.col("Units_Sold"), F.col("Unit_Price"), F.col("Transaction_ID")
        agg = df.agg(
            F.count_if(~F.coalesce(rev > 0, F.lit(False))).alias("revenue_positive"),
            F.count_if(~F.coalesce(units >= 1, F.lit(False))).alias("units_at_least_one"),
            (F.count(F.lit(1)) - F.count_distinct(tid)).alias("unique_transaction_id"),
            F.count_if(~F.coalesce(F.abs(rev - price * units) < 1, F.lit(False))).alias("revenue_matches"),
        )
        cols = ["revenue_positive", "units_at_least_one", "unique_transaction_id", "revenue_matches"]
        stacked = agg.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in cols])))
        first = spark.range(1).select(F.lit(rules[0][0]).alias("rule"), rules[0][1].alias("violations"))
        out = first.unionByName(stacked)
    else:
        out = spark.range(1).select(F.lit(rules[0][0]).alias("rule"), rules[0][1].alias("violations"))
    return out.withColumn("passed", F.col("violations") == 0)


def validate_batches(df: DataFrame, key: str, required: list[str] = BATCH_REQUIRED) -> DataFrame:
    """S14 per batch: the five rules for every value of ``key`` (one batch file each)
    in one grouped aggregate -> rows (key, rule, violations, passed)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return (df.select(key).distinct()
                .select(key, F.lit("required_columns").alias("rule"), F.lit(len(missing)).cast("long").alias("violations"))
                .withColumn("passed", F.lit(False)))
    rev, units, price, tid = F.col("Revenue"), F.col("Units_Sold"), F.col("Unit_Price"), F.col("Transaction_ID")
    agg = df.groupBy(key).agg(
        F.count_if(~F.coalesce(rev > 0, F.lit(False))).alias("revenue_positive"),
        F.count_if(~F.coalesce(units >= 1, F.lit(False))).alias("units_at_least_one"),
        (F.count(F.lit(1)) - F.count_distinct(tid)).alias("unique_transaction_id"),
        F.count_if(~F.coalesce(F.abs(rev - price * units) < 1, F.lit(False))).alias("revenue_matches"),
    )
    cols = ["revenue_positive", "units_at_least_one", "unique_transaction_id", "revenue_matches"]
    rules = F.array(F.struct(F.lit("required_columns").alias("rule"), F.lit(0).cast("long").alias("violations")),
                    *[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in cols])
    return agg.select(key, F.inline(rules)).withColumn("passed", F.col("violations") == 0)


def batch_passed(report: DataFrame) -> bool:
    return report.filter(~F.col("passed")).limit(1).count() == 0
