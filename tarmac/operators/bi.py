"""Dashboard aggregates over the sales fact: filters, KPIs, shares, trends,
product/customer tables, top-n, pivots.

Result columns are renamed per result (P9: ``name``, ``revenue``, ``units``, ...).
All functions take the sales DataFrame and return a DataFrame; nothing is
collected. Group-bys run with map-side partial aggregation, so a hot customer,
product or region is combined before the shuffle. Windows are only used on
grouped results and partitioned by their group key; a window without
``partitionBy`` is only applied after ``limit`` or to a dimension-sized key set
(categories, regions).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.columns import (
    money_double, money_sum, money_total, month_key, month_start, ratio, truncate_label,
)


def _given(v) -> bool:
    return v is not None and str(v) != "" and str(v).lower() != "all"


def filter_sales(sales: DataFrame, year=None, category=None, region=None) -> DataFrame:
    """Optional equality filters; None, '' and 'all' mean no filter.

    The year filter is also written as a date range so that it can reach the
    order-date column of the scan (and partition pruning on a Year-partitioned fact).
    """
    out = sales
    if _given(year):
        y = int(year)
        out = out.filter((F.col("Date") >= F.lit(_dt.date(y, 1, 1)))
                         & (F.col("Date") < F.lit(_dt.date(y + 1, 1, 1)))
                         & (F.col("Year") == y))
    if _given(category):
        out = out.filter(F.col("Category") == str(category))
    if _given(region):
        out = out.filter(F.col("Region") == str(region))
    return out


def filter_values(sales: DataFrame) -> DataFrame:
    """Distinct years, categories and regions as (field, value), one scan.

    The three projections are exploded from one pass and de-duplicated with a
    single aggregate (map-side combine keeps the shuffle tiny).
    """
    pairs = F.array(
        F.struct(F.lit("years").alias("field"), F.col("Year").cast("string").alias("value")),
        F.struct(F.lit("categories").alias("field"), F.col("Category").alias("value")),
        F.struct(F.lit("regions").alias("field"), F.col("Region").alias("value")),
    )
    return (sales.select(F.inline(pairs))
            .filter(F.col("value").isNotNull())
            .distinct()
            .orderBy("field", "value"))


def row_count(sales: DataFrame) -> DataFrame:
    """Number of fact rows."""
    return sales.agg(F.count(F.lit(1)).alias("rows"))


def kpis(sales: DataFrame, year=None, category=None, region=None,
         current_year: int = 2023, base_year: int = 2022) -> DataFrame:
    """A1 + A2: headline figures under the filter, and YoY growth of
    ``current_year`` over ``base_year`` on the unfiltered fact (as the reference does).

    One scan: the filter becomes a condition inside the aggregate, so the YoY
    sums come from the same pass.
    """
    cond = F.lit(True)
    if _given(year):
        cond = cond & (F.col("Year") == int(year))
    if _given(category):
        cond = cond & (F.col("Category") == str(category))
    if _given(region):
        cond = cond & (F.col("Region") == str(region))
    rev_in = F.when(cond, F.col("Revenue"))
    # rows outside the filter count only for the two growth years; the scan drops the rest
    agg = sales.filter(cond | F.col("Year").isin(current_year, base_year)).agg(
        F.coalesce(money_sum(rev_in), F.lit(0.0)).alias("_rev"),
        F.coalesce(F.sum(F.when(cond, F.col("Units_Sold").cast("long"))), F.lit(0)).cast("long").alias("total_units"),
        F.count(F.when(cond, F.lit(1))).alias("total_transactions"),
        F.count(rev_in).alias("_sold"),  # the mean skips rows without revenue
        F.count_distinct(F.when(cond, F.col("Customer"))).alias("unique_customers"),
        F.coalesce(money_sum(F.when(F.col("Year") == current_year, F.col("Revenue"))), F.lit(0.0)).alias("_cur"),
        F.coalesce(money_sum(F.when(F.col("Year") == base_year, F.col("Revenue"))), F.lit(0.0)).alias("_prv"),
    )
    return agg.select(
        F.round("_rev", 2).alias("total_revenue"),
        "total_units",
        "total_transactions",
        F.round(ratio("_rev", "_sold"), 2).alias("avg_order_value"),
        "unique_customers",
        F.round(F.coalesce(ratio(F.col("_cur") - F.col("_prv"), "_prv"), F.lit(0.0)), 2).alias("yoy_growth"),
    )


def revenue_share(sales: DataFrame, key: str, year=None, category=None, region=None) -> DataFrame:
    """A3/A4 (+W7, T3): revenue and units per ``key`` with % of the total, 1 digit.

    Safe for any key cardinality: the grouped table is persisted, its grand
    total comes back as one scalar, and the share is a plain projection (no
    window that would pull the groups into one task).
    """
    d = filter_sales(sales, year, category, region)
    grp = d.groupBy(F.col(key).alias("name")).agg(
        money_total("Revenue").alias("_rev"),
        F.sum(F.col("Units_Sold").cast("long")).alias("units"),
    ).filter(F.col("name").isNotNull()).persist()
    total = grp.agg(F.sum("_rev")).first()[0]
    total_lit = F.lit(total).cast("decimal(38,8)")
    return grp.select(
        "name",
        F.round(money_double("_rev"), 2).alias("revenue"),
        "units",
        F.round(ratio(money_double("_rev"), money_double(total_lit)) * 100, 1).alias("pct"),
    ).orderBy(F.desc("revenue"), "name")


def trend_monthly(sales: DataFrame, category=None, region=None) -> DataFrame:
    """A5: revenue and units per month ``YYYY-MM``, ascending."""
    d = filter_sales(sales, None, category, region)
    # group on the month start (cheap per row); format only the grouped rows
    return (d.groupBy(month_start("Date").alias("_m"))
            .agg(F.round(money_sum("Revenue"), 2).alias("revenue"),
                 F.sum(F.col("Units_Sold").cast("long")).alias("units"))
            .filter(F.col("_m").isNotNull())
            .select(month_key("_m").alias("month"), "revenue", "units")
            .orderBy("month"))


def last_k(df: DataFrame, order_col: str, k: int) -> DataFrame:
    """T5: the last ``k`` rows of an ordered series (top-k on the descending key)."""
    return df.orderBy(F.desc(order_col)).limit(k).orderBy(order_col)


def in_millions(c, digits: int = 2):
    """P10: value in millions, rounded."""
    return F.round((F.col(c) if isinstance(c, str) else c) / 1e6, digits)


def _product_groups(sales: DataFrame, with_price: bool) -> DataFrame:
    aggs = [money_sum("Revenue").alias("_rev"),
            F.sum(F.col("Units_Sold").cast("long")).alias("units")]
    if with_price:
        aggs.append(F.round(F.avg("Unit_Price"), 0).alias("avg_price"))
    return (sales.groupBy(F.col("Product_Name").alias("name"),
                          F.col("Category").alias("category"),
                          F.col("ABC_Class").alias("abc"))
            .agg(*aggs)
            .filter(F.col("name").isNotNull() & F.col("category").isNotNull())
            .withColumn("revenue", F.round("_rev", 2)))


def products_all(sales: DataFrame, year=None) -> DataFrame:
    """Revenue, units, mean unit price per (product, category, ABC class).

    Needs the ABC_Class column (``operators.abc.with_abc_class``).
    """
    g = _product_groups(filter_sales(sales, year), with_price=True)
    return g.select("name", "category", "abc", "revenue", "units", "avg_price") \
        .orderBy(F.desc("revenue"), "name")


def products_top(sales: DataFrame, n: int = 10, by: str = "revenue", year=None) -> DataFrame:
    """A7 + T1 + W2: top ``n`` products by revenue (or units for any other ``by``), ranked 1..n.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps only
    its best n, so the final merge sees n x tasks rows.
    """
    g = _product_groups(filter_sales(sales, year), with_price=False)
    measure = "_rev" if by == "revenue" else "units"
    top = g.orderBy(F.desc(measure), "name").limit(int(n))
    rank = F.row_number().over(Window.orderBy(F.desc(measure), "name"))
    return top.select("name", "category", "abc", "revenue", "units", rank.alias("rank"))


def sort_table(df: DataFrame, column: str, ascending: bool = False, tie_break: str | None = None) -> DataFrame:
    """Sort a result by any column either way, with a name tie-break."""
    order = [F.col(column).asc() if ascending else F.col(column).desc()]
    if tie_break:
        order.append(F.col(tie_break).asc())
    return df.orderBy(*order)


def customers_table(sales: DataFrame, year=None, region=None) -> DataFrame:
    """Revenue, transactions and units per (customer, region), revenue descending."""
    d = filter_sales(sales, year, None, region)
    return (d.groupBy(F.col("Customer").alias("customer"), F.col("Region").alias("region"))
            .agg(F.round(money_sum("Revenue"), 2).alias("revenue"),
                 F.count("Transaction_ID").alias("transactions"),
                 F.sum(F.col("Units_Sold").cast("long")).alias("units"))
            .filter(F.col("customer").isNotNull() & F.col("region").isNotNull())
            .orderBy(F.desc("revenue"), "customer"))


def region_category_matrix(sales: DataFrame, year=None, categories: list[str] | None = None) -> DataFrame:
    """Region x Category revenue pivot, missing cells 0, rounded 2.

    The fact is aggregated once to the long (region, category) table; the pivot
    (and, without ``categories``, its distinct-values job) runs on that small
    persisted result, so the fact is scanned once.
    """
    d = filter_sales(sales, year).filter(F.col("Region").isNotNull() & F.col("Category").isNotNull())
    cells = d.groupBy(F.col("Region").alias("region"), "Category") \
        .agg(F.round(money_sum("Revenue"), 2).alias("_rev")).persist()
    piv = cells.groupBy("region").pivot("Category", categories).agg(F.first("_rev"))
    return piv.na.fill(0.0).orderBy("region")


def region_category_rollup(sales: DataFrame, year=None) -> DataFrame:
    """Cell values, per-region totals and the grand total (null = total),
    plus the largest cell value on every row.
    """
    d = filter_sales(sales, year).filter(F.col("Region").isNotNull() & F.col("Category").isNotNull())
    r = d.rollup(F.col("Region").alias("region"), F.col("Category").alias("category")) \
        .agg(F.round(money_sum("Revenue"), 2).alias("revenue"))
    # grouping sets give at most |regions| x |categories| + |regions| + 1 rows
    cell_max = F.max(F.when(F.col("category").isNotNull(), F.col("revenue"))).over(Window.partitionBy())
    return r.withColumn("max_cell", cell_max).orderBy("region", "category")


def customer_top_products(sales: DataFrame, customer: str | None = None, k: int = 5) -> DataFrame:
    """A customer's (or every customer's) top ``k`` products by revenue.

    The window is partitioned by customer; Spark inserts a partial
    WindowGroupLimit before the shuffle, so at most k rows per customer and task move.
    """
    d = sales if customer is None else sales.filter(F.col("Customer") == customer)
    g = (d.groupBy(F.col("Customer").alias("customer"), F.col("Product_Name").alias("product"))
         .agg(money_sum("Revenue").alias("_rev"))
         .filter(F.col("customer").isNotNull() & F.col("product").isNotNull()))
    w = Window.partitionBy("customer").orderBy(F.desc("_rev"), "product")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("customer", "product", F.round("_rev", 2).alias("revenue"), "rank"))


def popular_by_region(sales: DataFrame, n: int = 5) -> DataFrame:
    """A17 + T2: revenue per (region, product) and the top ``n`` products per region."""
    g = (sales.groupBy(F.col("Region").alias("region"), F.col("Product_Name").alias("product"))
         .agg(money_sum("Revenue").alias("_rev"))
         .filter(F.col("region").isNotNull() & F.col("product").isNotNull()))
    w = Window.partitionBy("region").orderBy(F.desc("_rev"), "product")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("region", "product", F.round("_rev", 2).alias("revenue"), "rank")
            .orderBy("region", "rank"))


def yoy_by_month(sales: DataFrame, category=None, region=None, years: list[int] | None = None) -> DataFrame:
    """Month (``MM``) x year pivot of revenue in millions (2 digits)."""
    d = filter_sales(sales, None, category, region)
    monthly = d.groupBy(F.month("Date").alias("_mo"), F.col("Year").alias("year")) \
        .agg(money_sum("Revenue").alias("_rev")) \
        .filter(F.col("_mo").isNotNull()) \
        .select(F.lpad(F.col("_mo").cast("string"), 2, "0").alias("month"), "year", "_rev") \
        .persist()  # months x years rows; the pivot's distinct-years job reads this, not the fact
    piv = monthly.groupBy("month").pivot("year", years).agg(F.first(in_millions("_rev")))
    return piv.orderBy("month")


def top_customers(sales: DataFrame, n: int = 10, year=None, region=None) -> DataFrame:
    """The first ``n`` rows of the customer table (revenue descending)."""
    return customers_table(sales, year, region).limit(n)


def schema_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, rows, nulls) for the given tables; one aggregate a table counts rows and nulls."""
    out = None
    for name, df in tables.items():
        fields = df.schema.fields
        counted = df.agg(F.count(F.lit(1)).alias("rows"),
                         *[F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
        lines = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"),
                                   F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"),
                                   F.col(f"n{i}").alias("nulls")) for i, f in enumerate(fields)])
        listed = counted.select(F.inline(lines))
        out = listed if out is None else out.unionByName(listed)
    return out


def top_customers_chart(sales: DataFrame, n: int = 10, year=None, region=None) -> DataFrame:
    """T6 chart rows: the first ``n`` customers, name cut to 20 characters + ellipsis
    beyond 22, revenue in millions (2 digits)."""
    return top_customers(sales, n, year, region).select(
        truncate_label("customer", 22, 20).alias("name"), in_millions("revenue").alias("revenue"))
