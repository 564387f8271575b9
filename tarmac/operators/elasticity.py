"""Price elasticity per category (M5a-d, A24, P9a).

Monthly mean unit price and total units per category (one aggregate with
map-side combine), then per category the least-squares slope of ln(units)
(units clipped to >= 1) on ln(mean price) with ``regr_slope`` / ``regr_r2``;
categories with fewer than six months are skipped.

The two-sided p-value of the slope uses the Student t distribution with
nu = n - 2 degrees of freedom (``functions.stats.t_two_sided_p``, a JVM
expression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.columns import month_key, month_start
from tarmac.functions.stats import t_two_sided_p
from tarmac.schema import (
    ELASTICITY_ELSE, ELASTICITY_LABELS, ELASTICITY_MIN_MONTHS, ELASTICITY_SENTENCE_ELSE, ELASTICITY_SENTENCES,
)


def monthly_price_units(sales: DataFrame) -> DataFrame:
    """Per (category, month) mean unit price and total units."""
    return (sales.filter(F.col("Category").isNotNull() & F.col("Date").isNotNull())
            .groupBy("Category", month_start("Date").alias("month"))
            .agg(F.avg("Unit_Price").alias("avg_price"),
                 F.sum(F.col("Units_Sold").cast("long")).alias("total_units")))


def _interpretation(slope: Column) -> Column:
    expr = F.lit(ELASTICITY_ELSE)
    for cut, label in reversed(ELASTICITY_LABELS):
        expr = F.when(slope > cut, F.lit(label)).otherwise(expr)
    return expr


def _insight(slope: Column) -> Column:
    pct = F.abs(slope * 10)

    def fmt(template: str) -> Column:
        return F.format_string(template.replace("%", "%%").replace("{pct}", "%.1f"), pct)
    expr = fmt(ELASTICITY_SENTENCE_ELSE)
    for cut, template in reversed(ELASTICITY_SENTENCES):
        expr = F.when(slope > cut, fmt(template)).otherwise(expr)
    return expr


def elasticity_fit(sales: DataFrame) -> DataFrame:
    """M5a + M5b: per category n months, slope, r^2, t statistic and p-value (unrounded)."""
    mo = monthly_price_units(sales)
    x = F.ln("avg_price")
    y = F.ln(F.greatest(F.col("total_units").cast("double"), F.lit(1.0)))
    fit = (mo.groupBy("Category")
           .agg(F.count(F.lit(1)).alias("months"),
                F.regr_slope(y, x).alias("slope"),
                F.regr_r2(y, x).alias("r2"),
                F.corr(y, x).alias("r"))
           .filter(F.col("months") >= ELASTICITY_MIN_MONTHS))
    nu = F.col("months") - 2
    rest = 1 - F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt(F.try_divide(nu.cast("double"), rest))  # null on a perfect fit, whose p is 0
    return (fit.withColumn("t_stat", t)
            .withColumn("p", F.when(rest <= 0, F.lit(0.0)).otherwise(t_two_sided_p(F.col("t_stat"), nu))))


def elasticity(sales: DataFrame) -> DataFrame:
    """M5a + M5c: category, elasticity (3 digits), r_squared (3), months,
    interpretation and insight; sorted by elasticity descending."""
    fit = elasticity_fit(sales)
    return fit.select(
        F.col("Category").alias("category"),
        F.round("slope", 3).alias("elasticity"),
        F.round("r2", 3).alias("r_squared"),
        F.col("months"),
        _interpretation(F.col("slope")).alias("interpretation"),
        _insight(F.col("slope")).alias("insight"),
    ).orderBy(F.desc("elasticity"), "category")


def elasticity_pvalue(sales: DataFrame, digits: int = 4) -> DataFrame:
    """T statistic (6 digits) and two-sided p-value (``digits``) of each slope."""
    fit = elasticity_fit(sales)
    return fit.select(F.col("Category").alias("category"), F.round("t_stat", 6).alias("t_stat"),
                      F.round("p", digits).alias("p_value"))


def elasticity_points(sales: DataFrame, category: str | None = None) -> DataFrame:
    """M5d (+P9a): scatter points (month, price 0 digits, units) per category with
    at least six months; ``category`` keeps one category."""
    mo = monthly_price_units(sales)
    fit = elasticity_fit(sales).select("Category", "slope")
    pts = mo.join(fit, "Category")  # the plan broadcasts it when its size allows
    if category is not None:
        pts = pts.filter(F.col("Category") == category)
    return pts.select(F.col("Category").alias("category"), month_key("month").alias("month"),
                      F.round("avg_price", 0).alias("price"), F.col("total_units").alias("units")) \
        .orderBy("category", "month")


def elasticity_points_for(sales: DataFrame, category: str | None = None) -> DataFrame:
    """The points of one category; the first of the elasticity ranking if none is chosen."""
    if category is None:
        first = elasticity(sales).select("category").first()
        if first is None:
            return elasticity_points(sales).limit(0)
        category = first["category"]
    return elasticity_points(sales, category)
