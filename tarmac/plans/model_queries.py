"""Registered queries: model_queries."""

from tarmac.operators import elasticity as el
from tarmac.plans.registry import msum, register
from tarmac.sources.tables import sales_view

_EL_CTES = """
mo AS (SELECT Category, date_trunc('month', Date) AS month, avg(Unit_Price) AS avg_price,
              CAST(SUM(Units_Sold) AS BIGINT) AS total_units
       FROM sales WHERE Category IS NOT NULL AND Date IS NOT NULL GROUP BY 1, 2),
fit AS (SELECT Category, COUNT(*) AS months,
               regr_slope(ln(greatest(CAST(total_units AS DOUBLE), 1.0)), ln(avg_price)) AS slope,
               regr_r2(ln(greatest(CAST(total_units AS DOUBLE), 1.0)), ln(avg_price)) AS r2
        FROM mo GROUP BY Category HAVING COUNT(*) >= 6),
el AS (SELECT Category AS category, round(slope, 3) AS elasticity, round(r2, 3) AS r_squared, months,
              CASE WHEN slope > -0.5 THEN 'Highly inelastic' WHEN slope > -1.0 THEN 'Inelastic'
                   WHEN slope > -1.5 THEN 'Unit elastic' ELSE 'Elastic' END AS interpretation,
              CASE WHEN slope > -0.5 THEN printf('A 10%% price increase reduces demand by only %.1f%% — strong pricing power.', abs(slope * 10))
                   WHEN slope > -1.0 THEN printf('A 10%% price increase reduces demand by %.1f%% — moderate sensitivity.', abs(slope * 10))
                   ELSE printf('A 10%% price increase reduces demand by %.1f%% — price-sensitive segment.', abs(slope * 10)) END AS insight
       FROM fit),
pts AS (SELECT mo.Category AS category, strftime(month, '%Y-%m') AS month, round(avg_price, 0) AS price,
               total_units AS units FROM mo JOIN fit USING (Category))"""


@register("elasticity", "SELECT * FROM el", _EL_CTES)
def q_elasticity(spark, d):
    return el.elasticity(sales_view(spark, d))


@register("elasticity_points", "SELECT * FROM pts", _EL_CTES)
def q_elasticity_points(spark, d):
    return el.elasticity_points(sales_view(spark, d))


@register("elasticity_points_one", """
SELECT * FROM pts WHERE category = (SELECT category FROM el ORDER BY elasticity DESC, category LIMIT 1)""", _EL_CTES)
def q_elasticity_points_one(spark, d):
    return el.elasticity_points_for(sales_view(spark, d))


# The finite series of the t distribution in theta = atan(t / sqrt(nu)), by the parity of nu.
_P_CTES = _EL_CTES + """,
ts AS (SELECT Category AS category, months - 2 AS nu, r * sqrt((months - 2) / (1 - r * r)) AS t
       FROM (SELECT Category, COUNT(*) AS months,
                    corr(ln(greatest(CAST(total_units AS DOUBLE), 1.0)), ln(avg_price)) AS r
             FROM mo GROUP BY Category HAVING COUNT(*) >= 6)),
angle AS (SELECT *, atan(abs(t) / sqrt(nu)) AS theta, cos(atan(abs(t) / sqrt(nu))) ** 2 AS c2 FROM ts),
coef AS (SELECT k, exp(sum(ln((2.0 * k - 1) / (2 * k))) OVER (ORDER BY k)) AS ev,
                exp(sum(ln(2.0 * k / (2 * k + 1))) OVER (ORDER BY k)) AS od
         FROM (SELECT unnest(range(1, (SELECT max(nu) FROM ts) + 1)) AS k)),
series AS (SELECT a.category, any_value(a.nu) AS nu, any_value(a.t) AS t, any_value(a.theta) AS theta,
                  1 + coalesce(sum(CASE WHEN a.nu % 2 = 0 THEN c.ev ELSE c.od END * a.c2 ** c.k), 0) AS s
           FROM angle a LEFT JOIN coef c ON c.k <= CASE WHEN a.nu % 2 = 0 THEN (a.nu - 2) // 2 ELSE (a.nu - 3) // 2 END
           GROUP BY a.category)"""


@register("elasticity_pvalue", """
SELECT category, round(t, 6) AS t_stat,
       round(1 - CASE WHEN nu % 2 = 0 THEN sin(theta) * s ELSE 2 / pi() * (theta + sin(theta) * cos(theta) * s) END, 9)
       AS p_value FROM series""", _P_CTES)
def q_elasticity_pvalue(spark, d):
    return el.elasticity_pvalue(sales_view(spark, d), digits=9)

from tarmac.operators import anomaly as an  # noqa: E402


@register("anomaly")
def q_anomaly(spark, d):
    return an.monthly_anomalies(sales_view(spark, d))


@register("anomaly_flagged")
def q_anomaly_flagged(spark, d):
    return an.flagged(an.monthly_anomalies(sales_view(spark, d)))


@register("anomaly_summary")
def q_anomaly_summary(spark, d):
    return an.anomaly_summary(an.monthly_anomalies(sales_view(spark, d)))

from tarmac.operators import churn as ch  # noqa: E402
from tarmac.operators import customers as cu  # noqa: E402
from tarmac.plans.customer_queries import SNAPSHOT, _RFM_BASE  # noqa: E402

# Trees of the registered churn queries (the library default is the reference's 200).
CHURN_TREES = 200


_TRAINED: dict = {}


def _churn(spark, d):
    """One fit per session and data folder, shared by the churn queries (the
    model is the expensive part; results are persisted DataFrames)."""
    key = ("churn", id(spark), d, CHURN_TREES)
    if key not in _TRAINED:
        rfm_table = cu.rfm_scores(cu.rfm_base(sales_view(spark, d), SNAPSHOT))
        _TRAINED[key] = ch.train_churn(rfm_table, max_iter=CHURN_TREES)
    return _TRAINED[key]


@register("churn_label", """
SELECT Customer, Recency, CAST(Recency > (SELECT quantile_cont(Recency, 0.6) FROM base) AS DOUBLE) AS label FROM base""",
          _RFM_BASE)
def q_churn_label(spark, d):
    labelled, _ = ch.churn_label(cu.rfm_base(sales_view(spark, d), SNAPSHOT))
    return labelled.select("Customer", "Recency", "label")


@register("churn")
def q_churn(spark, d):
    return ch.churn_table(_churn(spark, d)["scores"])


@register("churn_attribution")
def q_churn_attribution(spark, d):
    return ch.attribution_table(_churn(spark, d)["attribution"])


@register("churn_check", """
SELECT COUNT(*) AS customers, CAST(0 AS BIGINT) AS bad_probability, CAST(0 AS BIGINT) AS bad_count,
       CAST(0 AS BIGINT) AS bad_sum FROM base""", _RFM_BASE)
def q_churn_check(spark, d):
    """M1b, M1e: rules of the scores and attributions, counted over all customers."""
    return ch.churn_check(_churn(spark, d))


@register("churn_importance")
def q_churn_importance(spark, d):
    return ch.importance_table(_churn(spark, d)["importance"])


@register("churn_histogram")
def q_churn_histogram(spark, d):
    return ch.probability_histogram(ch.churn_table(_churn(spark, d)["scores"]))


@register("churn_risk_counts")
def q_churn_risk_counts(spark, d):
    return ch.risk_counts(ch.churn_table(_churn(spark, d)["scores"]))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tarmac.operators import recommend as rc  # noqa: E402


def _recommender(spark, d):
    key = ("als", id(spark), d)
    if key not in _TRAINED:
        _TRAINED[key] = rc.train_recommender(sales_view(spark, d))
    return _TRAINED[key]


@register("interactions", """
SELECT Customer AS customer, Product_Name AS product, round(ln(1 + CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) AS DOUBLE)), 6) AS rating
FROM sales WHERE Customer IS NOT NULL AND Product_Name IS NOT NULL GROUP BY 1, 2""")
def q_interactions(spark, d):
    return rc.interactions(sales_view(spark, d)).withColumn("rating", F.round("rating", 6))


@register("entity_index", """
SELECT 'customer' AS kind, customer AS name, CAST(row_number() OVER (ORDER BY customer) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT Customer AS customer FROM sales WHERE Customer IS NOT NULL)
UNION ALL
SELECT 'product', product, CAST(row_number() OVER (ORDER BY product) - 1 AS INTEGER)
FROM (SELECT DISTINCT Product_Name AS product FROM sales WHERE Product_Name IS NOT NULL)""")
def q_entity_index(spark, d):
    inter = rc.interactions(sales_view(spark, d))
    users = rc.entity_index(inter, "customer", "idx").select(F.lit("customer").alias("kind"),
                                                             F.col("customer").alias("name"), "idx")
    items = rc.entity_index(inter, "product", "idx").select(F.lit("product").alias("kind"),
                                                            F.col("product").alias("name"), "idx")
    return users.unionByName(items)


@register("customer_list", "SELECT DISTINCT Customer AS customer FROM sales WHERE Customer IS NOT NULL")
def q_customer_list(spark, d):
    return rc.customer_list(sales_view(spark, d))


@register("recommend")
def q_recommend(spark, d):
    return rc.recommend(_recommender(spark, d), n=5)


@register("recommend_customer")
def q_recommend_customer(spark, d):
    trained = _recommender(spark, d)
    first = trained["users"].orderBy("user").select("customer").first()
    return rc.recommend_for(trained, first["customer"] if first else "", n=5)



@register("recommend_check", """
SELECT CAST(SUM(least(5, m - b)) AS BIGINT) AS rows, COUNT(*) AS customers, CAST(0 AS BIGINT) AS bought,
       CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS misplaced
FROM (SELECT customer, COUNT(*) AS b FROM inter GROUP BY 1), (SELECT COUNT(DISTINCT product) AS m FROM inter)
WHERE m > b""", """
inter AS (SELECT DISTINCT Customer AS customer, Product_Name AS product FROM sales
          WHERE Customer IS NOT NULL AND Product_Name IS NOT NULL)""")
def q_recommend_check(spark, d):
    """Every customer gets five products, or all unseen ones; none of them bought, none twice, best first."""
    trained = _recommender(spark, d)
    recs = rc.recommend(trained, n=5)
    bought = recs.join(trained["rated"].select("customer", "product"), ["customer", "product"], "left_semi")
    order = Window.partitionBy("customer").orderBy("rank")
    placed = recs.select("customer", "product", ((F.row_number().over(order) != F.col("rank"))
                         | F.coalesce(F.col("score") > F.lag("score").over(order), F.lit(False))).alias("wrong"))
    totals = placed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer").alias("customers"),
                        (F.count(F.lit(1)) - F.count_distinct("customer", "product")).alias("repeated"),
                        F.count_if("wrong").alias("misplaced"))
    return totals.join(F.broadcast(bought.agg(F.count(F.lit(1)).alias("bought")))).select(  # one row each
        "rows", "customers", "bought", "repeated", "misplaced")

from tarmac.operators import forecast as fc  # noqa: E402
from tarmac.plans.bi_queries import _trend_sql  # noqa: E402


@register("forecast_history", f"SELECT 'total' AS series, month, revenue FROM ({_trend_sql('TRUE')}) t")
def q_forecast_history(spark, d):
    return fc.history(sales_view(spark, d))


@register("forecast_calendar", """
SELECT 'total' AS series, strftime(m, '%Y-%m') AS month
FROM (SELECT unnest(generate_series(CAST(date_trunc('month', max(Date)) AS DATE) + INTERVAL 1 MONTH,
                                    CAST(date_trunc('month', max(Date)) AS DATE) + INTERVAL 12 MONTH,
                                    INTERVAL 1 MONTH)) AS m FROM sales)""")
def q_forecast_calendar(spark, d):
    return fc.calendar(sales_view(spark, d), 12)


@register("forecast")
def q_forecast(spark, d):
    return fc.forecast(sales_view(spark, d), 12)


@register("forecast_by_category")
def q_forecast_by_category(spark, d):
    return fc.forecast(sales_view(spark, d), 12, by="Category")


@register("forecast_changepoints")
def q_forecast_changepoints(spark, d):
    return fc.changepoints(sales_view(spark, d))


@register("forecast_combined")
def q_forecast_combined(spark, d):
    return fc.combined(sales_view(spark, d), 12)


@register("churn_high_risk")
def q_churn_high_risk(spark, d):
    return ch.filter_risk(ch.churn_table(_churn(spark, d)["scores"]), "High")


@register("churn_customer_attribution")
def q_churn_customer_attribution(spark, d):
    res = _churn(spark, d)
    first = res["attribution"].agg(F.min("Customer")).first()[0]
    return ch.attribution_table(res["attribution"], first)


@register("anomaly_features", f"""
SELECT strftime(Date, '%Y-%m') AS month, round({msum()}, 2) AS revenue, CAST(SUM(Units_Sold) AS BIGINT) AS units
FROM sales WHERE Date IS NOT NULL GROUP BY 1""")
def q_anomaly_features(spark, d):
    """The month series the forest is grown on."""
    return an.monthly_features(sales_view(spark, d)).withColumn("revenue", F.round("revenue", 2))


@register("elasticity_t_stat", """
SELECT Category AS category, months, round(r * sqrt((months - 2) / (1 - r * r)), 6) AS t_stat
FROM (SELECT Category, COUNT(*) AS months,
             corr(ln(greatest(CAST(total_units AS DOUBLE), 1.0)), ln(avg_price)) AS r
      FROM mo GROUP BY Category HAVING COUNT(*) >= 6) f""", _EL_CTES)
def q_elasticity_t_stat(spark, d):
    """The t statistic of each slope."""
    fit = el.elasticity_fit(sales_view(spark, d))
    return fit.select(F.col("Category").alias("category"), "months", F.round("t_stat", 6).alias("t_stat"))


@register("anomaly_customer_months")
def q_anomaly_customer_months(spark, d):
    return an.customer_month_anomalies(sales_view(spark, d))


@register("forecast_by_product")
def q_forecast_by_product(spark, d):
    """M3a for every product series at once (one applyInPandas group per product)."""
    return fc.forecast(sales_view(spark, d), 12, by="Product_Name")


@register("forecast_by_region")
def q_forecast_by_region(spark, d):
    """M3a per region series."""
    return fc.forecast(sales_view(spark, d), 12, by="Region")
