"""Customer queries: RFM (A9, W3-W5, A19, P4), cohorts."""

from __future__ import annotations

from tarmac.operators import customers as cu
from tarmac.plans.registry import register
from tarmac.sources.tables import sales_view

# Day after the last order date of the given tables (orders end 2001-08-01).
SNAPSHOT = "2001-08-02"

_RFM_BASE = f"""
base AS (SELECT Customer, arg_min(Region, strftime(Date, '%Y%m%d') || Transaction_ID) AS Region,
                CAST(date_diff('day', max(Date), DATE '{SNAPSHOT}') AS INTEGER) AS Recency,
                COUNT(*) AS Frequency,
                CAST(SUM(CAST(Revenue AS DECIMAL(28,8))) AS DOUBLE) AS Monetary
         FROM sales WHERE Customer IS NOT NULL GROUP BY Customer),
e AS (SELECT quantile_cont(Recency, [0, 0.25, 0.5, 0.75, 1]) AS er,
             quantile_cont(Frequency, [0, 0.25, 0.5, 0.75, 1]) AS ef,
             quantile_cont(Monetary, [0, 0.25, 0.5, 0.75, 1]) AS em FROM base),
pr AS (SELECT Customer,
         (rank() OVER (ORDER BY Recency) + (COUNT(*) OVER (PARTITION BY Recency) - 1) / 2.0) / COUNT(*) OVER () AS pr_r,
         (rank() OVER (ORDER BY Frequency) + (COUNT(*) OVER (PARTITION BY Frequency) - 1) / 2.0) / COUNT(*) OVER () AS pr_f,
         (rank() OVER (ORDER BY Monetary) + (COUNT(*) OVER (PARTITION BY Monetary) - 1) / 2.0) / COUNT(*) OVER () AS pr_m
       FROM base)"""


def _score(c: str, e: str, pr: str, reverse: bool, force_rank: bool) -> str:
    labels = [4, 3, 2, 1] if reverse else [1, 2, 3, 4]
    x = f"(1 - {pr})" if reverse else pr
    rank = f"least(4, greatest(1, CAST(floor({x} * 3.99) AS INTEGER)))"
    if force_rank:
        return rank
    return (f"CASE WHEN list_unique({e}) < 5 THEN {rank} "
            f"WHEN {c} <= {e}[2] THEN {labels[0]} WHEN {c} <= {e}[3] THEN {labels[1]} "
            f"WHEN {c} <= {e}[4] THEN {labels[2]} ELSE {labels[3]} END")


def _rfm_sql(force_rank: bool) -> str:
    return f"""
sc AS (SELECT b.*,
         {_score('Recency', 'er', 'pr_r', True, force_rank)} AS Recency_Score,
         {_score('Frequency', 'ef', 'pr_f', False, force_rank)} AS Frequency_Score,
         {_score('Monetary', 'em', 'pr_m', False, force_rank)} AS Monetary_Score
       FROM base b JOIN pr USING (Customer), e),
rfm AS (SELECT Customer AS customer, Region AS region, Recency AS recency, Frequency AS frequency,
               round(Monetary, 0) AS monetary, Recency_Score AS recency_score, Frequency_Score AS frequency_score,
               Monetary_Score AS monetary_score, Recency_Score + Frequency_Score + Monetary_Score AS rfm_score,
               CASE WHEN Recency_Score + Frequency_Score + Monetary_Score >= 10 THEN 'Champions'
                    WHEN Recency_Score + Frequency_Score + Monetary_Score >= 8 THEN 'Loyal Customers'
                    WHEN Recency_Score + Frequency_Score + Monetary_Score >= 6 THEN 'Potential Loyalists'
                    WHEN Recency_Score + Frequency_Score + Monetary_Score >= 4 THEN 'At Risk'
                    ELSE 'Lost' END AS segment
        FROM sc)"""


RFM_CTES = _RFM_BASE + "," + _rfm_sql(False)


@register("rfm_base", "SELECT Customer, Region, Recency, Frequency, Monetary FROM base", _RFM_BASE)
def q_rfm_base(spark, d):
    return cu.rfm_base(sales_view(spark, d), SNAPSHOT)


@register("rfm", "SELECT * FROM rfm", RFM_CTES)
def q_rfm(spark, d):
    return cu.rfm(sales_view(spark, d), SNAPSHOT)


@register("rfm_fallback", "SELECT * FROM rfm", _RFM_BASE + "," + _rfm_sql(True))
def q_rfm_fallback(spark, d):
    return cu.rfm(sales_view(spark, d), SNAPSHOT, force_rank=True)


@register("rfm_segments", "SELECT segment, COUNT(*) AS customers FROM rfm GROUP BY segment", RFM_CTES)
def q_rfm_segments(spark, d):
    return cu.segment_sizes(cu.rfm(sales_view(spark, d), SNAPSHOT))


@register("rfm_segment_filter", "SELECT * FROM rfm WHERE segment = 'At Risk'", RFM_CTES)
def q_rfm_segment_filter(spark, d):
    return cu.filter_segment(cu.rfm(sales_view(spark, d), SNAPSHOT), "At Risk")


_COHORT_CTES = """
act AS (SELECT DISTINCT Customer, CAST(date_trunc('month', Date) AS DATE) AS ym FROM sales
        WHERE Customer IS NOT NULL AND Date IS NOT NULL),
c AS (SELECT Customer, ym, min(ym) OVER (PARTITION BY Customer) AS cohort FROM act),
g AS (SELECT cohort, CAST(date_diff('month', cohort, ym) AS INTEGER) AS age, COUNT(*) AS active FROM c GROUP BY 1, 2),
ret AS (SELECT strftime(cohort, '%Y-%m') AS cohort, age, active,
               max(CASE WHEN age = 0 THEN active END) OVER (PARTITION BY cohort) AS size,
               max(age) OVER () AS max_age FROM g),
retention AS (SELECT cohort, age, active, size, round(CAST(active AS DOUBLE) / size * 100, 1) AS retention, max_age FROM ret)"""


@register("cohort_retention", "SELECT * FROM retention", _COHORT_CTES)
def q_cohort_retention(spark, d):
    return cu.cohort_retention(sales_view(spark, d))


@register("cohort_recent", """
SELECT * FROM retention WHERE age <= 12
AND cohort IN (SELECT DISTINCT cohort FROM retention ORDER BY cohort DESC LIMIT 16)""", _COHORT_CTES)
def q_cohort_recent(spark, d):
    return cu.cohort_recent(cu.cohort_retention(sales_view(spark, d)), 16, 12)


@register("cohort_matrix")
def q_cohort_matrix(spark, d):
    return cu.cohort_matrix(cu.cohort_retention(sales_view(spark, d)))
