"""Write PLANS.md: the final (AQE) physical plans of the headline queries.

Usage: python tools/plans.py [--sf DIR] [--out PLANS.md]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default="PLANS.md")
    a = ap.parse_args()

    from tarmac.operators import abc, bi, customers
    from tarmac.session import get_spark, scratch_path
    from tarmac.sources.fact import materialize_fact, read_fact
    from tarmac.sources.tables import sales_view

    spark = get_spark("local[8]", 16)
    path = scratch_path(spark, "plans-fact")
    materialize_fact(sales_view(spark, a.sf), path)
    fact = read_fact(spark, path)
    view = sales_view(spark, a.sf)
    cases = [
        ("Sales view from the given tables (monthly trend, PROMO in EUROPE)",
         bi.trend_monthly(view, category="PROMO", region="EUROPE")),
        ("KPIs with YoY on the written fact", bi.kpis(fact, current_year=2000, base_year=1999)),
        ("Top-10 products of 2000 (partition pruning, broadcast classes, TakeOrderedAndProject)",
         bi.products_top(fact, 10, year=2000)),
        ("Top-5 products per customer (partial WindowGroupLimit before the shuffle)",
         bi.customer_top_products(fact, k=5)),
        ("Cohort retention (partial collect_set, no join back)", customers.cohort_retention(fact)),
        ("ABC Pareto table", abc.abc_products(fact)),
    ]
    lines = ["# Physical plans", "",
             f"Final adaptive plans of headline queries, generated by `tools/plans.py` at `{a.sf}` on local[8].", ""]
    for title, df in cases:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0]
        lines += [f"## {title}", "", "```", final.rstrip(), "```", ""]
    with open(a.out, "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
