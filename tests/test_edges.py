"""Edge cases of the analyses: nothing sold, prices that explain units fully."""

import datetime

from tarmac.operators import abc, elasticity

COLS = ("Product_Name string, Category string, Date date, Year int, Month int, Units_Sold int, Unit_Price double, "
        "Revenue double")


def fact(spark, rows):
    return spark.createDataFrame([(p, c, d, d.year, d.month, u, pr, rev) for p, c, d, u, pr, rev in rows], COLS)


def test_abc_without_revenue(spark):
    day = datetime.date(2020, 1, 1)
    s = fact(spark, [("a", "x", day, 1, 0.0, 0.0), ("b", "x", day, 1, 0.0, 0.0)])
    assert abc.abc_products(s).count() == 2
    assert {r["revenue_pct"] for r in abc.abc_summary(s).collect()} == {0.0}


def test_elasticity_of_a_perfect_fit(spark):
    rows = []
    for m in range(1, 9):
        price = float(2 ** m)
        units = 2 ** (10 - m)
        rows.append(("a", "x", datetime.date(2020, m, 1), units, price, price * units))
    got = elasticity.elasticity(fact(spark, rows)).collect()
    assert len(got) == 1 and abs(got[0]["elasticity"] + 1) < 1e-9
