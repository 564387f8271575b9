"""URL parts, rules and the regression against plain computations."""

import math
import re

from pyspark.sql import functions as F
from tarmac.llm import url_filter as U

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.com/de/", "https://sub.example.com/de/1",
        "http://notexample.com/de/1", "ftp://x.org/fr/1", "http://x.org/FR/1", "http://example.net", "a://b://c/d",
        "https://h?q=/en/", "https://h#/x", "http://cheap-pills.example.org/en/1", "http://www.casino-win.example.com/1",
        "http://blog.garden.example.com/1", "x\ny://h\ni/p\nq"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(n + p, v) for v, n, p in U.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in U.filter_urls(df).collect():
        h, p = parts(URLS[r.page_id])
        assert (r.host, r.path) == (h, p)
        name, verdict = rule(h, p)
        assert r.rule == name
        assert r.verdict == (verdict or ("block" if r.probability > 0.5 else "allow"))


def test_model_tells_kinds_apart_on_unseen_hosts(spark):
    bad = ["best-casino.test", "www.casino-online.test", "cheap-meds-pills.test", "spam-links.test", "adult-video.test",
           "free-bets-today.test", "ads-track-pixel.test"]
    good = ["blog.thing.test", "www.weather-news.test", "library.test", "m.cooking.test", "history-books.test",
            "science.school.test"]
    df = spark.createDataFrame([(i, f"https://{h}/en/12") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.filter_urls(df).collect()}
    assert [got[i] for i in range(len(bad))] == ["block"] * len(bad)
    assert [got[i] for i in range(len(bad), len(bad + good))] == ["allow"] * len(good)


def test_verdicts_turn_on_the_path(spark):
    hosts = ["site.test", "www.page.test", "blog.thing.test", "library.test"]
    bad = ["/casino/poker-bonus.html", "/en/best-casino/9", "/cheap-pills/order", "/adult-video/3.html",
           "/free-bets-today", "/payday-loans.html"]
    good = ["/en/12", "/news/weather-today.html", "/de/museum/12", "/books/history.html", "/"]
    cases = [(h + p, "block") for h in hosts for p in bad] + [(h + p, "allow") for h in hosts for p in good]
    cases += [(h + p, "block") for h in ("best-casino.test", "cheap-meds-pills.test", "adult-video.test") for p in good]
    df = spark.createDataFrame([(i, f"https://{u}") for i, (u, _) in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert [(u, got[i].verdict, got[i].probability) for i, (u, v) in enumerate(cases) if got[i].verdict != v] == []


def test_training_lowers_the_loss_like_plain_descent(spark):
    lab = U.labelled_urls(spark)
    rows = lab.select("label", U.buckets_of(U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("b")).collect()
    for r in rows[:5]:
        assert len(r.b) == len(set(r.b)) and min(r.b) >= 0 and max(r.b) < U.BUCKETS

    def loss(model):
        bias, w = model
        out = 0.0
        for r in rows:
            x = bias + sum(w.get(k, 0.0) for k in r.b)
            out += math.log1p(math.exp(-x if r.label else x))
        return out / len(rows)

    losses = [loss(U.train(lab, n)) for n in (1, 8, 30)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, label int")
    assert U.train(none) == (0.0, {})
    df = spark.createDataFrame([(1, "http://x.test/")], "page_id long, url string")
    assert U.filter_urls(df, none).first().verdict == "allow"
    assert U.filter_urls(df.limit(0)).count() == 0
