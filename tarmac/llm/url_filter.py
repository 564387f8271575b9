"""URL filter: path rules, else logistic regression on hashed character n-grams, in DataFrame functions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end; null or no ``://``: both empty. A rule (verdict, host suffix, path prefix) fits its host and all subdomains
if the path starts with the rule's path; the longest rule wins.

Model: character n-grams (``GRAMS``) of the host, framed by dots, and of the path, each with its own prefix, hashed to
``BUCKETS`` buckets (0/1 features). Host and path are evidence each: the built-in labelled table has neutral hosts with
wanted and with unwanted paths, and unwanted hosts with neutral paths. The labelled table is small; its rows become (url, bucket) pairs and batch
gradient descent runs as grouped sums over them. The weights, one for each bucket that the table touches, are
broadcast: their number is bounded by BUCKETS. Hosts repeat, so scores are sums over the n-grams of each row itself.

Cases: a null url has an empty host and path and scores the model's intercept; rows of the labelled table without url
or label are ignored; an empty labelled table gives probability 0.5, which allows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import LOWER, UPPER

GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
STEPS = 30
MOMENTUM, RIDGE = 0.8, 1e-3
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))

# The small labelled table: made-up hosts of unwanted (1) and wanted (0) kinds.
UNWANTED = ("casino-royal.example", "www.casino-win.example", "online-casino.example", "best-bets.example",
            "free-bets.example", "sports-bets.example", "poker-win.example", "slots-jackpot.example",
            "cheap-pills.example", "buy-pills.example", "pills-shop.example", "cheap-meds.example",
            "adult-x.example", "adult-cams.example", "xxx-adult.example", "sex-chat.example", "porn-tube.example",
            "spam-farm.example", "link-farm.example", "spam-mail.example", "ads-track.example",
            "track-ads.example", "ads-click.example", "click-track.example", "popup-ads.example",
            "fast-loans.example", "payday-loans.example", "win-prize.example", "free-crypto.example",
            "warez-crack.example", "torrent-crack.example", "replica-watch.example")
WANTED = ("news.example", "www.daily-news.example", "blog.gardening.example", "m.weather.example",
          "docs.library.example", "university.example", "museum.example", "www.recipes.example",
          "travel.example", "blog.cooking.example", "science.example", "health.example", "m.sports.example",
          "history.example", "music.example", "books.example", "city-council.example", "hospital.example",
          "school.example", "wiki.example", "forum.example", "www.photo.example", "code.example",
          "research.example", "theatre.example", "railway.example", "farming.example", "winter.example",
          "better.example", "trackside.example", "address.example", "blog.nature.example")
ENDS = ("", ".com", ".org", ".net")  # of hosts; they say nothing
PATHS = ("/en/1201", "/de/77.html", "/fr/5155", "/es/9123/")
# Paths that are the evidence, whatever the host (1), and paths of ordinary pages (0), which do not clear a host.
UNWANTED_PATHS = ("/casino/poker-bonus.html", "/en/online-casino/", "/free-slots/jackpot", "/poker/win-big.html",
                  "/best-bets", "/sports-betting/odds", "/buy-cheap-pills.html", "/pharmacy/viagra",
                  "/cheap-meds/list", "/adult/cams/live", "/xxx/videos.html", "/porn/tube", "/sex-chat/rooms",
                  "/adult-video", "/payday-loans/apply", "/fast-loans.html", "/ads/click", "/track/popup-ads",
                  "/free-crypto/claim", "/win-prize/now.html", "/warez/crack", "/torrent/keygen-crack.html",
                  "/es/replica-watches/", "/spam/links.html")
WANTED_PATHS = ("/news/2021/05/weather.html", "/en/history/museum", "/blog/gardening-tips", "/recipes/bread.html",
                "/docs/api/index.html", "/science/article/12", "/de/wetter/heute", "/fr/musique/concert", "/about.html",
                "/contact/", "/books/reviews/8", "/travel/city-guide", "/health/sleep.html", "/sports/football/results",
                "/es/cocina/pan", "/school/library/hours", "/wiki/Railway", "/forum/thread/331", "/photo/album/5",
                "/code/python/tutorial", "/research/papers.html", "/theatre/tickets/2", "/", "/index.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the built-in labelled table. Host and path are told apart: an unwanted host stays unwanted with
    sample and ordinary paths, and a wanted host is wanted with those and unwanted with unwanted paths."""
    def dealt(paths, i, n):
        return [paths[(5 * i + k) % len(paths)] for k in range(n)]

    rows = [(h + e + p, 1) for i, h in enumerate(UNWANTED) for e in ENDS for p in (*PATHS, *dealt(WANTED_PATHS, i, 3))]
    rows += [(h + e + p, 0) for i, h in enumerate(WANTED) for e in ENDS
             for p in (*PATHS, *dealt(WANTED_PATHS, i, 16))]
    rows += [(h + e + p, 1) for i, h in enumerate(WANTED) for e in ENDS for p in dealt(UNWANTED_PATHS, i, 4)]
    rows = [f"('https://{url}', {y})" for url, y in rows]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label)")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)) if rule is None else rule.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """Buckets of the n-grams of ``text``."""
    def of_length(n):
        last = F.length(text) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))),
                                                F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of_length(n) for n in GRAMS])


def buckets_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_grams(F.concat(F.lit("."), host, F.lit(".")), "h"), _grams(path, "p")))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[float, dict[int, float]]:
    """(intercept, weight by bucket): batch gradient descent with momentum on the log loss with a ridge.

    A gradient is a grouped sum over the n-grams of the rows; the step of a weight is the inverse of its curvature bound,
    a quarter of the features of the rows that have it.
    """
    rows = (labelled.filter("url IS NOT NULL AND label IS NOT NULL").distinct()
            .select(F.col("label").cast("double").alias("y"),
                    buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("b"))).persist()
    try:
        n, positive = rows.agg(F.count("*"), F.avg("y")).first()
        if not n or not 0 < positive < 1:
            return (0.0 if not n else math.log((positive * n + 0.5) / ((1 - positive) * n + 0.5))), {}
        bounds = rows.select((F.size("b") + 1).alias("s"), F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b"))
        rate = {r["b"]: 1 / (r["s"] / 4 + (RIDGE * n if r["b"] >= 0 else 0.0))  # at most BUCKETS + 1 rows
                for r in bounds.groupBy("b").agg(F.sum("s").alias("s")).collect()}
        bias, weights, moved, moved_bias = math.log(positive / (1 - positive)), {}, {}, 0.0
        for _ in range(steps):
            miss = rows.select((F.col("y") - 1 / (1 + F.exp(-logit(F.col("b"), bias, weights)))).alias("e"), "b")
            sums = (miss.select("e", F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b")).groupBy("b")
                    .agg(F.sum("e").alias("g")))
            gain = {r["b"]: r["g"] for r in sums.collect()}  # at most BUCKETS + 1 rows
            moved_bias = MOMENTUM * moved_bias + rate[-1] * gain.pop(-1, 0.0)
            bias += moved_bias
            for k in sorted(gain):
                moved[k] = MOMENTUM * moved.get(k, 0.0) + rate[k] * (gain[k] - RIDGE * n * weights.get(k, 0.0))
                weights[k] = weights.get(k, 0.0) + moved[k]
        return bias, weights
    finally:
        rows.unpersist()


def logit(buckets: Column, bias: float, weights: dict[int, float]) -> Column:
    """Intercept plus the weights of an array of buckets (the weights are one constant array)."""
    if not weights:
        return F.lit(bias)
    dense = ",".join(f"{weights[k]:.6g}" if k in weights else "0" for k in range(BUCKETS))
    table = F.split(F.lit(dense), ",").cast("array<double>")
    return F.aggregate(buckets, F.lit(bias), lambda a, b: a + F.element_at(table, b + 1))


def judge(pages: DataFrame, model: tuple[float, dict[int, float]], rules=RULES, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability): probability is that of an unwanted url."""
    bias, weights = model
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("probability", 1 / (1 + F.exp(-logit(
        buckets_of(F.col("host"), F.col("path")), bias, weights))))
    learnt = F.when(F.col("probability") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"),
                         "probability")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``judge`` with a model of the given or the built-in labelled table."""
    return judge(pages, train(labelled if labelled is not None else labelled_urls(pages.sparkSession)))
