from pyspark.sql import functions as F

from parcelbook.llm.url_filters import RULES, build, judge, member


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "block" if "bad" in host else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q=/", "https://example.org/en/1234#a", "x://bad.net?u=/a", "http://notexample.org/es/", "http://org", "http://com/de/", "ftp://bad.com/fr/", "http://bad.com", "a://b://c.org/", "http://é.ORG/É/" + "x" * 100_000]


def test_matches_brute_force(spark):
    rows = [(i % 7, u, "h") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, judge(pages, RULES, F.col("host").contains("bad")).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u, _ in rows], key=str)
    assert judge(pages.limit(0), RULES, F.lit(True)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    levels = build(keys)
    assert len(levels) > 2
    assert keys.where(member(F.col("key"), levels) != F.col("listed")).count() == 0
    none = build(keys.withColumn("listed", F.lit(False)))
    assert not none and keys.where(member(F.col("key"), none)).count() == 0
