import random

from pyspark.sql import functions as F

from oscilla.llm import urls
from oscilla.llm.queries import RULES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate(UPPER), tail[:end]


def brute(url, rules, default="allow"):
    host, path = parse(url)
    fit = [(-len(h + p), -len(h), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def judged(spark, pages, rules, **more):
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = urls.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), known, **more)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "https://a.Example.com/en/x?y#z", "https://www.example.com/en/", "https://www.example.com/en", "http://x.net/es/1",
    "http://net/fr/", "http://net/de/", "http://example.com", "http://example.com?/en/", "a://b://c.com/", "http://xexample.com/en/", "http://example.com:80/en/", "http://.com/", "http://É.com/en/",
    "x\ny://a.com/en/\n?q", "http://a..com//en//",
]


def test_contract_rules(spark):
    got = judged(spark, URLS, RULES)
    assert got == {k: brute(u, RULES) for k, u in enumerate(URLS)}


def test_any_rules_against_brute_force_with_colliding_prefixes(spark):
    r = random.Random(4)
    host = lambda: ".".join(r.choices(["a", "b", "com", "x-y"], k=r.randint(1, 3)))
    path = lambda: r.choice(["", "/", "/a", "/a/", "/a/b", "/ab/", "/a/b/c", "//"])
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(60)]
    pages = [f"http://{host()}{path()}{path()}{r.choice(['', '?q', '#f'])}" for _ in range(200)]
    want = {k: brute(u, rules, "block") for k, u in enumerate(pages)}
    for more in ({"prefix_hex": 1}, {}):
        assert judged(spark, pages, rules, default="block", **more) == want


def test_rules_beyond_the_broadcast_bound_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 2)
    assert judged(spark, URLS, RULES) == {k: brute(u, RULES) for k, u in enumerate(URLS)}


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")] * 3, "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2), "digest": F.lit(3), "best": F.lit("b")})
    rows = urls.judge_urls(pages, rules).collect()
    assert len(rows) == 3 and {(r["host"], r["verdict"], r["rule"], r["digest"]) for r in rows} == {("a.com", "allow", "com/", 3)}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_megabyte_of_directories_or_labels(spark):
    import time

    pages = ["http://example.com/en/" + "d/" * 500_000, "http://" + "a." * 500_000 + "www.example.com/en/", "http://x.net/" + "/" * 500_000, "x" * 1_000_000, "http://net/es/" + "é" * 500_000]
    began = time.time()
    assert judged(spark, pages, RULES) == {k: brute(u, RULES) for k, u in enumerate(pages)}
    assert time.time() - began < 60
    deep = [("com", "/a/b/c/d/", "block"), ("x.y.z.com", "/a/", "allow"), ("com", "", "block")]
    urls_ = ["http://x.y.z.com/a/b/c/d/e", "http://q.x.y.z.com/a/b", "http://z.com/a/b/c/d", "http://com/a/b/c/d/", "http://org/a/b/c/d/"]
    assert judged(spark, urls_, deep) == {k: brute(u, deep) for k, u in enumerate(urls_)}


def test_any_internal_name_may_be_a_column(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", 5, 6, 7, "s")], "page_id long, url string, __best int, best int, _best int, short string")
    (row,) = urls.judge_urls(pages, rules).collect()
    assert (row["__best"], row["best"], row["_best"], row["short"], row["rule"]) == (5, 6, 7, "s", "com/")
