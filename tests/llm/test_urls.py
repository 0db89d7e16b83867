import pytest

from lodestone.llm.urls import LISTED, Cascade, judge, read_list

URLS = [
    None, "", "no-scheme.com/x", "http://Example.COM/en/1?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/x", "https://www.example.com/de/",
    "http://x.net/es/1", "http://notnet/es/1", "http://net/fr/", "http://example.com", "http://example.com?x=/en/", "a://b://c.com/y", "http://casino-win.org/fr/", "http://www.casino-win.com/fr/",
    "http://spam-farm.example.net/de/", "http://xspam-farm.example.org/de/", "http://ÄX.Org/É", "http://xexample.com/en/", "://com/", "http://evil#com/", "http://x.org" + "/a" * 5000,
]
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best or ""):
            best = r
    return host, path, best, RULES[best] if best else "block" if set(host.split(".")) & set(LISTED) else "allow"


def test_judge(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == brute(URLS[r["page_id"]])
    with pytest.raises(ValueError):
        judge(pages, most_bits=1)
    assert judge(pages.limit(0)).collect() == []


def test_cascade_is_exact(spark):
    universe = spark.range(6000).selectExpr("concat('k', id) AS key")
    listed = universe.where("crc32(key) % 3 = 0").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    cascade = Cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    assert universe.where(cascade.holds(F.col("key")) != F.expr("crc32(key) % 3 = 0")).count() == 0
    assert Cascade.build(listed.limit(0), universe).levels == []


def test_a_list_of_a_hundred_thousand_keys_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# labels\n\n" + "".join(f"Bad{i}\n" for i in range(0, 300_000, 3)))
    pages = spark.range(60_000).selectExpr("id AS page_id", "concat('http://w.bad', id, '.org/') AS url")
    got = judge(pages, listed=read_list(spark, str(tmp_path / "list.txt")))
    assert got.where("listed <> (page_id % 3 = 0) OR (verdict = 'block') <> listed").count() == 0 and got.count() == 60_000
