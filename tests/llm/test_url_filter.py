"""URL rules against a plain loop over them."""

import re

import duckdb

from gridloom.llm import url_filter

from .odd import LOWER


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/7x?q", "https://a.b.example.com/en/8", "http://example.net/de/8", "http://x.example.net/de/9#a", "http://com/en/", "http://xcom/en/", "ftp://org?/es/", "http://m.org/es/a?b://c", "http://com", "://net/de/", "x://y://com/en/", "http://A.NET/DE/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(5, urls[5], "x", "y")], "page_id long, url string, verdict string, k string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == ((host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")), r
    assert url_filter.judge(pages.where("page_id < 0"), url_filter.rules_frame(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rules_frame(spark).where("false")).collect()} == {"allow"}


def test_long_urls_and_clashing_columns(spark):
    """A host of 500,000 labels and a path of a million characters; columns named like the operator's own."""
    urls = ["http://" + "a." * 500_000 + "example.com/en/7", "http://example.com/en/7" + "x" * 1_000_000, "http://" + "." * 30_000 + "com/en/", "://" * 300_000]
    pages = spark.createDataFrame([(k, u, 1, 2, 3, 4) for k, u in enumerate(urls)], "page_id long, url string, keys int, page int, row int, Verdict int")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["keys"], r["page"], r["row"]) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    assert got == {0: ("example.com/en/7", "allow", 1, 2, 3), 1: ("example.com/en/7", "allow", 1, 2, 3), 2: ("com/en/", "block", 1, 2, 3), 3: (None, "allow", 1, 2, 3)}


def test_many_rules(spark, monkeypatch):
    """Rules enough to fill blocks of the filter, with and without a broadcast."""
    rules = [("block" if k % 3 else "allow", f"h{k % 400}.net", f"/p{k % 7}" if k % 2 else "") for k in range(3000)]
    pages = spark.createDataFrame([(k, f"http://s.h{k % 500}.net/p{k % 9}/x") for k in range(2000)], "page_id long, url string")
    listed = {}
    for v, h, p in rules:
        listed[h, p] = max(v, listed.get((h, p), ""))
    for most in (1 << 16, 10):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
        got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")).collect()
        assert len(got) == 2000
        for r in got:
            fits = [(len(h + p), len(h), h + p, v) for (h, p), v in listed.items() if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
            assert (r["rule"], r["verdict"]) == (max(fits)[2:] if fits else (None, "allow"))


def test_op9_beside_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = sorted(con.execute(f"select page_id, host, path, rule, verdict from ({url_filter.OP9_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in url_filter.op9_url_filter(spark, folder).collect()), key=str) == want
