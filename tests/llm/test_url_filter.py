from __future__ import annotations

import numpy as np

from otreelake.llm import url_filter as U
from otreelake.llm.queries import URL_RULES


def brute(url):
    host, path = U.split_url(url)
    best = None
    for rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}") and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best, URL_RULES[best] if best else "allow"


def test_split_url():
    assert U.split_url("http://A.Com/x?y#z") == ("a.com", "/x")
    assert U.split_url("http://É.com?q=/en/") == ("É.com", "")
    assert U.split_url("no scheme/x") == U.split_url(None) == ("", "")
    assert U.split_url("a://b://c/d") == ("b:", "//c/d")


def test_rules_against_brute_force(spark):
    urls = [None, "", "x", "http://", "https://www.example.com/en/1", "https://example.com/en/1", "https://blog.example.com/en", "https://a.b.com/", "https://com", "http://shop.net/es/x", "http://net/fr/", "http://notnet/fr/", "http://EXAMPLE.com/en/#x", "http://x.net/de/", "http://a.www.example.com/en/" + "y" * 10_000, "http://.com/", "http://a..com/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(4, urls[4], "x", "y")], "page_id bigint, url string, rule string, verdict string")
    got = sorted(tuple(r) for r in U.filter_urls(pages, URL_RULES).collect())
    want = sorted((i, *brute(u)) for i, u in [*enumerate(urls), (4, urls[4])])
    assert [tuple(str(x) for x in r) for r in got] == [tuple(str(x) for x in r) for r in want]


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert U.filter_urls(pages, URL_RULES).collect() == []
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert U.filter_urls(pages, {}, default="block").first()["verdict"] == "block"


def test_colliding_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda data: 7 if data.startswith(b"x") else 9)
    path = tmp_path / "f"
    path.write_bytes(U.digest_array({"x.com/": "block", "xy.com/": "allow"}))
    array = U.DigestArray(str(path))
    assert isinstance(array.keys.base, np.ndarray)
    found = array.probe(["x.com/", "xy.com/", "xz.com/", "a.com/"])
    assert [array.rule(i)[1] if i >= 0 else None for i in found] == ["x.com/", "xy.com/", None, None]
