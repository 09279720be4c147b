import re

import pytest

from skyweft.llm import queries, url_rules

RULES = [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b", None, "allow"), ("a.b", "/", "block"), (None, "/x", "block"), ("", "/", "block"), ("\u00e9.fr", "/\u00fc", "block")]
URLS = ["http://x.Example.net/en/1?q#f", "https://example.net/en", "ftp://net", "http://net/", "//net/", "http://internet/", "http://a.net?x=http://b.com/de/",
        "http://example.com/de/", "http://my.example.com/de", "http://www.example.org/fr/#t", None, "", "no scheme", "http://", "http:///en/", "http://A.B/z", "a://c.a.b/",
        "http://\u00e9.fr/\u00fcber", "http://\u00c9.fr/\u00fcber", "http://u:p@h.net:80/x", "http://" + "s." * 300 + "net/" + "y" * 20000, "http://.net/", "http://net./", "http://a..net/\n/"]


def brute(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        rest = (url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = {}
        for h, p, verdict in rules:
            h, p = "".join(c.lower() if "A" <= c <= "Z" else c for c in h or ""), "/" if p is None else p
            if h and (host == h or host.endswith("." + h)) and path.startswith(p):
                key = (len(h + p), len(h), h + p)
                fits[key] = "block" if "block" in (verdict, fits.get(key)) else verdict
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], fits[best] if best else default))
    return sorted(out, key=repr)


def frame(spark, urls):
    return spark.createDataFrame([(p, u, "clash", 1) for p, u in urls], "page_id long, url string, host string, rule int")


@pytest.mark.parametrize("array_bytes", [1 << 20, 0])
def test_equal_to_brute_force(spark, array_bytes):
    urls = [*enumerate(URLS), (None, URLS[0]), (3, URLS[0]), (3, URLS[0])]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge(frame(spark, urls), rules, array_bytes=array_bytes, shard_rules=3)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(urls, RULES)


@pytest.mark.parametrize("array_bytes", [1 << 20, 0])
def test_empty_tables_and_default(spark, array_bytes):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge(frame(spark, []), none, array_bytes=array_bytes - 1).collect() == []
    got = url_rules.judge(frame(spark, [(1, "http://x.net/")]), none, default="block", array_bytes=array_bytes - 1)
    assert [tuple(r) for r in got.collect()] == [(1, "x.net", "/", None, "block")]


def test_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_rules, "digest", lambda key: len(key))
    keys = [b"net/", b"org/", b"com/", b"example.net/"]
    url_rules.write_array(str(tmp_path / "a"), [(k, k == b"org/") for k in keys] + [(b"net/", True)])
    array = url_rules.DigestArray(str(tmp_path / "a"))
    places = array.find([*keys, b"xyz/", b""])
    assert list(places[4:]) == [-1, -1] and len(set(places[:4].tolist())) == 4
    assert [bool(array.blocked[p]) for p in places[:4]] == [True, True, False, False]


def test_query_reads_the_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    got = queries.QUERIES["op12_url_rules"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([tuple(r) for r in pages.collect()], queries.URL_RULES)
