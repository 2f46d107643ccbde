import re

from corvane.llm import urls
from corvane.llm.queries import QUERIES

SCHEMA = "page_id long, url string, host string, score int, at string"


def parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")


def rule_of(host, path):
    fit = [(h, p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def check(rows, weights):
    for r in rows:
        rule = rule_of(r.host, r.path)
        at = urls.buckets(r.host, r.path)
        z = weights[at].sum() / max(1, len(at)) ** 0.5 + weights[-1]
        assert r.rule == (rule[0] + rule[1] if rule else None)
        assert r.verdict == (rule[2] if rule else "block" if z >= 0 else "allow")


def weights():
    return urls.fit(sorted((*parts(u), b) for u, b in urls.labelled_table()))


def test_odd_urls(spark):
    given = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net", "http://x.net/", "http://net/q", "ftp://a.org/fr/x?y",
             "http://b.org/FR/x", "https://example.com/de/", "://", "a://b://c/d", "http://u:p@h.NET:80/x#y", "http://É.ORG/fr/", "http://xnet/",
             "http://example.com#/de/", "http://a\nb.net/\n?", "x" * 100_000, "http://" + "a" * 50_000 + "/" + "b" * 50_000, "http://b.org/fr/"]
    rows = [(i, u, "clash", 1, "clash") for i, u in enumerate(given)] * 2 + [(None, None, None, None, None)]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str((r.id, r.host, r.path)) for r in got) == sorted(str((r[0], *parts(r[1]))) for r in rows)
    check(got, weights())
    assert {r.verdict for r in got if r.host == "" and r.path == ""} == {"allow"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_held_out_urls(spark):
    blocked = ["http://www.spam-offers.test/en/9", "https://casino-royal.test/de/3", "http://pills-online.example.test/fr/1",
               "https://porn-cams.test/en/2", "http://poker-bonus.test/es/5", "https://xxx-tube.test/de/7"]
    allowed = ["http://blog.thandre.example.test/en/9", "https://www.observatory.test/de/3", "http://kitchen.example.test/fr/1",
               "https://m.rerenti.test/en/2", "http://archive.test/es/5", "https://news.town.test/de/7"]
    got = {r.url: r for r in spark.createDataFrame([(i, u) for i, u in enumerate(blocked + allowed)], "page_id long, url string")
           .join(urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(blocked + allowed)], "page_id long, url string"), rules=())
                 .withColumnRenamed("id", "page_id"), "page_id").collect()}
    right = sum(got[u].verdict == "block" for u in blocked) + sum(got[u].verdict == "allow" for u in allowed)
    assert right >= 11


def test_own_labelled_table(spark):
    table = spark.createDataFrame([("http://bad.test/a", True), ("http://good.test/a", False), (None, False)], "url string, blocked boolean")
    got = urls.judge(spark.createDataFrame([(1, "http://bad.test/b"), (2, "http://good.test/b")], "page_id long, url string"),
                     rules=(), labelled=table).collect()
    assert {r.id: r.verdict for r in got} == {1: "block", 2: "allow"}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: parts(r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_url_filter"](spark, sf).collect()
    assert {r.page_id: (r.host, r.path) for r in rows} == pages
    check(rows, weights())
