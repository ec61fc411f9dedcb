import random

import pytest

from sortloom.llm import urls as U
from tests.llm.helpers import SF, duck, same

ODD = ["HTTP://Foo.COM/en/x?q#f", "https://example.com/en/7abc", "https://a.b.example.com/en/71", "http://com/en/", "http://xcom/en/", "http://.com/en/", "no scheme", "", None, "://", "http://", "http://org", "http://org/es", "http://org/es/", "http://u@h.org:80/es/#/x", "a://b://c.net/de/", "http://É.NET/de/1", "http://example.net/de/8", "http://x.example.net/de/80?y", "http://net?x/de/", "http://a..org/es/"]
RULES = U.RULES
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:at].translate(FOLD), rest[at:]
    path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fits = [((len(h) + len(p), len(h), v == "block", h, p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(None, None, "allow"))
    return host, path, best[1], best[2]


def rows(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_query_equals_sql(spark):
    assert same(U.op4_url_rules(spark, SF).toPandas(), duck(U.ORACLE))


@pytest.mark.parametrize("limit", [50_000, 0])
def test_equals_brute_force_broadcast_and_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rng = random.Random(2)
    hosts, paths = ["com", "a.com", "b.a.com", "org", "x.org"], ["", "/", "/a", "/a/", "/a/b", "/a/bc"]
    rules = RULES + sorted({(rng.choice(hosts), rng.choice(paths), rng.choice(("allow", "block"))) for _ in range(20)})
    urls = ODD + [f"http://{rng.choice(('', 'w.', 'v.w.'))}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', 'z', '?q', '#f'))}" for _ in range(300)] + ["http://hot.com/a/b"] * 200
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(rows(spark, urls), U.rules_frame(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_a_clash_of_short_prefixes_does_no_harm(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX", 1)
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(rows(spark, ODD), U.rules_frame(spark, RULES)).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(ODD)}


def test_no_rules_no_pages_and_other_columns(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in U.judge(rows(spark, ODD), none).collect()} == {"allow"}
    nulls = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert {r["verdict"] for r in U.judge(rows(spark, ODD), nulls, "allow").collect()} == {"allow"}
    assert U.judge(rows(spark, ODD).limit(0), U.rules_frame(spark, RULES)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/en/", "h", "p")] * 2, "page_id long, url string, host string, path string")
    assert [tuple(r) for r in U.judge(twice, U.rules_frame(spark, RULES)).collect()] == [(1, "a.com", "/en/", "com/en/", "block")] * 2
