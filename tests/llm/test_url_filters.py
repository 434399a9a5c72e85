import random
import re

import strandline.llm.url_filters as uf

RULE = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [((h + p), len(h), v == "block", v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: (len(x[0]), x[1], x[2]), default=None)
    return host, path, best and best[0], best[3] if best else default


def test_nested_rules_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(uf, "RANGE_ROWS", 60)
    monkeypatch.setattr(uf, "BOUND_CHARS", 9)
    rnd = random.Random(2)
    labels = ["a", "b", "a-b", "com", "net", "é", "B"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/x', '/x/y', '/xy?q#f', '?q', '#/x'])}" for _ in range(500)]
    urls += [None, "", "no scheme/x", "://", "x://", "http://com\n/x", "http://..com/x", "ftp://a://b.com/x", "https://com/" + "x" * 50_000] + ["https://www.com/x/y"] * 300
    rules = sorted({(h.lower(), p): (h.lower(), p, rnd.choice(["allow", "block"])) for h, p in [(rnd.choice(hosts), rnd.choice(["", "/", "/x", "/x/"])) for _ in range(40)] + [("com", "/x"), ("com", "")]}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'k' as rule", "1 as range")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(pages, spark.createDataFrame([*rules, (None, "/", "block")], RULE)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_query_and_empty(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.op1_url_filters(spark, sf_dir).collect()}
    assert got == {r.page_id: brute(r.url, uf.RULES) for r in pages.collect()}
    rules = spark.createDataFrame(uf.RULES, RULE)
    assert uf.filter_urls(pages.limit(0), rules).count() == 0
    two = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, None)], "page_id long, url string")
    assert sorted((r.verdict, r.rule or "") for r in uf.filter_urls(two, rules).collect()) == [("allow", ""), ("block", "com/en/"), ("block", "com/en/")]
    assert uf.filter_urls(two, rules.limit(0), default="block").where("verdict = 'block' and rule is null").count() == 3
