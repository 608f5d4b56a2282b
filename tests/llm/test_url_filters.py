import random

from lorebase.llm import url_filters as U

SCHEMA = "page_id long, url string, html string"


def plain(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], SCHEMA)
    rows = U.judge_urls(pages, spark.createDataFrame(rules, U.RULE_TYPE), **options).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_nested_rules_equal_plain_matching(spark):
    rnd = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "é.org", "A.Com", "a.com.", "a..com", ""]
    paths = ["", "/", "/e", "/en", "/en/", "/en/1", "/en/12", "/é/x", "/en/1\U0010ffff", "//"]
    rules = list({(h.lower(), p): (h.lower(), p, rnd.choice(["allow", "block"])) for h in hosts[:8] for p in paths if rnd.random() < 0.5}.values())
    urls = [f"{rnd.choice(['http', 'x', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/en/1', '#/en', '/more'])}" for _ in range(400)] + [None, "", "no scheme", "://", "http://com/en/1\n", "a://b://com/"] + ["http://b.a.com/en/1"] * 300
    want = {i: plain(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want == judged(spark, urls, rules, sweep=1)


def test_rules_that_repeat_none_and_empty_tables(spark):
    assert judged(spark, ["http://a.com/"], [("com", "/", "allow"), ("COM", "/", "block"), ("com", None, "allow"), ("", "/", "block"), (None, "/", "block")])[0][2:] == ("com/", "block")
    assert judged(spark, ["http://a.com/", None], [], default="block") == {0: ("a.com", "/", None, "block"), 1: ("", "", None, "block")}
    assert judged(spark, [], U.RULES) == {}
