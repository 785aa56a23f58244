"""List rules and mined rules against plain loops."""

from collections import Counter
from itertools import combinations
from urllib.parse import urlsplit  # noqa: F401  (the parsing here is by the contract, not by the standard)

from pyspark.sql import functions as F

from flipside.llm.queries import URL_RULES
from flipside.llm.url_rules import ListRule, MiningConfig, host_and_path, judge_urls, url_tokens


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(url):
    host, path = plain_parts(url)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://example.org", "http://example.org/", "HTTP://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12.html",
    "https://example.org/en/2", "https://www.b.com/fr/", "https://b.com/de/1?x=1", "https://b.com/de", "ftp://com/fr/x", "a://b://c/d", "http://notorg/", "http://x.net/?q=/fr/",
    "http://x.net#/fr/", "http://ÄX.org/ü", "http://spam-farm.example.net/en/5", "http://example.com?u=1",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, tokens string, rule string")


def test_list_rules(spark):
    got = {r["page_id"]: r for r in judge_urls(pages(spark, URLS * 2), URL_RULES).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        rule = plain_rule(url)
        assert (got[i]["host"], got[i]["path"]) == plain_parts(url)
        assert got[i]["rule"] == (rule.text if rule else None)
        if rule:
            assert got[i]["verdict"] == rule.verdict
    assert [got[i]["verdict"] for i in (0, 1, 2)] == ["allow"] * 3


def mined_by_hand(tokens, rules_of, cfg):
    """Antecedents with enough blocked labels and confidence, by listing every combination."""
    held, hit = Counter(), Counter()
    for i, rule in rules_of.items():
        if rule:
            for k in range(1, len(tokens[i]) + 1):
                for c in combinations(tokens[i], k):
                    held[c] += 1
                    hit[c] += rule.verdict == "block"
    blocked = sum(r is not None and r.verdict == "block" for r in rules_of.values())
    least = max(cfg.min_support * blocked, cfg.min_count)
    return {c for c in held if hit[c] >= least and hit[c] / held[c] >= cfg.min_confidence}


SITES = [f"https://{'m.' * (i % 2)}{n}.example.{end}/{d}/{i}{e}" for i in range(30) for n in ("fine", "other") for end in ("org", "com", "net") for d in ("en", "es", "de") for e in ("", "#a")]


def test_mined_rules(spark):
    cfg = MiningConfig()
    df = pages(spark, SITES)
    got = {r["page_id"]: r for r in judge_urls(df, URL_RULES, cfg).collect()}
    host, path = host_and_path(F.col("url"))
    tokens = {r["page_id"]: tuple(r["t"]) for r in df.withColumns({"host": host, "path": path}).select("page_id", url_tokens(F.col("url")).alias("t")).collect()}
    listed = {i: plain_rule(u) for i, u in enumerate(SITES)}
    rules = mined_by_hand(tokens, listed, cfg)
    for i in range(len(SITES)):
        mined = any(set(c) <= set(tokens[i]) for c in rules)
        want = listed[i].verdict if listed[i] else "block" if mined else "allow"
        assert got[i]["verdict"] == want
        assert (got[i]["mined_rule"] is not None) == (listed[i] is None and mined)
    free = [got[i]["verdict"] for i in got if listed[i] is None]
    assert 0 < sum(v == "block" for v in free) < len(free)


def test_more_allowed_urls_change_no_verdict(spark):
    rules = [ListRule("block", "bad.test", ""), ListRule("allow", "good.test", "")]
    bad = [f"http://a.bad.test/x/{i}?id=1" for i in range(4)] + ["http://other.test/x/5?id=1"]
    good = [f"http://good.test/y/{i}.html" for i in range(20_000)]
    few = {r["page_id"]: r["verdict"] for r in judge_urls(pages(spark, bad + good[:3]), rules).collect()}
    many = {r["page_id"]: r["verdict"] for r in judge_urls(pages(spark, bad + good), rules).filter("page_id < 5").collect()}
    assert [few[i] for i in range(5)] == [many[i] for i in range(5)] == ["block"] * 5


def test_a_long_list_as_a_table(spark):
    rules = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 4).cast("string"), F.lit(".test")).alias("host"),
        F.concat(F.lit("/"), F.repeat(F.lit("p/"), (F.col("id") % 4).cast("int"))).alias("path"),
    )
    urls = ["http://s7.test/", "http://a.b.s7.test/p/p/p/p/x", "http://s7.test/p/q", "http://xs7.test/p/", "http://test/", "http://s4999.test/p/p/", "http://s7.test"]
    got = [r["rule"] for r in judge_urls(pages(spark, urls), rules).orderBy("page_id").collect()]
    assert got == ["s7.test/", "s7.test/p/p/p/", "s7.test/p/", None, None, "s4999.test/p/p/", None]


def test_very_long_urls_and_clashing_names(spark):
    urls = ["http://" + "a." * 60_000 + "example.org/es/1", "http://x.com/de/" + "p/" * 200_000, "http://x.com/" + "q" * 300_000 + "?" + "z" * 100_000]
    df = pages(spark, urls).withColumns({c: F.lit("mine") for c in ("host", "path", "verdict", "mined_rule", "key", "ending", "__rule", "n")})
    got = [(r["rule"], r["verdict"]) for r in judge_urls(df, URL_RULES).orderBy("page_id").collect()]
    assert got == [("example.org/es/", "block"), ("com/de/", "block"), (None, "allow")]


def test_no_rules_and_empty_table(spark):
    assert judge_urls(pages(spark, ["x"]).limit(0), URL_RULES).count() == 0
    assert [r["verdict"] for r in judge_urls(pages(spark, ["http://a.test/x", None]), []).collect()] == ["allow"] * 2
