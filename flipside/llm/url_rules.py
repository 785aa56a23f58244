"""URL filter by association rules, DataFrame operations only.

URLs that the given lists judge are labels, the others have none.  FP-growth
mines which combinations of URL tokens go with the label "block"; combinations
with enough support and confidence become rules, which are found for a URL
through an inverted index on each rule's rarest token.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.llm.common import UPPER, written

BLOCK = "label:block"


@dataclass(frozen=True)
class ListRule:
    """A host with its subdomains, and what the path starts with."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MiningConfig:
    """A rule needs `min_support` of the blocked labels, `min_count` of them at least."""

    min_support: float = 0.001
    min_count: int = 3
    min_confidence: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty when the url is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[ListRule]) -> DataFrame:
    """A list of rules as the table `longest_rules` joins: verdict, host, path."""
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `__rule`, struct (size, text, verdict) of the longest rule that fits columns host and path, or null.

    Rules are a table of any length.  A host is cut into its endings, of at most
    as many labels as a rule's host has, and its path into beginnings of the
    lengths that the ending's rules have; both meet the rules by equality.
    Of two rules of one length the greater text counts, then the greater verdict.
    """
    text = F.concat("host", "path")
    listed = written(rules.select("verdict", "host", "path", text.alias("text"), F.length(text).alias("size")).dropna(), "url-list")
    most = listed.agg(F.max(F.size(F.split("host", r"\."))).alias("m")).first()["m"] or 0
    lengths = listed.groupBy(F.col("host").alias("ending")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    take = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most))))
    endings = F.transform(take, lambda k: F.array_join(F.slice(labels, -k, k), "."))
    near = urls.select("host", "path").distinct().withColumn("ending", F.explode(endings)).join(lengths, "ending")
    near = near.withColumn("n", F.explode("lengths")).filter(F.length("path") >= F.col("n"))
    near = near.select("host", "path", "ending", F.left("path", F.col("n")).alias("beginning"))
    fits = near.join(listed.withColumnsRenamed({"host": "ending", "path": "beginning"}), ["ending", "beginning"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "text", "verdict")).alias("__rule"))
    return urls.join(best, ["host", "path"], "left")


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: site, name and subdomain of the host, first folder, first digit, kind of ending."""
    labels = F.split("host", r"\.")
    count = F.size(labels)
    folders = F.filter(F.split("path", "/"), lambda s: s != "")

    def some(prefix: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(prefix), value))

    digit = F.regexp_extract("path", r"/(\d)\d*[^/]*/?$", 1)
    after = F.coalesce(F.regexp_extract(url, r"[?#](.*)$", 1), F.lit(""))
    ending = F.coalesce(
        F.when(F.contains(url, F.lit("?")), F.concat(F.lit("?"), F.regexp_extract(after, r"^([A-Za-z_]*)", 1))),
        F.when(F.contains(url, F.lit("#")), F.lit("#")),
        F.when(F.endswith("path", F.lit("/")), F.lit("/")),
        F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1),
    )
    tokens = F.array(
        some("site:", F.concat_ws(".", F.slice(labels, F.greatest(count - 1, F.lit(1)), 2)), F.col("host") != ""),
        some("name:", F.get(labels, count - 3), count >= 3),
        some("sub:", F.get(labels, F.lit(0)), count >= 4),
        some("dir:", F.get(folders, F.lit(0)), F.size(folders) >= 1),
        some("digit:", digit, digit != ""),
        some("end:", ending, ending != ""),
    )
    return F.array_sort(F.array_distinct(F.array_compact(tokens)))


def mine_rules(labelled: DataFrame, cfg: MiningConfig) -> DataFrame:
    """(antecedent, confidence, uses, key): token combinations that go with BLOCK.

    `labelled` has columns tokens and blocked.  `uses` counts the URLs that hold
    tokens and label, `key` is the antecedent's rarest token.
    """
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked")).first()
    # Counted among the blocked: more allowed URLs do not raise what a rule needs.
    least = max(cfg.min_count, math.ceil(cfg.min_support * size["blocked"]))
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens"))
    support = (least - 0.5) / max(size["n"], 1)  # FPGrowth rounds the count up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=cfg.min_confidence).fit(labelled.select(items.alias("items")))
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    with_label = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(
        F.array_remove("items", BLOCK).alias("antecedent"), F.col("freq").alias("uses")
    )
    held = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("all"))
    rules = with_label.join(held, "antecedent").withColumn("confidence", F.col("uses") / F.col("all")).filter(F.col("confidence") >= cfg.min_confidence)
    alone = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("seen"))
    keys = rules.select("antecedent", F.explode("antecedent").alias("token")).join(alone, "token").groupBy("antecedent").agg(
        F.min(F.struct("seen", "token"))["token"].alias("key")
    )
    return rules.join(keys, "antecedent").select("antecedent", "confidence", "uses", "key")


def judge_urls(pages: DataFrame, rules: Sequence[ListRule] | DataFrame, cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every row of `pages`.

    Reads page_id and url; `rules` is a list or a table (verdict, host, path).
    `rule` is the longest list rule that fits, which then decides; other URLs
    are blocked when a mined rule matches them and allowed otherwise.  URLs that
    a list rule judges are all that is learnt from: without blocked ones no rule
    is mined.  A null or odd url has no tokens and is allowed.  Repeated rows
    are judged alike; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    df = longest_rules(df.withColumn("tokens", url_tokens(F.col("url"))).drop("url"), table)
    rows = written(df.select("page_id", "host", "path", "__rule", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), "url-rows")
    labelled = rows.filter(F.col("__rule").isNotNull() & (F.size("tokens") > 0))
    mined = mine_rules(labelled.select("tokens", (F.col("__rule.verdict") == "block").alias("blocked")), cfg)
    # Equal token sets are judged once, whatever the number of their URLs.
    sets = rows.filter("__rule is null").groupBy("tokens").agg(F.count(F.lit(1)).alias("__n"))
    hits = sets.select("tokens", F.explode("tokens").alias("key")).join(mined, "key")
    hits = hits.filter(F.size(F.array_intersect("antecedent", "tokens")) == F.size("antecedent"))
    best = hits.groupBy("tokens").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("uses")).alias("u"), F.size("antecedent").alias("s"), F.array_join("antecedent", " ").alias("text")))["text"].alias("mined_rule")
    )
    out = rows.join(best, "tokens", "left")
    by_list = F.col("__rule").isNotNull()
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("__rule.text").alias("rule"),
        F.when(by_list, F.col("__rule.verdict")).when(F.col("mined_rule").isNotNull(), "block").otherwise("allow").alias("verdict"),
        F.when(~by_list, F.col("mined_rule")).alias("mined_rule"),
    )
