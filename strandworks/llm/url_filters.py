"""URL filters: list rules by host and path, and association rules mined from the labels that the list gives.

The labels are the verdicts of the list; a url that no list rule fits has none, which is a label of its own and not the verdict
that it gets by default. A mined rule says which verdict a combination of URL tokens mostly has: it counts if enough of all
urls have the tokens and the verdict (support), if most urls with the tokens have that verdict, and so many that it is not by
chance (the lower end of Wilson's interval around the confidence), several times as many as urls at large (lift), and if no
part of the combination says the same as surely. Very many combinations are tried, so the interval is a wide one. So a site most of whose urls the list
blocks is blocked for the others too. A url without a list rule takes the verdict of the surest mined rule whose tokens it has;
where there is none, allow.

Null urls and urls without "://" have an empty host and an empty path, so no list rule fits them.
Repeated urls are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, pick, table, written

LABEL = "label="
UNLISTED = "none"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.7
MIN_LIFT = 2.0
#: Half the width of Wilson's interval in standard errors; 0 takes confidences as they are.
SURENESS = 2.58
#: Mined rules up to this many go to every task.
FEW_RULES = 50_000


class ListRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules that the task gives.
RULES = (
    ListRule("block", "com", "/en/"),
    ListRule("allow", "example.com", "/en/7"),
    ListRule("allow", "net", "/de/"),
    ListRule("block", "example.net", "/de/8"),
    ListRule("block", "org", "/es/"),
)


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def url_tokens(url: Column) -> Column:
    """Scheme, host labels with their depth from the right, path segments (numbers by their first digit), query keys, fragment."""
    host, path = url_host(url), url_path(url)
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, r"^(\d)\d*", "$1#"), r"\d+$", "#")
    keys = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda s: s != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))),
            F.transform(labels, lambda s, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), s)),
            F.transform(segments, lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), shape(s))),
            F.transform(keys, lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))),
            F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
        )
    )


def match_rules(urls: DataFrame, rules: tuple[ListRule, ...]) -> DataFrame:
    """urls (url, host, path) with rule and rule_verdict of the longest fitting rule, null where none fits.

    The list is indexed by host: each url looks up the suffixes of its host in one map literal, whose size is that of the
    given list, and keeps the longest rule whose path its own begins with.
    """
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    by_host: dict[str, list[ListRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    entry = lambda r: F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict"))
    index = F.create_map(*[x for host, rs in by_host.items() for x in (F.lit(host), F.array(*map(entry, rs)))])
    looked = F.flatten(F.filter(F.transform(host_suffixes(F.col("host")), lambda h: index[h]), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(looked, lambda r: F.startswith(F.col("path"), r["path"])))
    return urls.withColumn("_best", best).select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def wilson(share: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval around a share of n, z standard errors wide."""
    zz = F.lit(z * z)
    return (share + zz / (2 * n) - F.lit(z) * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float, sureness: float = SURENESS) -> DataFrame:
    """labelled (tokens, verdict) -> association rules (antecedent, verdict, confidence, support, lift) whose consequent is a verdict, not UNLISTED.

    Support is relative; confidence is at least min_confidence also at the lower end of its interval. A rule goes if one with
    a part of its tokens and no less confidence gives the same verdict.
    """
    rows = labelled.count()
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    says = F.startswith(F.col("consequent")[0], F.lit(LABEL)) & (F.col("consequent")[0] != LABEL + UNLISTED)
    having = F.greatest(F.round(F.lit(rows) * F.col("support") / F.col("confidence")), F.lit(1))  # urls with the tokens
    sure = wilson(F.col("confidence"), having, sureness) >= min_confidence if sureness else F.lit(True)
    rules = model.associationRules.where(says & (F.col("lift") >= min_lift) & sure).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support", "lift"
    )
    rules = written(rules.where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit(LABEL)))), "url-rules")
    # each rule looks up the parts of its tokens, of which it has no more than were frequent with it: an equality join
    part = F.explode(F.filter(subsets(F.col("antecedent")), lambda x: (F.size(x) > 0) & (F.size(x) < F.size("antecedent"))))
    general = rules.select(F.col("antecedent").alias("g"), F.col("verdict").alias("gv"), F.col("confidence").alias("gc"))
    shorter = rules.select("antecedent", "verdict", "confidence", part.alias("sub"))
    covered = shorter.join(general, (F.col("sub") == F.col("g")) & (F.col("verdict") == F.col("gv")) & (F.col("gc") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    return written(rules.join(covered, ["antecedent", "verdict"], "left_anti"), "url-rules")


def without_doubles(labelled: DataFrame, min_support: float) -> DataFrame:
    """labelled (tokens, verdict) without tokens that stand in the very rows that a later one (by name) stands in.

    A rule with both says no more than one with either, so verdicts stay; but a long url of very many rows is one token, where
    the combinations of its parts are more than can be counted. Rows of a token are told by their number and the sum of their
    hashes. The driver gets frequent tokens only, each in min_support of the rows at least.
    """
    rows = labelled.count()
    places = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(20,0)").alias("h")).groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    alike = places.where(F.col("n") >= min_support * rows - 1).groupBy("n", "h").agg(F.sort_array(F.collect_list("token"), asc=False).alias("tokens"))
    doubles = [r["token"] for r in alike.select(F.explode(F.slice("tokens", F.lit(2), F.size("tokens"))).alias("token")).collect()]
    return labelled.withColumn("tokens", F.array_except("tokens", F.array(*map(F.lit, doubles)))) if doubles else labelled


def subsets(items: Column) -> Column:
    """All sub-arrays of an array, in its order."""
    return F.aggregate(items, F.array(F.array().cast("array<string>")), lambda found, t: F.concat(found, F.transform(found, lambda x: F.array_append(x, t))))


def apply_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens), distinct -> (url, mined_verdict, mined_confidence, mined_rule) of the surest rule that fits: by confidence, then support, then tokens.

    Inverted index: a rule is filed under the rarest of its tokens among the urls, so a url meets it once and few urls meet it
    in vain; the other tokens are then checked. The index is as large as the rules: it is broadcast if these are FEW_RULES at
    most, and joined by shuffle otherwise.
    """
    near = F.broadcast if rules.count() <= FEW_RULES else lambda x: x
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct()
    counts = written(urls.select(F.explode("tokens").alias("token")).join(near(wanted), "token").groupBy("token").count(), "token-counts")
    filed = rules.withColumn("id", F.monotonically_increasing_id()).select("*", F.explode("antecedent").alias("token")).join(counts, "token")
    key = filed.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("count", "token"))["token"].alias("key"), F.count("*").alias("known"))
    index = written(key.where(F.col("known") == F.size("antecedent")), "url-index")  # a rule with a token that no url has fits none
    met = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(near(index), "key")
    met = met.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", "verdict", "antecedent")).alias("best"))
    return best.select("url", F.col("best.verdict").alias("mined_verdict"), F.col("best.confidence").alias("mined_confidence"), F.array_join("best.antecedent", " ").alias("mined_rule"))


def filter_urls(pages: DataFrame, rules: tuple[ListRule, ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, sureness: float = SURENESS) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, mined_rule, mined_confidence.

    mined_rule has the tokens of the association rule that decided, and its confidence, where one did.
    """
    rows = pick(pages, "page_id", "url").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    judged = match_rules(rows, rules)
    labelled = judged.select(url_tokens(F.col("url")).alias("tokens"), F.coalesce("rule_verdict", F.lit(UNLISTED)).alias("verdict"))
    mined = mine_rules(without_doubles(labelled, min_support), min_support, min_confidence, min_lift, sureness)
    open_urls = judged.where(F.col("rule").isNull() & F.col("url").isNotNull()).select("url").distinct()
    # written before it is joined, as only then can the rows of a hot url be split
    found = written(apply_mined(open_urls.withColumn("tokens", url_tokens(F.col("url"))), mined).withColumnRenamed("url", "_url"), "judged-urls")
    out = judged.join(found, (F.col("url") == F.col("_url")) & F.col("rule").isNull(), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule", "mined_confidence")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
