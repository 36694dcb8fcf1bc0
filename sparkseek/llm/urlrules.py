"""URL filters: fixed host and path rules first, then association rules mined from labels.

Association rules: the labelled URLs' tokens (host labels, path segments, query names) are
transactions, those of bad ones with one more item; FP-growth finds the frequent sets, and rules
that lead to that item with enough support, confidence and lift are kept.  Support is at least
``COUNT`` bad URLs, however few labels there are.  Confidence is smoothed: ``WEIGHT`` more URLs of the
labels' own rate of bad ones count with each rule, so a rule seen a few times must be surer than
one seen often.  A rule that holds
whenever a kept rule with fewer tokens does is pruned.  Rules are found by an inverted index on
the rarest token of each, and a candidate must hold all of the rule's tokens.  DataFrame and
MLlib operations only.

Labels carry document ids; a page is labelled by the label of its own id.

Defined results.  A null url or one without :// has an empty host and path, no tokens, no rule
and the verdict allow.  Only A-Z are lower-cased.  Rows with a null page_id are judged like
others; repeated rows give their rows.  Without labels or pages there are no association rules.
Extra columns are ignored."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Verdict, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SUPPORT, CONFIDENCE, LIFT, COUNT, WEIGHT = 0.005, 0.75, 1.2, 5, 2.0
BAD = "#bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:label of the host, p:segment of the path, q:name of the query."""
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.filter(F.concat(labels, segments, names), lambda x: F.length(x) > 2))


def mine(pages: DataFrame, labels: DataFrame, scratch: Scratch, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, anchor, confidence): the kept rules."""
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    rows = pages.select("page_id", "url").join(known, "page_id")
    items = rows.select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = scratch.write(items.where(F.size("items") > 0), "items")
    n, bad = items.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, COUNT / max(n, 1))), minConfidence=confidence).fit(items)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= LIFT))
    hits = F.round(F.col("support") * n)
    sure = (hits + WEIGHT * bad / max(n, 1)) / (hits / F.col("confidence") + WEIGHT)
    found = found.select(F.array_sort("antecedent").alias("tokens"), hits.alias("hits"), sure.alias("confidence")).where((F.col("hits") >= COUNT) & (F.col("confidence") >= confidence))
    found = scratch.write(found.withColumn("rule_id", F.xxhash64("tokens")), "found")
    often = scratch.write(model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq"), "often")
    anchor = found.select("rule_id", F.explode("tokens").alias("token")).join(often, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("a"))
    kept = scratch.write(found.join(anchor, "rule_id").select("rule_id", "tokens", "confidence", F.col("a.token").alias("anchor")), "rules")
    less = kept.select(F.col("anchor").alias("token"), F.col("tokens").alias("fewer"))
    wide = kept.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    implied = wide.join(less, "token").where((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0)).select("rule_id").distinct()
    return scratch.write(kept.join(implied, "rule_id", "left_anti"), "pruned")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, association) of every row of ``pages``."""
    scratch = Scratch(pages.sparkSession)
    rules = mine(pages, labels, scratch)
    urls = pages.select("url").where("url is not null").distinct().select("url", tokens_of(F.col("url")).alias("have"))
    hits = urls.select("url", "have", F.explode("have").alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("tokens", "have")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "rule_id")).alias("b"))
    rows = pages.select("page_id", "url").join(best, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = fixed_rule(host, path)
    mined = F.when(F.col("b").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(said, mined).alias("verdict"), F.col("b.rule_id").alias("association"))
