"""URL filters: curated host and path rules first, mined association rules for the rest.

FP-growth mines combinations of URL tokens from labelled pages, with the label as one more item.
Rules "tokens -> blocked" are kept by support and confidence; a rule is dropped when a part of
its tokens already carries a rule at least as confident. A kept rule is indexed under its rarest
token; a url meets the rules of its own tokens only, and then must hold all their tokens.

All of it is DataFrame work on the JVM. Cases: a null url, or one without ``://``, has an empty
host and path, fits no rule and is allowed by the method unless its tokens are blocked (it has
none). Labels that are null, or that name no page, teach nothing. Without blocked labels there is
no mined rule. Repeated rows are judged alike, one result for each row.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

#: (verdict, host, path), fixed by the contract
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCKED = "\x01blocked"
#: A rule needs this share of the labelled pages, and this many of them.
MIN_SUPPORT = 0.002
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "\\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)\\A[^/?#]*(.*)\\z", 1)
    return host, F.regexp_extract(path, "\\A[^?#]*", 0)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels with their depth from the right, and the path's words."""
    labels = F.reverse(F.split(host, "\\."))
    deep = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.split(F.translate(path, UPPER, LOWER), "[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(deep, words), lambda x: ~x.isin("p:", "h0:") & ~x.rlike("^p:[0-9]+$")))


def mined_rules(pages: DataFrame, labels: DataFrame, *, blocked: Column, id_col: str = "page_id", label_id: str = "doc_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, anchor, confidence): pruned rules; anchor is the rule's rarest token."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    told = labels.select(F.col(label_id).cast("long").alias("__id"), F.coalesce(blocked, F.lit(False)).alias("__bad")).where("__id is not null")
    told = told.groupBy("__id").agg(F.max("__bad").alias("__bad"))
    seen = pages.select(F.col(id_col).cast("long").alias("__id"), url_tokens(host, path).alias("tokens")).where("size(tokens) > 0")
    baskets = staged(seen.join(told, "__id").select(F.when(F.col("__bad"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items")))
    # the share stays below 1 where there are fewer labelled pages than a rule needs: then no rule passes
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_pages / n)), minConfidence=min_confidence).fit(baskets)
    itemsets = model.freqItemsets.where(F.col("freq") >= min_pages)
    alone = itemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED))
    rules = rules.where(F.col("support") * n >= min_pages - 0.5).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    anchored = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(alone, "t")
    rules = staged(anchored.groupBy("tokens", "confidence").agg(F.min_by("t", F.struct("freq", "t")).alias("anchor")))
    # a rule goes when a part of its tokens has a rule at least as confident; it holds the part's anchor
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"), F.col("anchor").alias("t"))
    whole = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    smaller = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    covered = whole.join(part, "t").where(smaller).select("tokens").distinct()
    return staged(rules.join(covered, "tokens", "left_anti"))


def _rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null when none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, mined: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence), one row for each page."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rule, verdict = _rule_columns(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumns({"rule": rule, "listed": verdict})
    # the method judges each distinct (host, path) once
    asked = base.where("listed is null").select("host", "path").distinct()
    tokens = asked.withColumn("own", url_tokens(F.col("host"), F.col("path")))
    met = tokens.select("host", "path", "own", F.explode("own").alias("anchor")).join(mined, "anchor")
    hit = met.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("host", "path").agg(F.max("confidence").alias("confidence"))
    out = base.join(staged(hit), ["host", "path"], "left")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", by_method).alias("verdict"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"))
