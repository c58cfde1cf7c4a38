"""URL filters: listed rules first, then association rules that FP-growth mines from URLs with known verdicts."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<n, rule, verdict> of the longest of rules (verdict, `host/path`) that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules are a configured list.
    """
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fit = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host and its last two, segments of the path by depth, query keys."""
    labels = F.split(host, r"\.")
    ends = F.concat(F.lit("end="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    segments = F.transform(F.split(F.lower(path), "/"), lambda s, i: F.concat(F.lit("path"), F.least(i, F.lit(4)).cast("string"), F.lit("="), s))
    query = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1)
    tokens = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)), F.array(ends), segments, F.transform(query, lambda q: F.concat(F.lit("query="), q))
    )
    return F.array_distinct(F.filter(tokens, lambda t: ~t.endswith("=")))


def token_classes(urls: DataFrame, min_count: float) -> DataFrame:
    """(token, class) for the tokens of urls (url, tokens; one row a url) that min_count or more of them have.

    Tokens that the very same urls have are one class, named by its first token: they give rules of equal support
    and confidence, and mined one by one they would give every subset of them. At most tokens per url / support of
    them are frequent, so the table is broadcast.
    """
    h = F.xxhash64("url")
    seen = urls.select("url", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    first = Window.partitionBy("n", "x", "s")
    return seen.where(F.col("n") >= min_count).select("token", F.min("token").over(first).alias("class"))


def in_classes(urls: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """(url, more..., tokens) of urls (url, more..., tokens; one row a url), their tokens replaced by the classes; urls without any are left out."""
    found = urls.select("url", *more, F.explode("tokens").alias("token")).join(F.broadcast(classes), "token")
    return found.groupBy("url", *more).agg(F.collect_set("class").alias("tokens"))


def mine_rules(labelled: DataFrame, n: int, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, rarest, verdict, confidence, support) of labelled (url, tokens, verdict); n: how many urls are labelled.

    Frequent token sets together with a verdict give rules `tokens -> verdict`; those of low support or
    confidence are pruned. `rarest` is the token of a rule that the fewest labelled URLs have; it is the
    rule's key in the inverted index.
    """
    verdict = F.concat(F.lit("verdict="), F.col("verdict"))
    items = labelled.select(F.concat("tokens", F.array(verdict)).alias("items"))
    # Urls without a frequent token are no transactions here, but count.
    share = n / max(1, items.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * share), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 100).alias("verdict"), "confidence", (F.col("support") / share).alias("support"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    spread = found.select("*", F.explode("tokens").alias("token")).join(single, "token")
    rarest = F.min(F.struct("freq", "token"))["token"]
    return spread.groupBy("tokens", "verdict", "confidence", "support").agg(rarest.alias("rarest"))


def certain_tokens(labelled: DataFrame) -> DataFrame:
    """(token, verdict, n) of the tokens of labelled (url, tokens, verdict) whose n urls all have one verdict."""
    seen = labelled.select("verdict", F.explode("tokens").alias("token")).groupBy("token")
    return seen.agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("_other"), F.count("*").alias("n")).where("verdict = _other").drop("_other")


def all_rules(labelled: DataFrame, n: int, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, rarest, verdict, confidence, support): the rules of labelled (url, tokens, verdict) that can decide anything.

    A token that has one verdict alone is a rule of confidence 1. Larger sets with it have the same verdict, no more
    confidence and less support, so they decide nothing that it does not, and it is left out before sets are mined:
    on a site that is judged as a whole no subsets of its urls' tokens are enumerated.
    """
    certain = stored(certain_tokens(labelled), "certain_tokens")
    alone = certain.select(F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / n).alias("support"), F.col("token").alias("rarest"))
    open_tokens = labelled.select("url", "verdict", F.explode("tokens").alias("token")).join(F.broadcast(certain.select("token")), "token", "left_anti")
    rest = stored(open_tokens.groupBy("url", "verdict").agg(F.collect_set("token").alias("tokens")), "open_tokens")
    if rest.isEmpty():
        return stored(alone, "rules")
    return stored(alone.unionByName(mine_rules(rest, n, min_support, min_confidence)), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) for the urls (url, tokens) that a rule fits; the surest rule decides.

    A URL looks up the rules whose rarest token it has and keeps those whose tokens it has all. Of several the
    most confident decides, then the one with more support, more tokens, and block over allow.
    """
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("rarest"))
    index = rules.select("rarest", F.col("tokens").alias("needed"), "verdict", "confidence", "support")
    fit = looked_up.join(index, "rarest").where(F.size(F.array_except("needed", "tokens")) == 0)
    surest = F.struct("confidence", "support", F.size("needed").alias("n"), "verdict")
    return fit.groupBy("url").agg(F.max(surest)["verdict"].alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, default: str = "allow", min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    rules: (verdict, `host/path`), the longest fitting one decides. labels (url, verdict): known verdicts of other
    urls. Association rules are mined from both, the urls of pages that a listed rule fits with its verdict, and the
    labelled urls; without labels they can only carry the listed rules' verdicts on to the tokens that go with them.
    They judge the urls that no listed rule fits; where none fits either the verdict is default.

    A url counts once, however often pages or labels repeat it; of several labels of one, block holds. Urls are
    mined by classes of tokens, see token_classes, without those that one verdict alone has, see all_rules; the cost
    is that of the frequent sets of the other classes. Urls of any
    length are read whole. A null url has an empty host and path and gets the default. Repeated rows give repeated
    rows; an empty table gives an empty table. Other columns, whatever their names, are neither read nor returned.
    """
    url = F.col("url")
    read = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = read.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    tokens = url_tokens(F.col("host"), F.col("path"), url).alias("tokens")
    known = judged.where("listed is not null").select("url", F.lit(1).alias("by_rule"), F.col("listed.verdict").alias("verdict"))
    if labels is not None:
        known = known.union(labels.where("url is not null and verdict is not null").select("url", F.lit(0), "verdict"))
    best = F.max(F.struct("by_rule", "verdict"))["verdict"].alias("verdict")
    known = known.groupBy("url").agg(best)
    host, path = host_of(url).alias("host"), path_of(url).alias("path")
    labelled = stored(known.select("url", "verdict", host, path).select("url", "verdict", tokens), "labelled_urls")
    n = labelled.count()
    mined = judged.select("page_id", "url", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("known"))
    if not n:
        return mined.select("page_id", "host", "path", "rule", F.coalesce("known", F.lit(default)).alias("verdict"))
    classes = stored(token_classes(labelled, min_support * n), "token_classes")
    found = all_rules(in_classes(labelled, classes, "verdict"), n, min_support, min_confidence)
    open_urls = judged.where("listed is null and url is not null").select("url", tokens).distinct()
    verdicts = match_rules(in_classes(open_urls, classes), found).select(F.col("url").alias("_url"), F.col("verdict").alias("ruled"))
    out = mined.join(verdicts, F.col("url") == F.col("_url"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("known", "ruled", F.lit(default)).alias("verdict"))
