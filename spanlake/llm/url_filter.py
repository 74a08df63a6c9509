"""URL verdicts from host and path rules and, where none fits, from association rules that FP-growth mines."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.frames import column, cut

#: (verdict, host, path) of the rules that label pages.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host up to `/`, `?` or `#`, with A-Z lower-cased, and the path from there up to `?` or `#`."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does. Of equally long ones the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host names, path parts (their digits as #), query keys, and whether it has a fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "#")))
    names = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    other = F.array_compact(F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.when(F.contains(url, F.lit("#")), F.lit("fragment"))))
    return F.array_distinct(F.coalesce(F.concat(names, parts, keys, other), F.array().cast("array<string>")))


def token_classes(labelled: DataFrame, support: float) -> DataFrame:
    """(token, class) of the tokens of (page, tokens) that `support` of the pages have; tokens that the very same pages have are one class, called by its least.

    Classes are found by digests of page sets and then confirmed: a page with some of a class's tokens and not all of them takes it apart.
    """
    each = labelled.select("page", F.explode("tokens").alias("token"))
    least = labelled.count() * support
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page")).alias("x"), F.bit_xor(F.xxhash64("page", F.lit(1))).alias("y")).where(F.col("n") >= least)
    names = found.groupBy("n", "x", "y").agg(F.min("token").alias("class"), F.count("*").alias("tokens"))
    classes = cut(found.join(names, ["n", "x", "y"]).select("token", "class", "tokens"))
    partial = each.join(F.broadcast(classes.where("tokens > 1")), "token").groupBy("page", "class", "tokens").agg(F.count("*").alias("n")).where("n < tokens")
    partial = partial.select("class", F.lit(True).alias("apart")).distinct()
    return classes.join(partial, "class", "left").select("token", F.when(F.col("apart"), F.col("token")).otherwise(F.col("class")).alias("class"))


def in_classes(tokens: Column, classes: dict[str, str]) -> Column:
    """The classes that tokens belong to, in order; tokens without one are left out."""
    if not classes:
        return F.array().cast("array<string>")
    known = F.array_intersect(tokens, F.array(*map(F.lit, classes)))
    shared = [F.lit(x) for t, c in classes.items() if t != c for x in (t, c)]
    if shared:
        renamed = F.create_map(*shared)
        known = F.array_distinct(F.transform(known, lambda t: F.coalesce(F.try_element_at(renamed, t), t)))
    return F.array_sort(known)


def mined_rules(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, dict[str, str]]:
    """Rules (key, classes, verdict, confidence, support) from (page, tokens, verdict), and the class of each token that they use.

    Tokens that the same pages have would make 2**n combinations of one support and confidence; FP-growth sees each class of them as one item, and a page has
    a class if it has any of its tokens, so every rule on single tokens is kept. key is the rule's rarest class. At most 1 / support times the mean
    number of a page's tokens are frequent, so the list that comes to the driver is bounded. The number of rules is not: it
    grows with the combinations of classes that `support` of the pages have.
    """
    classes = token_classes(labelled, support)
    found = {r["token"]: r["class"] for r in classes.collect()}
    items = labelled.select(F.array_append(in_classes(F.col("tokens"), found), F.concat(F.lit("is:"), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    frequent = cut(model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("class"), "freq"))
    rules = model.associationRules.where("size(consequent) = 1 AND startswith(consequent[0], 'is:') AND NOT exists(antecedent, x -> startswith(x, 'is:'))")
    rules = cut(rules.select(F.monotonically_increasing_id().alias("rule"), F.array_sort("antecedent").alias("classes"), F.substring(F.col("consequent")[0], 4, 100).alias("verdict"), "confidence", "support"))
    each = rules.select("rule", F.explode("classes").alias("class")).join(frequent, "class")
    rarest = each.groupBy("rule").agg(F.min(F.struct("freq", "class")).alias("least")).select("rule", F.col("least.class").alias("key"))
    used = {r[0] for r in rules.select(F.explode("classes")).distinct().collect()}
    return rules.join(rarest, "rule").select("key", "classes", "verdict", "confidence", "support"), {t: c for t, c in sorted(found.items()) if c in used}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, support: float = 0.01, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence), a row per input row.

    A page that a rule fits has its verdict. These pages are the labels from which FP-growth mines token combinations; the
    others get the verdict of the matching combination of most confidence, then support, then by verdict, block before allow. What nothing matches gets `default`, as do all when no page has a label. confidence is null but for mined verdicts.

    Pages with the same mined classes of tokens are matched once, through an index of combinations by their rarest class, so a host that a third
    of the pages share is one entry. Null urls and urls without `://` have an empty host and path. Ids can be null or repeat. Only the two named
    columns are read, so others may have any names. An empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"))
    host, path = host_and_path(url)
    rows = rows.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "known": verdict, "tokens": tokens_of(url, F.col("host"), F.col("path"))})
    labelled = rows.where("known IS NOT NULL").select(F.monotonically_increasing_id().alias("page"), "tokens", F.col("known").alias("verdict"))
    done = rows.where("known IS NOT NULL").select("page_id", "host", "path", "rule", F.col("known").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    rest = rows.where("known IS NULL")
    if labelled.isEmpty():
        return done.unionByName(rest.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"), F.lit(None).cast("double").alias("confidence")))
    mined, used = mined_rules(cut(labelled), support, confidence)
    rest = rest.withColumn("set", F.array_join(in_classes(F.col("tokens"), used), "\n"))
    sets = rest.select("set").distinct().select("set", F.split("set", "\n").alias("has"))
    matched = sets.select("set", "has", F.explode("has").alias("key")).join(mined, "key").where(F.size(F.array_except("classes", "has")) == 0)
    best = matched.groupBy("set").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
    best = cut(best.select("set", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence")))
    rest = rest.join(best, "set", "left").select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"), "confidence")
    return done.unionByName(rest)
