"""URL filters: a path-template tree per host, grown level by level with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch, is_empty

#: (action, host, beginning of the path); a rule fits its host and all subdomains, the longest text wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A level is variable with this many different segments and this many per URL; segments of a larger share stay.
MANY, VARIED, COMMON = 8, 0.02, 0.2
#: Branches whose purity is less than so many standard errors from their parent's are merged.
SIMILAR = 2.0
#: Weight of the host's purity in a template's, and of the overall purity in a host's; templates below LEAST go.
PRIOR_WEIGHT, LEAST = 4.0, 0.6
ANY, MERGED = "*", "+"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    found = F.translate(F.regexp_extract(tail, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, or nulls. Rules are part of the program, so they go into the plan."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _common(lo: Column, hi: Column) -> Column:
    """How many first elements two arrays share: those of the least and the greatest of a set are shared by all of it."""
    pairs = F.arrays_zip(lo.alias("lo"), hi.alias("hi"))
    at = F.array_position(F.transform(pairs, lambda t: F.coalesce(t["lo"] != t["hi"], F.lit(True))), True)
    return F.when(at == 0, F.size(lo)).otherwise(at - 1).cast("int")


def templates(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """``urls(host, path, good)`` -> ``(host, path, template)`` for each distinct host and path.

    good is 1, 0 or null (no label). Level by level, segments of a variable level become '*', then literal branches whose
    purity is like their parent's become '+'. What all paths of a branch share is passed in one step, so there are as
    many steps as branchings below each other, whatever the depth of the paths.
    """
    segs = F.transform(F.slice(F.split("path", "/"), 2, 1 << 20), lambda s: F.when(s.isin(ANY, MERGED), F.concat(F.lit("="), s)).otherwise(s))
    now = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("known"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    now = scratch.save(now.select("host", "path", segs.alias("rest"), "n", "known", "good", F.lit("").alias("template")), "level-0")
    sums = [F.sum(c).alias(c) for c in ("n", "known", "good")]
    d = 0
    while not is_empty(now.filter("size(rest) > 0")):
        d += 1
        ahead = now.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).select("host", "template", _common(F.col("lo"), F.col("hi")).alias("shared"))
        at = now.join(ahead, ["host", "template"]).withColumn("seg", F.when(F.col("shared") == 0, F.get("rest", F.lit(0))))
        at = scratch.save(at, f"at-{d}")
        child = scratch.save(at.filter("seg is not null").groupBy("host", "template", "seg").agg(*sums), f"children-{d}")
        node = child.groupBy("host", "template").agg(F.count("*").alias("kinds"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "known", "good")))
        both = child.join(node, ["host", "template"])
        varied = (F.col("kinds") >= MANY) & (F.col("kinds") >= VARIED * F.col("all_n")) & (F.col("n") <= COMMON * F.col("all_n"))
        p = (F.col("all_good") + 1) / (F.col("all_known") + 2)
        own = F.try_divide(F.col("good"), F.col("known"))
        z = F.abs(own - p) / F.sqrt(p * (1 - p) / F.greatest("known", F.lit(1)))
        step = F.when(varied, F.lit(ANY)).when((F.col("kinds") > 1) & (F.coalesce(z, F.lit(0.0)) < SIMILAR), F.lit(MERGED)).otherwise(F.col("seg"))
        chosen = both.select("host", "template", "seg", step.alias("step"))
        taken = F.greatest("shared", F.lit(1))
        more = F.when(F.col("shared") > 0, F.array_join(F.slice("rest", F.lit(1), F.col("shared")), "/")).otherwise(F.col("step"))
        new = F.when(more.isNotNull() & (F.size("rest") > 0), F.concat("template", F.lit("/"), more)).otherwise(F.col("template"))
        left = F.slice("rest", taken + 1, F.greatest(F.size("rest") - taken, F.lit(0)))
        now = scratch.save(at.join(chosen, ["host", "template", "seg"], "left").select("host", "path", left.alias("rest"), "n", "known", "good", new.alias("template")), f"level-{d}")
        scratch.drop(f"children-{d}", f"at-{d}", f"level-{d - 1}")
    return now.select("host", "path", "template", "n", "known", "good")


def purity(tree: DataFrame, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """``(host, template, known, good, purity)``: a template's share of good labels, smoothed by its host's, and that by all."""
    each = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("good").alias("good"))
    host = each.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("good").alias("host_good"))
    total = host.agg(F.sum("host_known").alias("k"), F.sum("host_good").alias("g")).first()
    overall = ((total["g"] or 0) + 1) / ((total["k"] or 0) + 2)
    mean = (F.col("host_good") + weight * overall) / (F.col("host_known") + weight)
    return each.join(host, "host").select("host", "template", "known", "good", ((F.col("good") + weight * mean) / (F.col("known") + weight)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = LEAST) -> DataFrame:
    """``pages(page_id, url)`` and ``labels(page_id, good)`` -> ``(page_id, host, path, rule, verdict, template, purity)``.

    A null url, or one without '://', has an empty host and path and the template ''. Pages without labels get the
    purity of their template, host and all labels, and 'allow' if there are none at all. Several labels of one page each
    count; a null page_id has none.
    """
    scratch = Scratch(pages.sparkSession, "urltree")
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    votes = labels.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.round(F.avg("good")).cast("long").alias("good"))
    tree = scratch.save(templates(base.join(votes, "page_id", "left"), scratch), "tree")
    pure = scratch.save(purity(tree), "purity")
    named = tree.select("host", "path", "template").join(pure.select("host", "template", "purity"), ["host", "template"])
    out = base.join(named, ["host", "path"])
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
