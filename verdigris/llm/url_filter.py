"""URL filter: rules first, then gradient-boosted trees on lexical features; DataFrame functions only.

The trees are grown on histograms: features are binned, every level of a tree is one aggregation over
(leaf, feature, bin), and the model is a sum of nested CASE expressions, so training and scoring both
stay in generated JVM code. Training reads at most `max_train` distinct labelled URLs, drawn by hash, each
with the number of its rows as weight.

Null urls and urls without `://` have an empty host and path, fit no rule, and are judged by the
model. Repeated urls are judged alike. With one class among the labels the model always says that
class; without labels it allows. Empty tables give empty results. Extra columns pass through, but the added
host, path, rule, block_score and verdict replace columns of those names (unless one is the url itself).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The query's rules, (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; a rule fits its host, all subdomains, and paths it starts."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def count_of(c: Column, regex: str) -> Column:
    return F.regexp_count(c, F.lit(regex)).cast("double")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(c)

    def term(x: Column) -> Column:
        p = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return -p * F.log2(p)

    # scaled to whole millionths, so that the order of summing does not matter
    bits = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.round(term(x) * 1e6).cast("long"))
    return F.when(n > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b) / 1e6).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    n = F.greatest(F.length(u), F.lit(1))
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count_of(path, "/[^/]+"),
        "host_labels": count_of(host, "[^.]+"),
        "digit_ratio": count_of(u, "[0-9]") / n,
        "host_digits": count_of(host, "[0-9]"),
        "hyphens": count_of(u, "[-_]"),
        "escapes": count_of(u, "%"),
        "parameters": count_of(F.regexp_extract(F.substring_index(u, "#", 1), r"(?s)\?(.*)", 1), "[^&]+"),
        "secure": F.lower(u).startswith("https:").cast("double"),
        "url_entropy": entropy(u),
        "host_entropy": entropy(host),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)", 1)


class Boosted:
    """Logistic gradient boosting over binned features.

    trees: list of {leaf id: (feature, bin)} splits and {leaf id: value} leaves; children of i are 2i+1, 2i+2.
    """

    def __init__(self, names: list[str], edges: dict[str, list[float]], prior: float, trees: list, suffixes: dict[str, dict[str, float]]):
        self.names, self.edges, self.prior, self.trees, self.suffixes = names, edges, prior, trees, suffixes

    def features(self, url: Column) -> dict[str, Column]:
        """Lexical features and the learnt suffix statistics (log odds of the suffix and the first segment)."""
        u = F.coalesce(url, F.lit(""))
        out = lexical(url)
        for kind, c in (("suffix_odds", suffix_of(host_of(u))), ("segment_odds", first_segment(path_of(u)))):
            stats = self.suffixes.get(kind, {})
            pairs = [F.lit(x) for k, v in stats.items() for x in (k, v)]
            out[kind] = F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(0.0)) if pairs else F.lit(0.0)
        return out

    def binned(self, f: dict[str, Column]) -> list[Column]:
        return [
            reduce(lambda a, b: a + b, [(f[n] > F.lit(x)).cast("int") for x in self.edges[n]], F.lit(0)).alias(f"f{i}")
            for i, n in enumerate(self.names)
        ]

    def leaf(self, tree: int, node: int = 0) -> Column:
        """The leaf that a row of binned columns falls in."""
        splits, _ = self.trees[tree]
        if node not in splits:
            return F.lit(node)
        i, cut = splits[node]
        return F.when(F.col(f"f{i}") <= cut, self.leaf(tree, 2 * node + 1)).otherwise(self.leaf(tree, 2 * node + 2))

    def value(self, tree: int, node: int = 0) -> Column:
        splits, leaves = self.trees[tree]
        if node not in splits:
            return F.lit(leaves[node])
        i, cut = splits[node]
        return F.when(F.col(f"f{i}") <= cut, self.value(tree, 2 * node + 1)).otherwise(self.value(tree, 2 * node + 2))

    def margin(self) -> Column:
        return reduce(lambda a, b: a + b, [self.value(k) for k in range(len(self.trees))], F.lit(self.prior))

    def score(self, df: DataFrame, url: str, out: str) -> DataFrame:
        """df plus the probability of `block`."""
        feats = self.features(F.col(url))
        known = df.select(F.struct(*df.columns).alias("row"), *[feats[n].alias(n) for n in self.names])  # each feature once
        binned = known.select("row", *self.binned({n: F.col(n) for n in self.names}))
        return binned.select("row.*", (1 / (1 + F.exp(-self.margin()))).alias(out))


def train(labelled: DataFrame, url: str = "url", label: str = "label", n_trees: int = 10, depth: int = 3, n_bins: int = 16,
          rate: float = 0.3, l2: float = 1.0, max_train: int = 20_000, min_rows: int = 20) -> Boosted:
    """Fits on at most max_train distinct rows of (url, label), weighted by their numbers; label 1.0 means block.

    Suffixes and first segments of at least min_rows sampled rows have statistics of their own.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(url), F.lit("")).alias("u"), F.col(label).cast("double").alias("y"))
    # a hash threshold lets through little more than max_train rows, and equal ones meet before they are sorted
    every, span = rows.count(), 1 << 40
    draw = F.pmod(F.xxhash64("u"), F.lit(span))
    drawn = rows.where(draw < min(span, int((1.2 * max_train + 1000) / max(every, 1) * span) + 1)).groupBy("u", "y").agg(F.count("*").alias("w"))
    sample = drawn.orderBy(draw, "u", "y").limit(max_train).persist()
    try:
        n, pos = sample.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("y") * F.col("w")), F.lit(0.0))).first()
        if not pos or pos == n:
            return Boosted([], {}, 5.0 if pos else -5.0, [], {})
        base = math.log(pos / (n - pos))
        odds = {}
        for kind, c in (("suffix_odds", suffix_of(host_of(F.col("u")))), ("segment_odds", first_segment(path_of(F.col("u"))))):
            got = sample.groupBy(c.alias("k")).agg(F.sum("w").alias("n"), F.sum(F.col("y") * F.col("w")).alias("p")).where(F.col("n") >= min_rows).collect()  # at most max_train rows
            odds[kind] = {r["k"]: round(math.log((r["p"] + 1) / (r["n"] - r["p"] + 1)) - base, 6) for r in got}
        model = Boosted([], {}, round(base, 6), [], odds)
        feats = model.features(F.col("u"))
        names = sorted(feats)
        # the features are computed once, by several tasks
        known = sample.repartition(8).select("y", "w", *[feats[x].alias(x) for x in names]).persist()
        cuts = [k / n_bins for k in range(1, n_bins)]
        facts = known.agg(*[F.percentile(x, F.array(*map(F.lit, cuts)), F.col("w")).alias(x) for x in names], *[F.max(x).alias(f"top_{x}") for x in names]).first()
        model.edges = {x: [v for v in sorted({round(v, 9) for v in facts[x]}) if v < facts[f"top_{x}"]] for x in names}
        model.names = [x for x in names if model.edges[x]]
        if not model.names:
            return model
        width = range(len(model.names))
        binned = known.select("y", "w", *model.binned({x: F.col(x) for x in names})).groupBy(*[f"f{i}" for i in width]).agg(F.sum(F.col("y") * F.col("w")).alias("y"), F.sum("w").alias("n")).withColumn("margin", F.lit(model.prior))
        binned = common.written(binned, "margins")
        known.unpersist()
        for _ in range(n_trees):
            binned = grow(model, binned, depth, rate, l2)
        common.drop_written(binned)
        return model
    finally:
        sample.unpersist()


def grow(model: Boosted, binned: DataFrame, depth: int, rate: float, l2: float) -> DataFrame:
    """Adds one tree; each level is one aggregation to (leaf, feature, bin) sums of gradients and hessians.

    binned, a stored table, has the margin under the trees so far; the table with the new tree's margin takes its place, so no plan
    holds more than one tree.
    """
    p = 1 / (1 + F.exp(-F.col("margin")))
    data = binned.withColumn("g", F.col("y") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))
    splits, leaves = {}, {0: 0.0}
    model.trees.append((splits, leaves))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("b")) for i in range(len(model.names))]))
    for level in range(depth + 1):
        sums = (
            data.select(model.leaf(len(model.trees) - 1).alias("leaf"), "g", "h", pairs.alias("x"))
            .groupBy("leaf", "x.f", "x.b")
            .agg(F.sum(F.round(F.col("g") * 1e6).cast("long")).alias("g"), F.sum(F.round(F.col("h") * 1e6).cast("long")).alias("h"))
            .collect()
        )
        table: dict[int, dict[int, list]] = {}
        for r in sums:
            table.setdefault(r["leaf"], {}).setdefault(r["f"], []).append((r["b"], r["g"] / 1e6, r["h"] / 1e6))
        grew = False
        for leaf, feats in sorted(table.items()):
            g_all = sum(g for _, g, _ in feats[0])
            h_all = sum(h for _, _, h in feats[0])
            leaves[leaf] = round(rate * g_all / (h_all + l2), 9)
            if level == depth:
                continue
            best = (1e-6, None)
            for f, bs in sorted(feats.items()):
                g = h = 0.0
                for b, dg, dh in sorted(bs)[:-1]:
                    g, h = g + dg, h + dh
                    gain = g * g / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
                    if gain > best[0] + 1e-9 and min(h, h_all - h) >= 0.5:
                        best = (gain, (f, b))
            if best[1]:
                splits[leaf] = best[1]
                leaves[2 * leaf + 1] = leaves[2 * leaf + 2] = 0.0
                grew = True
        if not grew:
            break
    out = common.written(binned.withColumn("margin", F.col("margin") + model.value(len(model.trees) - 1)), "margins")
    common.drop_written(binned)
    return out


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5, **training) -> DataFrame:
    """pages plus host, path, rule, block_score (the model's), verdict.

    labelled: (url, label) rows to learn from; without them, the urls that a rule decides are the labels.
    """
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    added = ("host", "path", "rule")
    clash = {*added, "block_score", "verdict"} & set(pages.columns) - {url}
    if clash:
        pages = pages.drop(*clash)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = pages.select("*", host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    decided = F.try_element_at(verdicts, F.col("rule"))
    if labelled is None:
        labelled = ruled.where("rule is not null").select(F.col(url).alias("url"), (decided == "block").cast("double").alias("label"))
    model = train(labelled, **training)
    scored = model.score(ruled, url, "block_score")
    return scored.withColumn("verdict", F.coalesce(decided, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))
