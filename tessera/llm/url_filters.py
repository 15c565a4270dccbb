"""URL verdicts: rules first, then gradient-boosted trees on lexical features, in DataFrame functions only.

The urls that a rule fits are the labelled ones; they teach the trees, which judge the others. Features are whole numbers
in few classes, so labelled urls are first summed up by their classes. Every level of a tree is one aggregation of gradients
by node, feature and class, in whole millionths so that no order of adding matters; only these sums, at most
nodes * features * classes, come to the driver. A finished tree is a nested CASE over the classes, compiled with the rest of the query.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rule (host and path) and verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
CLASSES = 32
TREES, DEPTH, RATE, LEAST, RIDGE = 8, 3, 0.4, 20, 1.0


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and where no :// is."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def classes(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, each as a class from 0 to CLASSES - 1."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    without = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    signs = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)))
    count = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(c)
    total = F.aggregate(signs, F.lit(0.0), lambda acc, c: acc + count(c) * F.log2(count(c)))
    values = {
        "length": F.length(text) / 4,
        "host_length": F.length(host) / 2,
        "labels": F.size(F.split(host, r"\.", -1)),
        "depth": F.length(path) - F.length(F.translate(path, "/", "")),
        "digits": 64 * without(string.digits) / n,
        "entropy": 8 * (F.log2(n) - total / n) - 16,
        "params": F.regexp_count(text, F.lit(r"[?&][^=&#?]*=")),
        "hyphens": without("-_"),
        "path_length": F.length(path) / 2,
    }
    return {k: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(CLASSES - 1)).cast("int") for k, v in values.items()}


def suffix_classes(labelled: DataFrame) -> DataFrame:
    """suffix, suffix_rate and suffix_count (classes): how labelled urls with this last host label were judged."""
    seen = labelled.groupBy("suffix").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    rate = F.floor((F.col("y") + 1) * CLASSES / (F.col("n") + 2))
    return seen.select(F.col("suffix").alias("_suffix"), rate.cast("int").alias("suffix_rate"), F.least(F.floor(F.log2("n")), F.lit(CLASSES - 1)).cast("int").alias("suffix_count"))


Tree = list  # [feature, upper class of the left side, left, right] or [None, value]


def _as_column(tree: Tree) -> Column:
    if tree[0] is None:
        return F.lit(float(tree[1]))
    feature, upto, left, right = tree
    return F.when(F.col(feature) <= upto, _as_column(left)).otherwise(_as_column(right))


def _node_column(tree: Tree) -> Column:
    """The number of the open leaf a row is in; -1 for closed ones."""
    if tree[0] is None:
        return F.lit(tree[2] if len(tree) > 2 else -1)
    feature, upto, left, right = tree
    return F.when(F.col(feature) <= upto, _node_column(left)).otherwise(_node_column(right))


def best_split(cells: dict[tuple[str, int], tuple[float, float, int]]) -> tuple[float, str, int] | None:
    """cells: sums of gradient, hessian and rows by feature and class, of one node. Gain, feature and upper class; ties go to the
    feature first by name, then to the lowest class."""
    best = None
    for feature in sorted({f for f, _ in cells}):
        mine = sorted((c, *v) for (f, c), v in cells.items() if f == feature)
        g, h, n = (sum(m[i] for m in mine) for i in (1, 2, 3))
        a = b = m = 0
        for c, dg, dh, dn in mine[:-1]:
            a, b, m = a + dg, b + dh, m + dn
            if min(m, n - m) < LEAST:
                continue
            gain = a * a / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - g * g / (h + RIDGE)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, feature, c
    return best


def train(labelled: DataFrame, features: list[str]) -> tuple[float, list[Tree]]:
    """labelled: y (1 to block) and the feature classes. The first log odds and the trees. Both verdicts weigh the same in all."""
    cells = written(labelled.groupBy(*features).agg(F.sum("y").cast("double").alias("y"), F.count("*").cast("double").alias("n")), "url-classes")
    ones, rows = cells.agg(F.sum("y"), F.sum("n")).first()
    if not rows:
        return 0.0, []
    start, trees = 0.0, []
    block, allow = rows / (2 * ones) if ones else 1.0, rows / (2 * (rows - ones)) if ones < rows else 1.0
    if ones in (0, rows):
        start = math.log((ones + 0.5) / (rows - ones + 0.5))
    pull, push = F.col("y") * block, (F.col("n") - F.col("y")) * allow
    pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("c")) for f in features))
    for _ in range(TREES):
        score = F.lit(start) + sum(map(_as_column, trees), F.lit(0.0))
        p = 1 / (1 + F.exp(-score))
        million = lambda x: F.round(x * 1e6).cast("long")
        rows_ = cells.select(pairs.alias("pairs"), *features, million(pull * (1 - p) - push * p).alias("g"), million((pull + push) * p * (1 - p)).alias("h"), "n")
        tree: Tree = [None, 0.0, 0]
        open_ = {0: tree}
        for level in range(DEPTH + 1):
            sums: dict[int, dict] = {}
            found = rows_.withColumn("node", _node_column(tree)).filter("node >= 0").select("node", F.explode("pairs").alias("q"), "g", "h", "n")
            for r in found.groupBy("node", "q.f", "q.c").agg(F.sum("g"), F.sum("h"), F.sum("n").cast("long")).collect():
                sums.setdefault(r[0], {})[(r[1], r[2])] = r[3] / 1e6, r[4] / 1e6, r[5]
            following: dict[int, Tree] = {}
            for number, leaf in open_.items():
                mine = sums.get(number, {})
                one = [v for (f, _), v in mine.items() if f == features[0]]
                value = RATE * sum(v[0] for v in one) / (sum(v[1] for v in one) + RIDGE)
                split = best_split(mine) if level < DEPTH else None
                if split is None:
                    leaf[:] = [None, value]
                    continue
                left, right = [None, 0.0, len(following)], [None, 0.0, len(following) + 1]
                following |= {len(following): left, len(following) + 1: right}
                leaf[:] = [split[1], split[2], left, right]
            open_ = following
            if not open_:
                break
        trees.append(tree)
        if tree[0] is None:
            break
    return start, trees


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability to block, by the trees), a row per row of pages.

    pages: page_id and url; other columns are ignored. A null url has an empty host and path and no rule. Rows with
    equal page_id are judged each. Without any labelled url the trees are none and everything without a rule is allowed.
    An empty table gives no rows.
    """
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()))
    urls = urls.withColumns(classes(F.col("url"), F.col("host"), F.col("path")) | {"suffix": F.regexp_extract("host", r"[^.]*$", 0), "ruled": ruled})
    urls = written(urls.drop("url"), "urls")
    features = list(classes(F.lit(""), F.lit(""), F.lit("")))
    y = F.when(F.col("ruled") == "block", 1).otherwise(0)
    labelled = urls.filter("ruled IS NOT NULL").withColumn("y", y)
    urls = urls.join(suffix_classes(labelled), F.col("suffix") == F.col("_suffix"), "left").drop("_suffix")
    urls = urls.fillna({"suffix_rate": CLASSES // 2, "suffix_count": 0})
    features += ["suffix_rate", "suffix_count"]
    start, trees = train(urls.filter("ruled IS NOT NULL").withColumn("y", y), features)
    score = 1 / (1 + F.exp(-(F.lit(start) + sum(map(_as_column, trees), F.lit(0.0)))))
    urls = urls.withColumn("score", score)
    verdict = F.coalesce("ruled", F.when((F.col("score") >= 0.5) & F.lit(bool(trees)), "block").otherwise("allow"))
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
