"""URL verdicts: rules against plain Python, trees against plain loops over rows."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import url_filters as uf

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "https://a.COM/x?y#z", "x://example.com/en/1", "http://www.EXAMPLE.com/en/", "http://a.www.example.com/en/q",
    "http://notexample.com/en/", "http://a.net/es/", "http://net/fr/1?u=http://com/", "http://b.net/en/", "http://example.org#/en/", "http://é.com/ü", "http://x.com\n/en/", "a://b://com/", "http://" + "a" * 5000 + ".net/fr/",
]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    after = rest[cut:]
    path = after[: min((after.index(c) for c in "?#" if c in after), default=len(after))]
    fits = [r for r in uf.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def table(spark):
    rows = list(enumerate(URLS)) + [(3, "http://a.net/es/"), (None, "http://x.com/")]
    rows += [(100 + i, f"http://{'blog' if i % 3 else 'm'}.w{i % 17}.example.{('com', 'net', 'org')[i % 3 if i % 7 else 0]}/{('en', 'de', 'es')[i % 5 % 3]}/{i * 31}{'?a=1&b=2' * (i % 4 == 0)}") for i in range(900)]
    return spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string").repartition(3)


def test_rules_and_hosts(spark):
    got = uf.judge(table(spark)).collect()
    want = sorted((str(r.page_id), *map(str, plain(r.url))) for r in table(spark).collect())
    assert want == sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got)
    assert all(r.verdict == uf.RULES[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got if not r.rule} == {"allow", "block"}
    assert uf.judge(table(spark).limit(0)).count() == 0
    assert {r.verdict for r in uf.judge(table(spark).filter("page_id < 3 OR page_id = 13")).collect()} == {"allow"}


def boost(rows, ys, features):
    """The same trees, one row at a time."""
    ones = sum(ys)
    block, allow = len(ys) / (2 * ones), len(ys) / (2 * (len(ys) - ones))
    scores, trees = [0.0] * len(rows), []

    def grow(of, depth):
        g = [round(1e6 * (block * (1 - p) if y else -allow * p)) / 1e6 for y, p in ((ys[i], 1 / (1 + math.exp(-scores[i]))) for i in of)]
        h = [(block if ys[i] else allow) * p * (1 - p) for i in of for p in [1 / (1 + math.exp(-scores[i]))]]
        cells = defaultdict(lambda: [0.0, 0.0, 0])
        for i, a, b in zip(of, g, h):
            for f in features:
                c = cells[f, rows[i][f]]
                c[0] += a
                c[1] += b
                c[2] += 1
        split = uf.best_split({k: tuple(v) for k, v in cells.items()}) if depth < uf.DEPTH else None
        if not split:
            return [None, uf.RATE * sum(g) / (sum(h) + uf.RIDGE)]
        f, c = split[1:]
        return [f, c, grow([i for i in of if rows[i][f] <= c], depth + 1), grow([i for i in of if rows[i][f] > c], depth + 1)]

    def value(tree, row):
        return tree[1] if tree[0] is None else value(tree[2] if row[tree[0]] <= tree[1] else tree[3], row)

    for _ in range(uf.TREES):
        trees.append(grow(range(len(rows)), 0))
        scores = [s + value(trees[-1], r) for s, r in zip(scores, rows)]
    return scores


def test_trees_equal_plain_boosting(spark):
    host, path = uf.parsed(F.col("url"))
    urls = table(spark).filter("url IS NOT NULL").select("url", host.alias("host"), path.alias("path"))
    y = F.when(F.col("url").rlike(r"[?]|blog"), 1).otherwise(0)
    labelled = urls.select(y.alias("y"), *(c.alias(k) for k, c in uf.classes(F.col("url"), F.col("host"), F.col("path")).items()))
    features = [c for c in labelled.columns if c != "y"]
    rows = [r.asDict() for r in labelled.collect()]
    want = boost(rows, [r["y"] for r in rows], features)
    start, trees = uf.train(labelled, features)
    score = F.lit(start) + sum(map(uf._as_column, trees), F.lit(0.0))
    got = [r[0] for r in labelled.select(score).collect()]
    assert max(abs(a - b) for a, b in zip(sorted(want), sorted(got), strict=True)) < 1e-3
    hits = sum((a > 0) == bool(r["y"]) for a, r in zip(want, rows))
    assert hits > 0.9 * len(rows)
