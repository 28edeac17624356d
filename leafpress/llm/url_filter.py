"""URL filters (operator 6), native: DataFrame expressions only.

Rules are host and path prefixes with a verdict; the longest that fits wins. URLs
without a rule are judged by gradient-boosted trees on lexical features: length, depth, digit
ratio, entropy, parameter count, host labels, and how common the host's suffixes are in the
table. The trees learn from the URLs that a rule labels: features are cut into at most
``BINS`` bins, and rows are counted by their bins in Spark, so the driver sees only a bounded
table of counts, on which it fits the trees. Trees become CASE expressions.

Training reads about ``max_rows`` labelled URLs, chosen by a hash of the URL. Suffix counts
cover all rows. Defined results: a null URL, or one without ``://``, has an empty host and
path, no rule, and is judged by the trees on its text (null: empty). With no labelled URL, or
labels of one kind only, the trees give that kind (none: allow). Rules of equal length that
both fit: the smaller text wins. Repeated rows are judged each; an empty table gives no rows; a URL of any length is
judged whole. Other columns pass through whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm.common import ascii_lower, fitted, stored, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "labels", "hyphens", "suffix_share", "tld_share")
BINS, TREES, DEPTH, RATE, MAX_ROWS = 12, 24, 3, 0.3, 20_000


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.col(f"`{url_col}`")
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def rule_columns(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.char_length(text)
    kinds = F.array_distinct(F.split(text, ""))
    part = lambda c: (n - F.char_length(F.replace(text, c))) / n
    return F.coalesce(F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda a, c: a - part(c) * F.log2(part(c))), F.lit(0.0))


def with_features(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features (all double) to rows with host and path."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    n = F.char_length(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    pages = pages.withColumns(
        {
            "_tld": F.regexp_extract("host", r"[^.]*$", 0),
            "_suffix": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
            "length": n.cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digit_ratio": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(n, F.lit(0)), F.lit(0.0)),
            "entropy": _entropy(url),
            "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        }
    )
    # Features are computed once; all that is learned from them reads what is stored.
    pages = stored(pages)
    counts = stored(pages.groupBy("_suffix", "_tld").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    tlds = counts.groupBy("_tld").agg(F.sum("_n").alias("_t"))
    shares = stored(counts.join(tlds, "_tld").select("_suffix", F.log2(F.col("_n") / total).alias("suffix_share"), F.log2(F.col("_t") / total).alias("tld_share")))
    # Too many suffixes to broadcast: adaptive execution splits the pages of a hot one.
    return pages.join(fitted(shares), "_suffix").drop("_suffix", "_tld")


class Tree:
    """Nodes as (feature, bin, left, right) or a leaf value; rows with feature bin <= bin go left."""

    def __init__(self, node):
        self.node = node

    def value(self, bins: Sequence[int], node=None) -> float:
        node = self.node if node is None else node
        return self.value(bins, node[2] if bins[node[0]] <= node[1] else node[3]) if isinstance(node, tuple) else node

    def column(self, cuts: Sequence[Sequence[float]], node=None) -> Column:
        node = self.node if node is None else node
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, b, left, right = node
        return F.when(F.col(FEATURES[f]) <= cuts[f][b], self.column(cuts, left)).otherwise(self.column(cuts, right))


def _grow(cells: list, grad: list[float], hess: list[float], rows: list[int], depth: int, width: int, ridge: float = 1.0):
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    leaf = g / (h + ridge) * RATE
    if depth == 0 or len(rows) < 2:
        return leaf
    best = None
    for f in range(width):
        gs, hs = [0.0] * (BINS + 1), [0.0] * (BINS + 1)
        for i in rows:
            b = cells[i][0][f]
            gs[b] += grad[i]
            hs[b] += hess[i]
        a = c = 0.0
        for b in range(BINS):
            a, c = a + gs[b], c + hs[b]
            if c < 1e-3 or h - c < 1e-3:
                continue
            gain = a * a / (c + ridge) + (g - a) ** 2 / (h - c + ridge) - g * g / (h + ridge)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, b)
    if best is None:
        return leaf
    _, f, b = best
    sides = [i for i in rows if cells[i][0][f] <= b], [i for i in rows if cells[i][0][f] > b]
    return (f, b, *(_grow(cells, grad, hess, s, depth - 1, width) for s in sides))


def boost(cells: list[tuple[tuple[int, ...], int, int]], trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Tree]]:
    """(intercept, trees) of the log odds of 'block', from cells (bins, rows, rows that block)."""
    n, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if pos in (0, n):
        return (30.0 if n and pos == n else -30.0), []
    start = math.log(pos / (n - pos))
    margin, out = [start] * len(cells), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [c[2] - c[1] * q for c, q in zip(cells, p)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p)]
        tree = Tree(_grow(cells, grad, hess, list(range(len(cells))), depth, len(cells[0][0])))
        out.append(tree)
        margin = [m + tree.value(c[0]) for m, c in zip(margin, cells)]
    return start, out


def fit(labelled: DataFrame, url_col: str = "url", max_rows: int = MAX_ROWS) -> Column:
    """The log odds of 'block' as a column over FEATURES. labelled: features and a verdict."""
    n = labelled.count()
    if not n:
        return F.lit(-30.0)
    share = min(1.0, max_rows / n)
    sample = labelled.where(F.pmod(F.xxhash64(url_col), F.lit(1 << 20)) < share * (1 << 20))
    quantiles = [k / BINS for k in range(1, BINS)]
    row = sample.agg(*(F.percentile_approx(f, F.array(*map(F.lit, quantiles)), F.lit(10_000)).alias(f) for f in FEATURES)).first()
    cuts = [sorted(set(row[f] or [])) for f in FEATURES]
    # Bin b holds values up to the b-th cut; one bin more holds those above.
    bins = [reduce(lambda a, c: a + c, [(F.col(f) > x).cast("int") for x in cut], F.lit(0)).alias(f"b_{f}") for f, cut in zip(FEATURES, cuts)]
    counted = sample.select(*bins, (F.col("verdict") == "block").cast("int").alias("y")).groupBy(*(f"b_{f}" for f in FEATURES)).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    cells = sorted((tuple(r[: len(FEATURES)]), r["n"], r["y"]) for r in counted.collect())
    if not cells:
        return F.lit(-30.0)
    padded = [[*cut, *[float("inf")] * (BINS + 1 - len(cut))] for cut in cuts]
    start, trees = boost(cells)
    return reduce(lambda a, t: a + t.column(padded), trees, F.lit(start))


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """pages plus host, path, rule, verdict and block_score (the trees' probability)."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    seen = with_host_path(pages.select(*(F.col(f"`{c}`") for c in names)), url_col)
    rule, verdict = rule_columns(rules)
    inner = [f"_in{k}" for k in range(len(names))]
    # Other columns keep out of the way under names of their own while features are computed.
    seen = seen.select(F.col(f"`{url_col}`").alias("_url"), *(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    seen = with_features(seen, "_url")
    log_odds = fit(seen.where("rule IS NOT NULL"), "_url", max_rows)
    scored = seen.withColumn("block_score", 1 / (1 + F.exp(-log_odds)))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).select(
        *(F.col(i).alias(c) for c, i in zip(names, inner)), "host", "path", "rule", "verdict", "block_score"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")
