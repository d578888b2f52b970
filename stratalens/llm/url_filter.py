"""URL filters by gradient-boosted trees on lexical features.

Rules of a host and a path prefix give the verdict where one fits; the longest wins.
Elsewhere a boosted ensemble of histogram trees, fitted in numpy by logistic loss, judges
the URL by its length, depth, digit ratio, entropy, parameter counts and the statistics of
its host's suffixes: how often, and how often blocked, over every labelled URL of other folds. Folds go by the
URL's hash, so that neither a URL's own label nor that of its copies is among its features. The statistics are
aggregated by suffix first; those of suffixes that hold HOT of all URLs or more, at most 1 / HOT of them, are broadcast,
the others joined by shuffle. The trees learn from at most SAMPLE labelled URLs, whole, the smallest hashes.

A URL that is null or lacks `://` has an empty host and path, fits no rule and has
features of its parts as they are. With no labelled URL, or labels of one kind, every other URL gets
DEFAULT or that kind. Every row keeps one row; an empty table gives no rows; extra columns are left out.
Very long URLs are read whole. Of rules of equal length that fit, the last by code points wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .store import Store

SAMPLE, DEFAULT, FOLDS, HOT = 20_000, "allow", 5, 1e-3
TREES, DEPTH, RATE, LEAST, RIDGE, CUTS = 40, 3, 0.2, 5, 1.0, 32
FEATURES = ("length", "host_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "longest_label", "top_count", "top_share", "site_count", "site_share", "secure")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path prefix) that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


@dataclass
class Model:
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, bar, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bar[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def _segments(data: np.ndarray, offsets: np.ndarray, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of parts between marks that aren't empty, and the bytes of the longest, for each text."""
    inside = data != ord(mark)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    owner = np.searchsorted(offsets, start, side="right") - 1
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, owner, end - start)
    return np.bincount(owner, minlength=len(offsets) - 1), longest


ROWS = 4096


def features(urls: pa.Array, hosts: pa.Array, paths: pa.Array, queries: pa.Array, top: np.ndarray, site: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each URL, from the bytes of all at once; top and site have the count and the blocked count of its suffixes, a row for each."""
    n, parts = len(urls), [T.utf8(x) for x in (urls, hosts, paths, queries)]
    x = np.zeros((n, len(FEATURES)))

    def within(which: int, mask) -> np.ndarray:
        data, offsets = parts[which]
        run = np.concatenate([[0], np.cumsum(mask(data))])
        return run[offsets[1:]] - run[offsets[:-1]]

    def entropy(which: int) -> np.ndarray:
        data, offsets = parts[which]
        out = np.zeros(n)
        for i in range(0, n, ROWS):
            j = min(i + ROWS, n)
            size = np.diff(offsets[i : j + 1])
            owner = np.repeat(np.arange(j - i), size)
            share = np.bincount(owner * 256 + data[offsets[i] : offsets[j]], minlength=(j - i) * 256).reshape(j - i, 256) / np.maximum(size, 1)[:, None]
            out[i:j] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        return out

    characters = lambda d: (d & 0xC0) != 0x80
    digit, at = lambda d: (d >= 48) & (d <= 57), lambda c: lambda d: d == ord(c)
    x[:, 0], x[:, 1] = within(0, characters), within(1, characters)
    x[:, 2] = within(1, at(".")) + (x[:, 1] > 0)
    x[:, 3] = _segments(*parts[2], "/")[0]
    x[:, 4], x[:, 5] = within(0, digit) / np.maximum(x[:, 0], 1), within(1, digit) / np.maximum(x[:, 1], 1)
    x[:, 6], x[:, 7] = entropy(0), entropy(1)
    x[:, 8] = _segments(*parts[3], "&")[0]
    x[:, 9] = within(1, at("-")) + within(2, at("-"))
    x[:, 10] = _segments(*parts[1], ".")[1]
    for k, suffix in ((11, top), (13, site)):
        count, blocked = np.asarray(suffix, float).reshape(n, 2).T
        x[:, k], x[:, k + 1] = np.log1p(count), (blocked + 0.5) / (count + 1)
    data, offsets = parts[0]
    secure = np.ones(n, dtype=bool)
    for k, c in enumerate(b"https://"):
        here = offsets[:-1] + k
        there = here < offsets[1:]
        secure &= there
        secure[there] &= T.lowered(data[here[there]]) == c
    x[:, 15] = secure
    return x


def query_of(url: Column) -> Column:
    """What follows the first ? up to #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?]*\?([^#]*)", 1)


def train(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Boosted trees of DEPTH levels over quantile bins; y is 1 for blocked."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    odds, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - y, p * (1 - p)
        feature, bar = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best, total_g, total_h = 1e-9, g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c) or len(rows) < 2 * LEAST:
                        continue
                    b = binned[rows, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = 0
                    if (k := int(gain.argmax())) is not None and gain[k] > best:
                        best, feature[at], bar[at] = gain[k], f, c[k]
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > bar[at])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, minlength=2**DEPTH) / (np.bincount(leaf, h, minlength=2**DEPTH) + RIDGE)
        odds += value[leaf]
        trees.append((feature, bar, value))
    return start, trees


def _attached(rows: DataFrame, store: Store, total: int) -> DataFrame:
    """rows with top and site replaced by (count, blocked) of these suffixes over the labelled rows of other folds."""
    out = rows
    for key in ("top", "site"):
        one = lambda k, c: F.count(F.when((F.col("fold") == k) & c, 1))
        blocked, known = F.col("blocked"), F.col("blocked").isNotNull()
        counts = rows.groupBy(key).agg(F.count("*").alias("rows"), F.array(*(F.struct(one(k, known).alias("n"), one(k, blocked).alias("b")) for k in range(FOLDS))).alias("in"))
        every = lambda f: F.aggregate("in", F.lit(0).cast("long"), lambda s, x: s + x[f])
        others = F.transform("in", lambda x: F.array(every("n") - x["n"], every("b") - x["b"]))
        counts = store.save(counts.select(key, "rows", others.alias("others")), key)
        hot = F.broadcast(counts.where(F.col("rows") >= HOT * total).drop("rows"))
        cold = out.join(hot, key, "left_anti").join(counts.where(F.col("rows") < HOT * total).drop("rows"), key)
        out = out.join(hot, key).unionByName(cold).withColumn(key, F.get("others", F.col("fold"))).drop("others")
    return out


def _sampled(known: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, answers (1: blocked) and folds of at most `sample` labelled rows."""
    share = min(1.0, 4 * sample / max(known.count(), 1))
    key = F.xxhash64("url")
    few = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key.alias("key"), "url", "host", "path", "top", "site", "blocked", "fold")
    few = few.withColumn("query", query_of(F.col("url")))
    rows = sorted(map(tuple, few.orderBy("key", "url").limit(sample).collect()))
    _, url, host, path, top, site, blocked, fold, query = map(list, zip(*rows))
    texts = [pa.array(x, pa.string()) for x in (url, host, path, query)]
    return features(*texts, np.array(top), np.array(site)), np.array(blocked, float), np.array(fold)


def fit(known: DataFrame, sample: int = SAMPLE) -> Model | str:
    """known has url, host, path, top, site, blocked (boolean) and fold. A model, or the verdict that all get."""
    seen = {r["blocked"] for r in known.groupBy("blocked").count().collect()}
    if len(seen) < 2:
        return DEFAULT if not seen else "block" if seen.pop() else "allow"
    x, y, _ = _sampled(known, sample)
    return Model(*train(x, y))


def auc(answers: np.ndarray, scores: np.ndarray) -> float:
    """The share of pairs of a blocked and an allowed URL in which the blocked one scores higher, ties by half."""
    values, back = np.unique(scores, return_inverse=True)
    yes, no = (np.bincount(back, answers == k, len(values)) for k in (1, 0))
    return float((yes * (np.cumsum(no) - no / 2)).sum() / (yes.sum() * no.sum()))


def held_out_auc(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", labelled: DataFrame | None = None, sample: int = SAMPLE) -> float:
    """How well trees fitted on the sample's other folds tell its first fold's labels."""
    rows = _parsed(pages, rules, "url" if labelled is not None else url, url, labelled)
    store = Store(pages.sparkSession, "urls")
    rows = store.save(rows, "rows")
    x, y, fold = _sampled(_attached(rows, store, rows.count()).where("blocked is not null"), sample)
    model = Model(*train(x[fold > 0], y[fold > 0]))
    return auc(y[fold == 0], model.odds(x[fold == 0]))


def _parsed(pages: DataFrame, rules: list[tuple[str, str]], page_id: str, url: str, labelled: DataFrame | None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, top, site, fold, blocked and page of pages, and of the labelled URLs (page: false)."""
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).cast("string").alias("url"), F.lit(None).cast("boolean").alias("blocked"), F.lit(True).alias("page"))
    if labelled is not None:
        more = labelled.where("url is not null and blocked is not null")
        rows = rows.union(more.select(F.lit(None).cast("string"), F.col("url").cast("string"), F.col("blocked").cast("boolean"), F.lit(False)))
    host, path = split_url(F.col("url"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    if labelled is None:
        rows = rows.withColumn("blocked", F.col("verdict") == "block")
    fold = F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int")
    return rows.select("*", F.substring_index("host", ".", -1).alias("top"), F.substring_index("host", ".", -2).alias("site"), fold.alias("fold"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each URL. labelled has url and blocked; without it the
    URLs that rules decide are the labelled ones. score is the model's probability of block, also where a rule decides."""
    store = Store(pages.sparkSession, "urls")
    rows = store.save(_parsed(pages, rules, page_id, url, labelled), "rows")
    rows = store.save(_attached(rows, store, rows.count()), "attached")
    model = fit(rows.where("blocked is not null"))
    rows = rows.where("page").withColumn("page_id", F.col("page_id").cast("long"))
    if isinstance(model, str):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(model)).alias("verdict"), F.lit(float(model == "block")).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        net = shared.value
        for *texts, top, site in batches:
            x = features(*texts, top.flatten().to_numpy(), site.flatten().to_numpy())
            yield pa.array(1 / (1 + np.exp(-net.odds(x))))

    score = F.arrow_udf(run, "double")("url", "host", "path", query_of(F.col("url")), "top", "site")
    scored = rows.withColumn("score", score)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
