"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on statistics of a whole text.
Expectation-maximisation over the counts of all vote patterns estimates, for each rule,
how it votes on good and on bad texts; a text's posterior probability of being good
replaces all-must-pass filtering. Counts come from every row; their number is bounded by
the patterns (3 to the power of the rules), never by the rows.

A null text has no words and fails the base rules. An empty table has no patterns and the
model is its prior. Repeated rows count as often as they come; null ids are ids like others; very
long texts are read whole; extra columns are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .store import Store

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_bars", "n_letter_words", "n_distinct_words")
#: Rule: (numerator, denominator, good up to, bad from); with good above bad the rule reads the other way.
RULES: dict[str, tuple[str, str, float, float]] = {
    "symbols": ("n_symbols", "n_words", 0.05, 0.3),
    "marks": ("n_marks", "n_words", 0.1, 0.5),
    "bars": ("n_bars", "n_words", 0.02, 0.25),
    "repeats": ("n_repeat_words", "n_words", 0.05, 0.2),
    "lines": ("n_dup_lines", "n_lines", 0.1, 0.4),
    "capitals": ("n_upper", "n_letters", 0.2, 0.6),
    "long_words": ("word_chars", "n_words", 9.0, 14.0),
    "letters": ("n_letter_words", "n_words", 0.85, 0.6),
    "variety": ("n_distinct_words", "n_words", 0.2, 0.08),
}
ROUNDS, SMOOTH, PRIOR = 50, 20.0, 0.9

_MASK = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in {"symbols": b"#*$%&|<>", "marks": b"!?", "bars": b"|"}.items()}
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC3)  # a byte that starts a letter beyond ASCII counts as one


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    m = len(offsets) - 1
    out = np.zeros((m, len(FEATURES)), np.int64)
    column = {k: out[:, i] for i, k in enumerate(FEATURES)}

    def within(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)])

    def a_text(mask: np.ndarray) -> np.ndarray:
        run = within(mask)
        return run[offsets[1:]] - run[offsets[:-1]]

    start, end, doc = T.words(data, offsets)
    column["n_words"][:] = np.bincount(doc, minlength=m)
    run = within((data & 0xC0) != 0x80)
    column["word_chars"][:] = np.bincount(doc, run[end] - run[start], minlength=m)
    for k in _MASK:
        column[f"n_{k}"][:] = a_text(_MASK[k][data])
    column["n_letters"][:], column["n_upper"][:] = a_text(_LETTER[data]), a_text(_UPPER[data])
    run = within(_LETTER[data])
    column["n_letter_words"][:] = np.bincount(doc, run[end] > run[start], minlength=m)

    def later(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by owner and hash; where a value repeats the one before; and where it has a twin."""
        order = np.lexsort((h, owner))
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twin = same.copy()
        twin[:-1] |= same[1:]
        return order, same, twin

    hashes = T.span_hashes(data, start, end)
    order, same, _ = later(doc, hashes)
    column["n_distinct_words"][:] = np.bincount(doc[order][~same], minlength=m)
    h, at = T.windows(hashes, doc, 5)
    order, _, twin = later(doc[at], h)
    cover = np.zeros(len(doc) + 5, np.int64)
    np.add.at(cover, at[order][twin], 1)
    np.add.at(cover, at[order][twin] + 5, -1)
    column["n_repeat_words"][:] = np.bincount(doc, np.cumsum(cover)[: len(doc)] > 0, minlength=m)

    feeds = np.flatnonzero(data == 10)
    owner_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    # a feed that ends its text starts an empty line there, which has no word
    line_start = np.concatenate([offsets[:-1], feeds + 1])
    line_owner = np.concatenate([np.arange(m), owner_of_feed])
    order = np.lexsort((line_start, line_owner))
    line_start, line_owner = line_start[order], line_owner[order]
    line_end = np.append(line_start[1:] - 1, offsets[-1])
    last = np.append(line_owner[1:] != line_owner[:-1], True)
    line_end[last] = offsets[line_owner[last] + 1]
    run = within(~T._SPACE[data])
    full = run[line_end] > run[line_start]
    column["n_lines"][:] = np.bincount(line_owner, full, minlength=m)
    line_start, line_end, line_owner = line_start[full], line_end[full], line_owner[full]
    order, same, _ = later(line_owner, T.span_hashes(data, line_start, line_end))
    column["n_dup_lines"][:] = np.bincount(line_owner[order], same, minlength=m)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.utf8(batch.column(1))
        for i, j in T.slices(offsets):
            got = _counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[:, k], pa.int64()) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(T.released(_features), "doc_id long, " + ", ".join(f"{k} long" for k in FEATURES))


def vote(rule: str) -> Column:
    top, under, good, bad = RULES[rule]
    ratio = F.col(top) / F.col(under)
    ok, fail = (ratio <= good, ratio >= bad) if good <= bad else (ratio >= good, ratio <= bad)
    return F.when(F.col(under) <= 0, 0).when(fail, -1).when(ok, 1).otherwise(0)


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation-maximisation. Returns the log odds of a good text and, for each rule, the
    weight (log odds) that its vote of -1, 0 or 1 adds. A rule's good vote never lowers the
    odds, its bad vote never raises them, and abstaining says nothing."""
    if not len(counts):
        return float(np.log(PRIOR / (1 - PRIOR))), np.zeros((len(RULES), 3))
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = np.where((votes < 0).any(axis=1), 0.2, 0.95)  # to begin with, as all-must-pass would say
    base = np.array([[0.05, 0.15, 0.8], [0.6, 0.2, 0.2]])  # votes expected on good and on bad texts
    for _ in range(ROUNDS):
        weight = np.stack([counts * good, counts * (1 - good)])
        table = np.einsum("cp,prv->crv", weight, onehot) + SMOOTH * base[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        share = (weight[0].sum() + SMOOTH * PRIOR) / (counts.sum() + SMOOTH)
        lean = np.log(table[0] / table[1])
        lean[:, 0], lean[:, 1], lean[:, 2] = np.minimum(lean[:, 0], 0), 0, np.maximum(lean[:, 2], 0)
        start = float(np.log(share / (1 - share)))
        now = 1 / (1 + np.exp(-np.clip(start + np.einsum("prv,rv->p", onehot, lean), -50, 50)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return start, lean


def judge(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, base_failed, each rule's vote, quality (the posterior) and kept of each row."""
    found = Store(docs.sparkSession, "quality").save(features(docs, doc_id, text), "features")
    voted = found.select("*", *(vote(r).alias(f"vote_{r}") for r in RULES))
    names = [f"vote_{r}" for r in RULES]
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    rows = sorted((tuple(p[n] for n in names), p["count"]) for p in patterns)
    start, lean = estimate(np.array([r[0] for r in rows]).reshape(len(rows), len(names)), np.array([r[1] for r in rows], float))
    odds = F.lit(start)
    for n, w in zip(names, lean):
        odds = odds + F.when(F.col(n) < 0, float(w[0])).when(F.col(n) > 0, float(w[2])).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
