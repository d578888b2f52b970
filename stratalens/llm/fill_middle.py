"""Fill-in-middle transformation.

A text is cut into units: a run of A-Z and a-z is one unit, any other character is one. One Aho-Corasick automaton
over the text, with characters beyond ASCII blanked, reports its events: each ASCII character whose class (letter or
not) differs from that of the one before it, and each sentinel. Between two events a gap is all letters, which is
one unit, or has none, which is as many units as characters; so the gaps' sums give the number of units, and the place of any
unit is found in the few events by a binary search, without a list of units.

Where a text is cut, and in which form it is written, goes by a digest of seed and id. A null text is empty; an empty text, or one
that holds a sentinel, stays plain. A null id draws as if it were empty. Rows that repeat draw and give the same; an empty
table gives no rows; very long texts are read whole; extra columns are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT_BYTES = 1 << 22


@cache
def automaton() -> ahocorasick.Automaton:
    """Finds pairs of ASCII characters of unlike class (value 0) and sentinels (value 1)."""
    found = ahocorasick.Automaton()
    others = [chr(c) for c in range(128) if chr(c) not in ascii_letters]
    for a in ascii_letters:
        for b in others:
            found.add_word(a + b, 0)
            found.add_word(b + a, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """The units of a text: n of them, start(k) where unit k begins (the text's length for k = n)."""

    def __init__(self, text: str):
        blanked = text.encode("ascii", "replace").decode("ascii")  # one character for each
        events = np.fromiter((2 * end + kind for end, kind in automaton().iter(blanked)), np.int64)
        self.sentinel = bool((events & 1).any())
        self.bounds = np.concatenate([[0], events[events & 1 == 0] >> 1, [len(text)]])
        size = np.diff(self.bounds)
        self.letters = np.arange(len(size)) % 2 == (0 if blanked[:1] in ascii_letters else 1)  # gaps alternate
        self.upto = np.concatenate([[0], np.cumsum(np.where(self.letters, np.minimum(size, 1), size))])
        self.n = int(self.upto[-1])

    def start(self, k: int) -> int:
        gap = min(int(np.searchsorted(self.upto, k, side="right")) - 1, len(self.letters) - 1)
        inside = k - int(self.upto[gap])
        return int(self.bounds[gap + 1]) if self.letters[gap] and inside else int(self.bounds[gap]) + inside


def _transform(plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            draws = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1)
            _, offsets = T.utf8(batch.column(1))
            for i, j in T.slices(offsets, OUT_BYTES):
                rows = []
                for text, (h1, h2, h3, h4) in zip(batch.column(1).slice(i, j - i).to_pylist(), draws[i:j].tolist()):
                    text = text or ""
                    units = Units(text)
                    if not text or units.sentinel or h3 % 100 >= plain_from:
                        rows.append((units.n, "plain", None, None, text))
                        continue
                    a, b = (units.start(k) for k in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    if h4 % 100 < spm_below:
                        rows.append((units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        rows.append((units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                columns = zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(list(c), t) for c, t in columns)], names=names)

    return run


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: the number of units, how the text is
    written (plain, psm or spm), the lengths of its parts (null if plain) and the text so written.

    Of 100 texts, plain_from are cut; of 100 that are cut, spm_below have the suffix first."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *draws)
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(T.released(_transform(plain_from, spm_below)), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, rebuilt from its output and form. The parts hold no sentinel, so the first one found is the one written."""

    def whole(first: str, second: str, prefix_first: bool) -> Column:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        b = F.substring_index(F.substring_index(rest, second, -1), MIDDLE, 1)
        middle = F.substring_index(rest, MIDDLE, -1)
        return F.concat(a, middle, b) if prefix_first else F.concat(b, middle, a)

    return F.when(form == "psm", whole(PREFIX, SUFFIX, True)).when(form == "spm", whole(SUFFIX, PREFIX, False)).otherwise(output)
