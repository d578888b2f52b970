"""Byte-level BPE encoding and decoding from a tokenizer file.

A text is cut at the added tokens' strings, then by the pre-tokenizer's pattern; each piece's
bytes start as symbols of a doubly linked list, and a priority queue of merge ranks joins
neighbours, lowest rank and leftmost first, skipping entries whose symbols have changed.
Decoding concatenates vocabulary strings.

Texts are cut in numpy, a slice of them at once, and pieces of equal 64-bit hashes are merged once. A
table of SLOTS slots keeps merged pieces: a slot holds the last piece that fell to it, and all go when their
bytes pass TABLE_BYTES. A text whose decoded bytes aren't its own is encoded again without hashes, piece
by piece, so that no result rests on a hash.

A null text is encoded as an empty one: no ids. Bytes that aren't UTF-8 become replacement
characters before anything else. Very long texts and pieces need memory in proportion to
themselves. Repeated rows and extra columns change nothing; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T

#: Fixed value: what follows an apostrophe at the start of a piece and stays with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SLOTS, TABLE_BYTES, KEPT_LENGTH = 1 << 19, 1 << 24, 64
#: Bytes of text cut at once: what numpy makes of a slice is some fifty times as large.
SLICE = 1 << 18
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 ones themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE (White_Space) or OTHER of each code point."""
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                out[a : max(a, b)] = kind
    return out


def starts(points: np.ndarray, kind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which characters start a piece; where fresh is set a text starts.

    A piece is an apostrophe with one of ENDINGS, a run of one class with the space before it, or white space;
    white space before another piece leaves its last character to it, or alone if that is not a space."""
    n = len(points)
    run = fresh.copy()
    run[1:] |= kind[1:] != kind[:-1]
    out = run.copy()
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    blank = (kind[at] == SPACE) & (end < n)
    after = end[blank]
    after = after[~fresh[after]]
    out[after - 1] = True
    out[after[points[after - 1] == 0x20]] = False
    # an apostrophe that starts a piece, alone in its run, before letters
    mark = at[(points[at] == 0x27) & (end == at + 1) & (end < n) & out[at]]
    mark = mark[~fresh[mark + 1]]
    for ending in ENDINGS:
        fits = mark[mark + len(ending) < n]
        for k, c in enumerate(ending, 1):
            fits = fits[(points[fits + k] == ord(c)) & ~fresh[fits + k]]
        out[fits + 1] = False
        stop = fits + 1 + len(ending)
        out[stop[stop < n]] = True
    return out


class _Table:
    """Merged pieces: their ids as text, each followed by a comma, then their decoded bytes."""

    def __init__(self):
        self.key, self.place = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, 4), np.uint32)
        self.bytes = bytearray()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash whether it is held, and (start, middle, end, number of ids) if so."""
        if len(self.bytes) > TABLE_BYTES:
            self.key[:] = 0
            self.bytes = bytearray()
        slot = (h % np.uint64(SLOTS)).astype(np.int64)
        return self.key[slot] == h, self.place[slot].astype(np.int64)

    def keep(self, h: np.ndarray, place: np.ndarray) -> None:
        slot = (h % np.uint64(SLOTS)).astype(np.int64)
        self.key[slot], self.place[slot] = h, place


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The spans of data one after another, and the len + 1 bounds of each."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)].tobytes(), upto


class Tokenizer:
    """Merges and vocabulary of a byte-level BPE file; one is sent to each executor."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path} {odd}")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or match whole words are not supported")
        vocabulary = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        text_of = lambda s: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.strings = {i: text_of(s) for s, i in vocabulary.items()} | {i: s for s, i in self.added.items()}
        self.byte_ids = [vocabulary[c] for c in byte_characters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.joined = [c for _, _, c in pairs]
        self.classes = character_classes()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("added", "strings", "byte_ids", "ranks", "joined", "classes")}

    @cached_property
    def _table(self) -> _Table:
        return _Table()

    @cached_property
    def _numbers(self) -> dict[int, bytes]:
        return {i: b"%d," % i for i in self.strings}

    @cached_property
    def _added(self):
        return regex.compile(b"|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) or rb"(?!)")

    @cached_property
    def _first_ranks(self) -> list[int]:
        """The rank of each pair of bytes."""
        none = len(self.joined)
        return [self.ranks.get(a << 32 | b, none) for a in self.byte_ids for b in self.byte_ids]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(piece)
        ids = [self.byte_ids[b] for b in piece]
        if n == 1:
            return ids
        rank_of, joined, first = self.ranks.get, self.joined, self._first_ranks
        none = len(joined)
        # rank[i]: that of the pair of symbol i and its successor; a queue entry with another rank is stale
        rank = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        queue = [r << 32 | i for i, r in enumerate(rank) if r < none]
        if not queue:
            return ids
        rank.append(none)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r = pop(queue)
            i = r & 0xFFFFFFFF
            r >>= 32
            if rank[i] != r:
                continue
            j = after[i]
            k = after[j]
            ids[i] = new = joined[r]
            ids[j], rank[j], after[i] = -1, none, k
            if k >= 0:
                before[k] = i
                rank[i] = r = rank_of(new << 32 | ids[k], none)
                if r < none:
                    push(queue, r << 32 | i)
            else:
                rank[i] = none
            h = before[i]
            if h >= 0:
                rank[h] = r = rank_of(ids[h] << 32 | new, none)
                if r < none:
                    push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """The bounds of the pieces of some texts in UTF-8, and the ids of those (by their start) that are added tokens."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        fresh = np.zeros(len(points) + 1, dtype=bool)
        fresh[np.searchsorted(chars, offsets)] = True
        added, spans = {}, []
        whole = data.tobytes()
        if self._added.search(whole):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for m in self._added.finditer(whole, a, b):
                    added[m.start()] = self.added[m[0]]
                    spans.append(np.searchsorted(chars, m.span()))
            for a, b in spans:
                fresh[[a, b]] = True
        out = starts(points, self.classes[points], fresh[:-1])
        for a, b in spans:
            out[a + 1 : b] = False
        return np.append(chars[out], len(data)), added

    def _merged(self, raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray, added: dict[int, int]) -> np.ndarray:
        """The places in the table's bytes of pieces of raw that have hashes h."""
        table, numbers, strings = self._table, self._numbers, self.strings
        held, place = table.find(h)
        new = np.flatnonzero(~held)
        rows, out = [], table.bytes
        for a, b in zip(start[new].tolist(), end[new].tolist()):
            ids = [added[a]] if a in added else self.merge(raw[a:b])
            at = len(out)
            out += b"".join([numbers[i] for i in ids])
            middle = len(out)
            out += b"".join([strings[i] for i in ids])
            rows.append((at, middle, len(out), len(ids)))
        if rows:
            place[new] = rows
            new = new[end[new] - start[new] <= KEPT_LENGTH]
            table.keep(h[new], place[new])
        return place

    def texts(self, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids, each followed by a comma, and the decoded bytes."""
        data, offsets = T.utf8(column)
        for i, j in T.slices(offsets, SLICE):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                yield from [(0, b"", b"")] * (j - i)
                continue
            raw = part.tobytes()
            at, added = self._cut(part, bounds)
            alike = pa.array(T.span_hashes(part, at[:-1], at[1:])).dictionary_encode()
            h, alike = alike.dictionary.to_numpy(), alike.indices.to_numpy()
            first = np.zeros(len(h), np.int64)
            first[alike[::-1]] = np.arange(len(alike))[::-1]
            place = self._merged(raw, h, at[first], at[first + 1], added)[alike]
            held = np.frombuffer(self._table.bytes, np.uint8)
            ids, ids_upto = _gather(held, place[:, 0], place[:, 1] - place[:, 0])
            decoded, upto = _gather(held, place[:, 1], place[:, 2] - place[:, 1])
            del held
            n = np.concatenate([[0], np.cumsum(place[:, 3])])
            cuts = np.searchsorted(at[:-1], bounds)
            n, ids_upto, upto = n[cuts].tolist(), ids_upto[cuts].tolist(), upto[cuts].tolist()
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                got = n[k + 1] - n[k], ids[ids_upto[k] : ids_upto[k + 1]], decoded[upto[k] : upto[k + 1]]
                yield got if got[2] == raw[a:b] else self._alone(raw, at[cuts[k] : cuts[k + 1] + 1].tolist(), added)

    def _alone(self, raw: bytes, at: list[int], added: dict[int, int]) -> tuple[int, bytes, bytes]:
        ids = [i for a, b in zip(at[:-1], at[1:]) for i in ([added[a]] if a in added else self.merge(raw[a:b]))]
        return len(ids), b"".join([b"%d," % i for i in ids]), self.decode_bytes(ids)

    def encode(self, text: str) -> list[int]:
        (_, ids, _), = self.texts(pa.array([text], pa.large_string()))
        return [int(x) for x in ids.split(b",")[:-1]]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.strings[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _valid(column: pa.Array) -> pa.Array:
    """The texts, bytes that aren't UTF-8 replaced."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([x and x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())


def _run(tokenizer, digests: bool):
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def encoded(t: Tokenizer, part: pa.RecordBatch) -> pa.RecordBatch:
        # decoded bytes that aren't UTF-8 become replacement characters
        rows = ((n, ids[:-1], decoded.decode("utf-8", "replace")) for n, ids, decoded in t.texts(_valid(part.column(1))))
        if digests:
            rows = [(n, digest(ids), digest(decoded.encode())) for n, ids, decoded in rows]
            n, ids, decoded = zip(*rows)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _, ids, decoded = zip(*rows)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([[int(x) for x in y.split(b",")] if y else [] for y in ids], pa.list_(pa.int32())), pa.array(decoded)], names=["doc_id", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield encoded(t, batch.slice(i, 512))
            T.release()

    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of each row, or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    path names a tokenizer file on the driver; its tables, of the file's fixed size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(path))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return narrow.mapInArrow(T.released(_run(shared, digests)), kind)
