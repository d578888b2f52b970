"""Language-model scoring by a hidden Markov model.

Words (lower-cased A-Z, runs of bytes outside [\\x20\\x09-\\x0D]) and one end token make a text's sequence. A state emits a
class of words, and the class emits the word: classes are CLASSES hashes of words, whose odds by state the
model learns, and within a class a word has its share of the class's count, add-one smoothed, with one more place for all
words that training doesn't know. So what is broadcast has a fixed size (STATES x CLASSES numbers), while word counts
stay a table that grows with the corpus.

1. Texts become slices: rows of distinct word hashes and of token numbers that point into them.
2. Training words are counted over all slices: a table of words.
3. Baum-Welch: each task runs scaled forward and backward recursions over the class sequences of its training texts; expected
   counts (whole 2^-20ths, so that their sum doesn't depend on order) are summed by class across partitions. A training
   text is learned from in pieces of at most PIECE tokens, all of them; a piece that isn't a text's first starts from the states'
   shares. ROUNDS rounds.
4. Scoring: those words of a slice that others have too meet their counts by a join; then each text's exact likelihood is the scaled forward recursion
   over its whole sequence. Recursions run over blocks of BLOCK tokens at once: a block's product of transition
   matrices, all blocks together, then the chain of blocks.

A null or empty text is the end token alone. Null ids and repeated rows are rows like others, each with its score; an
empty table gives no rows. Without training texts all words are unknown and classes are even. Very long texts are a slice of
their own. Extra columns are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .groups import grouped
from .store import Store, tasks

STATES, CLASSES, ROUNDS = 8, 1 << 13, 5
#: Tokens, dealt by the classes' shares in the corpus, that each state is taken to have emitted besides.
PRIOR = 2000.0
SLICE, BLOCK, PIECE, PART = 1 << 23, 32, 256, 1 << 17
UNIT = float(1 << 20)
END_WORD = -(1 << 63)  # the hash that stands for the end token, whose class is 0
_HASHED = np.uint64(CLASSES - 1)


def classes(words: np.ndarray) -> np.ndarray:
    """Classes of word hashes: 0 for the end, 1 and on for words."""
    out = (words.view(np.uint64) % _HASHED).astype(np.int64) + 1
    out[words == END_WORD] = 0
    return out


def _class(word: Column) -> Column:
    """As classes(), of a signed column: a remainder of the unsigned number, by halves."""
    high, low = F.shiftrightunsigned(word, 32), word.bitwiseAND(F.lit(0xFFFFFFFF))
    rest = (high % (CLASSES - 1) * ((1 << 32) % (CLASSES - 1)) + low) % (CLASSES - 1)
    return F.when(word == END_WORD, 0).otherwise(rest + 1).cast("int")


BLOBS = ("texts", "classes", "own", "seq")


def _squeezed(data: bytes | pa.Buffer) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _spread(data: pa.Buffer) -> pa.Buffer:
    return pa.Codec("zstd").decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (doc_id, learns, text): the slice's distinct words, in order, and how often its training texts have each; and, packed, a table of
    the texts (doc_id, learns, number of tokens), the words' classes and counts, and the places of all tokens in the words."""
    here, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = T.utf8(batch.column(2))
        learns = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in T.slices(offsets, SLICE):
            part, bounds = T.lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
            start, end, doc = T.words(part, bounds)
            h = T.span_hashes(part, start, end).view(np.int64)
            h[h == END_WORD] += 1
            n = np.bincount(doc, minlength=j - i) + 1
            ends = np.cumsum(n) - 1
            seq = np.empty(ends[-1] + 1, np.int64)
            inner = np.ones(len(seq), dtype=bool)
            inner[ends] = False
            seq[ends], seq[inner] = END_WORD, h
            words, at = np.unique(seq, return_inverse=True)
            counts = np.bincount(at, np.repeat(learns[i:j], n), len(words)).astype(np.int64)
            texts = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(learns[i:j]), pa.array(n)], names=["doc_id", "learns", "n"])
            packed = pa.BufferOutputStream()
            with pa.ipc.new_stream(packed, texts.schema) as out:
                out.write_batch(texts)
            blobs = [_squeezed(packed.getvalue()), _squeezed(classes(words).astype("<u2").tobytes()), _squeezed(counts.astype("<i4").tobytes()), _squeezed(at.astype("<i4").tobytes())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([here << 32 | made], pa.int64()), pa.array([words], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)],
                names=["slice", "words", "counts", *BLOBS],
            )
            made += 1


@dataclass
class Model:
    """Odds of the first state, of the next state by state, and of a class by state: start[s], step[s, t], emit[c, s]; and the
    states' shares of all tokens."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    share: np.ndarray

    @classmethod
    def begin(cls, share: np.ndarray) -> Model:
        """States that mostly stay, and emit classes near their shares, each a little otherwise."""
        draw = np.random.Generator(np.random.PCG64(11))
        emit = share[:, None] * draw.uniform(0.5, 1.5, (len(share), STATES))
        step = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1)) + np.eye(STATES) * (0.9 - 0.1 / max(STATES - 1, 1))
        even = np.full(STATES, 1 / STATES)
        return cls(even, step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), even)


class Blocks:
    """Sequences of classes cut into blocks; blocks lie in rows, in order, the last of a sequence filled up with -1."""

    def __init__(self, seq: np.ndarray, n: np.ndarray):
        self.n, self.per = n, -(-n // BLOCK)
        self.first = np.cumsum(self.per) - self.per
        at = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(self.first, n) + at // BLOCK
        self.cells = np.full((int(self.per.sum()), BLOCK), -1, np.int64)
        self.cells[row, at % BLOCK] = seq

    def likelihood(self, model: Model) -> np.ndarray:
        """The log10 likelihood of each sequence."""
        prods, logs = self._products(model)
        total = np.zeros(len(self.n))
        now = np.broadcast_to(model.start, (len(self.n), STATES)).copy()
        live = np.arange(len(self.n))
        for j in range(int(self.per.max(initial=0))):
            live = live[self.per[live] > j]
            row = self.first[live] + j
            after = np.matmul(now[live][:, None, :], prods[row])[:, 0, :]
            scale = after.sum(axis=1)
            total[live] += np.log10(scale) + logs[row]
            now[live] = after / scale[:, None]
        return total

    def _products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """By block, the scaled matrix (state before the first token, state after the last) and its log10 scale.

        A token multiplies by its emissions and then by the step to the next state; a sequence's own end takes no step."""
        m = len(self.cells)
        prods, logs = np.broadcast_to(np.eye(STATES), (m, STATES, STATES)).copy(), np.zeros(m)
        for k in range(BLOCK):
            there = self.cells[:, k] >= 0
            if not there.any():
                break
            some = slice(None) if there.all() else np.flatnonzero(there)
            x = prods[some] * model.emit[self.cells[some, k]][:, None, :]
            x = (x.reshape(-1, STATES) @ model.step).reshape(-1, STATES, STATES)
            if k % 8 == 7 or k == BLOCK - 1:
                scale = x.sum(axis=(1, 2))
                x /= scale[:, None, None]
                logs[some] += np.log10(scale)
            prods[some] = x
        return prods, logs


def expect(model: Model, seq: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected numbers of start states (of the sequences that are first), of steps from state to state, and of classes by
    state: scaled forward and backward recursions over all sequences at once, the longest first, so that those that go on lie in front."""
    order = np.argsort(-n, kind="stable")
    at, n, first = (np.cumsum(n) - n)[order], n[order], first[order]
    kind = np.float32
    step, emit = model.step.astype(kind), model.emit.astype(kind)
    now = np.where(first[:, None], model.start, model.share).astype(kind)
    length = int(n[0])
    live = np.searchsorted(-n, -np.arange(length), side="left")  # sequences longer than t
    seen, odds, alpha = [], [], []
    for t in range(length):
        c = seq[at[: live[t]] + t]
        e = emit[c]
        x = now[: live[t]] * e
        x /= x.sum(axis=1, keepdims=True)
        seen.append(c)
        odds.append(e)
        alpha.append(x)
        now = x @ step
    steps, beta = np.zeros((STATES, STATES)), np.zeros((0, STATES), kind)
    for t in range(length - 1, -1, -1):
        a, more = alpha[t], len(beta)
        after = np.ones_like(a)
        after[:more] = beta @ step.T
        gamma = a * after
        weight = 1 / gamma.sum(axis=1, keepdims=True)
        steps += (a[:more] * weight[:more]).T @ beta
        gamma *= weight
        alpha[t] = gamma
        beta = after * odds[t]
        beta /= beta.sum(axis=1, keepdims=True)
    seen, gammas = np.concatenate(seen), np.concatenate(alpha)
    counts = np.stack([np.bincount(seen, gammas[:, k], len(emit)) for k in range(STATES)], axis=1)
    return alpha[0][first].sum(axis=0, dtype=np.float64), steps * model.step, counts


def _texts(data: pa.Buffer) -> pa.Table:
    with pa.ipc.open_stream(_spread(data)) as source:
        return source.read_all()


def _pieces(seq: np.ndarray, texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of training texts, the lengths of their pieces, and which pieces are the first of a text."""
    n, learns = texts["n"].to_numpy(), texts["learns"].to_numpy()
    seq, n = seq[np.repeat(learns, n)], n[learns]
    per = -(-n // PIECE)
    last = np.cumsum(per) - 1
    size = np.full(int(per.sum()), PIECE)
    size[last] = n - PIECE * (per - 1)
    first = np.zeros(len(size), dtype=bool)
    first[last - per + 1] = True
    return seq, size, first


def _parts(n: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Sequences and tokens dealt into parts of PART tokens or of one longer sequence, which bounds what recursions hold."""
    upto, i, at = np.cumsum(n), 0, 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, at + PART, side="right")))
        yield slice(i, j), slice(at, int(upto[j - 1]))
        i, at = j, int(upto[j - 1])


COUNTS = ", ".join(f"c{s} long" for s in range(STATES))


def _expected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
        for batch in batches:
            for k in range(batch.num_rows):
                texts, of, seq = (batch.column(c)[k].as_buffer() for c in ("texts", "classes", "seq"))
                of, seq = np.frombuffer(_spread(of), "<u2"), np.frombuffer(_spread(seq), "<i4")
                seq, n, first = _pieces(of[seq].astype(np.int64), _texts(texts))
                for pieces, tokens in _parts(n):
                    for x, y in zip(total, expect(m, seq[tokens], n[pieces], first[pieces])):
                        x += y
        rows = np.concatenate([total[2], total[1], total[0][None]])
        some = np.flatnonzero(rows.any(axis=1))
        counts = np.rint(rows[some] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(counts[:, s]) for s in range(STATES))], names=["part", *(f"c{s}" for s in range(STATES))])

    return run


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def train(slices: DataFrame, sizes: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training texts of slices; sizes are the classes' counts. Only STATES numbers a class reach the driver."""
    spark = slices.sparkSession
    share = (sizes + 1) / (sizes.sum() + len(sizes))
    model = Model.begin(share)
    for _ in range(rounds if sizes.sum() else 0):
        sent = spark.sparkContext.broadcast(model)
        found = slices.select("texts", "classes", "seq").mapInArrow(T.released(_expected(sent)), f"part int, {COUNTS}")
        got = np.zeros((CLASSES + STATES + 1, STATES))
        for r in found.groupBy("part").agg(*(F.sum(f"c{s}").alias(f"c{s}") for s in range(STATES))).collect():  # CLASSES + STATES + 1 rows at most
            got[r["part"]] = [r[f"c{s}"] / UNIT for s in range(STATES)]
        sent.unpersist()
        emit = got[:CLASSES] + PRIOR * share[:, None]
        model = Model(_normal(got[-1] + 1), _normal(got[CLASSES:-1] + 1), emit / emit.sum(axis=0), _normal(got[:CLASSES].sum(axis=0)))
    return model


def _scores(model, sizes, distinct, tokens: int, known: int):
    """Scores of slices; a partition has, slice by slice, the slice itself and the counts of those of its words that other slices have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, size, kinds = model.value, sizes.value, distinct.value
        for g in grouped(batches, ["slice"]):
            blob = g.filter(g["seq"].is_valid())
            texts, (of, c, seq) = _texts(blob["texts"][0].as_buffer()), (_spread(blob[k][0].as_buffer()) for k in BLOBS[1:])
            of, c, seq = np.frombuffer(of, "<u2").astype(np.int64), np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(seq, "<i4")
            told = g.filter(g["seq"].is_null())
            c[told["place"].to_numpy()] = told["count"].to_numpy()
            n = texts["n"].to_numpy()
            base = np.log10((c + 1) / (tokens + known + 1))
            within = np.log10((c + 1) / (size[of] + kinds[of] + 1))
            score = np.concatenate([np.zeros(0), *(Blocks(of[seq[b]], n[a]).likelihood(m) for a, b in _parts(n))])
            sums = [np.add.reduceat(x[seq], np.cumsum(n) - n) for x in (base, within, (c > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [texts["doc_id"].combine_chunks(), pa.array(~texts["learns"].to_numpy()), pa.array(n), pa.array(sums[2]), pa.array(sums[0]), pa.array(score + sums[1])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def prepared(docs: DataFrame, held_out: Column, store: Store, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Slices of the texts, and the count of every training word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), ~F.coalesce(held_out, F.lit(False)), F.col(text).cast("string").alias("text"))
    kind = "slice long, words array<long>, counts array<long>, " + ", ".join(f"{k} binary" for k in BLOBS)
    slices = store.save(rows.mapInArrow(T.released(_slices), kind), "slices")
    words = _words(slices).groupBy("word").agg(F.sum("count").alias("count")).where("count > 0")
    return slices, store.save(words, "words")


def _words(slices: DataFrame) -> DataFrame:
    each = slices.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    return each.select("slice", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))


def class_sizes(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    sizes, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.groupBy(_class(F.col("word")).alias("class")).agg(F.sum("count").alias("size"), F.count("*").alias("kinds")).collect():  # CLASSES rows at most
        sizes[r["class"]], kinds[r["class"]] = r["size"], r["kinds"]
    return sizes, kinds


def score(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text", name: str = "markov") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row: log10 probabilities of the
    text by add-one word counts and by the model, both learned from the rows that aren't held out."""
    spark = docs.sparkSession
    slices, words = prepared(docs, held_out, Store(spark, name), doc_id, text)
    sizes, kinds = class_sizes(words)
    model = train(slices, sizes, rounds)
    # a word that no other slice's training texts have has the count that its slice knows
    own = _words(slices).withColumnRenamed("count", "own")
    met = own.join(words, "word").where("count <> own").select("slice", "place", "count", *(F.lit(None).cast("binary").alias(k) for k in BLOBS))
    whole = slices.select("slice", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("count"), *BLOBS)
    sent = [spark.sparkContext.broadcast(x) for x in (model, sizes, kinds)]  # of a fixed size
    dealt = met.union(whole).repartition(tasks(spark), "slice").sortWithinPartitions("slice")
    tokens, known = int(sizes.sum()), int(kinds.sum())
    scored = dealt.mapInArrow(T.released(_scores(*sent, tokens, known)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
