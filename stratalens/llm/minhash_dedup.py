"""MinHash near-dedup by an LSH forest.

1. Each text becomes its set of distinct n-word shingles (64-bit hashes of lower-cased
   words) and a MinHash signature. Texts of equal sets are one class, which its row of the smallest id stands for.
2. The forest: every class has one row in each of TREES sorted signature orders, a range
   sort whose key is the tree's own signature values. Neighbours with a common prefix are
   candidates; the prefix asked for deepens from MIN_DEPTH to DEPTH values where a region
   holds more than REGION rows. Regions still larger at full depth, rows of one key, are compared
   whole, in tiles dealt over tasks if they are crowds (see crowds). Candidates whose signatures agree in
   `near` of HASHES values (half a byte of each; 5 standard deviations below the threshold) join a family.
3. Families: components of those edges. Each member's text is sent once to its
   family's tile, and once more for each tile that holds members apart from the family's largest part; all pairs
   of a tile, or of two, are decided exactly on full sets, by products of incidence matrices, and only the
   spanning forest of the confirmed links leaves the task.
4. Components of the confirmed links name the groups.

Nulls and texts without words have no shingles and link with nothing. Rows that repeat an
id are told apart by their texts and keep a row each. A null id is kept, never in a group. An empty table gives no rows.
Very long texts are read whole, a slice of their own. Of equal candidates the smallest id names a group, and of rows that repeat
id and text unique() keeps the first by all their columns. Extra columns are left out by near_duplicates() and kept by unique(),
whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .components import components, roots
from .crowds import LIMIT, dealt, forest, links_within
from .groups import grouped_runs
from .store import Store, bits, holds, tasks

TREES, DEPTH, MIN_DEPTH, REGION = 16, 6, 3, 64
HASHES = TREES * DEPTH
#: Members of a family in one tile, and tiles of a family that all meet one another.
TILE, WHOLE = 512, 16
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
SEEDS = np.random.Generator(np.random.PCG64(85)).integers(1, 1 << 63, HASHES)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(2))
            for i, j in T.slices(offsets):
                part, bounds = T.lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                h, at = T.shingle_sets(part, bounds, n)
                count = np.diff(at)
                sig = T.minhashes(h, at, SEEDS).astype(">u4")
                # two independent 64-bit sums over the set: its digest
                both = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h + np.uint64(s)))]) for s in (11, 23)]
                digest = np.stack([x[at[1:]] - x[at[:-1]] for x in both] + [count.astype(np.uint64)], axis=1).astype("<u8")
                # the last half byte of each value, two values to a byte
                last = sig.view(np.uint8).reshape(len(sig), HASHES, 4)[:, :, 3] & 15
                half = last[:, 0::2] | last[:, 1::2] << 4
                full = count > 0
                binary = lambda rows: pa.array([x.tobytes() if f else None for x, f in zip(rows, full)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(count, pa.int64()), binary(digest), binary(sig), binary(half)], names=["doc_id", "th", "n_shingles", "digest", "sig", "half"])

    return run


def _agree(near: int):
    """Which rows of two arrays of halved signatures agree in `near` values."""

    def matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _equal(x[:, None, :], y[None, :, :]) >= near

    return matrix


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x ^ y
    return ((z & 15) == 0).sum(axis=-1, dtype=np.int16) + (z < 16).sum(axis=-1, dtype=np.int16)


def _neighbours(near: int):
    """Over rows (key, half, id) in order of key: edges between rows of one region whose signatures agree in `near` values.

    Rows of regions that hold more than REGION rows at full depth are compared with REGION rows before them only."""

    def edges(key: np.ndarray, half: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(ids)
        same = np.ones((m, DEPTH + 1), dtype=bool)  # same[i, d]: row i shares d values and the tree with row i - 1
        same[0] = False
        eq = np.concatenate([(key[1:, :1] == key[:-1, :1]), (key[1:, 1:].reshape(m - 1, DEPTH, 4) == key[:-1, 1:].reshape(m - 1, DEPTH, 4)).all(axis=2)], axis=1)
        same[1:] = np.logical_and.accumulate(eq, axis=1)
        depth = np.full(m, DEPTH)
        for d in range(DEPTH - 1, MIN_DEPTH - 1, -1):
            run = np.cumsum(~same[:, d]) - 1
            depth[np.bincount(run)[run] <= REGION] = d
        shared = np.where(same.any(axis=1), same.sum(axis=1) - 1, -1)  # values shared with the row before
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, low = np.arange(m), shared.copy()  # low: values that row `at` shares with the row `off` before it
        for off in range(1, REGION + 1):
            some = (low >= MIN_DEPTH) & (at >= off)
            at, low = at[some], low[some]
            if not len(at):
                break
            deep = low >= np.maximum(depth[at], depth[at - off])
            x = at[deep]
            x = x[_equal(half[x], half[x - off]) >= near]
            a_out.append(x)
            b_out.append(x - off)
            low = np.minimum(low, shared[at - off])
        # rows of one class in several trees are one node
        return forest(ids, np.concatenate(a_out), np.concatenate(b_out))

    return edges


def _bytes(column: pa.Array) -> np.ndarray:
    """A row of bytes for each value; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(parts: list[Rows]) -> Rows:
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Keys:
    """Takes rows (key, half, id) in order of key, part by part. Gives the rows of each key that more than REGION rows share,
    whole (False), and the rows, as they come, of the first and last key and of keys that more than LIMIT rows share (True)."""

    def __init__(self):
        self.held: list[Rows] = []  # the rows so far of the open key, unless they are passed on
        self.passed, self.last = True, None

    def _close(self) -> Iterator[tuple[bool, Rows]]:
        if sum(len(x[2]) for x in self.held) > REGION:
            yield False, _joined(self.held)
        self.held, self.passed = [], False

    def push(self, rows: Rows) -> Iterator[tuple[bool, Rows]]:
        key = rows[0]
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        # keys that end in these rows and are shared by few are left out, but for the first
        runs = [tuple(x[s:e].copy() for x in rows) for s, e in zip(cuts[:-1], cuts[1:]) if s == 0 or e == len(key) or e - s > REGION]
        for k, run in enumerate(runs):
            if k or self.last is not None and (key[0] != self.last).any():
                yield from self._close()
            if self.passed:
                yield True, run
                continue
            self.held.append(run)
            if sum(len(x[2]) for x in self.held) > LIMIT:
                yield True, _joined(self.held)
                self.held, self.passed = [], True
        self.last = key[-1].copy()

    def end(self) -> Iterator[tuple[bool, Rows]]:
        if self.held:
            yield True, _joined(self.held)


def _walk(near: int, closed: bool):
    """Edges of a partition's sorted rows. Unless closed, also its first and last REGION rows, named by the border they lie
    at, and, with neither v nor border, the rows of keys that lie at a border or are shared by more than LIMIT rows."""
    edges, agree = _neighbours(near), _agree(near)

    def out(u, v=None, border=None, key=None, half=None):
        n = len(u)
        blank = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        binary = lambda x: None if x is None else [y.tobytes() for y in x]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), blank(v, pa.int64()), blank(border, pa.int32()), blank(binary(key), pa.binary()), blank(binary(half), pa.binary())], names=["u", "v", "border", "key", "half"])

    def compared(parts: Iterator[tuple[bool, Rows]]) -> Iterator[pa.RecordBatch]:
        for crowd, (key, half, ids) in parts:
            yield out(ids, key=key, half=half) if crowd else out(*forest(ids, *links_within(half, agree)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept, keys = TaskContext.get().partitionId(), None, _Keys()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = new = _bytes(batch.column("key")), _bytes(batch.column("half")), batch.column("id").to_numpy(zero_copy_only=False)
            if kept is not None:
                rows = _joined([kept, new])
            elif not closed:
                head = [x[:REGION] for x in new]
                yield out(head[2], border=np.full(len(head[2]), here), key=head[0], half=head[1])
            yield out(*edges(*rows))
            kept = tuple(x[-2 * REGION :].copy() for x in rows)
            if not closed:
                yield from compared(keys.push(new))
        if kept is not None and not closed:
            yield from compared(keys.end())
            tail = [x[-REGION:] for x in kept]
            yield out(tail[2], border=np.full(len(tail[2]), here + 1), key=tail[0], half=tail[1])

    return run


def _member_texts(firsts, names):
    """Lower-cased texts of the rows whose id and text may stand for a class that is a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = np.frombuffer(firsts.value, np.uint8), np.frombuffer(names.value, np.uint8)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            known &= holds(ids, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)) & holds(texts, batch.column(1).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(known))
            data, offsets = T.utf8(batch.column(2))
            for i, j in T.slices(offsets):
                part, bounds = T.lowered(data[offsets[i] : offsets[j]]).tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([part[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["first", "id", "payload"])

    return run


def word_sets(n: int):
    """Makes the sorted sets of n-word shingles of lower-cased texts."""

    def sets(payloads: list[pa.Buffer]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        offsets = np.concatenate([[0], np.cumsum([x.size for x in payloads])])
        for i, j in T.slices(offsets):
            h, at = T.shingle_sets(np.frombuffer(b"".join(payloads[i:j]), np.uint8), offsets[i : j + 1] - offsets[i], n)
            out += [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return out

    return sets


def linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in a, j in b, i != j) of sets with den * intersection >= num * union.

    Tokens that many sets have are counted by products of incidence matrices; of a token that few have, each pair is counted."""
    size = np.array([len(s) for s in sets])
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    new = np.ones(len(token) + 1, dtype=bool)
    new[1:-1] = token[1:] != token[:-1]
    shared = ~(new[1:] & new[:-1])
    owner, run = owner[shared], np.cumsum(new[:-1])[shared]
    count = np.diff(np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]]))
    many = count * count > max(64, len(a) * len(b) // 100)
    dense = np.repeat(many, count)
    row_a, row_b = np.full(len(sets), -1), np.full(len(sets), -1)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    of_many, column = owner[dense], np.repeat(np.arange(many.sum()), count[many])
    for c in range(0, int(many.sum()), COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        o, x = of_many[i:j], column[i:j] - c
        width = min(COLUMNS, int(many.sum()) - c)
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        left[row_a[o][row_a[o] >= 0], x[row_a[o] >= 0]] = 1
        right[row_b[o][row_b[o] >= 0], x[row_b[o] >= 0]] = 1
        both += left @ right.T
    owner, run = owner[~dense], run[~dense]
    at, off = np.arange(len(run)), 1
    while True:
        at = at[at + off < len(run)]
        at = at[run[at + off] == run[at]]
        if not len(at):
            break
        for x, y in ((owner[at], owner[at + off]), (owner[at + off], owner[at])):
            i, j = row_a[x], row_b[y]
            there = (i >= 0) & (j >= 0)
            np.add.at(both.reshape(-1), i[there] * len(b) + j[there], np.float32(1))
        off += 1
    inter = both.astype(np.int64)
    hit = den * inter >= num * (size[a][:, None] + size[b][None, :] - inter)
    hit &= a[:, None] != b[None, :]
    x, y = np.nonzero(hit)
    return a[x], b[y]


def _confirm(num: int, den: int, sets_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for table, cuts in grouped_runs(batches, ["family", "a", "b"]):
            ids, tile, first, second = (table[k].to_numpy() for k in ("id", "tile", "a", "b"))
            sets = sets_of([x.as_buffer() for x in table["payload"]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s == 2:  # most families are pairs
                    if tile[s] == first[s] and tile[s + 1] == second[s] or tile[s + 1] == first[s] and tile[s] == second[s]:
                        x = np.concatenate(sets[s : s + 2])
                        x.sort()
                        n = int(np.count_nonzero(x[1:] == x[:-1]))
                        if den * n >= num * (len(sets[s]) + len(sets[s + 1]) - n):
                            u.append(ids[s + 1 : e])
                            v.append(ids[s : s + 1])
                elif e - s > 2:
                    a, b = np.flatnonzero(tile[s:e] == first[s]), np.flatnonzero(tile[s:e] == second[s])
                    if len(a) and len(b):
                        root = roots(e - s, *linked(sets[s:e], a, b, num, den))
                        far = np.flatnonzero(root != np.arange(e - s))
                        u.append(ids[s:e][far])
                        v.append(ids[s:e][root[far]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], names=["u", "v"])

    return run


def families(family: DataFrame) -> DataFrame:
    """(id, family, size) of every node of components()."""
    member = family.select(F.col("u").alias("id"), F.col("v").alias("family")).union(family.select(F.col("v").alias("id"), F.col("v").alias("family")).distinct())
    return member.join(member.groupBy("family").agg(F.count("*").alias("size")), "family")


def _compared(tiled: DataFrame, num: int, den: int, sets_of) -> DataFrame:
    """(u, v) of spanning forests of the links between the tiles a and b of each family; rows have family, a, b, tile, id, payload."""
    rows = tiled.select("family", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "payload")
    return rows.repartition(tasks(tiled.sparkSession), "family", "a", "b").sortWithinPartitions("family", "a", "b", "id").mapInArrow(T.released(_confirm(num, den, sets_of)), "u long, v long")


def confirmed(sets: DataFrame, member: DataFrame, num: int, den: int, sets_of, store: Store, name: str) -> DataFrame:
    """(u, v) that join every two sets of a family with den * intersection >= num * union, directly or through others.

    sets has (id, payload); sets_of makes sorted sets of distinct hashes of a list of payloads. A family is dealt into tiles. Up to
    WHOLE of them, all meet one another. In a larger family all pairs of a tile are compared, and its first member is in every
    tile, so that what is like it is joined across tiles; where it is still in parts, those outside the largest part meet all the
    others, tile by tile. So the work grows with a family's members, times the tiles of those outside its largest part."""
    deal = lambda n: F.ceil(n / TILE).cast("int")
    blocks, own = deal(F.col("size")), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    pair, all_tiles = lambda t, o: F.struct(t.alias("tile"), o.alias("other")), F.sequence(F.lit(0), blocks - 1)
    first = F.when(blocks <= WHOLE, F.transform(all_tiles, lambda o: pair(own(blocks), o))).when(F.col("id") == F.col("family"), F.transform(all_tiles, lambda o: pair(o, o))).otherwise(F.array(pair(own(blocks), own(blocks))))
    every, large = sets.join(member, "id"), member.where(F.col("size") > TILE * WHOLE)
    done = large.isEmpty()
    if not done:
        every = store.save(every, f"{name}_texts")  # they are read again
    met = every.withColumn("_pair", F.explode(first)).select("id", "payload", "family", "_pair.*")
    links = _compared(met, num, den, sets_of)
    if done:
        return links
    links = store.save(links, f"{name}_within")
    inside = links.join(large.select(F.col("id").alias("u")), "u", "left_semi")
    part = families(components(inside, store, f"{name}_parts")).select("id", F.col("family").alias("part"))
    large = large.join(part, "id", "left").select("id", "family", F.coalesce("part", "id").alias("part"))
    parts = large.groupBy("family", "part").agg(F.count("*").alias("n"))
    most = parts.groupBy("family").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("size")).where("size > most.n")
    most = most.select("family", F.col("most.part").alias("main"), deal(F.col("most.n")).alias("inside"), deal(F.col("size") - F.col("most.n")).alias("outside"))
    apart = store.save(large.join(most, "family"), f"{name}_apart")
    inner = F.col("part") == F.col("main")
    tile = F.when(inner, F.col("outside") + own(F.col("inside"))).otherwise(own(F.col("outside")))
    others = F.sequence(F.lit(0), F.when(inner, F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1)
    apart = apart.select("id", "family", tile.alias("tile"), others.alias("others"))
    tiled = every.select("id", "payload").join(apart, "id").withColumn("other", F.explode("others"))
    return links.union(_compared(tiled, num, den, sets_of))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    words = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(words).alias("th"), words.alias("text"))


def _classes(docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, digest) of each row, th a hash of its text, and (digest, first, id, component, name) of each
    class: the smallest id of its rows and the hash of that row's text, and the same of the class that names its group."""
    spark = docs.sparkSession
    store, many = Store(spark, name), tasks(spark)
    texts = _texts(docs, doc_id, text)
    signed = store.save(texts.mapInArrow(T.released(_signatures(n)), "doc_id long, th long, n_shingles long, digest binary, sig binary, half binary"), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("sig").alias("sig"), F.first("half").alias("half"))
    classes = store.save(classes.select("digest", F.col("first.doc_id").alias("first"), F.col("first.th").alias("id"), "sig", "half"), "classes")

    low = HASHES * num / den
    near = int(low - 5 * (low * (1 - num / den)) ** 0.5)
    trees = F.array(*(F.concat(F.unhex(F.lit(f"{t:02x}")), F.expr(f"substring(sig, {4 * DEPTH * t + 1}, {4 * DEPTH})")) for t in range(TREES)))
    rows = classes.select("id", "half", trees.alias("trees")).select("id", "half", F.explode("trees").alias("key"))
    ordered = rows.repartitionByRange(many, "key", "id").sortWithinPartitions("key", "id")
    kind = "u long, v long, border int, key binary, half binary"
    walked = store.save(ordered.select("key", "half", "id").mapInArrow(T.released(_walk(near, False)), kind), "walked")
    borders = walked.where("border is not null").select("border", "key", "half", F.col("u").alias("id")).repartition(many, "border").sortWithinPartitions("border", "key", "id")
    crowd = walked.where("v is null and border is null").select(F.col("key").alias("bucket"), F.col("u").alias("id"), F.col("half").alias("row"))
    edges = walked.where("v is not null").select("u", "v").union(borders.select("key", "half", "id").mapInArrow(T.released(_walk(near, True)), kind).select("u", "v"))
    family = components(edges.union(dealt(crowd, lambda t: _bytes(t["row"]), _agree(near))), store, "family")
    store.drop("walked")

    member = store.save(families(family).join(classes.select("id", "first"), "id"), "member")
    firsts, names = (spark.sparkContext.broadcast(bits(member, c)) for c in ("first", "id"))
    found = texts.mapInArrow(T.released(_member_texts(firsts, names)), "first long, id long, payload binary")
    found = found.join(member.select("first", "id"), ["first", "id"], "left_semi").select("id", "payload")
    joined = components(confirmed(found, member.drop("first"), num, den, word_sets(n), store, "confirmed"), store, "links")
    group = families(joined).select("id", F.col("family").alias("root"))
    group = group.join(classes.select("id", "first"), "id")
    leader = group.groupBy("root").agg(F.min(F.struct("first", "id")).alias("leader"))
    group = group.join(leader, "root").select("id", "leader")
    named = classes.select("digest", "first", "id").join(group, "id", "left").select("digest", "first", "id", F.coalesce("leader.first", "first").alias("component"), F.coalesce("leader.id", "id").alias("name"))
    named = store.save(named, "named")
    store.drop("classes")
    store.drop("member")
    return signed.select("doc_id", "th", "n_shingles", "digest"), named


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", name: str = "near") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups of texts whose n-word shingle
    sets have Jaccard similarity >= num / den, chains included."""
    signed, named = _classes(docs, n, num, den, doc_id, text, name)
    out = signed.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def unique(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", name: str = "unique") -> DataFrame:
    """The rows, one of each group: that of the smallest id, then of the smallest hash of its text.

    Decided row by row: rows that repeat an id with unlike texts don't stand for one another; of rows that repeat id
    and text, one stays. Rows without an id or without a word stay."""
    spark = docs.sparkSession
    signed, named = _classes(docs, n, num, den, doc_id, text, name)
    rows = signed.where("digest is not null and doc_id is not null").groupBy("doc_id", "th", "digest").agg(F.count("*").alias("n")).join(named, "digest")
    stays = (F.col("doc_id") == F.col("component")) & (F.col("th") == F.col("name"))
    decided = rows.where(~stays | (F.col("n") > 1)).select("doc_id", "th", stays.alias("stays"))
    decided = Store(spark, name).save(decided, "decided")
    # the caller's columns are one column of the joins, so that none clashes
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    alone = packed.join(decided.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    # of rows that repeat id and text, the first by all their columns
    first = packed.join(decided.where("stays").select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    first = first.groupBy("doc_id", "th").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return alone.union(first.select(alone.columns)).select("row.*")
