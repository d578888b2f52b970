"""Turn reassembly against a plain run through the batches, one conversation at a time."""

import hashlib
import random
from collections import defaultdict

from stratalens.llm import turns
from stratalens.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(arrivals, batches, idle=2):
    """(event, what, conv_id, turn, batch, n_missing, n_breaks); arrivals: (conv_id, turn, role, text, batch)."""
    arrivals = [(c, t, r or "", x or "", b) for c, t, r, x, b in arrivals if t is not None]
    first, by = {}, defaultdict(lambda: defaultdict(list))
    for c, t, r, x, b in arrivals:
        first[c] = min(first.get(c, t), t)
        by[b][c, t].append((f"{r}|{x}".encode(), r))
    kept, nxt, last, closed, out = defaultdict(dict), {}, {}, set(), []

    def close(c, b):
        left = sorted(t for t in kept[c] if t >= nxt[c])
        top = max(kept[c])
        breaks = sum(t - 1 in kept[c] and kept[c][t - 1][1] == kept[c][t][1] for t in kept[c])
        out.append(("close", ",".join(map(str, left)), c, -1, b, top - first[c] + 1 - len(kept[c]), breaks))
        closed.add(c)

    for b in range(batches):
        here = {k: min(v) for k, v in by[b].items()}
        for (c, t), (payload, role) in here.items():
            if c in closed:
                out.append(("reject", payload.decode(), c, t, b, None, None))
                continue
            last[c] = b
            nxt.setdefault(c, first[c])
            kept[c].setdefault(t, (payload, role))
        for c in nxt:
            if c in closed:
                continue
            while nxt[c] in kept[c]:
                out.append(("release", kept[c][nxt[c]][0].decode(), c, nxt[c], b, None, None))
                nxt[c] += 1
            if b - last[c] >= idle:
                close(c, b)
    for c in nxt:
        if c not in closed:
            close(c, batches)
    return sorted(out, key=repr)


def found(df):
    rows = []
    for r in df.collect():
        what = ",".join(map(str, r["pending"])) if r["event"] == "close" else f"{r['role']}|{r['text']}"
        rows.append((r["event"], what, r["conv_id"], r["turn"], r["batch"], r["n_missing"], r["n_breaks"]))
    return sorted(rows, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, batch long, bucket string, tick string"


def test_against_plain(spark):
    draw = random.Random(13)
    rows = []
    for c in range(60):
        for _ in range(draw.randrange(1, 25)):
            t = draw.choice([None, -2, *range(8)]) if c % 3 else draw.randrange(12)
            rows.append((None if c == 7 else c, t, draw.choice([None, "user", "assistant", "a|b", ""]), draw.choice([None, "", "x", "y", "中文", "\U0001f600", "|", "long " * 2000]), draw.choice([0, 1, 2, 5, 6]), "x", "y"))
    rows += [(1000, t, "user", "same", b, "", "") for t in range(400) for b in (t % 7, (t + 3) % 7)]  # a long conversation
    rows += [(1001, 3, "user", "same", 4, "", "")] * 500  # and one that repeats itself
    got = found(turns.reassemble(spark.createDataFrame(rows, SCHEMA), 7))
    want = brute([r[:5] for r in rows], 7)
    assert got == want
    assert {e[0] for e in got} == {"release", "reject", "close"}


def test_empty_table(spark):
    assert turns.reassemble(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_state_keeps_all():
    """Merging with the state packed and unpacked after every batch gives what merging in memory gives."""
    import numpy as np

    draw = np.random.default_rng(1)
    kept, whole = None, turns.Bucket()
    for b in range(6):
        n = int(draw.integers(0, 40))
        rows = {"conv": draw.integers(0, 5, n), "turn": draw.integers(0, 12, n), "first": np.zeros(n, np.int64), "role": draw.choice(["user", "bot"], n).astype(object), "text": draw.choice(["a", "b", "c"], n).astype(object)}
        one = turns.Bucket(kept)
        a, b_ = one.merge(dict(rows), b, 2, b == 5), whole.merge(dict(rows), b, 2, b == 5)
        kept = one.packed()
        assert a.astype(str).equals(b_.astype(str))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_turns"](spark, sf).collect()
    arrivals = []
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        if r["turn"] is not None:
            h = int(sha(f"{'' if r['conv_id'] is None else r['conv_id']}:{r['turn']}")[:8], 16)
            arrivals.append((r["conv_id"], r["turn"], r["role"], r["text"], h % 12))
            if h % 7 < 2:
                arrivals.append((r["conv_id"], r["turn"], "user", r["text"], (h + 5) % 12))
    want = sorted(((e, sha(w), *rest) for e, w, *rest in brute(arrivals, 12)), key=repr)
    assert sorted((tuple(r[k] for k in ("event", "sha256", "conv_id", "turn", "batch", "n_missing", "n_breaks")) for r in got), key=repr) == want
