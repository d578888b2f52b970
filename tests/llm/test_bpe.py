"""Byte-level BPE against the tokenizers library, where texts are cut and where the table of pieces fails."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalens.llm import byte_bpe
from stratalens.llm.queries import tokenizer_path

PARTS = ["'", "'s", "'re", "'ll", "'v", "'T", " ", "  ", "\n", "\t", "a", "re", "s", "é", "中", "1", "٣", "½", "!", "’", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|endof", "text|>", "\U0001f600", "x"]


@pytest.fixture(scope="module")
def both():
    return byte_bpe.Tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def same(both, texts):
    own, library = both
    for t, (n, ids, decoded) in zip(texts, own.texts(pa.array(texts, pa.large_string()))):
        want = library.encode(t, add_special_tokens=False).ids
        assert ([int(x) for x in ids.split(b",")[:-1]], n) == (want, len(want)), t
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_cuts(both):
    draw = random.Random(10)
    same(both, ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(5000)])


def test_long_pieces(both):
    same(both, ["ab" * 5000, "", " " * 3000 + "x", "é" * 4000, "7" * 999])


def test_false_hits(both):
    """Pieces that the table holds under another piece's hash don't change the result."""
    own = both[0]
    texts = ["some words that are known", "other words"]
    same(both, texts)
    own._table.place[:] = own._table.place[own._table.key != 0][0]
    same(both, texts)
    del own._table


def test_table_is_bounded(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TABLE_BYTES", 100)
    for k in range(3):
        same(both, [f"word{k} again and again word{k}" * 5])
        assert len(both[0]._table.bytes) < 1000


def test_memory_follows_the_slice(both):
    """Beside the table, encoding four MB of texts takes memory for a slice of them."""
    texts = pa.array([" ".join(f"w{(k * j) % 9973}" for j in range(1, 400)) for k in range(1, 1800)], pa.large_string())
    assert texts.nbytes > 4 << 20
    same(both, ["the table"])
    tracemalloc.start()
    for _ in both[0].texts(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < byte_bpe.TABLE_BYTES + (24 << 20)


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'a�b'")
    rows = byte_bpe.encode(df, tokenizer_path()).collect()
    assert rows[0]["ids"] == rows[1]["ids"] and rows[0]["decoded"] == "a�b"
