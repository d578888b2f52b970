"""Fill-in-middle against a plain cut of the text, unit by unit."""

import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import fill_middle
from stratalens.llm.queries import ORACLE_SQL, QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
TEXTS = [
    None, "", "a", " ", "ab", "a b", "ab1c", "\n\n", "café 中文 x", "\U0001f600ab\U0001f600", "the <P> one", "<S>", "x<M", "<P", "a<b>c<S<P", "é", "ZéZ", "  lead", "trail  ",
    "word " * 30_000, "q" * 200_000, "中" * 50_000, "<" * 99, "a\x00b\x7fc",
]


def plain(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ <>PSM1é中\U0001f600\n?"), max_size=40))
def test_units(text):
    units, found = UNIT.findall(text), fill_middle.Units(text)
    assert found.n == len(units) and found.sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))
    assert [found.start(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_against_plain(spark):
    rows = [(k * 100 + i if i else None, t, "x") for k, t in enumerate(TEXTS) for i in range(8)]
    rows.append(rows[-1])  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    cut = fill_middle.transform(docs)
    got = cut.withColumn("back", fill_middle.restored(cut["output"], cut["form"])).collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours, theirs = QUERIES["op12_fill_middle"](spark, sf).toPandas(), con.execute(ORACLE_SQL["op12_fill_middle"]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].fillna(-1).values.tolist()))
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    ours[["prefix_chars", "middle_chars"]] = ours[["prefix_chars", "middle_chars"]].astype(float)
    theirs[["prefix_chars", "middle_chars"]] = theirs[["prefix_chars", "middle_chars"]].astype(float)
    assert key(ours) == key(theirs)
    assert (ours["restored_sha256"].value_counts() > 0).all()
