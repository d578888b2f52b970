"""URL features from bytes at once against one URL at a time."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalens.llm import url_filter as U

URLS = [None, "", "x", "http://a.b-c.com/en/7/a-b?x=1&y=2&&z#f?q", "HTTPS://Ünï.example.com/p//q/", "https://", "https:/", "://", "http://h?only=1", "a" * 5000 + "://host/" + "1" * 3000, "http://..a..b/?", "ftp://1.2.3.4:80/%20é中"]


def entropy(data):
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(len(data), 1)
    return -sum(p * math.log2(p) for p in n if p)


def plain(u, h, p):
    u = u or ""
    q = u.partition("?")[2].partition("#")[0]
    digits = lambda s: sum("0" <= c <= "9" for c in s) / max(len(s), 1)
    parts = [x for x in h.split(".") if x]
    return [len(u), len(h), h.count(".") + bool(h), sum(map(bool, p.split("/"))), digits(u), digits(h), entropy(u.encode()), entropy(h.encode()), sum(map(bool, q.split("&"))), h.count("-") + p.count("-"), max((len(x.encode()) for x in parts), default=0), math.log1p(3), 1.5 / 4, math.log1p(3), 1.5 / 4, u[:8].lower() == "https://"]


def test_features(spark):
    host, path = U.split_url(F.col("url"))
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i long, url string").select("i", "url", host.alias("h"), path.alias("p"), U.query_of(F.col("url")).alias("q")).orderBy("i").collect()
    pairs = np.tile([3, 1], (len(rows), 1))
    got = U.features(*(pa.array([r[c] for r in rows], pa.string()) for c in ("url", "h", "p", "q")), pairs, pairs)
    assert np.allclose(got, [plain(r["url"], r["h"], r["p"]) for r in rows])
    assert U.features(*(pa.array([], pa.string()) for _ in range(4)), pairs[:0], pairs[:0]).shape == (0, len(U.FEATURES))
