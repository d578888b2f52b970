"""Registered queries over the library's operators, each with the same computation as DuckDB SQL.

Vectors of 64 values stand for images: one band of 8 x 8, four bands of 4 x 4, or two of 4 x 8."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, kernels
from .operators import analysis, clusters, corpus, filters, layers, normalise, packed
from .params import Params, Response
from .sources.tables import table, vector_maps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns or ("v",)})


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


@cache
def gabors(k: int = 3, n: int = 4, phases: int = 1) -> np.ndarray:
    return kernels.gabor_bank(k, n, phases).reshape(n * phases, k, k)


@cache
def prototypes(bands: int, k: int, n: int = 5) -> np.ndarray:
    return kernels.random_bank(n, (bands, k, k), seed=3)


def bank_sql(bank: np.ndarray) -> str:
    values = ", ".join(f"({a}, {b}, {c}, {d}, CAST({w!r} AS DOUBLE))" for a, b, c, d, w in kernels.rows(bank))
    return f"(VALUES {values})"


def gabor_sql(k: int = 3, n: int = 4, phases: int = 1) -> str:
    """The rows of gabors(k, n, phases), from the formula."""
    theta = f"(pi() * (o + 0.5) / {n})"
    across, along = (f"((b - {k // 2}) * {p}({theta}) {s} (a - {k // 2}) * {q}({theta}))" for p, s, q in (("-sin", "+", "cos"), ("cos", "+", "sin")))
    wave = f"exp(-({along} * {along} + 0.36 * {across} * {across}) / (2 * pow({k} / 8.0, 2))) * sin(2 * pi() * {along} / ({k} / 4.0) + 2 * pi() * p / {phases})"
    return f"""(SELECT kernel, 0 AS band, ky, kx, w / sqrt(sum(w * w) OVER (PARTITION BY kernel)) AS w FROM (SELECT CAST(o * {phases} + p AS INT) AS kernel, CAST(a AS INT) AS ky, CAST(b AS INT) AS kx, {wave} AS w
        FROM range({n}) AS r(o), range({phases}) AS s(p), range({k}) AS t(a), range({k}) AS u(b)))"""


def cells_sql(bands: int = 1, h: int = 8, w: int = 8) -> str:
    return f"""cells AS (SELECT vec_id AS image_id, CAST((i - 1) // {h * w} AS INT) AS band, CAST((i - 1) // {w} % {h} AS INT) AS y,
        CAST((i - 1) % {w} AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {bands * h * w + 1}) AS r(i))"""


def conv_sql(name: str, source: str, bank: np.ndarray | tuple[int, int, int], value: str, h: int, w: int, stride: int = 1) -> str:
    """A CTE of a filter; a bank is an array, or the arguments of gabor_sql()."""
    k, bank = (bank[0], gabor_sql(*bank)) if isinstance(bank, tuple) else (bank.shape[-1], bank_sql(bank))
    oh, ow = (h - k + 1) // stride, (w - k + 1) // stride
    return f"""{name} AS (SELECT c.image_id, CAST(b.kernel AS INT) AS band, CAST((c.y - b.ky) // {stride} AS INT) AS y, CAST((c.x - b.kx) // {stride} AS INT) AS x, {value} AS v
        FROM {source} c JOIN {bank} AS b(kernel, band, ky, kx, w) ON c.band = b.band
        WHERE c.y >= b.ky AND c.x >= b.kx AND (c.y - b.ky) % {stride} = 0 AND (c.x - b.kx) % {stride} = 0 AND (c.y - b.ky) // {stride} < {oh} AND (c.x - b.kx) // {stride} < {ow} GROUP BY 1, 2, 3, 4)"""


def pool_sql(name: str, source: str, k: int, h: int, w: int, value: str = "max(c.v)", stride: int = 1) -> str:
    oh, ow = (h - k + 1) // stride, (w - k + 1) // stride
    return f"""{name} AS (SELECT c.image_id, c.band, CAST(o.y AS INT) AS y, CAST(p.x AS INT) AS x, {value} AS v FROM {source} c JOIN range({oh}) AS o(y) ON c.y BETWEEN o.y * {stride} AND o.y * {stride} + {k - 1}
        JOIN range({ow}) AS p(x) ON c.x BETWEEN p.x * {stride} AND p.x * {stride} + {k - 1} GROUP BY 1, 2, 3, 4)"""


DOT, NORM = "sum(b.w * c.v)", "sum(b.w * c.v) / sqrt(greatest(sum(c.v * c.v), {}))"
MAP = f"SELECT image_id, band, y, x, {r6('v')} AS v FROM "


def maps(spark, d, bands=1, h=8, w=8):
    return vector_maps(table(spark, d, "embeddings"), bands, h, w)


def out(df: DataFrame) -> DataFrame:
    return rounded(df.select("image_id", "band", "y", "x", "v"))


@query(f"WITH {cells_sql()} {MAP} cells")
def map_cells(spark, d):
    return out(maps(spark, d))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (3, 4, 1), DOT, 8, 8)} {MAP} o")
def conv_dot(spark, d):
    return out(filters.dot(maps(spark, d), kernels.frame(spark, gabors()), 3, 8, 8))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (3, 4, 1), NORM.format(0.01), 8, 8)} {MAP} o")
def conv_norm_dot(spark, d):
    return out(filters.norm_dot(maps(spark, d), kernels.frame(spark, gabors()), 3, 8, 8))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (3, 4, 1), 'exp(-5.0 * sum((b.w - c.v) * (b.w - c.v)))', 8, 8)} {MAP} o")
def conv_rbf(spark, d):
    return out(filters.rbf(maps(spark, d), kernels.frame(spark, gabors()), 3, 8, 8))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (3, 4, 1), 'exp(-10.0 * (1 - ' + NORM.format(0.1) + '))', 8, 8)} {MAP} o")
def conv_norm_rbf(spark, d):
    return out(filters.norm_rbf(maps(spark, d), kernels.frame(spark, gabors()), 3, 8, 8))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (3, 4, 1), DOT, 8, 8, 2)} {MAP} o")
def conv_dot_stride2(spark, d):
    return out(filters.dot(maps(spark, d), kernels.frame(spark, gabors()), 3, 8, 8, stride=2))


@query(f"WITH {cells_sql(2, 4, 8)}, {conv_sql('o', 'cells', prototypes(2, 3), DOT, 4, 8)} {MAP} o")
def conv_multiband(spark, d):
    return out(filters.dot(maps(spark, d, 2, 4, 8), kernels.frame(spark, prototypes(2, 3)), 3, 4, 8))


CONTRAST = "(max(CASE WHEN c.y = o.y + 1 AND c.x = p.x + 1 THEN c.v END) - avg(c.v)) / sqrt(var_samp(c.v) + 1.0)"


@query(f"WITH {cells_sql()}, {pool_sql('o', 'cells', 3, 8, 8, CONTRAST)} {MAP} o")
def contrast_enhance(spark, d):
    return out(filters.contrast_enhance(maps(spark, d), 3, 8, 8))


@query(f"WITH {cells_sql()}, {pool_sql('o', 'cells', 3, 8, 8)} {MAP} o")
def local_max(spark, d):
    return out(filters.local_max(maps(spark, d), 3, 8, 8))


@query(f"WITH {cells_sql()}, {pool_sql('o', 'cells', 3, 8, 8, stride=2)} {MAP} o")
def local_max_stride(spark, d):
    return out(filters.local_max(maps(spark, d), 3, 8, 8, stride=2))


@query(f"WITH {cells_sql(4, 4, 4)} SELECT image_id, band, {r6('max(v)')} AS v FROM cells GROUP BY 1, 2")
def global_max(spark, d):
    return rounded(filters.global_max(maps(spark, d, 4, 4, 4)).select("image_id", "band", "v"))


_SIDES = "sides AS (SELECT p_partkey AS id, CAST(p_size * 9 AS INT) AS side FROM part)"


def _sides(spark, d):
    """The sizes of parts, in pixels, as sides of images."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 9).cast("int").alias("side"))


@query(f"WITH {_SIDES} SELECT id, side, k, s, CAST(greatest(side - k + 1, 0) // s AS INT) AS out_side FROM sides, (VALUES (11, 1), (11, 5), (7, 1)) AS u(k, s)")
def out_shape(spark, d):
    filters_ = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in ((11, 1), (11, 5), (7, 1))))
    sides = _sides(spark, d).select("id", "side", F.explode(filters_).alias("f"))
    return sides.select("id", "side", "f.k", "f.s", F.greatest(geometry.output_side(F.col("side"), F.col("f.k"), F.col("f.s")), F.lit(0)).alias("out_side"))


@query(f"WITH {_SIDES} SELECT id, side, CAST(side * 5 + 10 AS INT) AS in_side FROM sides")
def in_shape(spark, d):
    return _sides(spark, d).select("id", "side", geometry.input_side(F.col("side"), 11, 5).alias("in_side"))


@query(f"WITH {_SIDES} SELECT id, CAST(side // 9 AS INT) AS s2_kwidth, CAST((side // 9 * 5 + 10) + 10 AS INT) AS least_side FROM sides")
def min_retina(spark, d):
    """The least side of an image for S2 kernels as wide as the parts are large."""
    least = F.create_map(*(x for k in range(1, 51) for x in (F.lit(k), F.lit(geometry.minimum_side(Params(s2_kwidth=[k]))))))
    wide = (F.col("side") / 9).cast("int")
    return _sides(spark, d).select("id", wide.alias("s2_kwidth"), least[wide].alias("least_side"))


@query(f"WITH {_SIDES} SELECT id, side, CAST((SELECT count(*) FROM range(60) AS n(i) WHERE 55 * pow(pow(2, 0.25), i) < side - 0.0001) AS INT) AS scales FROM sides")
def num_scales(spark, d):
    return _sides(spark, d).select("id", "side", geometry.scales_of(Params(), F.col("side") - 0.0001).alias("scales"))


WHITE = """m AS (SELECT *, v - avg(v) OVER (PARTITION BY image_id, y, x) AS u FROM {}), wh AS (SELECT image_id, band, y, x, u / greatest(1.0, sqrt(sum(u * u) OVER (PARTITION BY image_id, y, x))) AS v FROM m)"""


@query(f"WITH {cells_sql(4, 4, 4)}, {WHITE.format('cells')} {MAP} wh")
def whiten_bands(spark, d):
    return out(layers.whiten(maps(spark, d, 4, 4, 4)))


SMALL = Params(s1_kwidth=3, s1_num_orientations=4, s1_num_phases=2, c1_kwidth=3, c1_sampling=1, s2_kwidth=[2], s1_operation=Response.DOT)
NDP = Params(s1_kwidth=3, c1_kwidth=3, c1_sampling=1, s2_kwidth=[2], s2_beta=0.05, num_scales=1)
_S1 = f"{cells_sql()}, {conv_sql('raw', 'cells', (3, 4, 1), NORM.format(0.01), 8, 8)}, s1 AS (SELECT image_id, band, y, x, abs(v) AS v FROM raw)"
_C1 = f"{_S1}, {pool_sql('c1', 's1', 3, 6, 6)}"
_S2 = f"{_C1}, {conv_sql('s2', 'c1', prototypes(4, 2), 'exp(-0.05 * sum((b.w - c.v) * (b.w - c.v)))', 4, 4)}"


@query(f"WITH {cells_sql()}, {conv_sql('raw', 'cells', (3, 4, 2), DOT, 8, 8)} SELECT image_id, CAST(band // 2 AS INT) AS band, y, x, {r6('max(v)')} AS v FROM raw GROUP BY 1, 2, 3, 4")
def phase_pool(spark, d):
    return out(layers.s1(maps(spark, d), kernels.frame(spark, gabors(3, 4, 2)), SMALL, 8, 8))


def _c1(spark, d):
    return layers.c1(layers.s1(maps(spark, d), kernels.frame(spark, gabors()), NDP, 8, 8), NDP, 6, 6)


def _s2(spark, d):
    return layers.s2(_c1(spark, d), kernels.frame(spark, prototypes(4, 2)), NDP, 4, 4, 2)


@query(f"WITH {_C1} {MAP} c1")
def layer_c1(spark, d):
    return out(_c1(spark, d))


@query(f"WITH {_S2} {MAP} s2")
def layer_s2(spark, d):
    return out(_s2(spark, d))


@query(f"WITH {_S2} SELECT image_id, band, {r6('max(v)')} AS v FROM s2 GROUP BY 1, 2")
def layer_c2(spark, d):
    return rounded(layers.c2(_s2(spark, d)))


@query(f"WITH {_C1} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY band, y, x) - 1 AS INT) AS pos, {r6('v')} AS v FROM c1")
def features_flat(spark, d):
    return rounded(filters.flatten(_c1(spark, d)).select("image_id", F.posexplode("features").alias("pos", "v")))


@query(f"""WITH {_C1}, g AS (SELECT DISTINCT image_id, band, CAST(b AS INT) AS bin FROM c1, range(4) AS r(b)),
    n AS (SELECT image_id, band, CAST(least(floor(v / 0.8 * 4), 3) AS INT) AS bin, count(*) AS n FROM c1 WHERE v >= 0 AND v <= 0.8 GROUP BY 1, 2, 3)
    SELECT g.image_id, g.band, g.bin, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM g LEFT JOIN n ON g.image_id = n.image_id AND g.band = n.band AND g.bin = n.bin""")
def features_hist(spark, d):
    return analysis.histogram_features(_c1(spark, d), 4, 0.0, 0.8)


@query(f"WITH {cells_sql()} SELECT image_id, band, CAST((y - 1) // 2 AS INT) AS y, CAST((x - 1) // 2 AS INT) AS x, {r6('v')} AS v FROM cells WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND (y - 1) % 2 = 0 AND (x - 1) % 2 = 0")
def prune_array(spark, d):
    return out(filters.prune(maps(spark, d), 3, 8, 8, 2))


@query(f"""WITH {cells_sql()}, g AS (SELECT DISTINCT vec_id AS image_id, CAST(a AS INT) AS y, CAST(b AS INT) AS x FROM embeddings, range(12) AS r(a), range(10) AS s(b))
    SELECT g.image_id, 0 AS band, g.y, g.x, {r6('coalesce(c.v, -1.0)')} AS v FROM g LEFT JOIN cells c ON g.image_id = c.image_id AND g.y = c.y + 2 AND g.x = c.x + 1""")
def pad_array(spark, d):
    return out(filters.pad(maps(spark, d), 8, 8, 12, 10, -1.0))


@query(f"WITH {cells_sql()} SELECT image_id, band, CAST(y - 2 AS INT) AS y, CAST(x - 1 AS INT) AS x, {r6('v')} AS v FROM cells WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def crop_array(spark, d):
    return out(filters.crop(maps(spark, d), 8, 8, 4, 6))


@query(f"WITH {cells_sql()} SELECT image_id, band, CAST(y // 3 AS INT) AS ty, CAST(x // 3 AS INT) AS tx, CAST(y % 3 AS INT) AS y, CAST(x % 3 AS INT) AS x, {r6('v')} AS v FROM cells WHERE y < 6 AND x < 6")
def tile(spark, d):
    return rounded(filters.tile(maps(spark, d), 3, 8, 8).drop("scale"))


@query(f"WITH {cells_sql()} {MAP} cells WHERE y < 6 AND x < 6")
def untile(spark, d):
    return out(filters.untile(filters.tile(maps(spark, d), 3, 8, 8), 3))


PATCHES = "p AS (SELECT vec_id AS patch_id, CAST(i - 1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i))"


def patches(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), "embedding").repartition("patch_id")
    return rows.select("patch_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {PATCHES} SELECT patch_id, pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY patch_id))')} AS v FROM p")
def unit_norm(spark, d):
    return rounded(normalise.unit_norm(patches(spark, d)))


@query(f"WITH {PATCHES} SELECT patch_id, pos, {r6('(v - avg(v) OVER (PARTITION BY patch_id)) / sqrt(var_pop(v) OVER (PARTITION BY patch_id) + 10)')} AS v FROM p")
def local_contrast(spark, d):
    return rounded(normalise.local_contrast(patches(spark, d)))


@query(f"WITH {PATCHES} SELECT patch_id, pos, {r6('(v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos)')} AS v FROM p")
def global_contrast(spark, d):
    return rounded(normalise.global_contrast(patches(spark, d)))


@query(f"WITH {cells_sql()}, t AS (SELECT *, max(v) OVER (PARTITION BY image_id) AS m FROM cells) {MAP} t WHERE v = m")
def argmax_cells(spark, d):
    return out(analysis.arg_max(maps(spark, d)))


@query(f"WITH {_C1}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id, band ORDER BY v DESC, y, x) AS r FROM c1) {MAP} t WHERE r = 1")
def best_match(spark, d):
    return out(analysis.best_match(_c1(spark, d)))


_FIELD = "CAST(floor({}) AS INT)"


@query(f"""WITH {_S2}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id, band ORDER BY round(v, 9) DESC, y, x) AS r FROM s2)
    SELECT image_id, band, {_FIELD.format('y')} AS top, {_FIELD.format('y + 2 + 3 - 1 + 3 - 1')} AS bottom, {_FIELD.format('x')} AS left_side, {_FIELD.format('x + 2 + 3 - 1 + 3 - 1')} AS right_side FROM t WHERE r = 1""")
def receptive_field(spark, d):
    """What each image's best match of a prototype sees."""
    best = analysis.best_match(_s2(spark, d).withColumn("v", F.round("v", 9)))
    box = geometry.receptive_field(NDP, F.col("scale"), F.col("y"), F.col("x"), 2)
    return best.select("image_id", "band", box["top"].alias("top"), box["bottom"].alias("bottom"), box["left"].alias("left_side"), box["right"].alias("right_side"))


@query(f"WITH {cells_sql()}, {conv_sql('o', 'cells', (7, 4, 2), DOT, 8, 8)} {MAP} o")
def gabor_bank(spark, d):
    """A bank of two phases over the maps, whose rows SQL makes from the formula."""
    return out(filters.dot(maps(spark, d), kernels.frame(spark, gabors(7, 4, 2)), 7, 8, 8))


_BLACKMAN = "(0.42 - 0.5 * cos(2 * pi() * {0} / 7) + 0.08 * cos(4 * pi() * {0} / 7))"


@query(f"WITH {cells_sql()} SELECT image_id, band, y, x, {r6('v * ' + _BLACKMAN.format('y') + ' * ' + _BLACKMAN.format('x'))} AS v FROM cells")
def blackman2d(spark, d):
    """The maps under a Blackman window."""
    window = kernels.frame(spark, kernels.blackman2d(8)[None]).select(F.col("ky").alias("y"), F.col("kx").alias("x"), "w")
    return out(maps(spark, d).join(F.broadcast(window), ["y", "x"]).withColumn("v", F.col("v") * F.col("w")))  # 64 rows


_SINC = "CASE WHEN {0} = 0 THEN 1.0 WHEN abs({0}) = 3 THEN 0.0 ELSE sin(pi() * {0}) / (pi() * {0}) * sin(pi() * {0} / 3) / (pi() * {0} / 3) END"
_LANCZOS = f"l AS (SELECT 0 AS kernel, 0 AS band, CAST(y + 3 AS INT) AS ky, CAST(x + 3 AS INT) AS kx, w / sum(w) OVER () AS w FROM (SELECT y, x, ({_SINC.format('y')}) * ({_SINC.format('x')}) AS w FROM range(-3, 4) AS a(y), range(-3, 4) AS b(x)))"


@query(f"WITH {cells_sql()}, {_LANCZOS} SELECT c.image_id, 0 AS band, CAST(c.y - b.ky AS INT) AS y, CAST(c.x - b.kx AS INT) AS x, {r6('sum(b.w * c.v)')} AS v FROM cells c JOIN l b ON c.y - b.ky BETWEEN 0 AND 1 AND c.x - b.kx BETWEEN 0 AND 1 GROUP BY 1, 2, 3, 4")
def lanczos_kernel(spark, d):
    """The maps smoothed by a Lanczos kernel."""
    return out(filters.dot(maps(spark, d), kernels.frame(spark, kernels.lanczos()[None]), 7, 8, 8))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, source AS class_name, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS label FROM documents")
def corpus_scan(spark, d):
    return corpus.scan(table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), "source", "path")


@query("SELECT vec_id, label, 'class ' || label AS class_name FROM embeddings")
def label_names(spark, d):
    return corpus.label_names(table(spark, d, "embeddings").select("vec_id", "label"), [f"class {i}" for i in range(10)])


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) SELECT doc_id, lang FROM r, m WHERE r <= m")
def balance_corpus(spark, d):
    return corpus.balance(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= floor(0.5 * count(*) OVER (PARTITION BY label)) AS is_train FROM embeddings")
def train_split(spark, d):
    return corpus.choose_training(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.5)


@query("SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 10 AS INT) AS fold FROM embeddings")
def cv_folds(spark, d):
    return corpus.folds(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("SELECT doc_id, lang AS class_name, doc_id % 2 = 0 AS is_train FROM documents")
def split_union(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("class_name"))
    return corpus.join_split(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"))


@query("SELECT doc_id, CAST(CASE WHEN quality + 1 = 1 THEN 0 ELSE 1 END AS INT) AS label FROM labels")
def relabel_binary(spark, d):
    return corpus.relabel_binary(table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).cast("int").alias("label")), "label")


@query(f"""WITH {cells_sql()}, o AS (SELECT vec_id AS image_id, CAST(vec_id * 7 % 6 AS INT) AS y0, CAST(vec_id * 5 % 6 AS INT) AS x0 FROM embeddings)
    SELECT c.image_id, o.y0, o.x0, CAST(c.y - o.y0 AS INT) AS y, CAST(c.x - o.x0 AS INT) AS x, {r6('c.v')} AS v FROM cells c JOIN o ON c.image_id = o.image_id WHERE c.y BETWEEN o.y0 AND o.y0 + 2 AND c.x BETWEEN o.x0 AND o.x0 + 2""")
def imprint_patches(spark, d):
    from .operators import sampling

    return rounded(sampling.patches_at(maps(spark, d), (F.col("image_id") * 7 % 6).cast("int"), (F.col("image_id") * 5 % 6).cast("int"), 3).select("image_id", "y0", "x0", "y", "x", "v"))


@cache
def centroids() -> np.ndarray:
    return np.round(np.random.default_rng(11).normal(0, 0.12, (4, 64)), 4)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


_CENTRES = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {[float(v) for v in c]}::DOUBLE[])" for k, c in enumerate(centroids())) + ") AS t(cluster, centre))"
_NEAR = f"""{_CENTRES}, dist AS (SELECT vec_id AS id, CAST(cluster AS INT) AS cluster, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - centre[i]) * (CAST(embedding[i] AS DOUBLE) - centre[i]))) AS d, embedding FROM embeddings, c),
    near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)"""


@query(f"WITH {_NEAR} SELECT id, cluster, {r6('d')} AS distance FROM near")
def nearest_centroid(spark, d):
    return rounded(clusters.nearest(vectors(spark, d), centroids()).select("id", "cluster", "distance"), "distance")


@query(f"WITH {_NEAR} SELECT cluster, id FROM near QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d, id) = 1")
def nearest_kmeans(spark, d):
    return clusters.representatives(clusters.nearest(vectors(spark, d), centroids()), "id")


@query(f"WITH {_NEAR} SELECT cluster, CAST(i - 1 AS INT) AS pos, {r6('sum((id % 3 + 1) * CAST(embedding[i] AS DOUBLE)) / sum(id % 3 + 1)')} AS v FROM near, range(1, 65) AS r(i) GROUP BY 1, 2")
def kmeans_step_weighted(spark, d):
    moved = clusters.step(clusters.nearest(vectors(spark, d), centroids()), (F.col("id") % 3 + 1).cast("double"))
    return rounded(moved.select("cluster", "pos", "v"))


@query(f"""WITH {cells_sql(4, 4, 4)}, s AS (SELECT band, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, list_sort(list(v)) AS l FROM cells GROUP BY 1),
    q AS (SELECT *, n * 0.3 + 0.4 + 0.3 * 0.2 AS a3, n * 0.7 + 0.4 + 0.7 * 0.2 AS a7 FROM s)
    SELECT band, {r6('mean')} AS mean, {r6('std')} AS std, {r6('low')} AS low, {r6('high')} AS high, {r6('l[CAST(floor(a3) AS INT)] * (1 - (a3 - floor(a3))) + l[CAST(floor(a3) AS INT) + 1] * (a3 - floor(a3))')} AS q30,
    {r6('l[CAST(floor(a7) AS INT)] * (1 - (a7 - floor(a7))) + l[CAST(floor(a7) AS INT) + 1] * (a7 - floor(a7))')} AS q70 FROM q""")
def meta_features(spark, d):
    return rounded(analysis.meta_features(maps(spark, d, 4, 4, 4), "band", "v"), "mean", "std", "low", "high", "q30", "q70")


@query(f"""WITH m AS (SELECT label AS rid, i, avg(CAST(embedding[i] AS DOUBLE)) AS r FROM embeddings, range(1, 65) AS t(i) GROUP BY 1, 2),
    pairs AS (SELECT e.vec_id AS id, rid, round(sum((CAST(e.embedding[i] AS DOUBLE) - r) * (CAST(e.embedding[i] AS DOUBLE) - r)), 9) AS d FROM embeddings e, m GROUP BY 1, 2),
    top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid) <= 4) SELECT id, {r6('avg(rid)')} AS quality FROM top GROUP BY 1""")
def knn_quality(spark, d):
    """The reference set is one mean vector for each class."""
    rows = vectors(spark, d)
    means = clusters.step(rows.withColumn("cluster", F.col("label"))).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    known = means.select(F.col("cluster").alias("id"), F.transform("m", lambda x: x["v"]).alias("features"), F.col("cluster").cast("double").alias("quality"))
    return rounded(clusters.knn_mean(rows, known, "quality"), "quality")


@query("""WITH v AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
    pairs AS (SELECT a.id, b.id AS known, b.label, round(list_distance(a.x, b.x) * list_distance(a.x, b.x), 9) AS d FROM v a, v b),
    top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, known) AS rank FROM pairs QUALIFY rank <= 5) SELECT id, CAST(rank AS INT) AS rank, known, round(d, 6) + 0.0 AS distance FROM top""")
def knn_neighbours(spark, d):
    """The five nearest of all vectors to each vector, itself among them."""
    rows = vectors(spark, d)
    near = clusters.knn(rows, rows, "label", 5).select("id", F.posexplode("near").alias("rank", "n"))
    return rounded(near.select("id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("known"), F.col("n.d").alias("distance")), "distance")


@query(f"""WITH {cells_sql()}, b AS (SELECT vec_id AS box_id, vec_id AS image_id, label, CAST(vec_id % 4 AS INT) AS t, CAST(vec_id % 3 AS INT) AS l FROM embeddings)
    SELECT b.box_id, {r6('coalesce(avg(1 - CAST(c.v > 0 AS INT)), 0)')} AS ratio FROM b LEFT JOIN cells c ON b.image_id = c.image_id AND b.label <> 0 AND c.y >= t AND c.y < t + 4 AND c.x >= l AND c.x < l + 5 GROUP BY 1""")
def mask_fg_ratio(spark, d):
    """Images of class 0 have no mask."""
    rows = table(spark, d, "embeddings")
    boxes = rows.select(F.col("vec_id").alias("box_id"), F.col("vec_id").alias("image_id"), (F.col("vec_id") % 4).alias("top"), (F.col("vec_id") % 4 + 4).alias("bottom"), (F.col("vec_id") % 3).alias("left"), (F.col("vec_id") % 3 + 5).alias("right"))
    mask = rows.where("label <> 0").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda v: (v > 0).cast("double")).alias("data"))
    return rounded(analysis.foreground_ratio(boxes, mask), "ratio")


def _judged(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int").alias("prediction"), (F.col("doc_id") * 7 % 20 + F.col("quality") * 6).alias("score"))


_JUDGED = "j AS (SELECT *, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS INT) AS prediction, doc_id * 7 % 20 + quality * 6 AS score FROM labels)"


@query(f"WITH {_JUDGED} SELECT {r6('avg(CASE WHEN quality = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM j")
def accuracy(spark, d):
    return rounded(analysis.accuracy(_judged(spark, d), "quality", "prediction"), "accuracy")


@query(f"WITH {_JUDGED}, r AS (SELECT quality, avg(i) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS i FROM j)) SELECT {r6('(sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1))')} AS auc FROM r")
def auc_rank(spark, d):
    return rounded(analysis.auc(_judged(spark, d), "quality", "score"), "auc")


@query(f"WITH {_JUDGED} SELECT quality, prediction, count(*) AS n FROM j GROUP BY 1, 2")
def confusion(spark, d):
    return analysis.confusion(_judged(spark, d), "quality", "prediction")


@query(f"SELECT event_type, count(*) AS n, {r6('avg(value)')} AS y_mean, {r6('stddev_pop(value)')} AS y_std, {r6('stddev_pop(value) / sqrt(count(*))')} AS y_stderr FROM events GROUP BY 1")
def grouped_stats(spark, d):
    return rounded(analysis.grouped_stats(table(spark, d, "events"), "event_type", "value"), "y_mean", "y_std", "y_stderr")


@query("SELECT CAST(least(floor((l_quantity - 1) / 49 * 7), 6) AS INT) AS x_bin, CAST(least(floor(l_discount / 0.1 * 5), 4) AS INT) AS y_bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def hist2d(spark, d):
    return analysis.histogram2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", 7, 5, (1.0, 50.0), (0.0, 0.1))


@query(f"WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM n) SELECT {r6('-sum(p * ln(p)) / ln(count(*))')} AS balance, count(*) AS groups FROM p")
def entropy_balance(spark, d):
    return rounded(analysis.balance_entropy(table(spark, d, "lineitem"), "l_suppkey"), "balance")


_WAVE = "{}(-2 * 3.141592653589793 * (ky * y + kx * x) / 8)"
_POWER = f"""{cells_sql()}, f AS (SELECT image_id, CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, sum(v * {_WAVE.format('cos')}) AS re, sum(v * {_WAVE.format('sin')}) AS im FROM cells, range(8) AS a(ky), range(8) AS b(kx) GROUP BY 1, 2, 3)"""


def _power(spark, d):
    return analysis.power_spectrum(table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding"), "embedding", 8, 8)


@query(f"WITH {_POWER} SELECT image_id, ky, kx, {r6('re * re + im * im')} AS power FROM f")
def power_spectrum(spark, d):
    return rounded(_power(spark, d), "power")


@query(f"""WITH {_POWER}, w AS (SELECT image_id, (ky + 4) % 8 - 3.5 AS a, (kx + 4) % 8 - 3.5 AS b, re * re + im * im AS p FROM f)
    SELECT image_id, (floor(sqrt(a * a + b * b)) - 1) / 8 AS freq, {r6('sum(p)')} AS power, count(*) AS n FROM w WHERE floor(sqrt(a * a + b * b)) BETWEEN 1 AND 3 GROUP BY 1, 2""")
def radial_spectrum(spark, d):
    return rounded(analysis.radial_spectrum(_power(spark, d), 8), "power")


def _train(spark, d):
    return corpus.choose_training(vectors(spark, d).withColumnRenamed("id", "image_id"), "label", "image_id", 0.5)


@query()
def fit_svm(spark, d):
    from .operators import learn

    return learn.train_and_test(_train(spark, d), "svm")["predictions"].select("image_id", "label", "is_train", "prediction")


@query()
def fit_logreg(spark, d):
    from .operators import learn

    return learn.train_and_test(_train(spark, d), "logreg")["predictions"].select("image_id", "label", "is_train", "prediction")


@query()
def cross_validate(spark, d):
    from .operators import learn

    scores = learn.cross_validate(vectors(spark, d).withColumnRenamed("id", "image_id"), "logreg", 3)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, accuracy double")


def _maps8(spark, d):
    """The vectors as grey maps of 8 x 8."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("data"))


def _packed(spark, d, p: Params, banks):
    return packed.build(_maps8(spark, d), p, gabors()[:, None], banks, ("c2",), "double")


@query(f"WITH {_S2} SELECT image_id, band, {r6('max(v)')} AS v FROM s2 GROUP BY 1, 2")
def packed_c2(spark, d):
    """The packed engine, held against the same SQL as the long one."""
    return rounded(_packed(spark, d, NDP, [prototypes(4, 2)]).select("image_id", F.posexplode("data").alias("band", "v")))


@query()
def packed_c2_scales(spark, d):
    """The packed engine on 32 x 32 maps in three scales, each made of four copies of a vector's map doubled in size."""
    p = Params(s1_kwidth=5, c1_kwidth=3, c1_sampling=2, s2_kwidth=[3], s2_beta=0.05, num_scales=3)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(32).alias("height"), F.lit(32).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.get("embedding", (F.floor(i / 64) % 8 * 8 + F.floor(i % 32 / 2) % 8).cast("int"))).alias("data"))
    made = packed.build(rows, p, kernels.gabor_bank(5, 4), [prototypes(4, 3)], ("c2",))
    return made.select("image_id", "kwidth", F.posexplode("data").alias("band", "v")).withColumn("v", F.round("v", 4))


@query(f"WITH {_C1.replace('c1 AS', 'c1 AS MATERIALIZED', 1)} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY band, y, x) - 1 AS INT) AS pos, {r6('v')} AS v FROM c1")
def stream_activation(spark, d):
    """The streaming job on the embeddings' maps, run to the end of its input: C1 of each image as it arrives."""
    import uuid

    from .sources.scratch import shared_folder
    from .streaming import activation

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _maps8(spark, d).write.parquet(f"{base}/in")
    activation.activate(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", NDP, gabors()[:, None], None, ("c1",), precision="double").awaitTermination()
    made = spark.read.parquet(f"{base}/out")
    return rounded(made.select("image_id", F.posexplode("data").alias("pos", "v")))


@query(f"WITH {_S2} SELECT image_id, band, {r6('max(v)')} AS v FROM s2 GROUP BY 1, 2")
def climb_from_c1(spark, d):
    """C2 from a stored C1, by the layer graph, held against the SQL that starts from the images."""
    from .sources.scratch import written

    stored = written(packed.build(_maps8(spark, d), NDP, gabors()[:, None], None, ("c1",), "double"), "c1")
    made = packed.graph(NDP, gabors()[:, None], [prototypes(4, 2)], "double").build("c2", {"c1": stored})["c2"]
    return rounded(made.select("image_id", F.posexplode("data").alias("band", "v")))


from . import learner_queries  # noqa: E402, F401  registers its queries
