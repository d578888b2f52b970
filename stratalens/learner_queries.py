"""Registered queries of prototype learners, fixed linear models, ordered rows and further analysis, with their SQL.

Importing this module adds them to the registry of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels
from .operators import analysis, clusters, factors, filters, learn, learners, normalise, packed, sequences, sums
from .queries import _C1, MAP, NDP, _c1, cells_sql, gabors, maps, mask_fg_ratio, out, prototypes, query, r6, rounded, table, vectors

N, SIZE, STEPS = 6, 64, 3
#: A linear model of ten classes, and the coefficients that rate 40 prototypes.
WEIGHTS = np.array([[((c * 31 + i * 17) % 23 - 11) / 20 for i in range(SIZE)] for c in range(10)])
INTERCEPTS = np.array([(c % 3 - 1) / 10 for c in range(10)])
KNOWN = 40
RATES = np.array([[((c * 7 + i * 3) % 11 - 5) / 10 for i in range(KNOWN)] for c in range(10)])

V = "v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, label FROM embeddings)"
FIRST = "first AS MATERIALIZED (SELECT CAST(r - 1 AS INT) AS kernel, id, x FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM {0}) WHERE r <= {1})"
POS = "range(1, 65) AS r(i)"


def draw_sql(*key: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def k_means_sql(source: str, n: int = N, steps: int = STEPS, weight: str = "1.0") -> str:
    """CTEs n1, c1 and so on: the rows of a source (id, x) with their clusters, and the centroids, after each step."""
    parts = [FIRST.format(source, n), "c0 AS MATERIALIZED (SELECT kernel AS cluster, x AS centre FROM first)"]
    for s in range(1, steps + 2):
        gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - centre[i]) * (x[i] - centre[i])))"
        parts.append(f"n{s} AS MATERIALIZED (SELECT * FROM (SELECT s.*, c.cluster, {gap} AS d FROM {source} s, c{s - 1} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)")
        mean = f"SELECT cluster, list(m ORDER BY i) AS centre FROM (SELECT cluster, i, sum({weight} * x[i]) / sum({weight}) AS m FROM n{s}, {POS} GROUP BY 1, 2 HAVING sum({weight}) > 0) GROUP BY 1"
        parts.append(f"c{s} AS MATERIALIZED (SELECT p.cluster, coalesce(m.centre, p.centre) AS centre FROM c{s - 1} p LEFT JOIN ({mean}) m ON p.cluster = m.cluster)")
    return ", ".join(parts)


def bank_of(source: str, kernel: str = "kernel", x: str = "x") -> str:
    return f"SELECT {kernel} AS kernel, CAST(i - 1 AS INT) AS pos, {r6(f'{x}[i]')} AS w FROM {source}, {POS}"


def bank(spark, x: np.ndarray) -> DataFrame:
    return rounded(learners.frame(spark, x), "w")


@query(f"WITH {V}, {FIRST.format('v', N)} {bank_of('first')}")
def learn_imprint(spark, d):
    return bank(spark, learners.imprint(vectors(spark, d), N))


@query(f"WITH {V}, {FIRST.format('v', N)} SELECT kernel, CAST(row_number() OVER (PARTITION BY kernel ORDER BY md5(concat_ws(':', id, i - 1)), i) - 1 AS INT) AS pos, {r6('x[i]')} AS w FROM first, {POS}")
def learn_shuffle(spark, d):
    return bank(spark, learners.shuffle(vectors(spark, d), N))


@query(f"WITH b AS (SELECT CAST(min(e) AS DOUBLE) AS low, CAST(max(e) AS DOUBLE) AS high FROM (SELECT unnest(embedding) AS e FROM embeddings)) SELECT CAST(k AS INT) AS kernel, CAST(i AS INT) AS pos, {r6('low + (high - low) * ' + draw_sql(chr(39) + 'uniform' + chr(39), 'k', 'i'))} AS w FROM b, range({N}) AS a(k), range({SIZE}) AS c(i)")
def learn_uniform(spark, d):
    """Even draws between the extremes of the vectors' elements."""
    low, high = vectors(spark, d).agg(F.min(F.array_min("features")), F.max(F.array_max("features"))).first()
    return bank(spark, learners.uniform(N, SIZE, low, high))


_NORMAL = f"sqrt(-2 * ln({draw_sql(chr(39) + 'normal' + chr(39), 'k', 'i', '1')})) * cos(2 * pi() * {draw_sql(chr(39) + 'normal' + chr(39), 'k', 'i', '2')})"


@query(f"WITH {V}, m AS (SELECT avg(e) AS mean, stddev_pop(e) AS std FROM (SELECT unnest(x) AS e FROM v)) SELECT CAST(k AS INT) AS kernel, CAST(i AS INT) AS pos, {r6(f'mean + std * {_NORMAL}')} AS w FROM m, range({N}) AS a(k), range({SIZE}) AS b(i)")
def learn_norm(spark, d):
    return bank(spark, learners.normal(vectors(spark, d), N, SIZE))


@query(f"""WITH {V}, e AS MATERIALIZED (SELECT unnest(x) AS e FROM v), b AS MATERIALIZED (SELECT min(e) AS low, (max(e) - min(e)) / 100 AS width, count(*) AS total FROM e),
    n AS (SELECT CAST(least(floor((e - low) / width), 99) AS INT) AS bin, count(*) AS c FROM e, b GROUP BY 1),
    t AS MATERIALIZED (SELECT bin, t, sum(t) OVER (ORDER BY bin) AS upto FROM (SELECT bin, CAST(floor(c / (total * 0.0025)) AS BIGINT) AS t FROM n, b) WHERE t > 0),
    j AS (SELECT k, i, CAST(floor({draw_sql("'bin'", 'k', 'i')} * (SELECT sum(t) FROM t)) AS BIGINT) AS j, {draw_sql("'within'", 'k', 'i')} AS u FROM range({N}) AS a(k), range({SIZE}) AS b(i))
    SELECT CAST(k AS INT) AS kernel, CAST(i AS INT) AS pos, {r6('low + (bin + u) * width')} AS w FROM j, b, t WHERE j.j >= t.upto - t.t AND j.j < t.upto""")
def learn_histogram(spark, d):
    return bank(spark, learners.histogram(vectors(spark, d), N, SIZE))


@query(f"WITH {V}, {k_means_sql('v')} {bank_of(f'c{STEPS}', 'cluster', 'centre')}")
def learn_kmeans(spark, d):
    return bank(spark, learners.k_means(vectors(spark, d), N, STEPS))


@query(f"WITH {V}, {k_means_sql('v')}, b AS (SELECT c.cluster, coalesce(n.x, c.centre) AS x FROM c{STEPS} c LEFT JOIN (SELECT * FROM n{STEPS + 1} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d, id) = 1) n ON c.cluster = n.cluster) {bank_of('b', 'cluster')}")
def learn_nearest_kmeans(spark, d):
    return bank(spark, learners.nearest_k_means(vectors(spark, d), N, STEPS))


_CONTRAST = "u AS MATERIALIZED (SELECT id, list_transform(x, lambda e: (e - m) / sqrt(q + 10 / (255.0 * 255.0))) AS x FROM (SELECT id, x, m, list_sum(list_transform(x, lambda e: (e - m) * (e - m))) / 64 AS q FROM (SELECT id, x, list_sum(x) / 64 AS m FROM v)))"


@query(f"WITH {V}, {_CONTRAST}, {k_means_sql('u')} {bank_of(f'c{STEPS}', 'cluster', 'centre')}")
def learn_contrast_kmeans(spark, d):
    return bank(spark, learners.k_means(learners.local_contrast(vectors(spark, d)), N, STEPS))


#: Swaps tried a round.
TRIED = 8


def swap_sql(r: int) -> str:
    """CTEs of a round of swaps: m{r} (slot, x) from m{r - 1}, by the exact costs of all swaps over all rows."""
    old, dist = f"m{r - 1}", "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - {0}.x[i]) * (v.x[i] - {0}.x[i]))))"
    return f"""t{r} AS MATERIALIZED (SELECT CAST(t - 1 AS INT) AS t, x FROM (SELECT x, row_number() OVER (ORDER BY md5(concat_ws(':', 'medoid', '{r - 1}', CAST(id AS VARCHAR))), id) AS t FROM v) WHERE t <= {TRIED}),
    dm{r} AS MATERIALIZED (SELECT v.id, m.slot, {dist.format('m')} AS d FROM v, {old} m), dt{r} AS MATERIALIZED (SELECT v.id, t.t, {dist.format('t')} AS d FROM v, t{r} t),
    without{r} AS MATERIALIZED (SELECT a.id, a.slot, min(b.d) AS d FROM dm{r} a JOIN dm{r} b ON a.id = b.id AND a.slot <> b.slot GROUP BY 1, 2),
    cost{r} AS MATERIALIZED (SELECT w.slot, t.t, round(sum(least(w.d, t.d)), 6) AS c FROM without{r} w JOIN dt{r} t ON w.id = t.id GROUP BY 1, 2),
    best{r} AS MATERIALIZED (SELECT slot, t FROM cost{r} WHERE c < (SELECT round(sum(d), 6) FROM (SELECT min(d) AS d FROM dm{r} GROUP BY id)) QUALIFY row_number() OVER (ORDER BY c, slot, t) = 1),
    m{r} AS MATERIALIZED (SELECT m.slot, coalesce(t.x, m.x) AS x FROM {old} m LEFT JOIN best{r} b ON b.slot = m.slot LEFT JOIN t{r} t ON t.t = b.t)"""


@query(f"WITH {V}, {FIRST.format('v', N)}, m0 AS MATERIALIZED (SELECT kernel AS slot, x FROM first), {swap_sql(1)}, {swap_sql(2)} {bank_of('m2', 'slot')}")
def learn_kmedoids(spark, d):
    """Two rounds of swaps, each with the exact costs over all rows."""
    return bank(spark, learners.k_medoids(vectors(spark, d), N, 2, TRIED))


def mini_sql(s: int, batches: int) -> str:
    """CTEs of a mini-batch step: centroids and counts b{s} from b{s - 1}."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - centre[i]) * (x[i] - centre[i])))"
    return f"""a{s} AS MATERIALIZED (SELECT * FROM (SELECT q.*, c.cluster, {gap} AS d FROM q, b{s - 1} c WHERE batch = {(s - 1) % batches}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1),
    s{s} AS MATERIALIZED (SELECT cluster, list(t ORDER BY i) AS total, any_value(w) AS w FROM (SELECT cluster, i, sum(w * x[i]) AS t, sum(w) AS w FROM a{s}, {POS} GROUP BY 1, 2) GROUP BY 1),
    b{s} AS MATERIALIZED (SELECT b.cluster, CASE WHEN s.w > 0 THEN list_transform(range(1, 65), lambda i: (b.centre[i] * b.n + s.total[i]) / (b.n + s.w)) ELSE b.centre END AS centre, b.n + coalesce(s.w, 0) AS n FROM b{s - 1} b LEFT JOIN s{s} s ON s.cluster = b.cluster)"""


@query(f"""WITH {V}, {FIRST.format('v', N)}, q AS MATERIALIZED (SELECT id, x, CAST(id % 3 + 1 AS DOUBLE) AS w, CAST(floor({draw_sql("'batch'", 'CAST(id AS VARCHAR)')} * 2) AS INT) AS batch FROM v),
    b0 AS MATERIALIZED (SELECT kernel AS cluster, x AS centre, 0.0 AS n FROM first), {mini_sql(1, 2)}, {mini_sql(2, 2)}, {mini_sql(3, 2)} {bank_of('b3', 'cluster', 'centre')}""")
def learn_mini_batch(spark, d):
    """Weighted mini-batch k-means: three steps over two batches, which hold all rows."""
    rows = vectors(spark, d)
    model = learners.mini_batch_steps(rows, learners.imprint(rows, N), batches=2, count=3, weight=F.col("id") % 3 + 1)
    return bank(spark, model.centres)


@query()
def learn_mini_batch_spread(spark, d):
    """Weighted mini-batch k-means to its end, from spread starts."""
    return bank(spark, learners.mini_batch(vectors(spark, d), N, batches=4, rounds=5, weight=(F.col("id") % 3 + 1).cast("double"))[0])


@query()
def learn_whitened_kmeans(spark, d):
    """k-means of vectors of normed contrast, whitened over the whole table, until the centroids stay; they are brought back."""
    from .operators import prototypes as P

    return bank(spark, P.contrast_kmeans(vectors(spark, d), N))


@query(f"WITH {V}, m AS MATERIALIZED (SELECT i, avg(x[i]) AS m FROM v, {POS} GROUP BY 1) SELECT CAST(a.i - 1 AS INT) AS i, CAST(b.j - 1 AS INT) AS j, {r6('avg(x[a.i] * x[b.j]) - any_value(p.m) * any_value(q.m)')} AS c FROM v, range(1, 65) AS a(i), range(1, 65) AS b(j), m p, m q WHERE p.i = a.i AND q.i = b.j GROUP BY 1, 2")
def learn_covariance(spark, d):
    """What PCA and whitening take from the table."""
    _, c = sums.covariance(vectors(spark, d))
    return rounded(spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(c) for j, v in enumerate(row)], "i int, j int, c double"), "c")


@query()
def learn_ica(spark, d):
    return bank(spark, factors.ica(vectors(spark, d), N, rounds=12))


@query()
def learn_sparse_pca(spark, d):
    return bank(spark, factors.sparse_pca(vectors(spark, d), N))


@query()
def learn_nmf(spark, d):
    """Parts of the vectors less the least element of all."""
    low = vectors(spark, d).agg(F.min(F.array_min("features"))).first()[0]
    rows = vectors(spark, d).withColumn("features", F.transform("features", lambda v: v - F.lit(low)))
    return bank(spark, factors.nmf(rows, N, rounds=8)[0])


SQUARINGS = 14


def direction_sql(k: int) -> str:
    """CTEs of the leading direction d{k} of the covariance m{k}, by squaring it again and again, and the covariance without it."""
    dot = "list_dot_product(a, b)"
    return f"""p{k} AS (SELECT 0 AS s, c AS m FROM m{k} UNION ALL SELECT s + 1, list_transform(q, lambda a: list_transform(a, lambda e: e / t)) FROM (SELECT s, q, list_sum(list_transform(range(1, 65), lambda i: q[i][i])) AS t FROM (SELECT s, list_transform(m, lambda a: list_transform(m, lambda b: {dot})) AS q FROM p{k} WHERE s < {SQUARINGS}))),
    r{k} AS (SELECT row AS x FROM (SELECT unnest(m) AS row, unnest(list_transform(range(1, 65), lambda i: m[i][i])) AS top FROM p{k} WHERE s = {SQUARINGS}) ORDER BY top DESC LIMIT 1),
    d{k} AS MATERIALIZED (SELECT list_transform(x, lambda e: e / sqrt(list_dot_product(x, x)) * sign(list_max(x) + list_min(x))) AS x FROM r{k}),
    m{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: c[i][j] - lambda_ * x[i] * x[j])) AS c FROM (SELECT c, x, list_dot_product(x, list_transform(c, lambda r: list_dot_product(r, x))) AS lambda_ FROM m{k}, d{k}))"""


@query(f"""WITH RECURSIVE {V}, mean AS MATERIALIZED (SELECT i, avg(x[i]) AS m FROM v, {POS} GROUP BY 1), u AS MATERIALIZED (SELECT id, list(x[i] - m ORDER BY i) AS x FROM v, mean GROUP BY 1),
    m1 AS MATERIALIZED (SELECT list(row ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS row FROM (SELECT a.i, b.j, avg(x[a.i] * x[b.j]) AS c FROM u, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY 1, 2) GROUP BY 1)),
    {', '.join(direction_sql(k) for k in range(1, 4))}, found AS (SELECT 0 AS kernel, x FROM d1 UNION ALL SELECT 1, x FROM d2 UNION ALL SELECT 2, x FROM d3) SELECT CAST(kernel AS INT) AS kernel, CAST(i - 1 AS INT) AS pos, round(x[i], 4) + 0.0 AS w FROM found, {POS}""")
def learn_pca(spark, d):
    """Three principal directions, to four digits."""
    return learners.frame(spark, factors.pca(vectors(spark, d), 3)[0]).withColumn("w", F.round("w", 4) + 0.0)


@query(f"""WITH {V}, {cells_sql()}, b AS (SELECT vec_id AS id, label, CAST(vec_id % 4 AS INT) AS t, CAST(vec_id % 3 AS INT) AS l FROM embeddings),
    f AS (SELECT b.id, round(coalesce(avg(1 - CAST(c.v > 0 AS INT)), 0), 6) + 0.1 AS w FROM b LEFT JOIN cells c ON b.id = c.image_id AND b.label <> 0 AND c.y >= t AND c.y < t + 4 AND c.x >= l AND c.x < l + 5 GROUP BY 1),
    o AS MATERIALIZED (SELECT v.id, v.x, f.w FROM v JOIN f ON v.id = f.id), {k_means_sql('o', weight='w')} {bank_of(f'c{STEPS}', 'cluster', 'centre')}""")
def learn_omw_kmeans(spark, d):
    """Vectors weigh by the foreground in their boxes, and 0.1 more."""
    weights = mask_fg_ratio(spark, d).select(F.col("box_id").alias("id"), (F.col("ratio") + 0.1).alias("w"))
    return bank(spark, learners.k_means(vectors(spark, d).join(weights, "id"), N, STEPS, F.col("w")))


def _meta(features):
    """Mean, deviation, extremes and two quantiles of a vector's elements."""
    total = lambda f: F.aggregate(features, F.lit(0.0), lambda s, v: s + f(v)) / F.size(features)
    mean = total(lambda v: v)
    return F.array(mean, F.sqrt(total(lambda v: v * v) - mean * mean), F.array_min(features), F.array_max(features), analysis.quantile(features, 0.3), analysis.quantile(features, 0.7))


_Q = "l[CAST(floor({0}) AS INT)] * (1 - ({0} - floor({0}))) + l[CAST(floor({0}) AS INT) + 1] * ({0} - floor({0}))"
_META = f"""meta AS MATERIALIZED (SELECT id, x, [m, sqrt(q - m * m), l[1], l[64], {_Q.format('(64 * 0.3 + 0.4 + 0.3 * 0.2)')}, {_Q.format('(64 * 0.7 + 0.4 + 0.7 * 0.2)')}] AS meta
    FROM (SELECT id, x, list_sum(x) / 64 AS m, list_sum(list_transform(x, lambda e: e * e)) / 64 AS q, list_sort(x) AS l FROM v))"""
_RATES = "rates AS (SELECT i AS kernel, sum(((c * 7 + i * 3) % 11 - 5) / 10.0 * (((c * 7 + i * 3) % 11 - 5) / 10.0)) AS q FROM range(10) AS a(c), range(40) AS b(i) GROUP BY 1)"
_WEIGH = """near AS (SELECT m.id, r.q, row_number() OVER (PARTITION BY m.id ORDER BY round(list_sum(list_transform(range(1, 7), lambda i: (m.meta[i] - k.meta[i]) * (m.meta[i] - k.meta[i]))), 9), f.kernel) AS rank
    FROM meta m, first40 f JOIN meta k ON k.id = f.id JOIN rates r ON r.kernel = f.kernel), w AS (SELECT id, avg(q) AS w FROM near WHERE rank <= 4 GROUP BY 1), o AS MATERIALIZED (SELECT v.id, v.x, w.w FROM v JOIN w ON v.id = w.id)"""


@query(f"WITH {V}, {_META}, {FIRST.format('v', KNOWN).replace('first AS', 'first40 AS', 1)}, {_RATES}, {_WEIGH}, {k_means_sql('o', weight='w')} {bank_of(f'c{STEPS}', 'cluster', 'centre')}")
def learn_mfw_kmeans(spark, d):
    """Vectors weigh by the rates of the 4 known vectors of the likest meta-features; rates are sums of squared coefficients."""
    rows = vectors(spark, d)
    meta = rows.select("id", _meta(F.col("features")).alias("features"))
    coefficients = spark.createDataFrame([(c, i, float(w)) for c, r in enumerate(RATES) for i, w in enumerate(r)], "class int, pos int, w double")
    quality = [r["quality"] for r in learners.coefficient_quality(coefficients).orderBy("pos").collect()]  # KNOWN rows
    known = spark.createDataFrame([(k, m.tolist(), float(q)) for k, (m, q) in enumerate(zip(learners.imprint(meta, KNOWN), quality))], "id long, features array<double>, w double")
    return bank(spark, learners.k_means(rows.join(clusters.knn_mean(meta, known, "w"), "id"), N, STEPS, F.col("w")))


@query(f"WITH {V}, {k_means_sql('v', 5, STEPS, '(id % 3 + 1)')} SELECT id, cluster, {r6('d')} AS distance FROM n{STEPS + 1}")
def fit_kmeans(spark, d):
    rows = vectors(spark, d)
    centres = learners.k_means(rows, 5, STEPS, (F.col("id") % 3 + 1).cast("double"))
    return rounded(clusters.nearest(rows, centres).select("id", "cluster", "distance"), "distance")


_LINEAR = f"lin AS (SELECT id, label, c, list_sum(list_transform(range(1, 65), lambda i: x[i] * (((c * 31 + (i - 1) * 17) % 23 - 11) / 20.0))) + (c % 3 - 1) / 10.0 AS margin FROM v, range(10) AS t(c))"


@query(f"WITH {V}, {_LINEAR} SELECT id AS image_id, CAST(c AS INT) AS class, {r6('margin')} AS margin FROM lin")
def linear_margins(spark, d):
    rows = learn.linear(vectors(spark, d), WEIGHTS, INTERCEPTS)
    return rounded(rows.select(F.col("id").alias("image_id"), F.posexplode("margins").alias("class", "margin")), "margin")


@query(f"WITH {V}, {_LINEAR}, p AS (SELECT id, label, CAST(c AS INT) AS prediction FROM lin QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(margin, 9) DESC, c) = 1) SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2")
def linear_confusion(spark, d):
    return analysis.confusion(learn.linear(vectors(spark, d), WEIGHTS, INTERCEPTS), "label", "prediction")


@query(f"WITH {_C1.replace('c1 AS', 'c1 AS MATERIALIZED', 1)} SELECT image_id, band, y, x, {r6('v')} AS v FROM c1")
def packed_c1(spark, d):
    """The packed engine's C1, held against the same SQL as the long engine's."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("data"))
    p = type(NDP)(s1_kwidth=3, c1_kwidth=3, c1_sampling=1, s2_kwidth=[2], num_scales=1)
    made = packed.build(rows, p, gabors()[:, None], None, ("c1",), "double").select("image_id", "shape", F.posexplode("data").alias("i", "v"))
    h, w = F.col("shape")[1], F.col("shape")[2]
    div = lambda a, b: F.floor(a / b).cast("int")
    return out(made.select("image_id", div(F.col("i"), h * w).alias("band"), (div(F.col("i"), w) % h).alias("y"), (F.col("i") % w).alias("x"), "v"))


def _reflected(p: str, k: int, side: int) -> str:
    at = f"({p} + k.{'ky' if p == 'y' else 'kx'} - {k // 2})"
    return f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= {side} THEN {2 * side - 1} - {at} ELSE {at} END"


@query(f"""WITH {cells_sql(2, 4, 8)}, k AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {c}, {e}, CAST({w!r} AS DOUBLE))' for a, b, c, e, w in kernels.rows(prototypes(2, 3)))}) AS t(kernel, band, ky, kx, w)),
    g AS (SELECT DISTINCT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM cells)
    SELECT g.image_id, CAST(k.kernel AS INT) AS band, g.y, g.x, {r6('sum(k.w * c.v)')} AS v FROM g, k JOIN cells c ON c.band = k.band AND c.image_id = g.image_id AND c.y = {_reflected('g.y', 3, 4).replace('g.y + k.kx', 'g.y + k.ky')} AND c.x = {_reflected('g.x', 3, 8)} GROUP BY 1, 2, 3, 4""")
def correlate_reflect(spark, d):
    return out(filters.correlate(maps(spark, d, 2, 4, 8), kernels.frame(spark, prototypes(2, 3)), 3, 4, 8))


@query(f"WITH {cells_sql()}, t AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS m FROM cells) {MAP} t WHERE v = m")
def argmin_cells(spark, d):
    return out(analysis.arg_min(maps(spark, d)))


@query(f"WITH {_C1}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY band, y, x) AS r FROM c1) {MAP} t WHERE r <= 16")
def first_cells(spark, d):
    """What a plot of the first 16 arrays of an image shows."""
    return out(analysis.first_of(_c1(spark, d), 16))


@query(f"WITH {V} SELECT id AS patch_id, CAST(i - 1 AS INT) AS pos, {r6('x[i] / sqrt(list_sum(list_transform(x, lambda e: e * e)))')} AS v FROM v, {POS}")
def normalise_length(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return rounded(normalise.length(rows).select("patch_id", "pos", "v"))


@query(f"SELECT user_id, event_id, {r6('value - prev')} AS difference FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL")
def adjacent_difference(spark, d):
    return rounded(sequences.differences(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "difference"), "difference")


@query(f"SELECT user_id, event_id, {r6('sum(value) OVER (PARTITION BY user_id ORDER BY event_id)')} AS total FROM events")
def running_total(spark, d):
    return rounded(sequences.running_total(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "total"), "total")


@query(f"WITH RECURSIVE {V}, a AS (SELECT id, 1 AS i, x[1] AS now FROM v UNION ALL SELECT a.id, a.i + 1, a.now * 0.75 + v.x[a.i + 1] * 0.25 FROM a JOIN v ON v.id = a.id WHERE a.i < 64) SELECT id, CAST(i - 1 AS INT) AS pos, {r6('now')} AS average FROM a")
def moving_average(spark, d):
    rows = vectors(spark, d).select("id", F.posexplode(sequences.moving_average(F.col("features"), 0.25)).alias("pos", "average"))
    return rounded(rows, "average")


_GROUPED = "SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 3 AS INT) AS part, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 3 AS INT) AS pos, vec_id AS value FROM embeddings"


@query(_GROUPED)
def grouped_triples(spark, d):
    """Groups of three, the last of a class with fewer, and out of them again."""
    rows = table(spark, d, "embeddings").select("label", "vec_id")
    return sequences.ungrouped(sequences.groups(rows, "label", "vec_id", "vec_id", 3), "label")


@query(f"WITH {V} SELECT id, CAST(p AS INT) AS part, CAST(len(s) AS INT) AS n, {r6('list_sum(s)')} AS total FROM (SELECT id, unnest([x[1:5], x[6:25], x[26:64]]) AS s, unnest([0, 1, 2]) AS p FROM v)")
def split_arrays(spark, d):
    rows = vectors(spark, d).select("id", F.posexplode(sequences.split(F.col("features"), [5, 20])).alias("part", "s"))
    return rounded(rows.select("id", "part", F.size("s").alias("n"), F.aggregate("s", F.lit(0.0), lambda t, v: t + v).alias("total")), "total")


@query("SELECT label, vec_id, 'b' AS only_in FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT label + 1, vec_id, 'a' FROM embeddings WHERE vec_id % 10 = 3")
def compare_tables(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 10 == 3, F.col("label") + 1).otherwise(F.col("label")).cast("int"))
    return sequences.unlike(changed, rows)


@query(f"""WITH t AS (SELECT CAST(event_id % 2 AS INT) AS series, event_type AS name, value, event_id FROM events), o AS (SELECT name, row_number() OVER (ORDER BY min(event_id)) - 1 AS at FROM t WHERE series = 0 GROUP BY 1)
    SELECT t.series, t.name, CAST(o.at AS INT) AS place, {r6('avg(value)')} AS y_mean, {r6('stddev_pop(value) / sqrt(count(*))')} AS y_stderr FROM t JOIN o ON o.name = t.name GROUP BY 1, 2, 3""")
def bar_data(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("at"))
    return rounded(analysis.bars([rows.where("at % 2 = 0"), rows.where("at % 2 = 1")]), "y_mean", "y_stderr")


@query(f"SELECT * FROM (SELECT CAST(least(floor((l_quantity - 1) / 49 * 7), 6) AS INT) AS x_bin, CAST(least(floor(l_discount / 0.1 * 5), 4) AS INT) AS y_bin, {r6('sum(l_tax)')} AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2) WHERE n BETWEEN 1 AND 1000")
def hist2d_weighted(spark, d):
    rows = analysis.histogram2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", 7, 5, (1.0, 50.0), (0.0, 0.1), "l_tax")
    return rounded(rows, "n").where("n between 1 and 1000")


@query(f"""WITH {cells_sql()}, k AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, exp(-(xo * xo + 0.25 * yo * yo) / (2 * 2.5 * 2.5)) * sin(0.7 + 2 * pi() * xo / 4.5) AS w FROM (SELECT y, x, (x - 4) * cos(0.6) + (y - 4) * sin(0.6) AS xo, -(x - 4) * sin(0.6) + (y - 4) * cos(0.6) AS yo FROM range(8) AS a(y), range(8) AS b(x)))
    SELECT image_id, {r6('sum(c.v * k.w)')} AS v FROM cells c JOIN k ON c.y = k.y AND c.x = k.x GROUP BY 1""")
def gabor_fill(spark, d):
    """The maps' products with one Gabor function over the whole map."""
    filled = kernels.frame(spark, kernels.gabor_fill(2.5, 0.6, 0.7, 0.5, 4.5, 8, 8)[None]).select(F.col("ky").alias("y"), F.col("kx").alias("x"), "w")
    return rounded(maps(spark, d).join(F.broadcast(filled), ["y", "x"]).groupBy("image_id").agg(F.sum(F.col("v") * F.col("w")).alias("v")))  # 64 rows


@query("SELECT e.vec_id, CASE WHEN e.label < 5 THEN 'host' || e.label END AS host FROM embeddings e")
def worker_lookup(spark, d):
    """Names of workers by number; those that have none are null."""
    names = spark.createDataFrame([(k, f"host{k}") for k in range(5)], "label int, host string")
    return table(spark, d, "embeddings").select("vec_id", "label").join(F.broadcast(names), "label", "left").select("vec_id", "host")  # five rows
