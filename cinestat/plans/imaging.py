"""Iterative and neighbourhood operators on images."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions import stencils
from cinestat.operators import label_graph as mrf, pixels as px_ops, superpixels as sp
from cinestat.plans.geometry import PX_SQL, images
from cinestat.plans.registry import query


def _reflect(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"


SEEDS_SQL = f"""{PX_SQL},
    off(dx, dy, kx, ky) AS (VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)),
    gr AS (SELECT a.vec_id, a.y, a.x, sqrt(pow(sum(b.v * kx), 2) + pow(sum(b.v * ky), 2)) AS g
      FROM px a, off JOIN px b ON b.vec_id = a.vec_id AND b.x = {_reflect('a.x + dx')} AND b.y = {_reflect('a.y + dy')}
      GROUP BY a.vec_id, a.y, a.x),
    grid AS (SELECT row_number() OVER (ORDER BY gx, gy) - 1 AS c, gx, gy FROM (VALUES (2),(4),(6)) a(gx), (VALUES (2),(4),(6)) b(gy)),
    c0 AS (SELECT vec_id, c, v AS color, x AS cx, y AS cy FROM (SELECT gr.vec_id, c, gr.x, gr.y, px.v,
        row_number() OVER (PARTITION BY gr.vec_id, c ORDER BY round(g, 9), gr.y, gr.x) AS rn
        FROM grid JOIN gr ON gr.x >= gx - 1 AND gr.x < gx + 1 AND gr.y >= gy - 1 AND gr.y < gy + 1
        JOIN px ON px.vec_id = gr.vec_id AND px.x = gr.x AND px.y = gr.y) WHERE rn = 1),
    l0 AS (SELECT vec_id, y, x, v, -1 AS label FROM px)
"""


def _slic_step(k: int) -> str:
    p = k - 1
    return f"""
    d{k} AS (SELECT p.vec_id, p.y, p.x, c, sqrt(pow((p.v - color) / 0.2e0, 2) + (pow(p.x - cx, 2) + pow(p.y - cy, 2)) / 4) AS d
      FROM px p JOIN c{p} USING (vec_id) WHERE p.x >= floor(cx - 3) AND p.x < cx + 3 AND p.y >= floor(cy - 3) AND p.y < cy + 3),
    b{k} AS (SELECT vec_id, y, x, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, y, x ORDER BY d, c) AS rn FROM d{k}) WHERE rn = 1),
    l{k} AS MATERIALIZED (SELECT o.vec_id, o.y, o.x, o.v, coalesce(b.c, o.label)::INTEGER AS label FROM l{p} o LEFT JOIN b{k} b
      ON o.vec_id = b.vec_id AND o.y = b.y AND o.x = b.x),
    c{k} AS MATERIALIZED (SELECT vec_id, label AS c, avg(v) AS color, (sum(x) // count(*)) AS cx, (sum(y) // count(*)) AS cy FROM l{k}
      WHERE label >= 0 GROUP BY ALL)"""


SLIC = {"superpixels": 16, "nc": 0.2, "radius": 1}
ROUNDS, ADAPTIVE_ROUNDS = 25, 10
SLIC_SQL = ", ".join(_slic_step(k) for k in range(1, ROUNDS + 1))


@query("slic_seeds", f"WITH {SEEDS_SQL} SELECT vec_id, c::INTEGER AS c, round(color, 6) AS color, cx, cy FROM c0")
def slic_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sp.seed_centres(images(spark, sf_dir), "vec_id", "px", 8, 8, sp.grid_step(8, 8, 16), 1)
    return s.withColumn("color", F.round("color", 6))


@query(
    "slic_superpixels",
    f"WITH {SEEDS_SQL}, {SLIC_SQL} SELECT vec_id, y, x, label FROM l{ROUNDS}",
)
def slic_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp.slic(images(spark, sf_dir), "vec_id", "px", 8, 8, iterations=ROUNDS, **SLIC)
    return out.select("vec_id", "y", "x", "label")


@query(
    "superpixel_means",
    f"""WITH {SEEDS_SQL}, {SLIC_SQL}
    SELECT vec_id, label, round(avg(v), 6) AS mean, count(*) AS n FROM l{ROUNDS} GROUP BY ALL""",
)
def superpixel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp.slic(images(spark, sf_dir), "vec_id", "px", 8, 8, iterations=ROUNDS, **SLIC)
    return sp.cluster_means(out, "vec_id").withColumn("mean", F.round("mean", 6))


@query(
    "superpixel_contours",
    f"""WITH {SEEDS_SQL}, {SLIC_SQL}
    SELECT a.vec_id, a.x, a.y, count(*) FILTER (a.label != b.label) AS differing FROM l{ROUNDS} a JOIN l{ROUNDS} b
    ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.x, a.y
    HAVING count(*) FILTER (a.label != b.label) >= 2""",
)
def superpixel_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp.slic(images(spark, sf_dir), "vec_id", "px", 8, 8, iterations=ROUNDS, **SLIC)
    return sp.contour_pixels(out, "vec_id")


def _slico_step(k: int) -> str:
    p = k - 1
    return f"""
    d{k} AS (SELECT p.vec_id, p.y, p.x, c, color, maxc, pow(p.v - color, 2) / maxc + (pow(p.x - cx, 2) + pow(p.y - cy, 2)) / 9 AS d
      FROM px p JOIN c{p} USING (vec_id) WHERE p.x >= floor(cx - 3) AND p.x < cx + 3 AND p.y >= floor(cy - 3) AND p.y < cy + 3),
    b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, y, x ORDER BY d, c) AS rn FROM d{k}) WHERE rn = 1),
    l{k} AS MATERIALIZED (SELECT o.vec_id, o.y, o.x, o.v, coalesce(b.c, o.label)::INTEGER AS label, coalesce(b.color, o.color) AS color,
      coalesce(b.maxc, o.maxc) AS maxc FROM l{p} o LEFT JOIN b{k} b ON o.vec_id = b.vec_id AND o.y = b.y AND o.x = b.x),
    c{k} AS MATERIALIZED (SELECT vec_id, label AS c, avg(v) AS color, avg(x) AS cx, avg(y) AS cy,
      greatest(max(pow(v - color, 2)), max(maxc)) AS maxc FROM l{k} WHERE label >= 0 GROUP BY ALL)"""


@query(
    "slico_superpixels",
    f"""WITH {PX_SQL}, spot(i, p) AS (VALUES (0, 1), (1, 4), (2, 6)),
    c0 AS (SELECT vec_id, b.i * 3 + a.i AS c, v AS color, a.p::DOUBLE AS cx, b.p::DOUBLE AS cy, 1.1754944e-38 AS maxc
      FROM spot a, spot b JOIN px ON px.x = a.p AND px.y = b.p),
    l0 AS (SELECT vec_id, y, x, v, -1 AS label, NULL::DOUBLE AS color, NULL::DOUBLE AS maxc FROM px),
    {', '.join(_slico_step(k) for k in range(1, ADAPTIVE_ROUNDS + 1))} SELECT vec_id, y, x, label FROM l{ADAPTIVE_ROUNDS}""",
)
def slico_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp.slico(images(spark, sf_dir), "vec_id", "px", 8, 8, region=3, iterations=ADAPTIVE_ROUNDS)
    return out.select("vec_id", "y", "x", "label")


@query(
    "block_histograms",
    f"""WITH {PX_SQL}, q AS (SELECT vec_id, least(y // 2, 3) * 4 + least(x // 2, 3) AS block,
        least(floor((v + 1) / 2 * 5), 4)::INTEGER AS bin FROM px)
    SELECT vec_id, block::INTEGER AS block, bin, count(*) AS n FROM q GROUP BY ALL""",
)
def block_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px_ops.explode_pixels(images(spark, sf_dir), "vec_id", "px", 8)
    bins = F.least(F.floor((F.col("v") + 1) / 2 * 5), F.lit(4)).cast("int")
    return sp.block_histograms(p, "vec_id", sp.block_label(F.col("x"), F.col("y"), 8, 8, 4, 4), bins)


LABELS = [1, 2, 0]
SMOOTH = mrf.potts(LABELS, 7.0, unknown=0)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel sites with the costs of the labels bright, dark and unknown."""
    scaled = images(spark, sf_dir).select("vec_id", px_ops.rescale_minmax(F.col("px")).alias("px"))
    long = scaled.select("vec_id", F.posexplode("px").alias("site", "v"))
    costs = F.array((1 - F.col("v")) * 100, F.col("v") * 100, F.lit(60.0))
    return long.select("vec_id", "site", mrf.integer_costs(costs).alias("costs"))


MRF_SQL = f"""{PX_SQL},
    sc AS (SELECT vec_id, y * 8 + x AS site, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM px WINDOW w AS (PARTITION BY vec_id)),
    lab(l, pos) AS (VALUES (1, 0), (2, 1), (0, 2)),
    cost AS (SELECT vec_id, site, l, pos, trunc(CASE l WHEN 1 THEN (1 - v) * 100 WHEN 2 THEN v * 100 ELSE 60 END) AS c FROM sc, lab),
    sm AS (SELECT a.l AS l1, b.l AS l2, CASE WHEN a.l = b.l AND a.l != 0 THEN 0 ELSE 7 END AS w FROM lab a, lab b),
    ed AS (SELECT a.s AS s, b.s AS d FROM (SELECT unnest(range(64)) AS s) a, (SELECT unnest(range(64)) AS s) b
           WHERE abs(a.s // 8 - b.s // 8) + abs(a.s % 8 - b.s % 8) = 1),
    m0 AS (SELECT vec_id, s, d, l, 0e0 AS m FROM (SELECT DISTINCT vec_id FROM sc), ed, lab)
"""


def _lbp_round(k: int) -> str:
    return f"""
    i{k} AS (SELECT vec_id, d AS s, l, sum(2 * m) AS m FROM m{k-1} GROUP BY ALL),
    h{k} AS (SELECT c.vec_id, ed.s, ed.d, c.l, c.c + i.m - 2 * r.m AS h FROM cost c JOIN ed ON ed.s = c.site
      JOIN i{k} i ON i.vec_id = c.vec_id AND i.s = c.site AND i.l = c.l
      JOIN m{k-1} r ON r.vec_id = c.vec_id AND r.s = ed.d AND r.d = ed.s AND r.l = c.l),
    n{k} AS (SELECT vec_id, s, d, l2 AS l, min(h + w) AS m FROM h{k} JOIN sm ON sm.l1 = h{k}.l GROUP BY ALL),
    m{k} AS MATERIALIZED (SELECT vec_id, s, d, l, m - min(m) OVER (PARTITION BY vec_id, s, d) AS m FROM n{k})"""


LBP_SQL = f"""{MRF_SQL}, {_lbp_round(1)}, {_lbp_round(2)}, {_lbp_round(3)},
    bel AS (SELECT c.vec_id, c.site, c.l, c.pos, c.c, c.c + i.m AS b FROM cost c JOIN
      (SELECT vec_id, d AS site, l, sum(2 * m) AS m FROM m3 GROUP BY ALL) i USING (vec_id, site, l)),
    fin AS (SELECT vec_id, site, l AS label, c AS data_cost FROM (SELECT *, row_number() OVER
      (PARTITION BY vec_id, site ORDER BY b, pos) AS rn FROM bel) WHERE rn = 1)
"""


@query("mrf_belief_propagation", f"WITH {LBP_SQL} SELECT vec_id, site::INTEGER AS site, label, data_cost::DOUBLE AS data_cost FROM fin")
def mrf_belief_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    edges = mrf.grid_edges(sites, "vec_id", 8, 8)
    return mrf.belief_propagation(sites, edges, "vec_id", LABELS, SMOOTH, 3)


@query(
    "mrf_energy",
    f"""WITH {MRF_SQL}, fin AS (SELECT vec_id, site, l AS label, c AS data_cost FROM (SELECT *, row_number() OVER
      (PARTITION BY vec_id, site ORDER BY c, pos) AS rn FROM cost) WHERE rn = 1),
    e AS (SELECT a.vec_id, sum(2 * w) AS smoothness FROM ed JOIN fin a ON a.site = ed.s
      JOIN fin b ON b.site = ed.d AND b.vec_id = a.vec_id JOIN sm ON l1 = a.label AND l2 = b.label GROUP BY a.vec_id)
    SELECT vec_id, (sum(data_cost) + any_value(smoothness))::DOUBLE AS energy FROM fin JOIN e USING (vec_id) GROUP BY vec_id""",
)
def mrf_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    edges = mrf.grid_edges(sites, "vec_id", 8, 8)
    start = mrf.initial_labels(sites, "vec_id", LABELS)
    return mrf.energy(start, edges, "vec_id", LABELS, SMOOTH)


NEAR = [
    [y2 * 8 + x2 for y2, x2 in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= y2 < 8 and 0 <= x2 < 8]
    for y in range(8) for x in range(8)
]


@query(
    "mrf_iterated_modes",
    f"""WITH RECURSIVE {MRF_SQL},
    cl AS (SELECT vec_id, list(c ORDER BY site) FILTER (l = 1) AS a, list(c ORDER BY site) FILTER (l = 2) AS b,
             list(c ORDER BY site) FILTER (l = 0) AS u FROM cost GROUP BY vec_id),
    it AS (SELECT vec_id, 0 AS k, list_transform(range(64), lambda j: CASE WHEN a[j + 1] <= b[j + 1] AND a[j + 1] <= u[j + 1] THEN 0
             WHEN b[j + 1] <= u[j + 1] THEN 1 ELSE 2 END) AS lab FROM cl
      UNION ALL
      SELECT vec_id, k + 1, list_transform(range(64), lambda j: CASE WHEN j != k % 64 THEN lab[j + 1]
             WHEN pa <= pb AND pa <= pu THEN 0 WHEN pb <= pu THEN 1 ELSE 2 END)
      FROM (SELECT it.vec_id, k, lab, a[k % 64 + 1] + 14 * len(list_filter(nb, lambda q: lab[q + 1] != 0)) AS pa,
              b[k % 64 + 1] + 14 * len(list_filter(nb, lambda q: lab[q + 1] != 1)) AS pb, u[k % 64 + 1] + 14 * len(nb) AS pu
            FROM (SELECT *, ({NEAR})[k % 64 + 1] AS nb FROM it WHERE k < 192) it JOIN cl ON cl.vec_id = it.vec_id)),
    f AS (SELECT it.vec_id, unnest(range(64)) AS site, unnest(lab) AS i, unnest(a) AS a, unnest(b) AS b, unnest(u) AS u
          FROM it JOIN cl ON cl.vec_id = it.vec_id WHERE k = 192)
    SELECT vec_id, site::INTEGER AS site, (CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)::INTEGER AS label,
           (CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE u END)::DOUBLE AS data_cost FROM f""",
)
def mrf_iterated_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    edges = mrf.grid_edges(sites, "vec_id", 8, 8)
    return mrf.iterated_modes(sites, edges, "vec_id", LABELS, SMOOTH, 3)


#: Rounds that the twins lay out; every graph of the given tables ends before.
MOST = 12


def _settled_sql() -> str:
    """Energies of every round by graph, and for each graph the round that it ends with."""
    parts = [MRF_SQL, """
    r0 AS (SELECT vec_id, site, l AS label, c AS data_cost FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, site ORDER BY c, pos) AS rn FROM cost) WHERE rn = 1)"""]
    for k in range(1, MOST + 1):
        parts += [_lbp_round(k), f"""
    r{k} AS MATERIALIZED (SELECT vec_id, site, l AS label, c AS data_cost FROM (SELECT c.*, row_number() OVER (PARTITION BY c.vec_id, c.site ORDER BY c.c + i.m, c.pos) AS rn
      FROM cost c JOIN (SELECT vec_id, d AS site, l, sum(2 * m) AS m FROM m{k} GROUP BY ALL) i USING (vec_id, site, l)) WHERE rn = 1)"""]
    energies = " UNION ALL ".join(f"""SELECT vec_id, {k} AS r, sum(data_cost) + (SELECT sum(2 * w) FROM ed JOIN r{k} a ON a.site = ed.s JOIN r{k} b ON b.site = ed.d AND b.vec_id = a.vec_id
      JOIN sm ON l1 = a.label AND l2 = b.label WHERE a.vec_id = o.vec_id) AS e FROM r{k} o GROUP BY vec_id""" for k in range(MOST + 1))
    parts += [f"en AS MATERIALIZED ({energies})", """
    st AS (SELECT vec_id, min(r) AS r FROM (SELECT *, lag(e) OVER (PARTITION BY vec_id ORDER BY r) AS was FROM en) WHERE r > 0 AND (e = was OR (r > 1 AND e >= was)) GROUP BY vec_id),
    co AS (SELECT st.vec_id, st.r, a.e = b.e AS converged FROM st JOIN en a ON a.vec_id = st.vec_id AND a.r = st.r JOIN en b ON b.vec_id = st.vec_id AND b.r = st.r - 1)""",
              "al AS (" + " UNION ALL ".join(f"SELECT *, {k} AS r FROM r{k}" for k in range(1, MOST + 1)) + ")"]
    return ", ".join(parts)


@query(
    "mrf_settled",
    f"""WITH {_settled_sql()} SELECT al.vec_id, site::INTEGER AS site, label, data_cost::DOUBLE AS data_cost, co.r::INTEGER AS rounds, converged
    FROM al JOIN co ON co.vec_id = al.vec_id AND co.r = al.r""",
)
def mrf_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every image after as many rounds of messages as its energy falls."""
    sites = _sites(spark, sf_dir)
    edges = mrf.grid_edges(sites, "vec_id", 8, 8)
    return mrf.settle_labels(sites, edges, "vec_id", LABELS, SMOOTH)


def _filtered(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels of all images after a stencil."""
    out = stencils.map_images(images(spark, sf_dir).select("vec_id", "px"), "px", kernel, 8, "out")
    return px_ops.explode_pixels(out, "vec_id", "out", 8).withColumn("v", F.round("v", 6))


def _pm_step(k: int) -> str:
    p = f"pm{k - 1}"
    return f"""
    ds{k} AS (SELECT a.vec_id, a.y, a.x, sum(b.v * kx) AS gx, sum(b.v * ky) AS gy FROM {p} a, off JOIN {p} b
      ON b.vec_id = a.vec_id AND b.x = {_reflect('a.x + dx')} AND b.y = {_reflect('a.y + dy')} GROUP BY a.vec_id, a.y, a.x),
    g{k} AS (SELECT vec_id, y, x, CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN 1 ELSE 1 / (1 + (gx * gx + gy * gy) / 0.25e0) END AS g FROM ds{k}),
    q{k} AS (SELECT * FROM {p} JOIN g{k} USING (vec_id, y, x)),
    pm{k} AS MATERIALIZED (SELECT a.vec_id, a.y, a.x, a.v + 0.2e0 * sum((b.g + a.g) * (b.v - a.v)) / 4 AS v FROM q{k} a JOIN q{k} b
      ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.vec_id, a.y, a.x, a.v)"""


@query(
    "diffusion_filter",
    f"""WITH {PX_SQL}, pm0 AS (SELECT vec_id, y, x, v FROM px),
    off(dx, dy, kx, ky) AS (VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)),
    {_pm_step(1)}, {_pm_step(2)}, {_pm_step(3)} SELECT vec_id, y, x, round(v, 6) AS v FROM pm3""",
)
def diffusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, lambda a: stencils.perona_malik(a, 0.5, 0.2, 0.6))


@query(
    "local_contrast",
    f"""WITH {PX_SQL}, k AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 8e0) AS w FROM (SELECT unnest(range(-4, 5)) AS dx) a,
        (SELECT unnest(range(-4, 5)) AS dy) b), kn AS (SELECT dx, dy, w / (SELECT sum(w) FROM k) AS w FROM k),
    c AS (SELECT a.vec_id, a.y, a.x, any_value(a.v) AS v, sum(b.v * w) AS m, sqrt(sum(b.v * b.v * w)) AS s FROM px a, kn JOIN px b
      ON b.vec_id = a.vec_id AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.vec_id, a.y, a.x)
    SELECT vec_id, y, x, round((v - m) / greatest(s, avg(s) OVER (PARTITION BY vec_id), 1e-4), 6) AS v FROM c""",
)
def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, stencils.local_contrast)


def _flagged(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pixels of all images after a filter that ends by itself, and whether it did so within its steps."""
    out = stencils.map_images(images(spark, sf_dir).select("vec_id", "px"), "px", lambda a: stencils.with_flag(kernel(a)), 8, "out")
    flag = (F.element_at("out", -1) > 0).alias("converged")
    one = out.select("vec_id", flag, F.slice("out", 1, 64).alias("out"))
    return one.select("vec_id", "converged", F.posexplode("out").alias("i", "v")).select(
        "vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.round("v", 6).alias("v"), "converged")


@query("level_set_regions")
def level_set_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside or outside of a level set that starts as a disc and runs until it settles, 1,000 steps at most."""
    yy, xx = np.mgrid[0:8, 0:8]
    disc = 3.0 - np.hypot(yy - 3.5, xx - 3.5)
    p = _flagged(spark, sf_dir, lambda a: stencils.chan_vese(a, disc, mu=0.2, lambda1=4.0, lambda2=4.0))
    return p.select("vec_id", "y", "x", (F.col("v") > 0).alias("inside"), "converged")


def _each(body: str) -> str:
    """A list over the 64 pixels; ``i`` counts from 0."""
    return f"list_transform(range(64), lambda i: {body})"


#: One step of the dual projection in lists, image by image, until the energy changes little.
_TV_SQL = f"""
    im AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS img FROM embeddings),
    it AS (SELECT vec_id, 0 AS k, {_each('0e0')} AS p, {_each('0e0')} AS q, img AS cur, 0e0 AS e, 0e0 AS first, TRUE AS going FROM im
      UNION ALL
      SELECT vec_id, k + 1, {_each('(p[i + 1] - 0.25e0 * gx[i + 1]) / (1 + 2.5e0 * nm[i + 1])')}, {_each('(q[i + 1] - 0.25e0 * gy[i + 1]) / (1 + 2.5e0 * nm[i + 1])')},
        now, en, CASE WHEN k = 0 THEN en ELSE first END, k = 0 OR abs(e - en) >= 2e-4 * first
      FROM (SELECT *, (list_sum(list_transform(d, lambda v: v * v)) + 0.1e0 * list_sum(nm)) / 64 AS en
        FROM (SELECT *, {_each('sqrt(gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1])')} AS nm
          FROM (SELECT *, {_each('CASE WHEN i < 56 THEN now[i + 9] - now[i + 1] ELSE 0e0 END')} AS gx, {_each('CASE WHEN i % 8 < 7 THEN now[i + 2] - now[i + 1] ELSE 0e0 END')} AS gy
            FROM (SELECT *, {_each('img[i + 1] + d[i + 1]')} AS now
              FROM (SELECT it.*, img, {_each('-p[i + 1] - q[i + 1] + CASE WHEN i >= 8 THEN p[i - 7] ELSE 0e0 END + CASE WHEN i % 8 > 0 THEN q[i] ELSE 0e0 END')} AS d
                FROM it JOIN im USING (vec_id) WHERE going AND k < 200))))))
"""


@query(
    "tv_denoise",
    f"""WITH RECURSIVE {_TV_SQL}, f AS (SELECT vec_id, max_by(cur, k) AS cur, NOT max_by(going, k) AS converged FROM it GROUP BY vec_id)
    SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, round(cur[i + 1], 6) AS v, converged FROM f CROSS JOIN (SELECT unnest(range(64)) AS i)""",
)
def tv_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, lambda a: stencils.tv_denoise(a, 0.1))
