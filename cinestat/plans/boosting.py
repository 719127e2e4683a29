"""Boosted trees under the Huber loss, checked tree by tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.models.boosting import Boosted, huber_boosting
from cinestat.plans.registry import query, table

TREES, DEPTH, RATE, BINS = 3, 2, 0.5, 8
FEATURES = ["qty", "lines", "disc"]


def _tree_sql(k: int) -> str:
    """CTEs of tree ``k``: residuals, two levels of splits by cumulated cells, leaf values."""
    out = [f"""r{k} AS MATERIALIZED (SELECT *, y - now AS r FROM p{k}),
    e{k} AS (SELECT quantile_disc(abs(r), 0.9) AS edge FROM r{k}),
    t{k}_0 AS MATERIALIZED (SELECT r{k}.*, sign(r) * least(abs(r), edge) AS g, 1 AS node FROM r{k}, e{k})"""]
    for d in range(DEPTH):
        out.append(f"""h{k}_{d} AS (SELECT node, f, bin, sum(g) AS s, count(*) AS n FROM (SELECT node, g, unnest([0, 1, 2]) AS f, unnest(bins) AS bin FROM t{k}_{d}) GROUP BY ALL),
    c{k}_{d} AS (SELECT node, f, bin, sum(s) OVER w AS sl, sum(n) OVER w AS nl, sum(s) OVER a AS st, sum(n) OVER a AS nt FROM h{k}_{d}
      WINDOW w AS (PARTITION BY node, f ORDER BY bin), a AS (PARTITION BY node, f)),
    s{k}_{d} AS MATERIALIZED (SELECT * FROM (SELECT node, f, bin, gain, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS rn FROM
      (SELECT node, f, bin, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM c{k}_{d} WHERE nl < nt)) WHERE rn = 1 AND gain > 1e-9),
    t{k}_{d + 1} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN s.node IS NULL THEN -t.node WHEN bins[f + 1] > s.bin THEN 2 * t.node + 1 ELSE 2 * t.node END AS node)
      FROM t{k}_{d} t LEFT JOIN s{k}_{d} s USING (node))""")
    out.append(f"""m{k} AS (SELECT node, quantile_disc(r, 0.5) AS m FROM t{k}_{DEPTH} GROUP BY node),
    v{k} AS (SELECT node, any_value(m) + avg(sign(r - m) * least(abs(r - m), edge)) AS v FROM t{k}_{DEPTH} JOIN m{k} USING (node), e{k} GROUP BY node),
    p{k + 1} AS MATERIALIZED (SELECT o_orderkey, y, bins, now + {RATE} * v AS now FROM t{k}_{DEPTH} JOIN v{k} USING (node))""")
    return ",\n    ".join(out)


_DATA_SQL = f"""
    x AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS qty, count(*)::DOUBLE AS lines, max(l_discount) AS disc FROM lineitem GROUP BY l_orderkey),
    j AS MATERIALIZED (SELECT o_orderkey, o_totalprice / 1000 AS y, qty, lines, disc FROM orders JOIN x USING (o_orderkey)),
    q AS (SELECT quantile_disc(y, 0.5) AS y0, {', '.join(f"list_distinct(quantile_disc({c}, [{', '.join(str(i / BINS) for i in range(1, BINS))}])) AS b_{c}" for c in FEATURES)} FROM j),
    p0 AS MATERIALIZED (SELECT o_orderkey, y, [{', '.join(f'len(list_filter(b_{c}, lambda v: v < {c}))' for c in FEATURES)}] AS bins, y0 AS now FROM j, q),
    {', '.join(_tree_sql(k) for k in range(TREES))}
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("lines"), F.max("l_discount").alias("disc"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"))
    return orders.join(lines, "o_orderkey")


def _model(rows: DataFrame) -> Boosted:
    return huber_boosting(rows, FEATURES, "y", trees=TREES, depth=DEPTH, rate=RATE, bins=BINS, accuracy=1_000_000)


@query("huber_boosting", f"WITH {_DATA_SQL} SELECT o_orderkey, round(now, 5) AS prediction FROM p{TREES}")
def huber_boosting_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _model(rows).predict(rows).select("o_orderkey", F.round("prediction", 5).alias("prediction"))


@query(
    "huber_importance",
    f"""WITH {_DATA_SQL}, a AS ({' UNION ALL '.join(f'SELECT f, gain FROM s{k}_{d}' for k in range(TREES) for d in range(DEPTH))}),
    n AS (SELECT unnest([0, 1, 2]) AS f, unnest({FEATURES}) AS feature), g AS (SELECT feature, coalesce(sum(gain), 0) AS gain FROM n LEFT JOIN a USING (f) GROUP BY feature)
    SELECT feature, round(100 * gain / (SELECT max(gain) FROM g), 4) AS relative FROM g""",
)
def huber_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _model(_rows(spark, sf_dir)).importance()
    return spark.createDataFrame(found, "feature string, relative double").withColumn("relative", F.round("relative", 4))
