"""Whole chains: from measured frames to what a study delivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions import cdf
from cinestat.operators import ring
from cinestat.plans.distributions import BINS_SQL
from cinestat.plans.registry import query, table
from cinestat.sources import submission

LEAST_DAYS = 14


@query(
    "study_submission",
    f"""WITH d AS (SELECT user_id, day(ts) AS day, avg(value) AS mu FROM events GROUP BY ALL),
    t AS (SELECT *, CASE WHEN day % 2 = 0 THEN 'Systole' ELSE 'Diastole' END AS target FROM d),
    template AS (SELECT DISTINCT user_id, target FROM t),
    enough AS (SELECT user_id, target FROM t GROUP BY ALL HAVING count(*) >= {LEAST_DAYS}),
    own AS MATERIALIZED (SELECT user_id, target, bin, avg(CASE WHEN mu <= bin THEN 1e0 ELSE 0e0 END) AS p
      FROM t JOIN enough USING (user_id, target), {BINS_SQL} GROUP BY ALL),
    up AS MATERIALIZED (SELECT user_id, target, bin, max(p) OVER (PARTITION BY user_id, target ORDER BY bin) AS p FROM own),
    fb AS MATERIALIZED (SELECT target, bin, avg(p) AS p FROM up GROUP BY ALL)
    SELECT m.user_id || '_' || m.target AS id, fb.bin::INTEGER AS bin, round(coalesce(up.p, fb.p), 5) AS p, up.p IS NULL AS missed
    FROM template m JOIN fb USING (target) LEFT JOIN up ON up.user_id = m.user_id AND up.target = m.target AND up.bin = fb.bin""",
)
def study_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distribution of a study, made monotone, into the template; targets with few days take the fallback.

    A study and target is one row with one array all along; it is widened only to be compared.
    """
    days = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("mu"))
    target = F.when(F.col("day") % 2 == 0, "Systole").otherwise("Diastole")
    # Days of a month: the list is bounded.
    studies = days.groupBy("user_id", target.alias("target")).agg(F.collect_list("mu").alias("mus"))
    share = F.transform(cdf.bins(), lambda j: F.size(F.filter("mus", lambda m: m <= j)).cast("double") / F.size("mus"))
    own = studies.where(F.size("mus") >= LEAST_DAYS).select(F.col("user_id").alias("study"), "target", cdf.running_max(share).alias("p"))
    bins = own.select("target", F.posexplode("p").alias("bin", "p")).groupBy("target", "bin").agg(F.avg("p").alias("p"))
    template = studies.select(F.col("user_id").alias("study"), "target")
    out = submission.fill_template(template, own, submission.to_arrays(bins, ["target"]))
    return out.select("id", "missed", F.posexplode("p").alias("bin", "p")).select("id", "bin", F.round("p", 5).alias("p"), "missed")


@query(
    "study_stack",
    """WITH d AS (SELECT user_id, event_type, day(ts) AS day, avg(value) AS v FROM events GROUP BY ALL),
    n AS (SELECT *, coalesce(lag(v) OVER w, last_value(v) OVER f) AS prv, coalesce(lead(v) OVER w, first_value(v) OVER f) AS nxt FROM d
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day),
      f AS (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY v, day) AS rn FROM n) WHERE rn = 1),
    hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY v DESC, day) AS rn FROM n) WHERE rn = 1),
    s AS (SELECT user_id, event_type, [lo.prv, lo.v, lo.nxt, hi.prv, hi.v, hi.nxt] AS ch,
      row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
      FROM lo JOIN hi USING (user_id, event_type)),
    p AS (SELECT user_id, pos, ch FROM s JOIN (SELECT unnest(range(15)) AS pos) q ON q.pos % s.n = s.i)
    SELECT user_id, (pos * 6 + k - 1)::INTEGER AS channel, round(ch[k], 6) AS v FROM p, (SELECT unnest(range(1, 7)) AS k)""",
)
def study_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array per study: 15 slices in order, each the frames around its minimum and its maximum."""
    frames = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("v"))
    keys = ["user_id", "event_type"]
    around = frames.select("*", ring.previous("v", keys, "day").alias("prv"), ring.following("v", keys, "day").alias("nxt"))
    three = F.array("prv", "v", "nxt")
    slices = around.groupBy(*keys).agg(
        F.concat(F.min_by(three, F.struct("v", "day")), F.max_by(three, F.struct(F.col("v"), -F.col("day")))).alias("ch"))
    padded = ring.pad_cycle(slices, ["user_id"], "event_type", 15)
    # 15 slices a study.
    stack = padded.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda x: x["ch"]))
    return stack.select("user_id", F.posexplode(flat).alias("channel", "v")).select("user_id", "channel", F.round("v", 6).alias("v"))


@query(
    "feature_unpivot",
    """WITH f AS (SELECT l_orderkey, min(l_quantity) AS v_min, max(l_quantity) AS v_max, avg(l_extendedprice) AS mean_area,
      count(*)::DOUBLE AS sax_count FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, feature, round(x, 6) AS value FROM f UNPIVOT (x FOR feature IN (v_min, v_max, mean_area, sax_count))""",
)
def feature_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named feature columns as one row per feature."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("v_min"), F.max("l_quantity").alias("v_max"), F.avg("l_extendedprice").alias("mean_area"),
        F.count("*").cast("double").alias("sax_count"))
    long = wide.unpivot("l_orderkey", ["v_min", "v_max", "mean_area", "sax_count"], "feature", "x")
    return long.select("l_orderkey", "feature", F.round("x", 6).alias("value"))
