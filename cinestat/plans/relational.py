"""Keyed joins, filters, de-duplication, splits and cyclic sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions import paths
from cinestat.operators import histograms, keyed, ranking, ring
from cinestat.models import training
from cinestat.plans.registry import query, table
from cinestat.sources.submission import fill_template


@query(
    "latest_per_key",
    """
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    WHERE rn = 1
    """,
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]
    o = table(spark, sf_dir, "orders").select(*cols)
    # The first of equal dates wins, hence the negated tie-break.
    return keyed.latest_per_key(
        o, [F.col("o_custkey").alias("k")], [F.col("o_orderdate"), -F.col("o_orderkey")], cols
    )


@query(
    "modal_filter",
    """
    WITH v AS (SELECT *, trunc(l_quantity)::INTEGER AS angle FROM lineitem),
    c AS (SELECT l_suppkey, angle, count(*) AS n FROM v GROUP BY ALL),
    m AS (SELECT l_suppkey, angle FROM (SELECT *, row_number() OVER
          (PARTITION BY l_suppkey ORDER BY n DESC, angle) AS rn FROM c) WHERE rn = 1)
    SELECT v.l_orderkey, v.l_linenumber, v.l_suppkey, m.angle AS modal FROM v JOIN m
    ON v.l_suppkey = m.l_suppkey AND v.angle = m.angle
    """,
)
def modal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    kept = keyed.modal_rows(li, ["l_suppkey"], F.col("l_quantity").cast("int"))
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "modal")


@query(
    "complete_ring_filter",
    """
    SELECT user_id FROM events GROUP BY user_id
    HAVING count(DISTINCT day(ts)) FILTER (day(ts) BETWEEN 1 AND 30) = 30
    """,
)
def complete_ring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return keyed.complete_keys(ev, ["user_id"], F.dayofmonth("ts"), 30)


@query(
    "sequence_size_filter",
    """
    SELECT user_id, day(ts)::INTEGER AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) BETWEEN 1 AND 2
    """,
)
def sequence_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"))
    return keyed.sized_keys(ev, ["user_id", "day"], 1, 2)


@query(
    "value_frequency",
    "SELECT trunc(l_extendedprice / 100)::INTEGER AS v, count(*) AS n FROM lineitem GROUP BY v",
)
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_extendedprice") / 100).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(v.alias("v")).agg(F.count("*").alias("n"))


@query(
    "label_join_fallback",
    """
    WITH h AS (SELECT user_id AS c_custkey, avg(value) AS mu, count(*)::BIGINT AS n FROM events GROUP BY user_id),
    d AS (SELECT avg(value) AS mu, count(*)::BIGINT AS n FROM events)
    SELECT c.c_custkey, h.mu IS NULL AS missed, round(coalesce(h.mu, d.mu), 6) AS mu, coalesce(h.n, d.n) AS n
    FROM d, customer c LEFT JOIN h USING (c_custkey)
    """,
)
def label_join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    stats = [F.avg("value").alias("mu"), F.count("*").alias("n")]
    known = ev.groupBy(F.col("user_id").alias("c_custkey")).agg(*stats)
    left = table(spark, sf_dir, "customer").select("c_custkey")
    out = keyed.with_fallback(left, known, "c_custkey", ["mu", "n"], ev.agg(*stats))
    return out.withColumn("mu", F.round("mu", 6))


@query(
    "missing_ids",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return keyed.missing_keys(table(spark, sf_dir, "customer").select("c_custkey"), users, "c_custkey")


@query(
    "annotated_only",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def annotated_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "submission_rows",
    """
    WITH t AS (SELECT c_custkey AS study, target FROM customer, (VALUES ('Diastole'), ('Systole')) v(target)),
    c AS (SELECT user_id AS study, CASE WHEN event_id % 2 = 0 THEN 'Diastole' ELSE 'Systole' END AS target,
                 ceil(value) AS b FROM events),
    n AS (SELECT study, target, count(*) AS n FROM c GROUP BY ALL),
    a AS (SELECT target, count(*) AS n FROM c GROUP BY ALL),
    bins AS (SELECT unnest(range(600)) AS bin),
    own AS (SELECT study, target, sum(q) AS total, sum(q * bin) AS weighted FROM (
        SELECT n.study, n.target, bin, count(*) FILTER (b <= bin) / any_value(n) AS q
        FROM n JOIN c USING (study, target), bins GROUP BY ALL) GROUP BY ALL),
    fb AS (SELECT target, sum(q) AS total, sum(q * bin) AS weighted FROM (
        SELECT a.target, bin, count(*) FILTER (b <= bin) / any_value(n) AS q
        FROM a JOIN c USING (target), bins GROUP BY ALL) GROUP BY ALL)
    SELECT t.study || '_' || t.target AS id, own.total IS NULL AS missed,
           round(coalesce(own.total, fb.total), 6) AS total, round(coalesce(own.weighted, fb.weighted), 4) AS weighted
    FROM t JOIN fb USING (target) LEFT JOIN own USING (study, target)
    """,
)
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.explode(F.array(F.lit("Diastole"), F.lit("Systole")))
    template = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), targets.alias("target"))
    target = F.when(F.col("event_id") % 2 == 0, "Diastole").otherwise("Systole")
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("study"), target.alias("target"), "value")
    own = histograms.empirical_cdf_arrays(ev, ["study", "target"], "value")
    fallback = histograms.empirical_cdf_arrays(ev, ["target"], "value")
    rows = fill_template(template, own, fallback)
    total = F.aggregate("p", F.lit(0.0), lambda s, q: s + q)
    weighted = F.aggregate(F.transform("p", lambda q, j: q * j), F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", "missed", F.round(total, 6).alias("total"), F.round(weighted, 4).alias("weighted"))


@query(
    "schedule_lookup",
    """
    WITH s(start, rate) AS (VALUES (1, 0.1e0), (10, 0.01e0), (20, 0.001e0)),
    e AS (SELECT event_id, day(ts)::INTEGER AS epoch FROM events)
    SELECT event_id, epoch, (SELECT max_by(rate, start) FROM s WHERE start <= epoch) AS rate FROM e
    """,
)
def schedule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").alias("epoch"))
    return keyed.step_lookup(ev, "epoch", {1: 0.1, 10: 0.01, 20: 0.001}, "rate")


@query(
    "group_kfold",
    """
    WITH k AS (SELECT user_id, ((row_number() OVER (ORDER BY user_id) - 1) % 10)::INTEGER AS fold
               FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_id, user_id, fold FROM events JOIN k USING (user_id)
    """,
)
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ranking.group_folds(ev, "user_id", 10).select("event_id", "user_id", "fold")


@query(
    "group_split",
    """
    WITH k AS (SELECT user_id, row_number() OVER (ORDER BY md5('10:' || user_id), user_id) AS rn,
                      count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_id, user_id, rn <= floor(n / 6) AS is_test FROM events JOIN k USING (user_id)
    """,
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ranking.group_split(ev, "user_id", 1 / 6, 10).select("event_id", "user_id", "is_test")


@query(
    "hash_splits",
    """
    SELECT o_orderkey, substr(md5('1:' || o_orderkey), 1, 8) < '26666666' AS holdout,
           substr(md5('2:' || o_custkey), 1, 8) < '19999999' AS validation,
           substr(md5('3:' || o_orderkey), 1, 8) < '33333333' AS stack_test FROM orders
    """,
)
def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ranking.seeded_below(1, 0.15, "o_orderkey").alias("holdout"),
        ranking.seeded_below(2, 0.10, "o_custkey").alias("validation"),
        ranking.seeded_below(3, 0.20, "o_orderkey").alias("stack_test"),
    )


@query(
    "shuffled_minibatches",
    """
    WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn,
                      count(*) OVER () AS n FROM events)
    SELECT event_id, value, rn, ((rn - 1) // 64)::BIGINT AS batch FROM r WHERE (rn - 1) // 64 < ceil(n / 64) - 1
    """,
)
def shuffled_minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return ranking.minibatches(ev, 42, "event_id", 64)


@query(
    "error_ranking",
    """
    WITH m AS (SELECT avg(value) AS mu FROM events)
    SELECT event_id, round(abs(value - mu), 6) AS err,
           row_number() OVER (ORDER BY round(abs(value - mu), 6) DESC, event_id) AS rn FROM events, m
    """,
)
def error_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    mu = ev.agg(F.avg("value").alias("mu")).scalar()
    err = ev.select("event_id", F.round(F.abs(F.col("value") - mu), 6).alias("err"))
    ranked = ranking.global_row_number(err.withColumn("down", -F.col("err")), ["down", "event_id"])
    return ranked.select("event_id", "err", "rn")


DAILY_SQL = """
    d AS (SELECT user_id, day(ts)::INTEGER AS day, avg(value) AS v FROM events GROUP BY ALL)
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per study and ring frame: at most 31 rows per study."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.avg("value").alias("v")
    )


@query(
    "ring_neighbours",
    f"""WITH {DAILY_SQL}
    SELECT d.user_id, d.day, round(d.v, 6) AS v, round(p.v, 6) AS prev, round(n.v, 6) AS next FROM d
    LEFT JOIN d p ON p.user_id = d.user_id AND p.day = CASE WHEN d.day = 1 THEN 30 ELSE d.day - 1 END
    LEFT JOIN d n ON n.user_id = d.user_id AND n.day = CASE WHEN d.day = 30 THEN 1 ELSE d.day + 1 END""",
)
def ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ring.triplets(daily(spark, sf_dir), ["user_id"], "day", "v", 30)
    return t.select("user_id", "day", *[F.round(c, 6).alias(c) for c in ("v", "prev", "next")])


@query(
    "ring_differences",
    f"""WITH {DAILY_SQL}
    SELECT user_id, day,
      round(v - coalesce(lag(v) OVER w, last_value(v) OVER f), 6) AS diff,
      coalesce(lead(v) OVER w, first_value(v) OVER f) > v AS rises
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day),
      f AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def ring_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select(
        "user_id", "day",
        F.round(F.col("v") - ring.previous("v", ["user_id"], "day"), 6).alias("diff"),
        (ring.following("v", ["user_id"], "day") > F.col("v")).alias("rises"),
    )


@query(
    "ring_pad_30",
    f"""WITH {DAILY_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i,
                 count(*) OVER (PARTITION BY user_id) AS n FROM d),
    p AS (SELECT unnest(range(30)) AS pos)
    SELECT user_id, pos::INTEGER AS pos, day, round(v, 6) AS v FROM r JOIN p ON p.pos % n = i""",
)
def ring_pad_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ring.pad_cycle(daily(spark, sf_dir), ["user_id"], "day", 30)
    return p.select("user_id", "pos", "day", F.round("v", 6).alias("v"))


@query(
    "leading_pad_15",
    f"""WITH {DAILY_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i,
                 count(*) OVER (PARTITION BY user_id) AS n FROM d),
    p AS (SELECT unnest(range(15)) AS pos)
    SELECT user_id, pos::INTEGER AS pos, day, round(v, 6) AS v FROM r JOIN p ON p.pos % n = i""",
)
def leading_pad_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ring.pad_cycle(daily(spark, sf_dir), ["user_id"], "day", 15)
    return p.select("user_id", "pos", "day", F.round("v", 6).alias("v"))


@query(
    "ring_outliers",
    f"""WITH RECURSIVE {DAILY_SQL},
    l AS (SELECT user_id, list(day ORDER BY day) AS days, list(v ORDER BY day) AS vs, count(*)::INTEGER AS n
          FROM d GROUP BY user_id),
    j AS (SELECT user_id, days, vs, n, list_transform(range(1, n + 1),
             lambda i: abs(vs[i] - vs[CASE WHEN i = 1 THEN n ELSE i - 1 END])) AS a FROM l),
    s AS (SELECT user_id, 0 AS i, 0 AS mode, 0e0 AS start, false AS bad FROM j
      UNION ALL
      SELECT user_id, i + 1,
        CASE WHEN mode = 0 THEN CASE WHEN opens THEN 1 ELSE 0 END WHEN mode = 1 THEN 2
             WHEN goes_on THEN 2 ELSE 0 END,
        CASE WHEN mode = 0 AND opens THEN here ELSE start END,
        mode = 1 OR (mode = 2 AND goes_on)
      FROM (SELECT s.user_id, i, mode, start, vs[i + 1] AS here,
          a[(i + 1) % n + 1] > 5 * a[i + 1]
            AND (vs[(i + 1) % n + 1] > 1.15e0 * vs[i + 1] OR vs[i + 1] > 1.15e0 * vs[(i + 1) % n + 1])
            AND a[(i + 1) % n + 1] > 2.5e0 AND i < n - 1 AS opens,
          a[i + 1] - a[(i + 1) % n + 1] < 2 OR coalesce(vs[i + 1] / nullif(start, 0), 0) > 3 AS goes_on
        FROM s JOIN j ON s.user_id = j.user_id WHERE i < n))
    SELECT s.user_id, days[i]::INTEGER AS day, bad, round(CASE WHEN bad THEN list_sort(vs)[n // 2 + 1] ELSE vs[i] END, 6)
           AS filtered
    FROM s JOIN j USING (user_id) WHERE i > 0""",
)
def ring_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ring.replace_outliers(daily(spark, sf_dir), ["user_id"], "day", "v")
    return r.select("user_id", "day", "bad", F.round("filtered", 6).alias("filtered"))


@query(
    "rolling_median",
    f"""WITH {DAILY_SQL},
    l AS (SELECT user_id, list(day ORDER BY day) AS days, list(v ORDER BY day) AS vs, count(*) AS n
          FROM d GROUP BY user_id)
    SELECT user_id, unnest(days) AS day, round(unnest(list_transform(range(n),
      lambda i: list_sort(list_transform(range(-2, 3), lambda k: vs[(i + k + n) % n + 1]))[3])), 6) AS smooth FROM l""",
)
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ring.rolling_median(daily(spark, sf_dir), ["user_id"], "day", "v")
    return m.select("user_id", "day", F.round("smooth", 6).alias("smooth"))


@query(
    "frame_totals",
    f"""WITH {DAILY_SQL}, t AS (SELECT day, sum(v) AS total FROM d GROUP BY day)
    SELECT day, round(total, 8) AS total,
      round(0.25e0 * coalesce(lag(total) OVER w, lead(total) OVER w) + 0.5e0 * total
          + 0.25e0 * coalesce(lead(total) OVER w, lag(total) OVER w), 8) AS smooth
    FROM t WINDOW w AS (ORDER BY day)""",
)
def frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ring.smoothed_totals(daily(spark, sf_dir), "day", "v")
    return t.select("day", F.round("total", 8).alias("total"), F.round("smooth", 8).alias("smooth"))


@query(
    "smoothed_volume_grid",
    """WITH d AS (SELECT event_type, user_id AS seq, day(ts)::INTEGER AS day, avg(value) AS v FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type, seq ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type, seq) AS n FROM d),
    m AS (SELECT a.event_type, a.seq, a.day, a.i, a.n, list_sort(list(b.v))[3] AS v FROM n a
      CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(k) JOIN n b ON b.event_type = a.event_type AND b.seq = a.seq AND b.i = (a.i + o.k + 5 * a.n) % a.n
      GROUP BY a.event_type, a.seq, a.day, a.i, a.n),
    c AS (SELECT a.event_type, a.seq, a.day, a.v, 0.25e0 * p.v + 0.5e0 * a.v + 0.25e0 * q.v AS c FROM m a
      JOIN m p ON p.event_type = a.event_type AND p.seq = a.seq AND p.i = (a.i + a.n - 1) % a.n
      JOIN m q ON q.event_type = a.event_type AND q.seq = a.seq AND q.i = (a.i + 1) % a.n),
    s AS (SELECT *, 0.25e0 * coalesce(lag(c) OVER w, lead(c) OVER w, c) + 0.5e0 * c + 0.25e0 * coalesce(lead(c) OVER w, lag(c) OVER w, c) AS s
      FROM c WINDOW w AS (PARTITION BY event_type, day ORDER BY seq))
    SELECT event_type, day, count(*) AS rows, round(sum(v), 6) AS total, round(sum(s), 6) AS smooth FROM s GROUP BY event_type, day""",
)
def smoothed_volume_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running medians of every series, smoothed along days and across series, summed by day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("seq"), F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("v"))
    medians = ring.rolling_median(days, ["event_type", "seq"], "day", "v").withColumnRenamed("smooth", "v")
    grid = ring.smoothed_grid(medians, ["event_type"], "seq", "day", "v", "s")
    sums = grid.groupBy("event_type", "day").agg(F.count("*").alias("rows"), F.sum("v").alias("total"), F.sum("s").alias("smooth"))
    return sums.select("event_type", "day", "rows", F.round("total", 6).alias("total"), F.round("smooth", 6).alias("smooth"))


@query(
    "area_pivot",
    "WITH " + DAILY_SQL + " SELECT user_id, "
    + ", ".join(f"round(max(v) FILTER (day = {i}), 6) AS f{i}" for i in range(1, 31))
    + " FROM d GROUP BY user_id",
)
def area_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = daily(spark, sf_dir).groupBy("user_id").pivot("day", list(range(1, 31))).agg(F.first("v"))
    return wide.select("user_id", *[F.round(F.col(f"`{i}`"), 6).alias(f"f{i}") for i in range(1, 31)])


@query(
    "best_so_far",
    """
    WITH m AS (SELECT event_type, day(ts)::INTEGER AS epoch, stddev_pop(value) AS loss FROM events GROUP BY ALL)
    SELECT event_type, epoch, round(loss, 6) AS loss, round(min(loss) OVER w, 6) AS best,
           loss <= min(loss) OVER w AS saved FROM m
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch ROWS UNBOUNDED PRECEDING)
    """,
)
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("epoch")).agg(
        F.stddev_pop("value").alias("loss")
    )
    out = training.best_so_far(m, ["event_type"], "epoch", "loss")
    return out.select("event_type", "epoch", F.round("loss", 6).alias("loss"), F.round("best", 6).alias("best"), "saved")


PATHS_SQL = """
    f AS (SELECT 'data\\train\\' || (CASE WHEN l_partkey % 97 = 0 THEN 'x' ELSE '' END) || l_suppkey || '/study/'
      || (CASE l_linenumber % 3 WHEN 0 THEN 'sax_' WHEN 1 THEN '2ch_' ELSE '4ch_' END) || l_linenumber
      || '/IM-' || lpad((l_orderkey % 10000)::VARCHAR, 4, '0') || '-' || lpad(day(l_shipdate)::VARCHAR, 4, '0')
      || (CASE WHEN l_quantity > 25 THEN '-0001' ELSE '' END) || '.dcm' AS raw, l_orderkey, l_partkey, l_linenumber
      FROM lineitem)
"""


def frame_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame paths in the layout of an image archive, derived from line items."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "sax_").when(F.col("l_linenumber") % 3 == 1, "2ch_").otherwise("4ch_")
    raw = F.concat(
        F.lit("data\\train\\"), F.when(F.col("l_partkey") % 97 == 0, "x").otherwise(""),
        F.col("l_suppkey").cast("string"), F.lit("/study/"), kind, F.col("l_linenumber").cast("string"),
        F.lit("/IM-"), F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0"),
        F.lit("-"), F.lpad(F.dayofmonth("l_shipdate").cast("string"), 4, "0"),
        F.when(F.col("l_quantity") > 25, "-0001").otherwise(""), F.lit(".dcm"),
    )
    return li.select(raw.alias("raw"), "l_orderkey", "l_partkey", "l_linenumber")


@query(
    "frame_from_path",
    f"""WITH {PATHS_SQL}, p AS (SELECT *, replace(raw, '\\', '/') AS path FROM f)
    SELECT l_orderkey, l_partkey, l_linenumber, split_part(parse_filename(path), '-', 3)[1:4]::INTEGER AS frame,
      coalesce(try_cast(split_part(path, '/', 3) AS INTEGER), -1) AS patient,
      split_part(split_part(path, '/', 5), '_', 1) AS seq_type,
      split_part(split_part(path, '/', 5), '_', 2)::INTEGER AS seq_number,
      replace(path, '.dcm', '_norm.dcm') AS renamed, substr(path, 12) AS relative,
      contains(path, 'sax') AND ends_with(path, '.dcm') AS is_sax
    FROM p""",
)
def frame_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    folder = paths.directory(path)
    return frame_paths(spark, sf_dir).withColumn("path", paths.slashes(F.col("raw"))).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        paths.frame_number(path).alias("frame"),
        paths.patient_id(path).alias("patient"),
        paths.sequence_type(folder).alias("seq_type"),
        paths.sequence_number(folder).alias("seq_number"),
        paths.add_suffix(path, "norm").alias("renamed"),
        paths.strip_prefix(path, F.lit("data/train")).alias("relative"),
        (path.contains("sax") & F.endswith(path, F.lit(".dcm"))).alias("is_sax"),
    )


@query(
    "relabel_directories",
    f"""WITH {PATHS_SQL}, p AS (SELECT l_orderkey, l_partkey, l_linenumber, replace(raw, '\\', '/') AS path FROM f
        WHERE contains(raw, 'sax')),
    g AS (SELECT *, split_part(path, '/IM-', 1) AS dir, split_part(replace(path, '.dcm', ''), '/IM-', 2) AS name FROM p),
    c AS (SELECT dir, count(*) AS n FROM g GROUP BY dir)
    SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN n >= 31 THEN dir || split_part(name, '-', 3)[3:4] ELSE dir END
      || '/IM-' || name || '.dcm' AS target FROM g JOIN c USING (dir)""",
)
def relabel_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_paths(spark, sf_dir).where(F.col("raw").contains("sax"))
    p = p.withColumn("path", paths.slashes(F.col("raw"))).withColumn("dir", paths.directory(F.col("path")))
    sizes = p.groupBy("dir").agg(F.count("*").alias("rows_in_key"), F.count("*").alias("n"))
    sized = keyed.attach_group(p.drop("raw"), sizes, ["dir"], "rows_in_key")
    part = F.coalesce(F.get(F.split(paths.stem(F.col("path")), "-"), 3), F.lit(""))
    folder = F.when(F.col("n") >= 31, F.concat("dir", F.substring(part, 3, 2))).otherwise(F.col("dir"))
    return sized.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.concat(folder, F.lit("/"), paths.basename(F.col("path"))).alias("target"),
    )


@query(
    "page_paths",
    """
    SELECT page_id, string_split_regex(url, '[-/?&=]')[3] AS host, length(url) - length(replace(url, '/', '')) AS depth,
           string_split_regex(url, '[-/?&=]')[-1] AS tail FROM pages
    """,
)
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = paths.split_any(F.col("url"), "-/?&=")
    slashes = F.length("url").cast("bigint") - F.length(F.replace("url", F.lit("/"), F.lit("")))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.get(parts, 2).alias("host"), slashes.cast("bigint").alias("depth"), F.element_at(parts, -1).alias("tail")
    )


@query(
    "last_annotation_wins",
    """
    SELECT key, page_id AS line, n FROM (
      SELECT split_part(url, '?', 1) AS key, page_id, length(html) AS n,
        row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1
    """,
)
def last_annotation_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(
        F.split_part("url", F.lit("?"), F.lit(1)).alias("key"), F.col("page_id").alias("line"),
        F.length("html").cast("bigint").alias("n"),
    )
    return keyed.latest_per_key(p, [F.col("key").alias("k")], [F.col("line")], ["key", "line", "n"])
