"""Distribution queries: encodings, averages, blends, scores and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cinestat.functions import cdf
from cinestat.operators import histograms, pixels, scoring
from cinestat.operators.keyed import attach_group
from cinestat.plans.registry import query, table
from cinestat.session import spread
from cinestat.sources import submission


def phi_sql(x: str, mu: str, sigma: str) -> str:
    """SQL text of the same Gaussian approximation."""
    z = f"(({x} - {mu}) / ({sigma} * 1.4142135623730951e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({z})))"
    poly = (
        f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t}"
        f" - 0.284496736e0) * {t} + 0.254829592e0)"
    )
    return f"(0.5e0 * (1e0 + sign({z}) * (1e0 - {poly} * {t} * exp(-({z} * {z})))))"


BINS_SQL = "(SELECT unnest(range(600)) AS bin)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count per study and day: the first, map-side combined aggregation."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.sum("value").alias("s"), F.count("value").alias("n")
    )


@query(
    "crps_by_study",
    f"""
    WITH daily AS (SELECT user_id, day(ts) AS d, avg(value) AS mu FROM events GROUP BY ALL),
    truth AS (SELECT user_id, avg(value) AS v FROM events GROUP BY ALL),
    m AS (SELECT user_id, bin, avg({phi_sql('bin', 'mu', '20e0')}) AS p
          FROM daily, {BINS_SQL} GROUP BY ALL),
    r AS (SELECT user_id, bin, max(p) OVER (PARTITION BY user_id ORDER BY bin
          ROWS UNBOUNDED PRECEDING) AS p FROM m)
    SELECT user_id, round(sum(pow(p - CASE WHEN v < bin THEN 1 ELSE 0 END, 2)) / 600, 6) AS crps
    FROM r JOIN truth USING (user_id) GROUP BY user_id
    """,
)
def crps_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("user_id")
    daily = spread(_daily(spark, sf_dir), "user_id")
    daily = daily.withColumn("v", F.sum("s").over(whole) / F.sum("n").over(whole))
    long = scoring.mean_cdf(daily, "user_id", F.col("s") / F.col("n"), 20.0, "v")
    scored = scoring.crps_by_key(scoring.monotone(long, "user_id"), "user_id", "v")
    return scored.select("user_id", F.round("crps", 6).alias("crps"))


@query(
    "cdf_running_max",
    """
    WITH px AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS bin
                FROM embeddings),
    scaled AS (SELECT vec_id, bin, v / max(v) OVER (PARTITION BY vec_id) AS p FROM px)
    SELECT vec_id, bin::INTEGER AS bin, round(max(p) OVER (PARTITION BY vec_id ORDER BY bin
           ROWS UNBOUNDED PRECEDING), 6) AS p FROM scaled
    """,
)
def cdf_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("px"))
    scaled = pixels.rescale_max(F.col("px"))
    return px.select("vec_id", F.posexplode(cdf.running_max(scaled)).alias("bin", "p")).select(
        "vec_id", "bin", F.round("p", 6).alias("p")
    )


@query(
    "empirical_cdf_closed",
    """
    WITH c AS (SELECT event_type, ceil(value) AS b, count(*) AS n FROM events GROUP BY ALL),
    t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY ALL)
    SELECT event_type, bin::INTEGER AS bin, round(coalesce(sum(n) FILTER (b <= bin), 0) / any_value(total), 6) AS p
    FROM t JOIN c USING (event_type), (SELECT unnest(range(600)) AS bin) GROUP BY event_type, bin
    """,
)
def empirical_cdf_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = histograms.empirical_cdf(table(spark, sf_dir, "events"), ["event_type"], "value")
    return long.select("event_type", "bin", F.round("p", 6).alias("p"))


@query(
    "step_cdf_conventions",
    f"""
    WITH lab AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN floor(max(value)) ELSE max(value) END AS v
                 FROM events GROUP BY user_id)
    SELECT user_id, bin::INTEGER AS bin,
           CASE WHEN v < bin THEN 1e0 ELSE 0e0 END AS strict_p,
           CASE WHEN v < bin THEN 1e0 WHEN v = bin THEN 0.5e0 ELSE 0e0 END AS half_p,
           CASE WHEN ceil(v) <= bin THEN 1e0 ELSE 0e0 END AS closed_p
    FROM lab, {BINS_SQL}
    """,
)
def step_cdf_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v"))
    label = F.when(F.col("user_id") % 2 == 0, F.floor("v").cast("double")).otherwise(F.col("v"))
    long = top.select("user_id", label.alias("v"), F.explode(cdf.bins()).alias("bin"))
    return long.select(
        "user_id", "bin",
        *[
            cdf.step_cdf(F.col("bin"), F.col("v"), c).alias(f"{c}_p")
            for c in ("strict", "half", "closed")
        ],
    )


@query(
    "label_encoding",
    """
    SELECT o_orderkey, list_sum(list_transform(range(600), lambda j: CASE WHEN o_totalprice / 1000 < j THEN 1 ELSE 0 END))::DOUBLE
             AS ones,
           split_part(o_orderpriority, '-', 1)::INTEGER AS cls,
           array_to_string(list_transform(range(6),
               lambda i: CASE WHEN i < split_part(o_orderpriority, '-', 1)::INTEGER THEN '1' ELSE '0' END), '') AS code,
           split_part(o_orderpriority, '-', 1)::INTEGER AS decoded
    FROM orders
    """,
)
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("cls")
    )
    coded = o.withColumn("bits", cdf.ordinal_encode(F.col("cls"), 6))
    step = cdf.step_array(F.col("o_totalprice") / F.lit(1000.0))
    return coded.select(
        "o_orderkey",
        F.aggregate(step, F.lit(0.0), lambda a, v: a + v).alias("ones"),
        "cls",
        F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("code"),
        cdf.ordinal_decode(F.col("bits")).alias("decoded"),
    )


SUBMISSIONS_SQL = """
    s AS (SELECT user_id, event_id % 2 AS src, value FROM events),
    k AS MATERIALIZED (SELECT user_id, src, count(*) AS n FROM s GROUP BY ALL),
    c AS MATERIALIZED (SELECT user_id, src, ceil(value) AS b, count(*) AS m FROM s GROUP BY ALL),
    g AS MATERIALIZED (SELECT user_id, src, bin, coalesce(sum(m) FILTER (b <= bin), 0) / any_value(n) AS p
          FROM k JOIN c USING (user_id, src), (SELECT unnest(range(600)) AS bin) GROUP BY user_id, src, bin),
    d AS (SELECT *, p - lag(p) OVER (PARTITION BY user_id, src ORDER BY bin) AS m, bin - 0.5e0 AS c FROM g),
    mom AS (SELECT user_id, src, sum(c * m) AS mu, sum(c * c * m) - sum(c * m) * sum(c * m) AS var
            FROM d WHERE bin > 0 GROUP BY ALL)
"""


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two empirical predictions per study, from even and odd measurements."""
    ev = table(spark, sf_dir, "events").withColumn("src", F.col("event_id") % 2)
    return histograms.empirical_cdf(ev, ["user_id", "src"], "value")


@query(
    "cdf_moments",
    f"WITH {SUBMISSIONS_SQL} SELECT user_id, src, round(mu, 5) AS mu, round(var, 4) AS var FROM mom",
)
def cdf_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = histograms.cdf_moments(_submissions(spark, sf_dir), ["user_id", "src"])
    return m.select("user_id", "src", F.round("mu", 5).alias("mu"), F.round("var", 4).alias("var"))


@query(
    "cdf_first_difference",
    f"""WITH {SUBMISSIONS_SQL}
    SELECT user_id, src, (bin - 1)::INTEGER AS bin, round(m, 6) AS mass FROM d WHERE bin > 0""",
)
def cdf_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = histograms.pmf(_submissions(spark, sf_dir), ["user_id", "src"])
    return d.select("user_id", "src", "bin", F.round("mass", 6).alias("mass"))


@query(
    "cdf_blend",
    f"""WITH {SUBMISSIONS_SQL},
    b AS (SELECT x.user_id, (x.mu + y.mu) / 2 AS mu, sqrt((x.var + y.var) / 4) AS sd
          FROM mom x JOIN mom y ON x.user_id = y.user_id AND x.src = 0 AND y.src = 1)
    SELECT user_id, bin::INTEGER AS bin, round({phi_sql('bin', 'mu', 'sd')}, 5) AS p
    FROM b, {BINS_SQL} WHERE sd > 0""",
)
def cdf_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = histograms.cdf_moments(_submissions(spark, sf_dir), ["user_id", "src"])

    def side(src: int, c: str):
        return F.max(F.when(F.col("src") == src, F.col(c)))

    both = m.groupBy("user_id").agg(
        ((side(0, "mu") + side(1, "mu")) / 2).alias("mu"),
        F.sqrt((side(0, "var") + side(1, "var")) / 4).alias("sd"),
    ).where(F.col("sd") > 0)
    long = both.select("*", F.explode(cdf.bins()).alias("bin"))
    return long.select(
        "user_id", "bin", F.round(cdf.norm_cdf(F.col("bin"), F.col("mu"), F.col("sd")), 5).alias("p")
    )


@query(
    "harmonic_blend",
    f"""WITH {SUBMISSIONS_SQL}
    SELECT user_id, bin::INTEGER AS bin, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS p
    FROM (SELECT user_id, bin, max(p) FILTER (src = 0) AS a, max(p) FILTER (src = 1) AS b FROM g GROUP BY ALL)
    WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def harmonic_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _submissions(spark, sf_dir)
    both = long.groupBy("user_id", "bin").agg(
        F.max(F.when(F.col("src") == 0, F.col("p"))).alias("a"),
        F.max(F.when(F.col("src") == 1, F.col("p"))).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.select("user_id", "bin", F.round(cdf.harmonic_mean(F.col("a"), F.col("b")), 6).alias("p"))


SIGMA_GRID_SQL = f"""
    pairs AS (SELECT user_id, avg(value) FILTER (day(ts) % 2 = 1) AS mu,
                     avg(value) FILTER (day(ts) % 2 = 0) AS v FROM events GROUP BY user_id),
    ok AS (SELECT * FROM pairs WHERE mu IS NOT NULL AND v IS NOT NULL),
    grid AS (SELECT 1.5e0 + 0.5e0 * i AS sigma FROM (SELECT unnest(range(57)) AS i)),
    sc AS (SELECT sigma, sum(pow({phi_sql('bin', 'mu', 'sigma')} - {phi_sql('bin', 'v', '0.01e0')}, 2))
                  / (600 * (SELECT count(*) FROM ok)) AS crps
           FROM ok, grid, {BINS_SQL} GROUP BY sigma),
    st AS (SELECT *, coalesce(lag(crps, 2) OVER w <= lag(crps) OVER w AND lag(crps) OVER w <= crps
                  AND row_number() OVER w > 3, false) AS stop FROM sc WINDOW w AS (ORDER BY sigma)),
    ev AS (SELECT *, NOT coalesce(bool_or(stop) OVER (ORDER BY sigma ROWS BETWEEN UNBOUNDED PRECEDING
                  AND 1 PRECEDING), false) AS evaluated FROM st)
"""


@query(
    "sigma_search",
    f"""WITH {SIGMA_GRID_SQL}
    SELECT sigma, round(crps, 6) AS crps, evaluated,
           sigma = (SELECT sigma FROM ev WHERE evaluated ORDER BY crps, sigma LIMIT 1) AS best FROM ev""",
)
def sigma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.dayofmonth("ts") % 2 == 1
    pairs = (
        table(spark, sf_dir, "events").groupBy("user_id")
        .agg(F.avg(F.when(odd, F.col("value"))).alias("mu"), F.avg(F.when(~odd, F.col("value"))).alias("v"))
        .where(F.col("mu").isNotNull() & F.col("v").isNotNull())
    )
    found = scoring.sigma_search(pairs, "mu", "v")
    return found.select("sigma", F.round("crps", 6).alias("crps"), "evaluated", "best")


@query(
    "gaussian_submission",
    f"""WITH v AS (SELECT user_id, event_id % 2 AS ph, avg(value) AS v FROM events GROUP BY ALL)
    SELECT user_id || CASE ph WHEN 0 THEN '_Systole' ELSE '_Diastole' END AS id, bin::INTEGER AS bin,
           round({phi_sql('bin', 'v', '13.5e0')}, 6) AS p FROM v, {BINS_SQL}""",
)
def gaussian_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("study"), (F.col("event_id") % 2).alias("is_diastole")
    ).agg(F.avg("value").alias("volume"))
    rows = submission.gaussian_rows(spread(v, "study"), 13.5)
    return rows.select("id", F.posexplode("p").alias("bin", "p")).select("id", "bin", F.round("p", 6).alias("p"))


@query(
    "weighted_kappa",
    """
    WITH p AS (SELECT quality AS i, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS j
               FROM labels JOIN documents USING (doc_id)),
    n AS (SELECT count(*) AS n FROM p),
    o AS (SELECT sum(pow(i - j, 2)) / (SELECT n FROM n) AS v FROM p),
    a AS (SELECT i, count(*) / (SELECT n FROM n) AS f FROM p GROUP BY i),
    b AS (SELECT j, count(*) / (SELECT n FROM n) AS f FROM p GROUP BY j),
    e AS (SELECT sum(pow(i - j, 2) * a.f * b.f) AS v FROM a, b)
    SELECT n.n, round(1 - o.v / e.v, 6) AS kappa FROM n, o, e
    """,
)
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scoring.weighted_kappa(_ratings(spark, sf_dir), "quality", "rule")
    return k.select("n", F.round("kappa", 6).alias("kappa"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("rule")
    )
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query(
    "confusion_matrix",
    """
    WITH p AS (SELECT quality AS rating, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS predicted
               FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT rating, predicted, count(*) AS n FROM p GROUP BY ALL)
    SELECT rating, predicted, n, round((sum(n) OVER (PARTITION BY rating))::DOUBLE
           * sum(n) OVER (PARTITION BY predicted) / sum(n) OVER (), 6) AS expected FROM c
    """,
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scoring.confusion(_ratings(spark, sf_dir), "quality", "rule")
    return c.withColumn("expected", F.round("expected", 6))


ERRORS_SQL = """
    m AS (SELECT user_id, avg(value) AS pred FROM events GROUP BY user_id),
    e AS (SELECT event_id, user_id, value, abs(pred - value) AS err FROM events JOIN m USING (user_id))
"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute error of the per-study mean against every measurement."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    means = ev.groupBy("user_id").agg(F.avg("value").alias("pred"), F.count("*").alias("rows_in_key"))
    joined = attach_group(ev, means, ["user_id"], "rows_in_key")
    return joined.select("event_id", "user_id", "value", F.abs(F.col("pred") - F.col("value")).alias("err"))


@query(
    "band_error_std",
    f"""WITH {ERRORS_SQL}
    SELECT floor(value / 100)::INTEGER AS band, count(*) AS n, round(stddev_pop(err), 6) AS error_std
    FROM e WHERE value > 0 AND value < 500 AND value % 100 != 0 GROUP BY band""",
)
def band_error_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = scoring.band_spread(_errors(spark, sf_dir), "value", "err")
    return b.withColumn("error_std", F.round("error_std", 6))


@query(
    "bad_subjects",
    f"""WITH {ERRORS_SQL}
    SELECT event_id, user_id, round(err, 6) AS err FROM e WHERE err > 50 ORDER BY user_id, event_id""",
)
def bad_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _errors(spark, sf_dir).where(F.col("err") > 50)
    return e.select("event_id", "user_id", F.round("err", 6).alias("err")).orderBy("user_id", "event_id")
