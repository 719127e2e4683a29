"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.llm import (
    alignment, language_id, lexical, lines, mixing, nearest, packing, sharding, simhash_groups, spotsigs, substrings, toxicity, warc,
)
from cinestat.llm.common import documents

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.held_out()
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs, model, ["doc_id"]).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_char")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def _mix_sql(passes: int = 3) -> str:
    """The same mix in one engine: whole sorts in place of bins."""
    parts = [r"""
rows AS MATERIALIZED (
  SELECT doc_id, source, size,
    ((('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM rows GROUP BY source),
sorted AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / w::DOUBLE AS ratio,
    row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source ASC NULLS LAST) AS nth FROM weighed),
levels AS (
  SELECT s.*, ((SELECT sum(source_size) FROM sorted) - coalesce((SELECT sum(most) FROM sorted b WHERE b.nth < s.nth), 0))::DOUBLE
    / ((SELECT sum(w) FROM sorted) - coalesce((SELECT sum(w) FROM sorted b WHERE b.nth < s.nth), 0))::DOUBLE AS level FROM sorted s),
plan AS MATERIALIZED (
  SELECT source, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p, target - floor(rate) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
    FROM (SELECT *, least(most::DOUBLE, (SELECT level FROM levels WHERE level <= ratio ORDER BY nth LIMIT 1) * w) AS target FROM levels))),
pass0 AS MATERIALIZED (
  SELECT r.*, n.source_size, n.target, n.whole, n.p, n.rest, n.p > 0 AND r.size > 0 AS open, FALSE AS taken_by_chance,
    CASE WHEN n.p > 0 THEN ((u / (1 - u)) / (n.p / (1 - n.p))) / (1 + (u / (1 - u)) / (n.p / (1 - n.p))) ELSE 0.0 END AS rank
  FROM rows r JOIN plan n ON r.source IS NOT DISTINCT FROM n.source)"""]
    for k in range(passes):
        near = " OR (upto - size <= rest AND upto - rest < size - (upto - rest))" if k == passes - 1 else ""
        fits = "size <= rest - got" if k < passes - 2 else "size <= 2 * (rest - got)"
        parts.append(f"""
line{k} AS (SELECT *, CASE WHEN open THEN sum(CASE WHEN open THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) END AS upto FROM pass{k}),
took{k} AS (SELECT *, coalesce(open AND (upto <= rest{near}), FALSE) AS take FROM line{k}),
sums{k} AS (SELECT *, coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS got FROM took{k}),
pass{k + 1} AS MATERIALIZED (SELECT doc_id, source, size, u, source_size, target, whole, p, rank, rest - got AS rest,
    taken_by_chance OR take AS taken_by_chance, open AND NOT (taken_by_chance OR take) AND {fits} AS open FROM sums{k})""")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, size, source_size, target, ((whole + taken_by_chance::BIGINT) * size)::BIGINT AS taken FROM pass{passes}"""


@query("op8_mixing", _mix_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups.group(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir)).drop("key")


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.search(table, F.col("vec_id") % 20 == 0, k=20)


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(documents(spark, sf_dir)).select("doc_id", "text", "removed_lines", "removed_chars")


def _signatures_sql(text: str) -> str:
    listed, chosen = (", ".join(f"'{x}'" for x in xs) for xs in (spotsigs.ANCHORS, spotsigs.CHOSEN))
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    marked = f"list_transform({words}, lambda w: CASE WHEN w IN ({listed}) OR substr(md5(w), 1, 1) IN ({chosen}) THEN '|' || w ELSE w END)"
    chains = f"list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda x: rtrim(x, ' '))"
    return f"list_sort(list_distinct(list_transform(list_filter({chains}, lambda x: x <> ''), lambda x: substr(md5(x), 1, 8))))"


_SPOTSIGS_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS MATERIALIZED (SELECT *, substr(text, 1, (length(text) - length(text) // 2)) || substr(next, 1, (length(text) // 2)) AS edit FROM p),
s AS MATERIALIZED (SELECT doc_id, length(text) AS n_chars, sha256(edit) AS edited_sha256,
  {_signatures_sql('text')} AS own, {_signatures_sql('edit')} AS edit, {_signatures_sql('next')} AS next FROM e),
c AS (SELECT *, len(list_intersect(own, edit)) AS both_edit, len(list_intersect(own, next)) AS both_next FROM s)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(edit, '') AS edited_fingerprint,
  CASE WHEN greatest(len(own), len(edit)) = 0 THEN 1.0::DOUBLE ELSE both_edit::DOUBLE / (len(own) + len(edit) - both_edit) END AS near_edited,
  CASE WHEN greatest(len(own), len(next)) = 0 THEN 1.0::DOUBLE ELSE both_next::DOUBLE / (len(own) + len(next) - both_next) END AS near_next
FROM c"""


@query("op10_spotsigs", _SPOTSIGS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edit(documents(spark, sf_dir))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.held_out()
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return toxicity.score(docs, net, ["doc_id"]).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
    1 + CAST((('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM g"""


@query("op11_warc", _WARC_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.sound(warc.read(spark, folder, payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS_SQL = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_LEXICAL_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS_SQL}, []) AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
scored AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM tf JOIN q USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query("op12_lexical", _LEXICAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
