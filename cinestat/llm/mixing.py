"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share all words by weight.  A source's target stops at ``cap`` times its words; what
it cannot take is shared again by weight among the others.  That fixed point is
``min(cap_i, level * weight_i)`` with one common level, found from the sources sorted by
``cap_i / weight_i``.

A document's expected copies are ``target / source words``.  Their whole part is certain.
The rest is drawn by Pareto order sampling: with inclusion probability ``p`` and a uniform
``u`` a document ranks by ``(u / (1 - u)) / (p / (1 - p))``, and documents are taken in that
order until the source's missing words are reached; the document across the line is taken if
that ends nearer.  What then is still missing is filled in the same order with documents that
fit wholly (``passes`` rounds), so a small source does not miss by a long document.

The line is found without sorting a source in one task: ranks fall into ``bins`` per source,
words are summed by bin, and only the bin across the line is ordered by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.llm.common import WORD, row_key
from cinestat.session import kept

WEIGHTS = (5, 2, 1)
_BINS = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) that depends on the columns alone; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``whole`` (certain copies), ``rest`` (missing words).

    One row per source; the windows below run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    lower = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("at", F.row_number().over(by_ratio)).withColumn("total", F.sum("source_size").over(every)).withColumn("open", F.sum("w").over(every))
        .withColumn("below", F.coalesce(F.sum("most").over(lower), F.lit(0)))
        .withColumn("closed", F.coalesce(F.sum("w").over(lower), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("below")) / (F.col("open") - F.col("closed")))
    )
    # The first source that the level does not fill decides it for itself and all after it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(every).getField("level")
    s = s.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return s.withColumn("whole", F.floor(rate)).select(
        "source", "source_size", "target", "whole", (rate - F.floor(rate)).alias("p"),
        (F.col("target") - F.floor(rate) * F.col("source_size")).alias("rest"),
    )


def _filled(rows: DataFrame, last: bool) -> DataFrame:
    """Marks rows (``group``, ``size``, ``rank`` in [0, 1), ``id``, ``rest``, ``open``) in rank order while they fit."""
    rows = rows.withColumn("bin", F.floor(F.col("rank") * _BINS))
    up = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # Written first: else each task's own sums of a source would all meet where its bins are added up.
    bins = kept(rows.where("open").groupBy(F.col("group").alias("g"), F.col("bin").alias("b")).agg(F.sum("size").alias("in_bin")))
    # Written again: else the rows would be dealt by source alone, as the window deals the bins.
    bins = kept(bins.withColumn("under", F.coalesce(F.sum("in_bin").over(up), F.lit(0))))
    rows = rows.join(bins, (F.col("group") == F.col("g")) & (F.col("bin") == F.col("b")), "left").drop("g", "b")
    sure = F.col("open") & (F.col("under") + F.col("in_bin") <= F.col("rest"))
    across = F.col("open") & ~sure & (F.col("under") <= F.col("rest"))
    # Only the bin across the line is numbered row by row.
    inside = Window.partitionBy("group", "bin").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.where(across).withColumn("upto", F.col("under") + F.sum("size").over(inside))
    fits = F.col("upto") <= F.col("rest")
    if last:
        over = F.col("upto") - F.col("rest")
        fits = fits | ((F.col("upto") - F.col("size") <= F.col("rest")) & (over < F.col("size") - over))
    line = line.withColumn("take", fits).drop("upto")
    done = rows.where(~F.coalesce(across, F.lit(False))).withColumn("take", F.coalesce(sure, F.lit(False)))
    return done.unionByName(line).drop("bin", "in_bin", "under")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 8, passes: int = 3,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken`` of every row.

    Null source is a source of its own, sorted last; a null or empty text has size 0 and is
    never copied by chance.  Repeated rows get the same rank and are told apart by order
    only: which of them is taken cannot be seen.  An empty table gives an empty result.
    """
    rows = kept(docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), words(text).alias("size"),
    ).withColumn("u", uniform(seed, "id")))
    plan = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    # Named by a number: sources may be null.
    plan = kept(plan.withColumn("group", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    named = plan.withColumnRenamed("source", "of")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    now = rows.join(named, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn(
        "rank", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(0.0)
    ).withColumn("taken_by_chance", F.lit(False)).withColumn("open", (F.col("p") > 0) & (F.col("size") > 0))
    missing = F.col("rest")
    for k in range(passes):
        now = kept(_filled(now, last=k == passes - 1))
        now = now.withColumn("taken_by_chance", F.col("taken_by_chance") | F.col("take"))
        if k < passes - 1:
            # Written first, so that Spark knows it to be small and does not deal the rows by source to join it.
            got = kept(now.where("take").groupBy(F.col("group").alias("g")).agg(F.sum("size").alias("got")))
            now = now.join(got, F.col("group") == F.col("g"), "left").withColumn(
                "rest", missing - F.coalesce("got", F.lit(0))).drop("g", "got")
            now = now.withColumn("open", F.col("open") & ~F.col("taken_by_chance") & (
                (F.col("size") <= F.col("rest")) if k < passes - 2 else (F.col("size") <= 2 * F.col("rest")))).drop("take")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.col("taken_by_chance").cast("long")
    return now.select(
        F.col("id").alias("doc_id"), "size", "source", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """Every row of ``docs`` as often as :func:`mix` takes it."""
    keyed = docs.withColumn("__key", row_key(docs))
    # Rows with one key are equal, so their copies are added up and drawn from one of them.
    copies = mix(keyed, doc_id="__key", source=source, text=text, **how).groupBy("doc_id").agg(F.sum("copies").alias("__n"))
    taken = keyed.join(copies.where("__n > 0").withColumnRenamed("doc_id", "__of"), F.col("__key") == F.col("__of"))
    once = taken.dropDuplicates(["__key"])
    return once.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
