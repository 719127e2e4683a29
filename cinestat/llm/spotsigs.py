"""SpotSigs fingerprints in DataFrame functions: content words that follow anchors.

An anchor opens a chain: itself and the words up to the next anchor.  A signature is a chain,
hashed; a text's fingerprint is the ascending set of its signatures, eight hexadecimal digits
each.  Common words are anchors.  They are frequent in running text and rare in tables, lists
and languages that the list does not know, so the text itself gives further ones: of all
words, those whose own hash begins with one of four of the sixteen digits.  Every word lies
in a chain (what comes before the first anchor is one too), and as anchors depend on words
alone, a change touches the chains around it only.

Likeness of two fingerprints is the Jaccard index of their sets.  Sets of sizes ``a <= b``
cannot be more alike than ``a / b``, so a comparison with a threshold skips pairs by size
first, and near duplicates are sought between neighbouring ranges of set size only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.functions.bind import let
from cinestat.session import kept

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the and of to in is it that for was on with as by at be this are or an from have not you "
    "der die das und ist von zu mit auf den des ein eine nicht auch als sich dem "
    "le la les et de du un une que qui dans pour pas sur est avec par au "
    "el los las y en es por con para se no su al lo como más del"
).split()
CHOSEN = "0123"  # first digits of the hashes of words that are anchors everywhere
MOST_RANGES = 100_000


def signatures(text: Column, anchors: list[str] | tuple[str, ...] = tuple(ANCHORS), chosen: str = CHOSEN) -> Column:
    """Ascending distinct signatures of a text; null counts as empty, and a text without words has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    opens = lambda w: w.isin(*anchors) | F.substring(F.md5(w), 1, 1).isin(*chosen)
    marked = F.array_join(F.transform(words, lambda w: F.when(opens(w), F.concat(F.lit("|"), w)).otherwise(w)), " ")
    chains = F.filter(F.split(marked, r" ?\|"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(chains, lambda x: F.substring(F.md5(x), 1, 8))))


def jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Likeness of two signature sets, 0 without looking where sizes rule out ``at_least``.

    Two empty sets are alike (1.0), an empty and a filled one are not (0.0).
    """
    less, more = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = F.when(more == 0, 1.0).otherwise(
        let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared)))
    return exact if at_least <= 0 else F.when(less < at_least * more, 0.0).otherwise(exact)


def with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = 5_000, carried: dict[str, Column] | None = None,
) -> DataFrame:
    """``doc_id``, ``text``, ``next``: each row's text and that of the next in descending ``doc_id``.

    ``carried`` names columns worked out from ``text`` once per row; each comes with the next
    row's as ``next_<name>``.

    After the last comes the first.  Null numbers come last; rows with one number are ordered
    by text.  Ranges of numbers are ordered each by itself; a range is handed the first row
    of the one after it, so no task sees more than a range.  The ranges' bounds come from an
    approximate percentile and need not be even for the result to be right.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = d.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    ranges = min(MOST_RANGES, max(1, math.ceil(facts["n"] / rows_per_range)))
    coarse, fine = min(ranges, 500), math.ceil(ranges / 500)
    cuts = []
    if coarse > 1 and facts["lo"] is not None:
        got = d.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 10 * coarse)).first()[0]
        cuts = sorted(set(got or []))
    # Between two cuts numbers are dealt evenly by value; the largest numbers have the lowest range, nulls the last.
    lows = F.array(*[F.lit(c).cast("long") for c in [facts["lo"] or 0, *cuts, (facts["hi"] or 0) + 1]])
    k = F.size(F.filter(F.slice(lows, 2, max(1, len(cuts))), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    low, high = F.element_at(lows, k + 1), F.element_at(lows, k + 2)
    inner = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * fine)
    of = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-(k * fine + F.least(inner, F.lit(fine - 1)))).cast("int")
    ranged = d.withColumn("range", of)
    # One row a range, MOST_RANGES at most: the window over them and the broadcast are bounded by that.
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("range")
    carry = heads.select(
        F.col("range").alias("into"), F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("of"))
    tops = heads.select(F.col("range").alias("of"), "top")
    carry = carry.join(tops, "of").withColumnRenamed("of", "from")
    head_rows = ranged.join(F.broadcast(carry), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("range") == F.col("from")))
    # Several rows may share the number: the first by text.
    head = head_rows.groupBy("into").agg(F.min("text").alias("text"))
    guests = head.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("into").alias("range"), F.lit(1).alias("guest"))
    carried = carried or {}
    every = ranged.withColumn("guest", F.lit(0)).unionByName(guests).withColumns(carried)
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    led = every.withColumns({"next": F.lead("text").over(w)} | {f"next_{c}": F.lead(c).over(w) for c in carried})
    return led.where("guest = 0").select("doc_id", "text", "next", *carried, *[f"next_{c}" for c in carried])


def edited(text: Column, following: Column) -> Column:
    """The last ``floor(n / 2)`` code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_edit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (to the next document's fingerprint).
    """
    paired = with_next(docs, doc_id, text, carried={"own": signatures(F.col("text"))}).withColumn("edit", edited(F.col("text"), F.col("next")))
    sets = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        "own", signatures(F.col("edit")).alias("edit"), F.col("next_own").alias("next"))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"),
        F.array_join("edit", "").alias("edited_fingerprint"), jaccard(F.col("own"), F.col("edit")).alias("near_edited"),
        jaccard(F.col("own"), F.col("next")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``a < b`` of class representatives with likeness ``>= threshold``, and ``likeness``.

    Texts with one fingerprint are one class, named by its smallest number; ``classes`` holds
    the membership.  Only signatures of a pair's rare end are joined: sorted by global
    frequency, two sets at the threshold share one of the first
    ``size - ceil(threshold * size) + 1``; a range of set sizes meets itself and the next.
    """
    marked = kept(classes(docs, doc_id, text).groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    sets = marked.withColumn("s", F.expr("filter(transform(sequence(0, greatest(length(fingerprint) div 8 - 1, 0)), i -> substring(fingerprint, i * 8 + 1, 8)), x -> x <> '')"))
    freq = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    ranked = kept(sets.select("id", F.size("s").alias("size"), F.explode("s").alias("sig")).join(freq, "sig").withColumn(
        "at", F.row_number().over(Window.partitionBy("id").orderBy("n", "sig"))))
    prefix = ranked.where((F.col("at") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1) & (F.col("n") > 1))
    step = -math.log(threshold)
    band = F.floor(F.log("size") / F.lit(step)).cast("int")
    left = prefix.select("sig", band.alias("band"), F.col("id").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("sig", F.explode(F.array(band, band - 1)).alias("band"), F.col("id").alias("b"), F.col("size").alias("size_b"))
    fits = F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b")
    met = left.join(right, ["sig", "band"]).where(fits & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    s = sets.select("id", "s")
    both = met.join(s.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    return both.withColumn("likeness", jaccard(F.col("s_a"), F.col("s_b"), threshold)).where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.array_join(signatures(F.col(text)), "").alias("fingerprint"))
