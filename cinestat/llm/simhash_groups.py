"""Near duplicates by SimHash, linked with tables of distances to reference fingerprints.

Every distinct fingerprint carries its Hamming distances to ``PIVOTS`` reference
fingerprints.  By the triangle inequality two fingerprints within ``radius`` bits differ by
at most ``radius`` in each of these coordinates, so a pair with a larger coordinate
difference is discarded unseen; survivors are verified on the fingerprints themselves.

The table alone cannot bring pairs together across a cluster: distances to a reference are
spread over a dozen values only, so cells of them hold large shares of all rows.  Pairs are
therefore sought inside blocks: of four 16-bit blocks, ``radius`` <= 2 changed bits leave at
least two untouched, so each fingerprint joins the six buckets of its block pairs.  Inside a
bucket, rows are sorted by the first coordinate and compared within its window only.

A bucket with more than ``bucket_rows`` distinct fingerprints takes an exact way whose work
is linear: each member offers itself under its own value and under all values one bit away;
two members within two bits meet under at least one of them, and all that meet are within
two bits of each other.  Such a meeting has 65 members at most.

Nothing is emitted for every pair: a bucket yields each member's link to the smallest one it
reaches there, and components are joined across buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cinestat.llm.common import components, derived, row_key
from cinestat.session import kept

PIVOTS = 16
_BLOCKS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included; no word gives zero.

    A-Z are lower-cased, words are split at ASCII white space; a bit is one if more than
    half of the shingles' XXH64 values (seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` and ``fp`` (the 64 bits as a long) of every row."""
    def make():
        return lambda texts: {"fp": np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)}

    return derived(docs, [text], make, keep, fp="long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: fixed pseudo-random words, as signed longs."""
    words = np.array([xxhash.xxh64_intdigest(b"pivot%d" % k, 42) for k in range(n)], np.uint64)
    return words.view(np.int64).tolist()


def _linked(bucket: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a fingerprint, the smallest it reaches) inside the buckets of a batch."""
    by = np.lexsort((table[:, 0], bucket))
    bucket, fp, table = bucket[by], fp[by], table[by]
    bits = fp.view(np.uint64)
    pairs, at, shift = [], np.arange(len(fp)), 1
    while len(at):
        at = at[at + shift < len(fp)]
        at = at[(bucket[at + shift] == bucket[at]) & (table[at + shift, 0] - table[at, 0] <= radius)]
        near = at[(np.abs(table[at + shift] - table[at]) <= radius).all(1)]
        near = near[np.bitwise_count(bits[near + shift] ^ bits[near]) <= radius]
        if len(near):
            pairs.append(np.stack([near, near + shift]))
        shift += 1
    if not pairs:
        return fp[:0], fp[:0]
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(len(fp))
    while True:  # within a batch; links never leave a bucket
        least = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == was).all():
            break
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(distinct: DataFrame, radius: int = 2, bucket_rows: int = 1024, pivot_count: int = PIVOTS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) within ``radius`` <= 2 bits.

    Their transitive closure is that of all such pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots(pivot_count)])
    block = [F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*[F.lit(i).cast("long") * (1 << 32) + block[a] * (1 << 16) + block[b] for i, (a, b) in enumerate(_BLOCKS)])
    member = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = kept(member.join(sizes, "bucket"))
    small = (
        placed.where(F.col("n") <= bucket_rows).withColumn("d", table)
        .groupBy("bucket").agg(F.collect_list(F.struct("fp", "d")).alias("rows"))  # bucket_rows at most
    )

    def run(batches):
        for batch in batches:
            sizes_now = batch["rows"].map(len).to_numpy()
            if not len(sizes_now):
                continue
            flat = [r for rows in batch["rows"] for r in rows]
            fp = np.fromiter((r["fp"] for r in flat), np.int64, len(flat))
            d = np.array([r["d"] for r in flat], np.int16).reshape(len(flat), -1)
            a, b = _linked(np.repeat(np.arange(len(sizes_now)), sizes_now), fp, d, radius)
            yield pd.DataFrame({"a": a, "b": b})

    found = small.mapInPandas(run, "a long, b long")
    large = placed.where(F.col("n") > bucket_rows).select("fp").distinct()
    reach = radius // 2 + radius % 2
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64 if reach else 0)])
    met = large.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    exact = met.select(F.array_min("m").alias("b"), F.explode("m").alias("a")).where("a != b").select("a", "b")
    if radius == 1:  # meetings hold pairs at two bits as well
        exact = exact.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return found.unionByName(exact).distinct()


def group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), radius: int = 2,
    shingle: int = 3, bucket_rows: int = 1024,
) -> DataFrame:
    """``doc_id``, ``keep``, ``fp``, ``root``, ``component_id`` of every row.

    ``component_id`` is the smallest document number reachable over links, the row's own
    included; ``root`` is the smallest fingerprint there.  Documents without words (null,
    empty) share fingerprint zero and are linked like any others.  Equal texts share
    everything.  Rows without a number take part; a component of such rows only has a null
    ``component_id``.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    marked = kept(fingerprints(plain, ["doc_id", *keep], shingle=shingle))
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct, radius, bucket_rows))
    rooted = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written first, so that Spark can split the join where one fingerprint has very many rows.
    names = kept(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "root", "component_id"))
    return marked.join(names, F.col("fp") == F.col("of")).select("doc_id", *keep, "fp", "root", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component: the smallest number, then the smallest row key.

    Rows equal in every column count as one.
    """
    keyed = docs.withColumn("__key", row_key(docs))
    groups = group(keyed, doc_id, text, keep=("__key",), **how)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("r"))
    stay = first.select(F.col("r.__key").alias("__stay"))
    return keyed.join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
