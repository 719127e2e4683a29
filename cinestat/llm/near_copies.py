"""Near copies by the exact Jaccard likeness of word shingles, candidates by SimHash and MinHash bands.

SimHash fingerprints of the same shingles are linked by :mod:`simhash_groups` (tables of distances
to reference fingerprints); links that the exact likeness confirms are groups from the start.
At a likeness of 0.8 fingerprints differ by some ten bits, more than those tables take, so the
groups are joined further by MinHash:

Each text is the set of its shingles (five words).  A signature holds ``BANDS`` times ``ROWS``
minima of the set under different hashes; two texts meet where all minima of a band are equal.
At a likeness of 0.8 a pair misses all bands with a chance of 2 in 10,000, above it more rarely.
What meets is compared on the sets themselves; pairs below ``least`` are not linked.

Equal sets are one member, and buckets of the same members are one bucket.  In a bucket every
two members not yet linked there, nor by SimHash, are compared; a group of near copies is therefore done after
one pass over it.  Buckets of more than ``bucket_rows`` members are cut into blocks, and every
two blocks are compared: no member is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cinestat.llm import simhash_groups
from cinestat.llm.common import components, derived, row_key
from cinestat.session import kept

BANDS, ROWS, SHINGLE, LEAST = 16, 4, 5, 0.8
_SEEDS = np.array([[xxhash.xxh64_intdigest(b"%d:%d" % (k, side), 42) | side for k in range(BANDS * ROWS)] for side in (0, 1)], np.uint64)
_SURE = 0.45  # of equal minima: seven deviations below what a likeness of 0.8 has


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of the word shingles; fewer words are one shingle.

    A-Z are lower-cased, words are split at ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([digest(join(words), 42)], np.uint64)
    return np.unique(np.fromiter((digest(join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))), np.uint64, n))


def signature(of: np.ndarray) -> np.ndarray:
    """The minima of a set of shingle values; all ones for an empty set."""
    low = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for at in range(0, len(of), 2048):
        np.minimum(low, ((of[at : at + 2048, None] ^ _SEEDS[0]) * _SEEDS[1]).min(0), out=low)
    return low


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of :func:`shingles`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _linked(names: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, least: float, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links of members within ``least``; with two ``sides`` only across (each is compared elsewhere).

    Members of one of ``groups`` are linked already.
    """
    marks, out = np.stack([signature(s) for s in sets]), []
    root = np.unique(groups, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    two = sides.min() != sides.max()
    for i in range(len(sets) - 1):
        fit = (marks[i + 1 :] == marks[i]).mean(1) >= _SURE
        fit &= np.minimum(sizes[i + 1 :], sizes[i]) >= least * np.maximum(sizes[i + 1 :], sizes[i])
        for j in (np.flatnonzero(fit & (root[i + 1 :] != root[i])) + i + 1).tolist():
            if root[i] != root[j] and not (two and sides[i] == sides[j]) and likeness(sets[i], sets[j]) >= least:
                root[root == root[j]] = root[i]
                out.append((int(names[i]), int(names[j])))
    return out


def simhash_links(docs: DataFrame, key: str, text: str, one: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """Links ``a``, ``b`` between sets (``fp``, ``key`` and fingerprint ``sim`` in ``one``) that SimHash finds and the likeness confirms.

    Sets of one fingerprint are held against the smallest of them, and those against each
    other as :func:`simhash_groups.links` says.
    """
    first = kept(one.groupBy("sim").agg(F.min(F.struct("fp", key)).alias("r")).select("sim", F.col("r.fp").alias("b"), F.col(f"r.{key}").alias("key_b")))
    own = one.join(first, "sim").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), F.col(key).alias("key_a"), "b", "key_b")
    met = simhash_groups.links(first.select(F.col("sim").alias("fp"))).toDF("x", "y")
    ends = [first.select(F.col("sim").alias(of), F.col("b").alias(c), F.col("key_b").alias(f"key_{c}")) for of, c in (("x", "a"), ("y", "b"))]
    across = met.join(ends[0], "x").join(ends[1], "y").select("a", "key_a", "b", "key_b")
    pairs = kept(own.unionByName(across))
    used = pairs.select(F.explode(F.array("key_a", "key_b")).alias("__used")).distinct()
    texts = kept(docs.join(used, F.col(key) == F.col("__used"), "left_semi").select(F.col(key).alias("__of"), F.col(text).alias("text")).dropDuplicates(["__of"]))
    full = pairs.join(texts.select(F.col("__of").alias("key_a"), F.col("text").alias("text_a")), "key_a").join(
        texts.select(F.col("__of").alias("key_b"), F.col("text").alias("text_b")), "key_b")

    def make():
        return lambda xs, ys: {"like": [likeness(shingles(x, shingle), shingles(y, shingle)) for x, y in zip(xs, ys)]}

    return kept(derived(full, ["text_a", "text_b"], make, ["a", "b"], like="double").where(F.col("like") >= least).select("a", "b"))


def links(docs: DataFrame, key: str, text: str, marked: DataFrame, least: float = LEAST, bucket_rows: int = 1024, shingle: int = SHINGLE) -> DataFrame:
    """Links ``a``, ``b`` between sets (column ``fp`` of ``marked``) of a likeness of ``least`` or more.

    ``marked``: a row of ``key``, ``fp``, ``bands`` and ``sim`` for each row of ``docs``.
    """
    one = kept(marked.groupBy("fp").agg(F.min(F.struct(key, "bands", "sim")).alias("r")).select("fp", f"r.{key}", "r.bands", "r.sim"))
    sure = simhash_links(docs, key, text, one, least, shingle)
    grouped = components(sure).select(F.col("node").alias("__node"), "root")
    member = kept(one.select("fp", key, F.posexplode("bands").alias("band", "value")))
    # A bucket is known by how many members it has and the sum of their hashes; equal buckets are looked at once.
    sizes = member.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("of")).where("n > 1")
    once = kept(sizes.groupBy("n", "of").agg(F.min(F.struct("band", "value")).alias("b")).select("n", "b.band", "b.value"))
    placed = kept(member.join(once, ["band", "value"]).join(grouped, F.col("fp") == F.col("__node"), "left").select(
        "fp", key, "band", "value", "n", F.coalesce("root", "fp").alias("known")))
    used = placed.select(F.col(key).alias("__used")).distinct()
    texts = kept(docs.join(used, F.col(key) == F.col("__used"), "left_semi").select(F.col(key).alias("__of"), F.col(text).alias("text")))
    blocks = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    # A bucket of one block is compared in itself; else each block meets itself and every other.
    dealt = placed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "fp", "known", key, "band", "value", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    full = dealt.join(texts, F.col(key) == F.col("__of")).select("fp", "known", "text", "band", "value", "mine", "lo", "hi")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp")
        found = _linked(part["fp"].to_numpy(), [shingles(x, shingle) for x in part["text"]], part["mine"].to_numpy(), least, part["known"].to_numpy()) if len(part) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return full.groupBy("band", "value", "lo", "hi").applyInPandas(run, "a long, b long").unionByName(sure).distinct()


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, shingle: int = SHINGLE, bucket_rows: int = 1024) -> DataFrame:
    """One row of ``docs`` for each component of near copies: the smallest number, then the smallest row key.

    Rows equal in every column count as one; documents without words are equal.
    """
    def make():
        def mark(texts):
            names, bands, sims = [], [], []
            for x in texts:
                of = shingles(x, shingle)
                sims.append(simhash_groups.fingerprint(x, shingle))
                names.append(xxhash.xxh3_64_intdigest(of.tobytes()))
                bands.append(b"".join(xxhash.xxh3_64_digest(part.tobytes()) for part in signature(of).reshape(BANDS, ROWS)).hex())
            return {"fp": np.array(names, np.uint64).view(np.int64), "bands": bands, "sim": np.array(sims, np.uint64).view(np.int64)}

        return mark

    keyed = docs.withColumn("__key", row_key(docs))
    plain = keyed.select("__key", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = kept(derived(plain, ["text"], make, ["__key", "doc_id"], fp="long", bands="string", sim="long").withColumn(
        "bands", F.array(*[F.substring("bands", 16 * k + 1, 16) for k in range(BANDS)])))
    joined = components(links(keyed, "__key", text, marked.select("__key", "fp", "bands", "sim"), least, bucket_rows, shingle))
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("r"))
    rooted = best.join(joined, F.col("fp") == F.col("node"), "left").select("r", F.coalesce("root", "fp").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.__key").alias("__stay"))
    return keyed.join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
