"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash ``h = (h << 1) + gear[byte]`` depends on the last 32 bytes only; a chunk ends
where its masked bits are zero, so boundaries move with the content and an insertion changes
the chunks around it alone.  Chunks are deduplicated by digest over the whole corpus.  A
single short chunk recurs by chance; what is reported is a run of neighbouring chunks that
all occur in other documents and together span ``least_bytes``.

Text that repeats one word over and over has the same hash everywhere and so no boundary of
its own: it is cut at the greatest length, and its repetition elsewhere is found by chance only.

The rolling hash is computed for all positions at once: the hash of the last ``2 m`` bytes is
that of the last ``m`` plus that of the ``m`` before, shifted by ``m``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.llm.common import derived, expanded
from cinestat.session import kept


LEAST, MOST, MASK = 16, 192, np.uint32(0x1F << 26)


def gear_table() -> np.ndarray:
    """One pseudo-random word per byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def ends(data: bytes, gear: np.ndarray, least: int = LEAST, most: int = MOST, mask: np.uint32 = MASK) -> list[int]:
    """Ends (exclusive) of the chunks of ``data``; never inside a UTF-8 character."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h, m = gear[raw], 1
    while m < 32:
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
        m *= 2
    first = np.ones(n, bool)
    first[:-1] = (raw[1:] & 0xC0) != 0x80  # the byte after the cut begins a character
    cuts, start = [], 0
    for c in (np.flatnonzero(((h & mask) == 0) & first) + 1).tolist():
        while c - start > most:
            forced = start + most
            while forced < n and not first[forced - 1]:
                forced += 1
            cuts.append(forced)
            start = forced
        if c - start >= least:
            cuts.append(c)
            start = c
    while n - start > most:
        forced = start + most
        while forced < n and not first[forced - 1]:
            forced += 1
        cuts.append(forced)
        start = forced
    if start < n:
        cuts.append(n)
    return cuts


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (of number and text), ``nth``, ``start``, ``length`` (bytes), ``digest``."""
    def make():
        gear, digest = gear_table(), xxhash.xxh3_64_intdigest

        def cut(texts):
            rows, nth, start, length, found = [], [], [], [], []
            for i, value in enumerate(texts):
                data = (value or "").encode("utf-8", "surrogatepass")
                at = 0
                for k, end in enumerate(ends(data, gear)):
                    rows.append(i); nth.append(k); start.append(at); length.append(end - at); found.append(digest(data[at:end]))
                    at = end
            return rows, {"nth": nth, "start": start, "length": length, "digest": np.array(found, np.uint64).view(np.int64)}

        return cut

    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).alias("text")).withColumn("key", _key())
    return expanded(plain, "text", make, ["doc_id", "key"], nth="int", start="int", length="int", digest="long")


def repeats(docs: DataFrame, least_bytes: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that occur in several documents, a row for each occurrence.

    ``doc_id``, ``key``, ``start``, ``length`` (bytes of the UTF-8 text), ``chunks``,
    ``first_doc_id`` (the smallest number that has a chunk of it), ``kept`` (every chunk of it
    appears here first; if not, none does).  A run of shared chunks is broken where it goes from
    chunks that appear here first to others, so each chunk is kept where it appears first;
    ``least_bytes`` holds for the whole run.  Documents are told apart by number: text that
    recurs inside one document only is not reported, and rows repeated whole count once.  Null
    numbers count as one document, null and empty texts have no passages.
    """
    cut = chunks(docs, doc_id, text)
    # Written first: a join of two plain shuffles is one whose hot digests Spark can split.
    shared = kept(cut.groupBy("digest", "length").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(
        F.col("digest").alias("d"), F.col("length").alias("l"), "first"))
    held = cut.join(shared, (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l")))
    inside = Window.partitionBy("key", "doc_id").orderBy("nth")
    alike = Window.partitionBy("key", "doc_id", "kept").orderBy("nth")
    run = held.select("key", "doc_id", "nth", "start", "length", "first", (F.col("first") == F.col("doc_id")).alias("kept")).withColumn(
        "run", F.col("nth") - F.dense_rank().over(inside)).withColumn("part", F.col("nth") - F.dense_rank().over(alike))
    parts = run.groupBy("key", "doc_id", "run", "kept", "part").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"),
        (F.max("nth") - F.min("nth") + 1).alias("chunks"), F.min("first").alias("first_doc_id"))
    whole = Window.partitionBy("key", "doc_id", "run")
    return parts.withColumn("run_bytes", F.sum("length").over(whole)).withColumn("run_chunks", F.sum("chunks").over(whole)).where(
        (F.col("run_bytes") >= least_bytes) & (F.col("run_chunks") > 1)).select(
        F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")).alias("doc_id"), "key",
        F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "chunks", "first_doc_id", "kept")


def dedup(docs: DataFrame, least_bytes: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages that a document with a smaller number has; and ``removed_bytes``."""
    gone = repeats(docs, least_bytes, doc_id, text).where(~F.col("kept"))
    # A document's passages: bounded by its own length.
    lists = gone.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__cut")).withColumnRenamed("key", "__of")
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), F.col(text))
    joined = docs.withColumn("__key", key).join(lists, F.col("__key") == F.col("__of"), "left").drop("__key", "__of")

    def clean():
        def cut(texts, lists_):
            out, sizes = [], []
            for value, spans in zip(texts, lists_):
                data = (value or "").encode("utf-8", "surrogatepass")
                parts, at = [], 0
                for span in spans or []:
                    parts.append(data[at : span["start"]])
                    at = span["start"] + span["length"]
                parts.append(data[at:])
                rest = b"".join(parts)
                out.append(None if value is None else rest.decode("utf-8", "surrogatepass"))
                sizes.append(len(data) - len(rest))
            return {text: out, "removed_bytes": sizes}

        return cut

    new = {text: "string", "removed_bytes": "long"}
    out = derived(joined, [text, "__cut"], clean, docs.columns, **new)
    return out.select(*docs.columns, *[c for c in new if c not in docs.columns])
