"""Removal of repeated multi-line chunks with content-defined boundaries.

Lines are hashed, and a rolling hash runs over the hashes of two neighbouring lines (blank
ones are passed over).  Where the rolled value also occurs elsewhere, the two lines hang
together; a boundary lies where it does not.  A chunk is a longest run of lines that hang
together: its boundaries depend on the lines at them only, so text put in or taken out shifts
none of the others, and a repeated passage of two lines is found as surely as one of fifty.

A pair of lines that occurs in several documents stays in the one with the smallest number
and goes from all others; inside one document its first occurrence stays.  A line goes if a
pair it lies in goes and no pair it lies in stays here, so every repeated pair survives
somewhere, whole.

Nothing is cut on hashes alone: the pairs behind each repeated value are compared byte by
byte, and a value that stands for two different pairs is never acted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from cinestat.llm.common import derived, extended
from cinestat.session import kept

LEAST_CHARS = 16  # of a pair: shorter ones ("\\end\n}") recur by chance


def pairs(lines: list[str]) -> list[tuple[int, int, int]]:
    """``(line, next line, rolled hash)`` of a text's neighbouring lines that are not blank."""
    at = [i for i, x in enumerate(lines) if x and not x.isspace()]
    if len(at) < 2:
        return []
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in at), np.uint64, len(at))
    rolled = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    rolled = ((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64).tolist()
    return [(i, j, h) for i, j, h in zip(at, at[1:], rolled) if len(lines[i]) + len(lines[j]) >= LEAST_CHARS]


def chunks(text: str, repeated: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, int, str]]:
    """``(first line, end line, text)`` of a text's chunks; joined by line feeds they are the text."""
    lines = text.split("\n")
    bound = [True] * len(lines)
    for i, j, h in pairs(lines):
        if h in repeated:
            bound[i + 1 : j + 1] = [False] * (j - i)
    starts = [i for i, b in enumerate(bound) if b or i == 0]
    return [(a, b, "\n".join(lines[a:b])) for a, b in zip(starts, [*starts[1:], len(lines)])]


def cut(text: str, away: set[int], own: set[int]) -> tuple[str, int]:
    """The text without pairs ``away`` and without later occurrences of ``own`` ones, and the number of lines gone."""
    lines = text.split("\n")
    going, staying, seen = set(), set(), set()
    for i, j, h in pairs(lines):
        if h in away or h in own and h in seen:
            going |= {i, j}
        elif h in own:
            staying |= {i, j}
            seen.add(h)
    going -= staying
    if not going:
        return text, 0
    out, blank, before = [], [], True  # blank lines go with the lines on both sides of them
    for i, x in enumerate(lines):
        if not x or x.isspace():
            blank.append(x)
            continue
        if not (before and i in going):
            out += blank
        blank, before = [], i in going
        if not before:
            out.append(x)
    if not before:
        out += blank
    return "\n".join(out), len(lines) - len(out)


def _signed(batch: pa.RecordBatch, name: str) -> Iterator[set[int]]:
    return (set(x) if x is not None else set() for x in batch.column(name).to_pylist())


def _attached(docs: DataFrame, found: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with the pairs of each that occur more than once: ``__away`` (another's) and ``__own``."""
    held = found.select("__key", "doc_id", F.explode("digests").alias("digest")).join(repeated, "digest")
    away = F.col("owner").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("owner"))
    lists = held.groupBy(F.col("__key").alias("__of")).agg(
        F.collect_set(F.when(away, F.col("digest"))).alias("__away"), F.collect_set(F.when(~away, F.col("digest"))).alias("__own"))
    return kept(docs.join(lists, F.col("__key") == F.col("__of"), "left").drop("__key", "__of"))


def _ambiguous(joined: DataFrame, text: str) -> DataFrame:
    """Hashes behind which different pairs of lines lie: their least and greatest text differ."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, seen = batch.slice(at, 1000), set()
                for value, away, own in zip(part.column("text").to_pylist(), _signed(part, "__away"), _signed(part, "__own")):
                    known, lines = away | own, (value or "").split("\n")
                    seen |= {(h, lines[i] + "\n" + lines[j]) for i, j, h in pairs(lines) if h in known}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in seen], pa.int64()), pa.array([t for _, t in seen], pa.string())], names=["digest", "pair"])

    some = joined.where(F.col("__away").isNotNull()).select(F.col(text).alias("text"), "__away", "__own")
    both = some.mapInArrow(run, "digest long, pair string").groupBy("digest").agg(F.min("pair").alias("lo"), F.max("pair").alias("hi"))
    return both.where(F.col("lo") != F.col("hi")).select("digest")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``removed_lines``, ``removed_chars``.

    A null text stays null and an empty one empty.  Repeated rows (same number, same text)
    count as one document: their first chunk occurrences stay in each.  Rows without a number
    keep chunks that no numbered row has.  All other columns pass unchanged; a document whose
    chunks all occur elsewhere first is left with an empty text, not dropped.
    """
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))
    names = docs.columns
    keyed = docs.withColumn("__key", key)
    plain = keyed.select("__key", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def roll(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes = [[h for *_, h in pairs((t or "").split("\n"))] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__key"), part.column("doc_id"), pa.array(hashes, pa.list_(pa.int64()))], names=["__key", "doc_id", "digests"])

    found = kept(plain.mapInArrow(roll, extended(plain.select("__key", "doc_id").schema, digests=ArrayType(LongType()))))
    each = found.select("doc_id", F.explode("digests").alias("digest"))
    repeated = each.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    joined = _attached(keyed, found, repeated)
    ambiguous = kept(_ambiguous(joined, text))
    if not ambiguous.isEmpty():
        joined = _attached(keyed, found, repeated.join(ambiguous, "digest", "left_anti"))

    def clean():
        def each_text(texts, away_lists, own_lists):
            out, lines, chars = [], [], []
            for value, away, own in zip(texts, away_lists, own_lists):
                new, n = (value, 0) if value is None or away is None else cut(value, set(away), set(own))
                out.append(new); lines.append(n); chars.append(len(value or "") - len(new or ""))
            return {text: out, "removed_lines": lines, "removed_chars": chars}

        return each_text

    new = {text: "string", "removed_lines": "long", "removed_chars": "long"}
    out = derived(joined, [text, "__away", "__own"], clean, names, **new)
    return out.select(*names, *[c for c in new if c not in names])
