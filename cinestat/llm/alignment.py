"""Aligning the tokens of two tokenizers over the same bytes, and how often token pairs meet.

A text is read as space + text.  Tokenizer A is a byte-level one (``tokenizers``), B a piece
model with byte fallback (``sentencepiece``, which adds that space itself).  Wherever a token
of A and one of B end at the same byte, both sequences are cut: the tokens between two cuts
are a group, the two tokens that end at a cut are a link.

Cuts come from the spans that the libraries report: character offsets of A, the spans of B's
proto.  Spans settle every token that has its characters to itself.  Several tokens in one
character (A's halves of a multibyte character, B's ``<0xHH>``) share a span; their ends are
counted forward from the last settled end by the bytes that the tokens decode to.

Neither tokenizer has a token that begins before a lone blank or line feed with a letter or digit
behind it, or between a letter and a full stop or comma (checked on the files), so a text is
aligned stretch by stretch, and stretches are remembered.  A stretch whose decoded bytes differ
sends its whole text through both tokenizers at once.

A text that is null, empty, or whose decoded tokens do not give its bytes back has no tokens:
all its counts are 0 and ``groups_sha256`` is ''.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from cinestat.llm.common import extended
from cinestat.session import kept

_LONGS = ArrayType(LongType())
_PAIRS = ArrayType(StructType().add("code", LongType()).add("times", LongType()))
_END = attrgetter("end")
_NONE = np.empty(0, np.int64)
_REMEMBERED = 100_000  # stretches of each of two generations, some 50 MB
_JOINED = 1 << 16  # characters of stretches that are encoded in one call
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = re.compile(rf"(?<=[!-~\w])(?=[ \n]\w)|(?<=[{_LATIN}])(?=[.,])")
_JOINS = re.compile(r"[ \n]\w(?s:.*)(?<=[!-~\w])|[ \n]\w")
_LEAD = " a"  # stands before a stretch that does not begin with a blank


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Aligns texts and remembers stretches: their numbers of tokens and groups, groups' text, links."""

    def __init__(self, a: str | None = None, b: str | None = None):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if a is None or b is None:
            import public_tokenizers

            a = a or public_tokenizers.path("byte_bpe_50k.json")
            b = b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        plain = dict(sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=False).items()))
        self.a_bytes = [bytes(map(letters.__getitem__, plain[i])) if i in plain else b"" for i in range(max(plain) + 1)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # Groups' text, token by token: an id and what follows it, inside its side of a group and at its end.
        self.spelt = [x + end for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for x in map(str, range(n))]
        self.spelt_size = np.array([len(x) for x in self.spelt])
        # A piece of B that reaches over the end of a stretch would forbid stretches, and so would another pattern of A.
        over = re.compile(rf"[^▁]▁|.\n|[{_LATIN}][.,]", re.S)
        first = json.loads(self.a.to_str())
        self.cuts = (
            not any(over.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())) and first["normalizer"] is None
            and all(first["pre_tokenizer"].get(k) == v for k, v in (("type", "ByteLevel"), ("add_prefix_space", False), ("use_regex", True))))
        # Stretches seen of late, and those seen before: (tokens of A, of B, groups, groups' text, links), None: bytes differ.
        self.seen: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    @staticmethod
    def _ends(start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where tokens end, in bytes: by span if no neighbour shares it, else counted on by decoded sizes."""
        some = end > start
        alone = some.copy()
        alone[1:] &= some[:-1] & (end[:-1] <= start[1:])
        alone[:-1] &= some[1:] & (end[:-1] <= start[1:])
        total = np.cumsum(size)
        last = np.maximum.accumulate(np.where(alone, np.arange(len(size)), -1))
        since = np.where(last < 0, 0, end[last] - total[last])
        return total + since

    def _align(self, text: str):
        """Ids of A and B, their ends, the ends they share; None if the decoded bytes are not the text's."""
        whole = text.encode()
        coded, pieces = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        a_list, b_list = coded.ids, [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a_list)) != whole or b"".join(map(self.b_bytes.__getitem__, b_list)) != whole:
            return None
        a, b = np.array(a_list, np.int64), np.array(b_list, np.int64)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(whole) != len(text):  # characters to bytes
            raw = np.frombuffer(whole, np.uint8)
            spans = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[spans]
        a_end = self._ends(spans[:, 0], spans[:, 1], self.a_size[a])
        # B's spans are bytes behind the blank that B adds; its first token holds that blank too.
        end = np.fromiter(map(_END, pieces), np.int64, len(b)) + 1
        b_end = self._ends(np.append(0, end[:-1]), end, self.b_size[b])
        return a, b, a_end, b_end, np.intersect1d(a_end, b_end, assume_unique=True)

    def _learn(self, parts: list[str]) -> None:
        """Remembers stretches that may follow one another; the first begins with a blank."""
        got = self._align("".join(parts))
        if got is None and len(parts) > 2:
            for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
                self._learn(half if half[0][0] == " " else [_LEAD, *half])
            return
        if got is None:
            self.seen[parts[-1]] = None
            if len(parts) == 2 and parts[0] != _LEAD:
                self._learn(parts[:1])
                self._learn(parts[1:] if parts[1][0] == " " else [_LEAD, parts[1]])
            return
        a, b, a_end, b_end, shared = got
        at_a, at_b = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)  # groups
        last_a, last_b = shared[at_a] == a_end, shared[at_b] == b_end
        links = ((a[last_a] << 32) | b[last_b]).tobytes()
        row = np.concatenate([a + len(self.a_bytes) * last_a, 2 * len(self.a_bytes) + b + len(self.b_bytes) * last_b])
        row = row[np.argsort(np.concatenate([2 * at_a, 2 * at_b + 1]), kind="stable")]
        spelt = "".join(map(self.spelt.__getitem__, row.tolist()))
        ends = np.cumsum([len(p.encode()) for p in parts])
        n_a, n_b, n = (np.searchsorted(x, ends, side="right") for x in (a_end, b_end, shared))
        written = np.append(0, np.cumsum(self.spelt_size[row]))[n_a + n_b].tolist()
        counts = np.diff(np.stack([n_a, n_b, n], axis=1), axis=0, prepend=0).tolist()
        from_text = from_link = 0
        for part, count, upto, to_link in zip(parts, counts, written, (8 * n).tolist()):
            self.seen[part] = (*count, spelt[from_text:upto], links[from_link:to_link])
            from_text, from_link = upto, to_link

    def _learn_all(self, parts: list[str]) -> None:
        joined, size = [_LEAD], 0
        for part in parts:
            if not _JOINS.fullmatch(part):
                self._learn([part] if part[0] == " " else [_LEAD, part])
                continue
            joined.append(part)
            size += len(part)
            if size >= _JOINED:
                self._learn(joined)
                joined, size = [_LEAD], 0
        if size:
            self._learn(joined)

    def align(self, values: list[str | None]) -> list[tuple | None]:
        """For each text (tokens of A, tokens of B, groups, groups' text, links' codes); None: no tokens."""
        if len(self.seen) > _REMEMBERED:
            self.seen, self.before = {}, self.seen
        seen, before = self.seen, self.before
        cut = [(_CUT.split(" " + v) if self.cuts else [" " + v]) if v else [] for v in values]
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in seen]
        seen |= {p: before[p] for p in new if p in before}
        self._learn_all([p for p in new if p not in before])
        out, long = [], [p for p in new if len(p) > 200]  # long ones hardly come again
        for value, parts in zip(values, cut):
            found = list(map(seen.__getitem__, parts))
            if None in found and len(parts) > 1:  # the stretches differ; the text as a whole decides
                whole = " " + value
                if whole not in seen:
                    self._learn([whole])
                    long.append(whole)
                found = [seen[whole]]
            if not found or None in found:
                out.append(None)
                continue
            n_a, n_b, n, texts, links = zip(*found)
            out.append((sum(n_a), sum(n_b), sum(n), "".join(texts)[:-1], np.frombuffer(b"".join(links), np.int64)))
        for p in long:
            seen.pop(p, None)
        return out


@cache
def _aligner(a: str | None, b: str | None) -> Aligner:
    """One for all tasks of a worker: reading the vocabularies takes a second."""
    return Aligner(a, b)


def encoded(docs: DataFrame, keep: list[str], a: str | None = None, b: str | None = None, text: str = "text") -> DataFrame:
    """``keep`` and ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the document's
    different links as ``codes`` (A id * 2^32 + B id, ascending) with ``times``."""
    def run(batches):
        aligner = _aligner(a, b)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                counts, shas, codes, times = [], [], [], []
                for got in aligner.align(part.column("__text").to_pylist()):
                    if got is None:
                        counts.append((0, 0, 0, 0)); shas.append(""); codes.append(_NONE); times.append(_NONE)
                        continue
                    code, n = np.unique(got[4], return_counts=True)
                    counts.append((*got[:3], len(got[4]))); codes.append(code); times.append(n)
                    shas.append(hashlib.sha256(got[3].encode()).hexdigest())
                numbers = np.array(counts, np.int64).reshape(-1, 4)
                ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], *[pa.array(numbers[:, k]) for k in range(4)], pa.array(shas, pa.string()),
                     *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate([_NONE, *x]))) for x in (codes, times)]],
                    names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    plain = docs.select(*keep, F.col(text).alias("__text"))
    return plain.mapInArrow(run, extended(
        docs.select(*keep).schema, n_a="long", n_b="long", n_groups="long", n_links="long", groups_sha256="string",
        codes=_LONGS, times=_LONGS))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``code``, ``n`` (links of that id pair in all documents), ``best``: no pair with its B id has more links."""
    each = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("x"))
    pairs = kept(each.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("n")))
    piece = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row for each piece of B's vocabulary at most.
    highest = pairs.groupBy(piece.alias("piece")).agg(F.max("n").alias("most"))
    return kept(pairs.join(F.broadcast(highest), piece == F.col("piece")).select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text",
          frequent: int = 500_000) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose pair count is the highest of their B id), ``count_sum`` (pair counts over links), ``groups_sha256``.

    Pairs that hold at least 1/``frequent`` of all links are broadcast: there are at most
    ``frequent`` of them, whatever the corpus.  The other links meet their counts in a join;
    no such pair can be hot, as each holds less than that share.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = kept(encoded(plain, ["doc_id"], a, b).withColumn("__row", F.monotonically_increasing_id()))
    pairs = pair_counts(rows)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    least = -(-total // frequent)
    top = pairs.where(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("code").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy(zero_copy_only=False)[order] for c in ("code", "n", "best")))

    def run(batches):
        known, counts, best = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                codes, times = part.column("codes"), part.column("times")
                of = np.repeat(np.arange(part.num_rows), np.diff(codes.offsets.to_numpy()))
                code, n = codes.flatten().to_numpy(), times.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                hit = known[at] == code if len(known) else np.zeros(len(code), bool)
                sums = np.zeros(part.num_rows, np.int64)
                bests = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, of[hit], n[hit] * counts[at[hit]])
                np.add.at(bests, of[hit], n[hit] * best[at[hit]])
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=part.num_rows))]).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(code[~hit]), pa.array(n[~hit])], names=["code", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in carried], pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), rest)],
                    names=[*carried, "n_best", "count_sum", "rest"])

    carried = [c for c in rows.columns if c not in ("codes", "times")]
    known = kept(rows.mapInArrow(run, extended(
        rows.select(*carried).schema, n_best="long", count_sum="long", rest=_PAIRS)))
    rare = known.select("__row", F.explode("rest").alias("x")).select("__row", "x.code", "x.times")
    added = rare.join(pairs.where(F.col("n") < least), "code").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return known.drop("rest").join(added, "__row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
