"""Packing documents into windows of fixed length by best-fit decreasing.

A document's tokens are cut into full windows first; what is left is one piece shorter than
a window.  Best-fit decreasing depends on piece lengths alone, and there are at most
``window`` of them, so the packing is planned on their histogram: pieces of one length and
open windows of one remaining capacity are handled as runs.  A segment tree over remaining
capacities finds the tightest open window in ``log2(window)`` steps.  The plan says for runs
of pieces (by number within their length) where they go; pieces look their place up in it.
It is the packing that treats the pieces one by one, longest first.

The driver sees the histogram and the plan only.  Both are bounded by the window length:
a run of open windows moves to a smaller capacity each time it is filled.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cinestat.llm.common import derived, expanded, gapless
from cinestat.session import kept

END = 2
_CACHE = 500_000
_ODD = bytes([*range(9), *range(0x0E, 0x20), 0x7F, *range(0x80, 0xA0)])  # control characters: left to the tokenizer


class WordTokens:
    """Token ids of a text as little-endian unsigned 32-bit bytes, exactly as the tokenizer gives them.

    The tokenizer splits a lower-cased text into words by a pattern and encodes each word by
    itself, so words are encoded once and remembered.  That short way is taken for texts in
    which it provably agrees (Latin-1 without control separators and without the marker
    that special tokens begin with); every other text goes through the tokenizer as a whole.
    """

    def __init__(self, path: str | None = None):
        import re

        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        letter, digit, space = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall
        # The model's alphabet: printable bytes stand for themselves, the others are numbered from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        model = self.tokenizer.model.tokenize

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= _CACHE:
                    self.clear()
                if not word.isascii():
                    spelt = "".join(map(letters.__getitem__, word.encode()))
                else:
                    spelt = word
                ids = self[word] = np.asarray([t.id for t in model(spelt)], "<u4").tobytes()
                return ids

        self.words = Words()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
            simple = "<|" not in text and len(raw.translate(None, _ODD)) == len(raw)
        except UnicodeEncodeError:
            simple = False
        if not simple:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))


def pieces(docs: DataFrame, window: int = 4096, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``: full windows and the rest of every document."""
    def make():
        tokens, end = WordTokens(tokenizer), np.asarray([END], "<u4").tobytes()

        def cut(texts):
            rows, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(texts):
                ids = tokens.encode(value or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    rows.append(i); start.append(at); length.append(len(part) // 4); crc.append(zlib.crc32(part)); total.append(n)
            return rows, {"start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}

        return cut

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return expanded(plain, "text", make, ["doc_id"], start="long", length="long", ids_crc32="long", doc_tokens="long")


class CapacityTree:
    """Segment tree over capacities 0..size: which of them have an open window, and the least at or above a bound."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def least(self, bound: int) -> int | None:
        at = bound + self.leaves
        if self.open[at]:
            return bound
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(histogram: dict[int, int], window: int) -> np.ndarray:
    """Plan rows ``length, first, count, bin, each, offset``.

    The pieces ``first .. first + count - 1`` of a length fill windows from ``bin`` on,
    ``each`` to a window, the first of them at ``offset``.
    """
    tree, runs, plan, bins = CapacityTree(window), {}, [], 0

    def put(capacity: int, start: int, count: int) -> None:
        runs.setdefault(capacity, []).append((start, count))
        if len(runs[capacity]) == 1:
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        first, left = 0, histogram[length]
        while left:
            capacity = tree.least(length)
            if capacity is None:  # open as many new windows as this length fills
                capacity = window
                put(window, bins, -(-left // (window // length)))
                bins += runs[window][-1][1]
            start, count = runs[capacity].pop()
            if not runs[capacity]:
                tree.set(capacity, False)
            each = capacity // length
            if left >= each:
                used = min(count, left // each)
                taken = used * each
            else:
                used, each, taken = 1, left, left
            plan.append((length, first, taken, start, each, window - capacity))
            put(capacity - each * length, start, used)
            if used < count:
                put(capacity, start + used, count - used)
            first += taken
            left -= taken
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, window: int = 4096, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document and its place.

    ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and ``sequence_id``,
    ``offset``: the piece lies at ``offset .. offset + length - 1`` of that sequence, without
    gaps from 0.  A null text counts as empty: one piece with the end token.  Repeated rows
    are packed as often as they occur.
    """
    cut = kept(pieces(docs, window, tokenizer, doc_id, text))
    # At most ``window`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, window)
    shared = cut.sparkSession.sparkContext.broadcast(plan)
    numbered = gapless(cut, ["length"], [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")], "nth")

    def make():
        rows = shared.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        key = (rows[:, 0] << 44) + rows[:, 1]

        def place(length, nth):
            length, nth = np.array(length, np.int64), np.array(nth, np.int64)
            row = rows[np.searchsorted(key, (length << 44) + nth, side="right") - 1]
            into, each = nth - row[:, 1], np.maximum(row[:, 4], 1)
            return {"sequence_id": row[:, 3] + into // each, "offset": row[:, 5] + into % each * length}

        return place

    return derived(numbered, ["length", "nth"], make, cut.columns, sequence_id="long", offset="long")
