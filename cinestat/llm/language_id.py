"""Language identification by cross-parsing against suffix automata of labelled text.

A text is parsed greedily into the longest phrases that occur in a language's sample; a
language that fits needs few of them.  Phrases are normalised to bits per character
(``phrases * log2(sample length) / characters``), so samples of unequal length compare.

A suffix automaton is stored as a dense table of completed transitions: where no longer
match exists, the entry leads to the state of the single next character and carries a flag
that counts one phrase.  Following a text is then one table look-up per character, done for
all texts of a batch side by side.

Defined cases: a null text, and a text without a letter, is ``und`` with score 0.  Letters
that no sample has are phrases of their own.  Equal bits go to the language that sorts first.
A phrase never crosses a multiple of ``BLOCK`` normalised characters.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.llm.common import derived
from cinestat.session import kept

UNDETERMINED = "und"
BLOCK = 2048
FLAG = np.int32(1 << 30)
_BATCH_CHARS = 2_000_000


def sample_texts(
    labelled: DataFrame, sample_chars: int = 20_000, sample_rows: int = 400, text: str = "text", label: str = "lang",
) -> dict[str, str]:
    """Distinct texts in hash order, per language up to ``sample_chars`` characters in all.

    This is the bound on what the classifier learns from: texts that would pass it are left
    out, equal texts count once.  Texts longer than half of it come after all others, each with
    its first ``sample_chars // 2`` characters; a language with few short texts so has a sample.
    Texts are drawn by hash alone; only the sample comes to the driver.  Labels are few: a row
    of counts for each is broadcast.
    """
    half = sample_chars // 2
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) > 0)).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    one = kept(known.groupBy("label", "h").agg(F.least(F.min("n"), F.lit(half + 1)).alias("n")).withColumn("long", F.col("n") > half))
    # Per language a share of the hash range that holds enough texts: without it every task would send its own.
    counts = one.groupBy("label", "long").agg(F.count("*").alias("texts"))
    share = F.least(F.lit(1.0), F.lit(8.0 * sample_rows) / F.col("texts"))
    drawn = one.join(F.broadcast(counts), ["label", "long"]).where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    first = drawn.withColumn("r", F.row_number().over(Window.partitionBy("label", "long").orderBy("h"))).where(F.col("r") <= sample_rows)
    upto = Window.partitionBy("label").orderBy("long", "h").rowsBetween(Window.unboundedPreceding, 0)
    taken = first.withColumn("sum", F.sum(F.least("n", F.lit(half))).over(upto)).where(F.col("sum") <= sample_chars).select("label", "long", "h")
    texts = known.join(F.broadcast(taken), ["label", "h"]).select("label", "long", "h", F.substring("text", 1, half).alias("text"))
    out: dict[str, list[str]] = {}
    for row in texts.groupBy("label", "long", "h").agg(F.min("text").alias("text")).orderBy("label", "long", "h").collect():
        out.setdefault(row["label"], []).append(row["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def _folded(text: str) -> str:
    """Lower-case letters, every run of other characters as one space."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).strip()


def _automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton of a sequence: transitions and suffix links, state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({}); link.append(0); length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link


class CrossParser:
    """The languages' tables; small enough to broadcast (samples are bounded)."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = {k: _folded(samples[k]) for k in self.languages}
        letters = sorted(set("".join(folded.values())) - {" "})
        self.codes = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(self.codes) + 1  # the last code stands for any other letter
        self.tables, self.bits = [], []
        for k in self.languages:
            self.tables.append(self._table([self.codes[c] for c in folded[k]]))
            self.bits.append(math.log2(max(2, len(folded[k]))))

    def _table(self, codes: list[int]) -> np.ndarray:
        nxt, _ = _automaton(codes)
        dead, a = len(nxt), self.width
        fresh = np.full(a, dead * a, np.int32)
        for c, s in nxt[0].items():
            fresh[c] = s * a
        table = np.tile(fresh | FLAG, (dead + 1, 1))
        table[0] = fresh
        for s, row in enumerate(nxt):
            for c, to in row.items():
                table[s, c] = to * a
        return table.reshape(-1)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts on end, each text's count of them, and whether it has a letter."""
        folded = "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n"
        points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        to = np.zeros(0x110000, np.uint16)
        for u in np.flatnonzero(seen):
            if chr(u).isalpha():
                to[u] = self.codes.get(chr(u), self.width - 1)
        codes = to[points]
        end = points == 10
        of = np.cumsum(end) - end
        start = np.concatenate(([True], end[:-1]))
        before = np.concatenate(([0], codes[:-1]))
        keep = ~end & ((codes > 0) | ((before > 0) & ~start))
        counts = np.bincount(of[keep], minlength=len(texts))
        letters = np.bincount(of[codes > 0], minlength=len(texts)) > 0
        return codes[keep], counts, letters

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases needed by text and language, characters parsed, and whether there is a letter."""
        codes, counts, letters = self._encode(texts)
        blocks = -(-counts // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * BLOCK
        size = np.minimum(counts[of] - nth * BLOCK, BLOCK)
        by = np.argsort(-size, kind="stable")
        of, begin, size = of[by], begin[by], size[by]
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(of):
            return found, counts, letters
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than the step
        lanes = [codes[begin[:k] + t].astype(np.int32) for t, k in enumerate(active)]
        for j, table in enumerate(self.tables):
            state, n = np.zeros(len(of), np.int32), np.ones(len(of), np.int32)
            for codes_now, k in zip(lanes, active):
                s = state[:k]
                np.add(s, codes_now, out=s)
                got = table.take(s)
                n[:k] += got >> 30
                np.bitwise_and(got, FLAG - 1, out=s)
            found[:, j] = np.bincount(of, weights=n, minlength=len(texts))
        return found, counts, letters

    def predict(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """``lang_pred``, ``score`` and ``bits_per_char`` (of the winner) of every text."""
        values = [x if isinstance(x, str) else "" for x in texts]
        size = np.fromiter(map(len, values), np.int64, len(values))
        cut = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, _BATCH_CHARS)))
        edges = [0, *[int(x) for x in cut if 0 < x < len(values)], len(values)]
        langs, score, bits = [], [], []
        for a, b in zip(edges, edges[1:]):
            found, counts, letters = self.phrases(values[a:b])
            rate = found * np.array(self.bits) / np.maximum(counts, 1)[:, None]
            best = rate.argmin(1) if rate.size else np.zeros(b - a, int)
            least = rate.min(1) if rate.size else np.zeros(b - a)
            weight = np.exp2(-(rate - least[:, None]) * np.minimum(counts, 50)[:, None])
            sure = 1 / weight.sum(1) if rate.size else np.zeros(b - a)
            known = letters & bool(self.languages)
            langs += [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            score.append(np.where(known, sure, 0.0))
            bits.append(np.where(known, least, np.nan))
        return {"lang_pred": langs, "score": np.concatenate(score), "bits_per_char": np.concatenate(bits)}


def fit(labelled: DataFrame, sample_chars: int = 20_000, text: str = "text", label: str = "lang") -> CrossParser:
    """Learns from a bounded sample (see :func:`sample_texts`) of ``labelled``."""
    return CrossParser(sample_texts(labelled, sample_chars, text=text, label=label))


def identify(docs: DataFrame, model: CrossParser, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` and ``lang_pred``, ``score``, ``bits_per_char`` (of the winner) of every row.

    Only ``text`` is looked at.  ``prefix`` goes before the three names where the table has
    columns so called; without it theirs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        parser = shared.value
        return lambda texts: {prefix + k: v for k, v in parser.predict(texts).items()}

    return derived(docs, [text], make, keep, **{f"{prefix}lang_pred": "string", f"{prefix}score": "double", f"{prefix}bits_per_char": "double"})


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rejected(prefix: str = "") -> Column:
    """No language: not a single letter.  Anything with words stays, however poor its fit."""
    return F.col(f"{prefix}lang_pred") == UNDETERMINED
