"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own (hashed) vector and as a vector of its characters: the mean of its
trigrams' and the sum of its beginnings' (hashed).  Two gated recurrent layers read a window
of words forwards and backwards, attention weighs the states, and a logistic unit scores the
window.  A document's score is that of its highest window; windows overlap and cover the
whole text.

Labels mark documents, not windows, so training takes, epoch by epoch, the windows of each
document that the network finds highest, and sets those to the document's label.

The network learns from a bounded sample of labelled documents (``fit_docs`` of each class
with at most ``fit_words`` words each).  Scoring looks at text only.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.llm.common import derived

WINDOW, STRIDE = 32, 16
_WORD_ROWS, _CHAR_ROWS, _BYTES = 1 << 13, 1 << 15, 24
_words = re.compile(r"[^\W\d_]+").findall
_CACHE = 200_000


def _pieces(word: str) -> list[str]:
    """A word in pieces of at most ``_BYTES`` bytes, each overlapping the next by half: none of its bytes goes unread."""
    size = len(word.encode("utf-8", "surrogatepass"))
    if size <= _BYTES:
        return [word]
    n = _BYTES // max(len(c.encode("utf-8", "surrogatepass")) for c in word)
    return [word[i : i + n] for i in range(0, max(1, len(word) - n // 2), n // 2)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; long ones (in scripts without blanks whole sentences) in pieces."""
    if not isinstance(text, str):
        return []
    words = _words(text.lower())
    if max(map(len, words), default=0) <= _BYTES // 4:
        return words
    return [p for w in words for p in ([w] if len(w) <= _BYTES // 4 else _pieces(w))]


def windows(n: int) -> list[int]:
    """First words of the windows over ``n`` words; a text without words has one, empty."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of each word: its own, its trigrams' and its beginnings' (-1: none)."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    own = np.fromiter((zlib.crc32(w) % _WORD_ROWS for w in raw), np.int64, len(raw))
    held = np.zeros((len(raw), _BYTES + 2), np.uint64)
    if raw:
        held[:, 1:-1] = np.frombuffer(b"".join(w[:_BYTES].ljust(_BYTES, b"\0") for w in raw), np.uint8).reshape(len(raw), -1)
    size = np.minimum(np.array([len(w) for w in raw], np.int64), _BYTES)
    held[:, 0] = 1
    held[np.arange(len(raw)), size + 1] = 2
    mixed = np.uint64(0x9E3779B97F4A7C15)
    tri = ((held[:, :-2] * np.uint64(65599) + held[:, 1:-1]) * np.uint64(65599) + held[:, 2:] + np.uint64(17)) * mixed >> np.uint64(49)
    tri = np.where(np.arange(_BYTES) < size[:, None], tri.astype(np.int64) % _CHAR_ROWS, -1)
    begin, h = [], np.zeros(len(raw), np.uint64)
    for k in range(10):  # the first k + 1 bytes, and whether the word goes on
        h = (h + held[:, k + 1] + np.uint64(k + 1)) * mixed
        if k >= 3:
            on = (h ^ (size > k + 1).astype(np.uint64)) * mixed
            begin.append(np.where(size > k, (on >> np.uint64(49)).astype(np.int64) % _CHAR_ROWS, -1))
    return own, tri, np.stack(begin, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, word_dim: int = 8, char_dim: int = 8, hidden: int = 8, seed: int = 6):
        rng = np.random.default_rng(seed)
        d, h = word_dim + char_dim, hidden
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.word_dim = h, word_dim
        self.p = {
            # Zero: what was never learnt from says nothing.
            "word": np.zeros((_WORD_ROWS, word_dim), np.float32), "char": np.zeros((_CHAR_ROWS, char_dim), np.float32),
            "att": normal(2 * h, h), "att_v": normal(h), "out": normal(2 * h), "bias": np.full(1, -1.0, np.float32),
        }
        for k in "fb":
            self.p |= {f"w{k}": normal(d, 3 * h), f"u{k}": normal(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.slope, self.shift, self.empty = 1.0, 0.0, 0.1

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The network's input vectors of words."""
        own, tri, begin = features(words)
        char = self.p["char"]
        n_tri = np.maximum((tri >= 0).sum(1), 1).astype(np.float32)
        c = np.zeros((len(words), char.shape[1]), np.float32)
        for col in tri.T:
            c += char[col] * (col >= 0)[:, None]
        c /= n_tri[:, None]
        for col in begin.T:
            c += char[col] * (col >= 0)[:, None]
        return np.concatenate([self.p["word"][own], c], axis=1), (own, tri, begin, n_tri)

    def _direction(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; ``x``: projected inputs, time first."""
        h, u = self.hidden, self.p[f"u{k}"]
        steps = range(len(x)) if k == "f" else range(len(x) - 1, -1, -1)
        state, states, trace = np.zeros((x.shape[1], h), np.float32), np.zeros((len(x), x.shape[1], h), np.float32), {}
        for t in steps:
            hu = state @ u
            zr = x[t][:, : 2 * h] + hu[:, : 2 * h]
            np.negative(zr, out=zr); np.exp(zr, out=zr); zr += 1; np.reciprocal(zr, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t][:, 2 * h :] + r * hu[:, 2 * h :])
            m = mask[t][:, None]
            now = state + m * (1 - z) * (n - state)
            if keep:
                trace[t] = (z, r, n, hu[:, 2 * h :], state)
            state = states[t] = now
        return states, trace

    def forward(self, x: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of windows from projected inputs (``time x window x 3 hidden`` per direction)."""
        f, tf = self._direction("f", x["f"], mask, keep)
        b, tb = self._direction("b", x["b"], mask, keep)
        s = np.concatenate([f, b], axis=2)
        a = np.tanh(s @ self.p["att"])
        e = np.where(mask > 0, a @ self.p["att_v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * s).sum(0) * mask.max(0)[:, None]
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (s, a, w, pooled, tf, tb)) if keep else logit

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"w{k}"] + self.p[f"c{k}"] for k in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss, and that of the inputs ``x`` (time first)."""
        p, h, g = self.p, self.hidden, {}
        logit, (s, a, w, pooled, tf, tb) = self.forward(self.projected(x), mask, keep=True)
        d = ((_sigmoid(logit) - label) * weight).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["out"] * mask.max(0)[:, None]
        ds = w[:, :, None] * dp
        dw = (s * dp).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att_v"] = (a * de[:, :, None]).sum((0, 1))
        g["att"] = np.einsum("tbi,tbj->ij", s, da)
        ds = ds + da @ p["att"].T
        dx = np.zeros_like(x)
        for k, trace, part in (("f", tf, ds[:, :, :h]), ("b", tb, ds[:, :, h:])):
            u, du, dproj = p[f"u{k}"], np.zeros_like(p[f"u{k}"]), np.zeros((*x.shape[:2], 3 * h), np.float32)
            back = np.zeros((x.shape[1], h), np.float32)
            for t in (range(len(x) - 1, -1, -1) if k == "f" else range(len(x))):
                z, r, n, hun, before = trace[t]
                back = back + part[t]
                m = mask[t][:, None]
                dm = back * m
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (before - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dh = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dh
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
                back = back * (1 - m) + dm * z + dh @ u.T
            g[f"u{k}"], g[f"c{k}"] = du, dproj.sum((0, 1))
            g[f"w{k}"] = np.einsum("tbi,tbj->ij", x, dproj)
            dx += dproj @ p[f"w{k}"].T
        return g, dx

    def logits(self, ids: np.ndarray, mask: np.ndarray, table: dict[str, np.ndarray], rows: int = 4096) -> np.ndarray:
        """Logits of windows given as word numbers (``window x time``) into projected tables."""
        out = np.zeros(len(ids), np.float32)
        for a in range(0, len(ids), rows):
            part = np.ascontiguousarray(ids[a : a + rows].T)
            m = np.ascontiguousarray(mask[a : a + rows].T).astype(np.float32)
            out[a : a + rows] = self.forward({k: v[part] for k, v in table.items()}, m)
        return out


def _windowed(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (``window x time``) into the words of all texts on end, masks, and each window's text."""
    at, own, base = [], [], 0
    last = []
    for i, n in enumerate(counts):
        first = windows(n)
        at += [base + f for f in first]
        own += [i] * len(first)
        last += [base + n] * len(first)
        base += n
    position = np.array(at, np.int64)[:, None] + np.arange(WINDOW)
    mask = position < np.array(last, np.int64)[:, None]
    return np.where(mask, position, 0), mask, np.array(own, np.int64)


def train(texts: list[str], labels: list[int], prevalence: float, epochs: int = 12, seed: int = 6, rate: float = 0.01) -> Network:
    """A network fitted to documents; one fifth of them only sets the score's scale.

    ``prevalence`` is the share of label 1 among all labelled rows: the sample holds the
    classes in other shares.
    """
    net, rng = Network(seed=seed), np.random.default_rng(seed)
    split = [words_of(x) for x in texts]
    names = sorted({w for ws in split for w in ws}) or [""]
    number = {w: i for i, w in enumerate(names)}
    stream = np.array([number[w] for ws in split for w in ws] or [0], np.int64)
    position, mask, own = _windowed([len(ws) for ws in split])
    ids, y = stream[position], np.array(labels, np.float32)
    if not len(texts) or y.min() == y.max():
        net.shift = float(np.log(max(prevalence, 1e-3) / max(1 - prevalence, 1e-3))) + 1.0
        net.empty = min(max(prevalence, 0.0), 1.0)
        return net
    scale = np.arange(len(texts)) % 5 == 4
    share = y.mean()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        x, (f_own, f_tri, f_begin, n_tri) = net.inputs(names)
        score = net.logits(ids, mask, net.projected(x))
        by = np.lexsort((-score, own))
        nth = np.arange(len(by)) - np.searchsorted(own[by], own[by])
        chosen = by[nth < (2 if epoch < epochs // 2 else 1)]
        others = by[(nth >= 2) & (y[own[by]] == 0)]
        if len(others):
            chosen = np.concatenate([chosen, rng.choice(others, min(len(others), len(texts)), replace=False)])
        chosen = rng.permutation(chosen[~scale[own[chosen]]])
        for a in range(0, len(chosen), 256):
            pick = chosen[a : a + 256]
            used, at = np.unique(ids[pick], return_inverse=True)
            o, tri, begin, n3 = f_own[used], f_tri[used], f_begin[used], n_tri[used]
            char = net.p["char"]
            c = (char[tri] * (tri >= 0)[:, :, None]).sum(1) / n3[:, None] + (char[begin] * (begin >= 0)[:, :, None]).sum(1)
            xs = np.concatenate([net.p["word"][o], c], axis=1).astype(np.float32)
            m = mask[pick].T.astype(np.float32)
            label = y[own[pick]]
            weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / len(pick)
            g, dx = net.gradients(xs[at.reshape(len(pick), -1).T], m, label, weight.astype(np.float32))
            dxs = np.zeros_like(xs)
            np.add.at(dxs, at.reshape(len(pick), -1).T, dx * m[:, :, None])
            gw, gc, dc = np.zeros_like(net.p["word"]), np.zeros_like(char), dxs[:, net.word_dim :]
            np.add.at(gw, o, dxs[:, : net.word_dim])
            r, k = np.nonzero(tri >= 0)
            np.add.at(gc, tri[r, k], dc[r] / n3[r][:, None])
            r, k = np.nonzero(begin >= 0)
            np.add.at(gc, begin[r, k], dc[r])
            g |= {"word": gw, "char": gc}
            step += 1
            for name, grad in g.items():
                m1, m2 = moment[name]
                m1 += 0.1 * (grad - m1)
                # One scale for a whole table of vectors: a rare row moves by its own small gradient.
                m2 += 0.01 * (((grad * grad).sum() / max(1, np.count_nonzero(grad)) if name in ("word", "char") else grad * grad) - m2)
                net.p[name] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    x, _ = net.inputs(names)
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, own, net.logits(ids, mask, net.projected(x)))
    _calibrate(net, best[scale] if len(set(y[scale])) == 2 else best, y[scale] if len(set(y[scale])) == 2 else y, prevalence)
    return net


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray, prevalence: float) -> None:
    """Logistic scale and shift of the document logit, classes weighted as in the whole table."""
    logit = logit.astype(np.float64)
    w = np.where(y > 0, prevalence / max(y.mean(), 1e-9), (1 - prevalence) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge towards the raw logit
        q = _sigmoid(a * logit + b)
        e, s = w * (q - y), w * q * (1 - q)
        ga, gb = (e * logit).sum() + (a - 1), e.sum() + 0.1 * b
        haa, hab, hbb = (s * logit * logit).sum() + 1, (s * logit).sum(), s.sum() + 0.1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / (abs(da) + abs(db) + 1e-9))
        a, b = max(0.05, a - scale * da), b - scale * db
    net.slope, net.shift = float(a), float(b)
    net.empty = float(min(_sigmoid(np.float64(a * net.p["bias"][0] + b)), prevalence))


class Scorer:
    """Scores texts; remembers the projected inputs of words it has seen."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.number, self.table, self.new = {}, {k: np.zeros((0, 3 * self.net.hidden), np.float32) for k in "fb"}, []

    def _ids(self, words: list[str]) -> list[int]:
        number, new = self.number, self.new
        out = []
        for w in words:
            i = number.get(w)
            if i is None:
                i = number[w] = len(number)
                new.append(w)
            out.append(i)
        return out

    def score(self, texts: list[str | None], chunk_words: int = 400_000) -> np.ndarray:
        out, a = np.full(len(texts), self.net.empty), 0
        while a < len(texts):
            if len(self.number) > _CACHE:
                self._forget()
            flat, counts, b = [], [], a
            while b < len(texts) and (b == a or len(flat) < chunk_words):
                ids = self._ids(words_of(texts[b]))
                flat += ids
                counts.append(len(ids))
                b += 1
            if self.new:
                fresh = self.net.projected(self.net.inputs(self.new)[0])
                self.table = {k: np.concatenate([v, fresh[k].astype(np.float32)]) for k, v in self.table.items()}
                self.new = []
            if flat:
                position, mask, own = _windowed(counts)
                logit = self.net.logits(np.array(flat, np.int64)[position], mask, self.table)
                best = np.full(b - a, -np.inf)
                np.maximum.at(best, own, logit.astype(np.float64))
                filled = np.array(counts) > 0
                out[a:b][filled] = _sigmoid(self.net.slope * best[filled] + self.net.shift)
            a = b
        return out


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 800, fit_words: int = 3000, epochs: int = 12) -> Network:
    """Learns from up to ``fit_docs`` documents of each label, in hash order of their numbers.

    Documents of more than ``fit_words`` words are not learnt from.  Labels are drawn first,
    so only the drawn documents' texts reach the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fit_docs).select("doc_id", "toxic")
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= 8 * fit_words)).select("doc_id", "text").join(
        F.broadcast(drawn), "doc_id")  # two times fit_docs rows at most
    sample = sorted(((r["doc_id"], r["toxic"], r["text"]) for r in rows.collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return train([r[2] for r in sample], [r[1] for r in sample], shares.get(1, 0) / total if total else 0.0, epochs)


def score(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every row: its highest window's; without words (null, empty) a fixed low one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: {"score": scorer.score(texts)}

    return derived(docs, [text], make, keep, score="double")
