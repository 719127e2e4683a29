"""Cascaded fern regression of landmark shapes.

Training rows stay distributed.  A fern costs three aggregations whose results are
bounded by the parameters, never by the data: covariances (pairs x candidates), the
largest difference per chosen pair, and the bin sums (2^pairs x coordinates).  The
residual is recomputed from the few ferns learnt since it was last written, so no
chain of intermediate tables builds up.  The model is a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinestat.functions import shapes as sh
from cinestat.operators.features import covariance_long
from cinestat.operators.ranking import seeded_key, shuffled
from cinestat.session import cut_lineage, settle

BOX = ["start_x", "start_y", "width", "height", "centroid_x", "centroid_y"]


@dataclass
class Fern:
    """Pixel pairs (positions in the candidate list), thresholds and bin outputs."""

    pairs: np.ndarray
    thresholds: np.ndarray
    bins: np.ndarray

    def index(self, dens: np.ndarray) -> np.ndarray:
        bits = dens[:, self.pairs[:, 0]] - dens[:, self.pairs[:, 1]] >= self.thresholds
        return bits @ (1 << np.arange(len(self.pairs)))


@dataclass
class Cascade:
    """Candidate offsets, the landmark each one hangs on, and the ferns."""

    offsets: np.ndarray
    anchors: np.ndarray
    ferns: list[Fern] = field(default_factory=list)

    def delta(self, dens: np.ndarray) -> np.ndarray:
        return sum(f.bins[f.index(dens)] for f in self.ferns)


@dataclass
class Model:
    mean: np.ndarray
    cascades: list[Cascade]


def _unit(shape: np.ndarray, box: np.ndarray) -> np.ndarray:
    return (shape - box[:, None, 4:6]) / (box[:, None, 2:4] / 2)


def _image(unit: np.ndarray, box: np.ndarray) -> np.ndarray:
    return unit * (box[:, None, 2:4] / 2) + box[:, None, 4:6]


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batch scale and 2x2 rotation that carry ``b`` to ``a`` (see ``functions.shapes``)."""
    a = a - a.mean(-2, keepdims=True)
    b = b - b.mean(-2, keepdims=True)
    size = [np.sqrt(((s[..., 0] - s[..., 1]) ** 2).sum(-1) / 2) for s in (a, b)]
    num = (a[..., 1] * b[..., 0] - a[..., 0] * b[..., 1]).sum(-1)
    den = (a * b).sum((-1, -2))
    norm = np.hypot(num, den)
    c, s = den / norm, num / norm
    return size[0] / size[1], np.stack([np.stack([c, -s], -1), np.stack([s, c], -1)], -2)


def densities(px: list, width: np.ndarray, shape: np.ndarray, box: np.ndarray, mean: np.ndarray, cascade: Cascade) -> np.ndarray:
    """Intensity under every candidate pixel, placed relative to the current shape."""
    scale, rot = _similarity(_unit(shape, box), mean)
    moved = np.einsum("nij,pj->npi", rot, cascade.offsets) * scale[:, None, None] * box[:, None, 2:4] / 2
    at = moved + shape[:, cascade.anchors]
    out = np.empty(at.shape[:2])
    for i, (flat, w) in enumerate(zip(px, width)):
        h = len(flat) // w
        x = np.clip(at[i, :, 0], 0, w - 1).astype(int)
        y = np.clip(at[i, :, 1], 0, h - 1).astype(int)
        out[i] = np.asarray(flat)[y * w + x]
    return out


def advance(shape: np.ndarray, box: np.ndarray, mean: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Apply a normalised shape step: back into the box frame, then to the image."""
    unit = _unit(shape, box)
    scale, rot = _similarity(unit, mean)
    step = scale[:, None, None] * np.einsum("nlj,nij->nli", delta, rot)
    return _image(unit + step, box)


def _stack(pdf: pd.DataFrame, column: str, *tail: int) -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(float).reshape(len(pdf), *tail)


def augment(samples: DataFrame, id_: str, starts: int, seed: int) -> DataFrame:
    """``starts`` rows per sample: a jittered box and the shape of another sample in it.

    Partners are found by rank: a permutation of the samples and a hashed offset.
    """
    ranked = shuffled(samples.select(id_, "px", "width", "box", "pts"), seed, id_)
    n = samples.agg(F.count("*").alias("n")).scalar()

    def hashed(part: str) -> Column:
        digits = F.substring(seeded_key(seed, part, id_, "start"), 1, 8)
        return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))

    rows = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    rows = rows.withColumns({"ja": F.lit("partner"), "jb": F.lit("size")})
    hop = 1 + F.floor(hashed("ja") * F.greatest(n - 1, F.lit(1)))
    rows = rows.withColumn("partner", F.pmod(F.col("rn") - 1 + hop, n) + 1).withColumn("grow", F.lit(0.5) + hashed("jb") * 0.7)
    b, g = F.col("box"), F.col("grow")
    w, h = b["width"] * g, b["height"] * g
    x, y = b["start_x"] - (w - b["width"]) / 2, b["start_y"] - (h - b["height"]) / 2
    jittered = F.struct(
        x.alias("start_x"), y.alias("start_y"), w.alias("width"), h.alias("height"),
        (x + w / 2).alias("centroid_x"), (y + h / 2).alias("centroid_y"),
    )
    others = ranked.select(F.col("rn").alias("partner"), sh.project(F.col("pts"), F.col("box")).alias("unit"))
    placed = rows.withColumn("box", jittered).join(others, "partner")
    flat = lambda c: F.flatten(F.transform(c, lambda p: F.array(p["x"], p["y"])))
    return placed.select(
        id_, "start", "px", "width", F.array(*[F.col("box")[c] for c in BOX]).alias("box"),
        flat("pts").alias("truth"), flat(sh.reproject(F.col("unit"), F.col("box"))).alias("shape"),
    )


def mean_unit_shape(samples: DataFrame) -> np.ndarray:
    """Mean landmark positions in box units; one row per landmark reaches the driver."""
    long = samples.select(F.posexplode(sh.project(F.col("pts"), F.col("box"))).alias("pos", "p"))
    rows = long.groupBy("pos").agg(F.avg("p.x"), F.avg("p.y")).orderBy("pos").collect()
    return np.array([r[1:] for r in rows])


def _candidates(mean: np.ndarray, n: int, rng: np.random.Generator) -> Cascade:
    at = rng.uniform(-1.2, 1.2, (n, 2))
    anchors = ((at[:, None] - mean[None]) ** 2).sum(-1).argmin(1)
    return Cascade(at - mean[anchors], anchors)


def _shape_features(cascade: Cascade, mean: np.ndarray, landmarks: int, id_: str, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            shape, truth = _stack(pdf, "shape", landmarks, 2), _stack(pdf, "truth", landmarks, 2)
            box = _stack(pdf, "box", 6)
            scale, rot = _similarity(mean[None], _unit(shape, box))
            gap = _unit(truth, box) - _unit(shape, box)
            target = scale[:, None, None] * np.einsum("nlj,nij->nli", gap, rot)
            dens = densities(pdf["px"], pdf["width"], shape, box, mean, cascade)
            yield pd.DataFrame({
                id_: pdf[id_], "start": pdf["start"], "dens": list(dens), "target": list(target.reshape(len(pdf), -1)),
            })

    return run, f"{id_} {kind}, start int, dens array<double>, target array<double>"


def _residual(pdf: pd.DataFrame, ferns: list[Fern]) -> tuple[np.ndarray, np.ndarray]:
    dens, left = _stack(pdf, "dens", -1), _stack(pdf, "target", -1)
    for f in ferns:
        left = left - f.bins[f.index(dens)].reshape(len(pdf), -1)
    return dens, left


def _sums(rows: DataFrame, statistic: Callable[[pd.DataFrame], np.ndarray], how: str = "sum") -> np.ndarray:
    """Reduce a flat numpy statistic over all rows: one vector per task, then per position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            if len(pdf):
                part = statistic(pdf)
                acc = part if acc is None else (acc + part if how == "sum" else np.maximum(acc, part))
        if acc is not None:
            yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

    out = rows.mapInPandas(run, "i long, v double").groupBy("i").agg(getattr(F, how)("v").alias("v"))
    return np.array([r.v for r in out.orderBy("i").collect()])


def choose_pairs(cov: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """For every projection the unused pair with the largest |correlation|."""
    var = np.diag(cov)
    den = np.sqrt(np.maximum(var[:, None] + var[None] - 2 * cov, 0))
    chosen: list[tuple[int, int]] = []
    for c in proj:
        score = np.where(den < 1e-10, -1.0, np.abs(c[:, None] - c[None]) / np.where(den < 1e-10, 1.0, den))
        for a, b in chosen:
            score[a, b] = score[b, a] = -1.0
        chosen.append(np.unravel_index(score.argmax(), score.shape))
    return np.array(chosen)


def train_fern(
    rows: DataFrame, ferns: list[Fern], cov: np.ndarray, coords: int, pairs: int, rng: np.random.Generator, beta: float
) -> Fern:
    candidates = len(cov)
    dirs = rng.normal(size=(pairs, coords))
    dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)

    def cross(pdf: pd.DataFrame) -> np.ndarray:
        dens, left = _residual(pdf, ferns)
        t = left @ dirs.T
        return np.concatenate([[len(pdf)], t.sum(0), dens.sum(0), (t.T @ dens).ravel()])

    s = _sums(rows, cross)
    n, st, sd = s[0], s[1 : 1 + pairs], s[1 + pairs : 1 + pairs + candidates]
    proj = s[1 + pairs + candidates :].reshape(pairs, candidates) / n - np.outer(st, sd) / n**2
    picked = choose_pairs(cov, proj)
    gap = _sums(rows, lambda pdf: np.abs(np.subtract(*(_stack(pdf, "dens", -1)[:, picked[:, i]] for i in (0, 1)))).max(0), "max")
    fern = Fern(picked, rng.uniform(-0.2, 0.2, pairs) * gap, np.zeros((2**pairs, coords // 2, 2)))

    def bin_sums(pdf: pd.DataFrame) -> np.ndarray:
        dens, left = _residual(pdf, ferns)
        out = np.zeros((2**pairs, 1 + coords))
        np.add.at(out, fern.index(dens), np.column_stack([np.ones(len(pdf)), left]))
        return out.ravel()

    b = _sums(rows, bin_sums).reshape(2**pairs, 1 + coords)
    count = np.maximum(b[:, :1], 1.0)
    fern.bins = (b[:, 1:] / ((1 + beta / count) * count)).reshape(-1, coords // 2, 2)
    return fern


def train(
    samples: DataFrame, id_: str, *, cascades: int = 10, ferns: int = 500, candidates: int = 400, pairs: int = 5,
    starts: int = 75, beta: float = 1000.0, seed: int = 0, rewrite_every: int = 50,
) -> Model:
    """Fit a model to ``(id, px, width, box, pts)``."""
    rng = np.random.default_rng(seed)
    mean = mean_unit_shape(samples)
    kind, coords = dict(samples.dtypes)[id_], mean.size
    rows = cut_lineage(augment(samples, id_, starts, seed))
    model = Model(mean, [])
    for _ in range(cascades):
        cascade = _candidates(mean, candidates, rng)
        run, ddl = _shape_features(cascade, mean, len(mean), id_, kind)
        base = settle(rows.mapInPandas(run, ddl))
        table = covariance_long(base, "dens").collect()
        cov = np.zeros((candidates, candidates))
        for i, j, v in table:
            cov[i, j] = cov[j, i] = v
        recent: list[Fern] = []
        for _ in range(ferns):
            fern = train_fern(base, recent, cov, coords, pairs, rng, beta)
            cascade.ferns.append(fern)
            recent.append(fern)
            if len(recent) == rewrite_every:
                base, recent = _rewrite(base, recent, id_, kind), []
        base.unpersist()
        model.cascades.append(cascade)
        rows = cut_lineage(_step(rows, model, id_, kind))
    return model


def _rewrite(base: DataFrame, ferns: list[Fern], id_: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(target=list(_residual(pdf, ferns)[1]))

    return settle(cut_lineage(base.mapInPandas(run, f"{id_} {kind}, start int, dens array<double>, target array<double>")), base)


def _step(rows: DataFrame, model: Model, id_: str, kind: str) -> DataFrame:
    """Move the current shapes by the cascade learnt last."""
    cascade, mean = model.cascades[-1], model.mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                shape, box = _stack(pdf, "shape", len(mean), 2), _stack(pdf, "box", 6)
                dens = densities(pdf["px"], pdf["width"], shape, box, mean, cascade)
                moved = advance(shape, box, mean, cascade.delta(dens))
                yield pdf.assign(shape=list(moved.reshape(len(pdf), -1)))

    return rows.mapInPandas(run, rows.schema)


def predict(images: DataFrame, id_: str, model: Model, starts: int = 1, seed: int = 0) -> DataFrame:
    """Landmarks for ``(id, px, width, box)``: mean over several seeded starts.

    The first start is the mean shape in the given box; the others jitter both.
    """
    mean = model.mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            box0 = np.array([[b[c] for c in BOX] for b in pdf["box"]], float)
            total = np.zeros((len(pdf), *mean.shape))
            for i in range(starts):
                rng = np.random.default_rng([seed, i])
                start, box = mean, box0.copy()
                if i:
                    start = mean + rng.uniform(-0.125, 0.125, mean.shape)
                    box[:, 2:4] *= rng.uniform(0.5, 1.0)
                    box[:, :2] -= (box[:, 2:4] - box0[:, 2:4]) / 2
                    box[:, 4:6] = box[:, :2] + box[:, 2:4] / 2
                shape = _image(np.broadcast_to(start, total.shape), box)
                for cascade in model.cascades:
                    dens = densities(pdf["px"], pdf["width"], shape, box, mean, cascade)
                    shape = advance(shape, box, mean, cascade.delta(dens))
                total += shape
            yield pd.DataFrame({id_: pdf[id_], "flat": list((total / starts).reshape(len(pdf), -1))})

    kind = dict(images.dtypes)[id_]
    out = images.select(id_, "px", "width", "box").mapInPandas(run, f"{id_} {kind}, flat array<double>")
    return out.select(id_, sh.points(F.col("flat")).alias("pts"))


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """The model as rows ``(cascade, part, number, ints, nums)`` for parquet."""
    rows = [(-1, "mean", 0, [], model.mean.ravel().tolist())]
    for c, cascade in enumerate(model.cascades):
        rows.append((c, "candidates", 0, cascade.anchors.tolist(), cascade.offsets.ravel().tolist()))
        for f, fern in enumerate(cascade.ferns):
            rows.append((c, "fern", f, fern.pairs.ravel().tolist(), fern.thresholds.tolist()))
            rows.append((c, "bins", f, [], fern.bins.ravel().tolist()))
    return spark.createDataFrame(rows, "cascade int, part string, number int, ints array<int>, nums array<double>")


def load_model(table: DataFrame) -> Model:
    """Inverse of :func:`model_table`; a model is bounded by its training parameters."""
    rows = {(r.cascade, r.part, r.number): r for r in table.collect()}
    mean = np.array(rows[-1, "mean", 0].nums).reshape(-1, 2)
    cascades = []
    for c in sorted({k[0] for k in rows if k[0] >= 0}):
        head = rows[c, "candidates", 0]
        ferns = [
            Fern(
                np.array(rows[c, "fern", f].ints).reshape(-1, 2), np.array(rows[c, "fern", f].nums),
                np.array(rows[c, "bins", f].nums).reshape(-1, len(mean), 2),
            )
            for f in range(sum(1 for k in rows if k[0] == c and k[1] == "fern"))
        ]
        cascades.append(Cascade(np.array(head.nums).reshape(-1, 2), np.array(head.ints), ferns))
    return Model(mean, cascades)
