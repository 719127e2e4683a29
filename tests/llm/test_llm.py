"""The training-data operators against brute force, round trips and held-out labels."""

import heapq
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from cinestat.llm import (
    language_id, lines, mixing, near_copies, nearest, packing, queries, sharding, simhash_groups, spotsigs, substrings, toxicity,
)
from cinestat.session import ensure_checkpoint_dir
from oracle import compare, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and numbers, clashing names."""
    rng = random.Random(3)
    v = ["alpha", "the", "Beta", "gamma", "größe", "of", "delta", "naïve"]
    text = "\n".join(prose(rng, 12, v) for _ in range(9))
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, "other text of mine", None, "b", None), (2, text, "de", None, 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, "12 !?", "fr", "b", 5), (None, "no number at all", "en", "a", 3),
        (None, None, None, None, None), (6, prose(rng, 20_000, v), "en", "c", 9), (7, "Ünï © 中文 <|endoftext|>", "de", "c", 2),
        (8, "x", "en", "c", 1), (2**62 + 1, "x", "en", "c", 1), (2**62 + 3, text + "\nmore", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "fp", "score", "removed_lines", "lang_pred", "node", "group", "shard", "root", "key"):
        df = df.withColumn(c, F.lit("kept"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_rows_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (3, None), (8, 1)], "doc_id long, toxic int")
    for df in (odd, none):
        n = df.count()
        model = language_id.fit(df.where(~language_id.held_out()))
        told = language_id.identify(df, model, ["doc_id"]).collect()
        assert len(told) == n and all(0 <= r["score"] <= 1 for r in told)
        kept_columns = language_id.identify(df, model, df.columns, prefix="__")
        assert kept_columns.columns[: len(df.columns)] == df.columns and kept_columns.count() == n
        placed = sharding.shard(df, shards=4).collect()
        assert len(placed) == n
        by = defaultdict(list)
        for r in placed:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        pieces = packing.pack(df).collect()
        assert len({(r["doc_id"], r["ids_crc32"], r["start"]) for r in pieces}) <= len(pieces) and len(pieces) >= n
        net = toxicity.fit(df, labels, epochs=1)
        assert toxicity.score(df, net, ["doc_id"]).count() == n
        clean = lines.dedup(df)
        assert clean.count() == n and set(df.columns) <= set(clean.columns)
        cut = substrings.dedup(df)
        assert cut.count() == n and set(df.columns) <= set(cut.columns)
        mixed = mixing.mix(df).collect()
        assert len(mixed) == n and all(r["taken"] <= 3 * r["size"] for r in mixed)
        groups = simhash_groups.group(df).collect()
        assert len(groups) == n
        like = spotsigs.compare_with_edit(df).collect()
        assert len(like) == n and all(0 <= r["near_next"] <= 1 for r in like)
        spotsigs.near_pairs(df).collect()
        assert simhash_groups.representatives(df).columns == df.columns
        assert mixing.apply_mix(df).columns == df.columns
    large = language_id.identify(odd, model, ["doc_id"]).where("doc_id > 9").select("doc_id").collect()
    assert sorted(r[0] for r in large) == [2**62 + 1, 2**62 + 3]
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        if k < 4:
            assert docs.columns == odd.columns
    assert docs.count() > 0


def test_cross_parsing_equals_greedy_search(sf, spark):
    rng = random.Random(1)
    samples = {"a": prose(rng, 80, ["baba", "dada", "gaga"]), "b": prose(rng, 80, ["roro", "toto", "baro"])}
    parser = language_id.CrossParser(samples)

    def phrases(text, sample):
        n, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
        return n

    texts = [prose(rng, k, ["baba", "toto", "zaza", "baro"]) for k in (1, 5, 30, 60)]
    found, counts, letters = parser.phrases(texts)
    for i, text in enumerate(texts):
        assert counts[i] == len(text) + 0 and letters[i]
        assert [phrases(text, samples[k]) for k in parser.languages] == found[i].tolist()
    got = queries.QUERIES["op1_language_id"](spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    held = got.join(lang, "doc_id").where("held_out").select((F.col("lang_pred") == F.col("truth")).cast("int").alias("ok"))
    assert held.agg(F.avg("ok")).first()[0] > 0.95


def test_every_labelled_language_has_a_sample(spark):
    rng = random.Random(18)
    v, w = [f"wort{i}" for i in range(300)], [f"mot{i}" for i in range(300)]
    copies = [("de", prose(rng, 30, v)) for _ in range(5)] + [("fr", prose(rng, 4000, w)), ("fr", prose(rng, 4000, w))]
    df = spark.createDataFrame(copies, "lang string, text string")
    rows = df.where("lang = 'fr'").unionByName(df.where("lang = 'de'").crossJoin(spark.range(4000)).drop("id"))
    got = language_id.sample_texts(rows)
    assert sorted(got["de"].split("\n")) == sorted(t for k, t in copies if k == "de")
    assert sorted(x for x in got["fr"].split("\n")) == sorted(t[:10_000] for k, t in copies if k == "fr")


def test_gear_chunks():
    rng, gear = random.Random(2), substrings.gear_table()
    data = bytes(rng.randrange(97, 123) for _ in range(5000))
    h, naive = 0, []
    for b in data:
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        naive.append(h & int(substrings.MASK) == 0)
    ends = substrings.ends(data, gear)
    starts = [0, *ends[:-1]]
    assert ends[-1] == len(data)
    assert all(substrings.LEAST <= b - a <= substrings.MOST for a, b in list(zip(starts, ends))[:-1])
    assert all(naive[e - 1] or e - s == substrings.MOST for s, e in list(zip(starts, ends))[:-1])
    moved = substrings.ends(b"inserted at the front " + data, gear)
    assert len(set(e - 22 for e in moved) & set(ends)) > 0.9 * len(ends)
    word = "é中" * 500
    for e in substrings.ends(word.encode(), gear):
        word.encode()[:e].decode()


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(5)
    v = [f"w{i:04d}" for i in range(2000)]
    passage = prose(rng, 55, v)
    rows = [(i, prose(rng, 80, v) + (" " + passage if i % 5 == 0 else "") + " " + prose(rng, 40, v)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeats(df).collect()
    assert {r["doc_id"] for r in spans} == {i for i in range(60) if i % 5 == 0}
    assert [r["doc_id"] for r in spans if r["kept"]] == [0]
    for r in spans:
        assert dict(rows)[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode().strip() in passage
    cut = {r["doc_id"]: r["text"] for r in substrings.dedup(df).collect()}
    assert cut[0] == rows[0][1] and len(cut[5]) < len(rows[5][1]) and cut[7] == rows[7][1]


def test_no_shared_chunk_is_cut_everywhere(spark):
    rng = random.Random(15)
    v = [f"w{i:04d}" for i in range(2000)]
    before, edit, after = prose(rng, 60, v), prose(rng, 60, v), prose(rng, 60, v)
    edited = f"{before} {edit} {after}"
    rows = [(1, f"{before} {after}"), (5, edited), (9, edited), (11, f"{prose(rng, 40, v)} {edit} {prose(rng, 40, v)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeats(df).collect()
    assert {r["doc_id"] for r in spans if r["kept"]} == {1, 5} and {r["doc_id"] for r in spans if not r["kept"]} == {5, 9, 11}
    left = defaultdict(list)  # what dedup() leaves, as byte ranges of the texts
    for r in spans:
        if not r["kept"]:
            left[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
    every, whole = set(), set()
    for r in substrings.chunks(df).collect():
        every.add((r["digest"], r["length"]))
        if not any(a <= r["start"] < b for a, b in left[r["doc_id"]]):
            whole.add((r["digest"], r["length"]))
    assert whole == every
    cut = {r["doc_id"]: r["text"] for r in substrings.dedup(df).collect()}
    assert cut[1] == rows[0][1] and cut[9] == "" and edit[40:-40] in cut[5] and len(cut[5]) < len(edited) / 2 and len(cut[11]) < len(rows[3][1])


def test_shards_hold_equal_bytes_and_copies_together(spark, sf):
    out = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), shards=6).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 6 and size.max() < 1.2 * size.mean() and size.min() > 0.8 * size.mean()
    assert out.groupby(["text_crc32", "size"]).shard.nunique().max() == 1
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    size = sharding.shard(copies, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(size) == 8 and size.max() < 1.2 * size.mean()


def test_nearest(spark, sf):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 12))
    x[300:600] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("vec_id") % 20 == 0, k=20, leaf_rows=32, least_rows=900, share=1.0).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -s.round(9))) if i != q][:20]
        assert np.allclose(np.sort(g.score)[::-1], g.sort_values("rank").score) and list(g.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, s[g.vec_id])
        hit += len(set(order) & set(g.vec_id))
    assert got.query_id.nunique() == 45 and hit >= 0.9 * 45 * 20
    hot = got[got.query_id == 320].sort_values("rank")
    assert list(hot.vec_id[:3]) == [0, 300, 301]
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    y, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got, hit, n = queries.QUERIES["op4_nearest"](spark, sf).toPandas(), 0, 0
    for q, g in got.groupby("query_id"):
        s = y @ y[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit, n = hit + len(set(order) & set(g.vec_id)), n + len(order)
    assert hit >= 0.9 * n
    two = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<double>")
    assert nearest.search(two, F.col("vec_id") % 20 == 0).count() == 2
    assert nearest.search(two.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _queue(forest, x, sizes, rows):
    """The trees' leaves by one priority queue, a node at a time."""
    full, inner, out = forest.extended(x, query=True), forest.normal.shape[1], []
    for q in full:
        queue, got, ahead = [(0.0, t, 0) for t in range(forest.trees)], set(), 0
        while queue and ahead < rows:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                s = float(forest.normal[t, node] @ q - forest.cut[t, node])
                near = 2 * node + 1 + (s > 0)
                heapq.heappush(queue, (far + s * s, t, 4 * node + 3 - near))
                node = near
            got.add((t, node - inner))
            ahead += int(sizes[t, node - inner])
        out.append(got)
    return out


@pytest.mark.parametrize("shift", [0.0, 3.0])  # 3: clusters, of which a group of queries sees few
def test_nearest_compares_the_rows_of_the_queue(shift):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 10)) + shift * rng.standard_normal((20, 10))[rng.integers(0, 20, 3000)]
    x[50:80] = x[50]
    forest = nearest.Forest(x[:2000], trees=5, leaf_rows=20, rows=len(x))
    leaf = forest.leaves(x)
    sizes = np.stack([np.bincount(leaf[:, t], minlength=1 << forest.depth) for t in range(5)])
    asked, want = np.arange(0, 3000, 5), _queue(forest, x[::5], sizes, 900)
    bits, _ = forest.reached(x[::5], sizes, 900)
    got = np.unpackbits(bits, axis=-1, bitorder="little").view(bool)
    assert [set(zip(*(a.tolist() for a in np.nonzero(g)))) for g in got] == want
    n = 1 + np.arange(3000) % 3
    start = np.concatenate([[0], np.cumsum(n)])
    ids = rng.permutation(start[-1])
    best = nearest.Asked(forest, sizes, 900, x[::5], 7, float(np.abs(x).max()) * 10**0.5)
    for a in range(0, 3000, 700):
        b = min(a + 700, 3000)
        best.meet(x[a:b], leaf[a:b].T, ids[start[a]:start[b]], start[a:b + 1] - start[a])
    for i, number, score in best.found():
        seen = np.flatnonzero(got[i, np.arange(5), leaf].any(axis=1))
        pairs = sorted((-s, j) for r, s in zip(seen, np.einsum("j,ij->i", x[asked[i]], x[seen])) for j in ids[start[r]:start[r + 1]])[:7]
        assert np.allclose(score, [-s for s, _ in pairs]) and set(number) == {j for _, j in pairs}


def test_nearest_infinite_scores_tie():
    x = np.stack([1e200 * np.arange(1.0, 41.0), np.ones(40)], axis=1)
    forest = nearest.Forest(x / 1e200, trees=1, leaf_rows=100, rows=40)
    best = nearest.Asked(forest, np.array([[40]]), 40, x, 2, 40e200 * 2**0.5)
    with np.errstate(over="ignore"):
        best.meet(x, np.zeros((1, 40), np.uint8), np.arange(40), np.arange(41))
    assert all(number == [0, 1] and np.isinf(score).all() for _, number, score in best.found())


def test_nearest_disk_follows_the_rows(spark):
    folders = [str(f) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    folders.append(ensure_checkpoint_dir(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for d in folders for f in Path(d).rglob("*") if f.is_file())
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((6000, 8)).tolist())], "vec_id long, embedding array<double>")
    before = used()
    assert nearest.search(df, F.col("vec_id") % 20 == 0, leaf_rows=16, least_rows=1).count() == 300 * 20
    assert used() - before < 12 * 6000 * 8 * 8


def test_packing_is_best_fit_decreasing(spark, sf):
    rng = random.Random(4)
    for window in (16, 64):
        sizes = [rng.randint(1, window) for _ in range(400)]
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(window - s)
        histogram = defaultdict(int)
        for s in sizes:
            histogram[s] += 1
        plan = packing.best_fit_decreasing(dict(histogram), window)
        used = defaultdict(int)
        for length, _, count, start, each, offset in plan.tolist():
            for k in range(count):
                used[start + k // each] += length
        assert sorted(window - u for u in used.values()) == sorted(room)
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values(["sequence_id", "offset"])
    end = (got.offset + got.length).groupby(got.sequence_id)
    assert (end.shift(1).fillna(0) == got.offset).all() and end.max().max() <= 4096
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = defaultdict(int)
    for r in got.itertuples():
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids + [packing.END]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert all(seen[k] == len(tok.encode(v, add_special_tokens=False).ids) + 1 for k, v in text.items())
    words = packing.WordTokens()
    letters = [chr(c) for c in range(0x180)] + ["'s", "'t", "<|endoftext|>", "œ", "İ", "́"]
    for _ in range(300):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert words.encode(x) == np.asarray(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_network_gradients_and_held_out_labels():
    rng = np.random.default_rng(0)
    net = toxicity.Network(seed=1)
    x = rng.standard_normal((5, 4, 16)).astype(np.float32)
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    y, w = np.array([0, 1, 1, 0], np.float32), np.full(4, 0.25, np.float32)

    def loss():
        q = 1 / (1 + np.exp(-net.forward(net.projected(x), mask).astype(np.float64)))
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()

    g, dx = net.gradients(x, mask, y, w)
    for name in ("wf", "ub", "cf", "att", "att_v", "out", "bias"):
        p = net.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3
    r = random.Random(2)
    v = [f"{a}{b}" for a in ("ta", "ro", "mi", "ne", "lu") for b in ("ka", "do", "si", "fe", "gu")]
    texts, labels = [], []
    for i in range(300):
        words = [r.choice(v) for _ in range(r.randrange(5, 150))]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words))] = "vile" + r.choice(["ness", "ly", "ka"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    model = toxicity.train(texts[:200], labels[:200], 0.25, epochs=12)
    s = toxicity.Scorer(model).score([*texts[200:], None, ""])
    good = np.array(labels[200:])
    assert s[:100][good == 1].mean() > s[:100][good == 0].mean() + 0.3
    assert s[-1] == s[-2] < 0.3
    assert toxicity.windows(10) == [0] and toxicity.windows(100)[-1] == 100 - toxicity.WINDOW


def test_line_chunks(spark):
    rng = random.Random(6)
    v = [f"v{i}" for i in range(500)]
    shared = [prose(rng, 9, v) for _ in range(14)]
    rows = []
    for i in range(30):
        own = [prose(rng, 9, v) for _ in range(10)]
        rows.append((i, "\n".join(own[:5] + (shared if i % 6 == 0 else []) + own[5:] + ["the same single line"])))
    for _, text in rows:
        assert "\n".join(c for _, _, c in lines.chunks(text)) == text
    out = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["removed_lines"] == 0 and out[i]["text"] == t for i, t in rows if i % 6 or i == 0)
    for i in (6, 12, 18, 24):
        gone = set(dict(rows)[i].split("\n")) - set(out[i]["text"].split("\n"))
        assert len(gone) >= 8 and gone <= set(shared)
    twice = "\n".join(shared + shared)
    one = lines.dedup(spark.createDataFrame([(1, twice), (2, None), (3, "")], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["text"] for r in one}
    assert set(by[1].split("\n")) == set(shared) and len(by[1]) < len(twice) and by[2] is None and by[3] == ""


def test_simhash_groups_equal_brute_force(spark, sf):
    assert simhash_groups.fingerprint(None) == simhash_groups.fingerprint(" \t") == 0
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d a")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 3)
    assert simhash_groups.fingerprint("A b\nC d\x0ba") == want
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(15):
            f = int(b)
            for k in rng.integers(0, 64, int(rng.integers(1, 7))):
                f ^= 1 << int(k)
            fps.add(f)
    fps |= {int(base[0]) >> 32 << 32 | int(k) for k in range(40)}
    values = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    root = np.arange(len(values))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(values))])
        if (new == root).all():
            break
        root = new
    classes = defaultdict(set)
    for v, r in zip(values.view(np.int64).tolist(), root.tolist()):
        classes[r].add(v)
    want = sorted(sorted(c) for c in classes.values() if len(c) > 1)
    for bucket_rows in (1024, 3):
        found = simhash_groups.components(simhash_groups.links(df, bucket_rows=bucket_rows)).collect()
        got = defaultdict(set)
        for r in found:
            got[r["root"]] |= {r["node"], r["root"]}
        assert sorted(sorted(c) for c in got.values()) == want
    out = queries.QUERIES["op9_simhash_groups"](spark, sf).toPandas()
    f = np.array([int(x, 16) for x in out.fingerprint], np.uint64)
    assert len(out) == 200 and (out.component_id <= out.doc_id).all()
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 2)
    assert (out.component_id.to_numpy()[i] == out.component_id.to_numpy()[j]).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert compare(df, df.collect(), duck(sf), queries.ORACLES[name]) is None


def test_mix_reaches_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = out["size"].sum()
    by = out.groupby(out.source.fillna("~")).agg(t=("target", "first"), k=("taken", "sum"), s=("size", "sum"))
    assert abs(by.t.sum() - total) < 1e-6 * total and ((by.k - by.t).abs() <= 60).all() and (by.t <= 3 * by.s).all()


def test_next_document(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "last"), (5, "a twin")]
    got = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=7).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(r["doc_id"]), r["text"], r["next"]) for r in got) == want


def test_spotsig_pairs(spark):
    rng = random.Random(8)
    v = [f"c{i}" for i in range(300)] + ["the", "of", "and"] * 40
    texts = [prose(rng, 150, v) for _ in range(25)]
    texts += [t.replace(t.split()[40], "changed") for t in texts[:8]] + [texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r["doc_id"]: {r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8)} for r in spotsigs.classes(df).collect()}
    least = {}
    for k, s in sorted(sets.items()):
        least.setdefault(frozenset(s), k)
    want = {(a, b) for x, a in least.items() for y, b in least.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert {(r["a"], r["b"]) for r in spotsigs.near_pairs(df).collect()} == want and want


def near_by_brute_force(rows):
    """Smallest numbers of the groups that five-word Jaccard >= 0.8 links."""
    def likeness(a, b):
        return len(a & b) / max(1, len(a | b))

    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {b""})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    least = defaultdict(list)
    for (number, _), r in zip(rows, root):
        least[r].append(number)
    return sorted(min(x) for x in least.values())


def test_near_dedup_stage_equals_brute_force(spark, sf):
    rng = random.Random(17)
    v = [f"n{i:03d}" for i in range(800)]
    base = [prose(rng, 120, v).split() for _ in range(12)]
    rows = []
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        for k in (1, 2, 3, 5):  # likeness from about 0.92 to 0.64
            other = list(words)
            for at in rng.sample(range(10, 110, 10), k):
                other[at] = f"x{i}k{k}at{at}"
            rows.append((10 * i + k, " ".join(other)))
    real = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 5000").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    rows += [tuple(r) for r in real.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_brute_force(rows)
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, sf).collect()) == want
    assert sorted(r["doc_id"] for r in near_copies.representatives(df, bucket_rows=2).collect()) == want


def test_near_dedup_links_by_simhash_and_checks_them(spark, monkeypatch):
    rng = random.Random(23)
    v = [f"s{i:03d}" for i in range(500)]
    long, rows = prose(rng, 900, v), []
    rows += [(1, long), (2, long + " end"), (3, "start " + long), (4, prose(rng, 900, v)), (5, "one two"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    used, found = [], near_copies.simhash_links
    monkeypatch.setattr(near_copies, "simhash_links", lambda *a: used.append(found(*a)) or used[-1])
    kept_rows = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept_rows) == near_by_brute_force(rows)
    assert len(used) == 1 and used[0].count() >= 1
    assert near_copies._linked(np.array([1, 2]), [np.arange(9, dtype=np.uint64)] * 2, np.array([0, 0]), 0.8, np.array([7, 7])) == []


def test_pipeline(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    once = sorted(r["doc_id"] for r in stages["near_dedup"](spark, docs, sf).collect())
    assert once == near_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    mixed = stages["mixing"](spark, docs, sf).groupBy("source").agg(F.sum(mixing.words()).alias("words"))
    want = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("longest"))
    for r in mixed.join(want, "source").collect():
        assert abs(r["words"] - r["target"]) <= r["longest"] / 2
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 4096


def test_every_word_counts_in_a_spotsig_fingerprint(spark):
    rng = random.Random(12)
    v = [f"q{i:04d}" for i in range(3000)]  # no common word among them
    a, b = prose(rng, 300, v).split(), prose(rng, 300, v).split()
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(50))
    texts = [" ".join(["alpha", "beta", *a]), " ".join(["alpha", "beta", *b]), " ".join(["alpha", "beta", *a[:150], *b[150:]]), " ".join(a),
             " ".join(a[:200] + ["other"] + a[201:]), han, han[:-1] + "x", "the the of", "solo solo", "", None, "!? --"]
    got = {r["doc_id"]: r["fingerprint"] for r in spotsigs.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = {k: {f[i : i + 8] for i in range(0, len(f), 8)} for k, f in got.items()}
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert len(sets[0]) > 50 and like(0, 1) < 0.1 and 0.25 < like(0, 2) < 0.45 and like(0, 3) > 0.9 and like(3, 4) > 0.9
    assert got[5] != got[6] and got[7] and got[8] and got[9] == got[10] == got[11] == ""
    for at in range(0, 300, 13):  # a change anywhere shows
        changed = spark.createDataFrame([(0, " ".join(a[:at] + ["changed"] + a[at + 1 :]))], "doc_id long, text string")
        assert spotsigs.classes(changed).first()["fingerprint"] != got[3]


def test_long_words_are_read_whole():
    assert toxicity.words_of("Short words, häßliche too") == ["short", "words", "häßliche", "too"]
    long = "donaudampfschifffahrtsgesellschaftskapitänsmütze"
    for word in (long, "漢" * 5 + "字" * 40, "ไ" * 33, "x" * 25, "𐐨" * 9):
        pieces = toxicity.words_of(word)
        assert len(pieces) > 1 and all(len(p.encode()) <= 24 for p in pieces)
        held, rest = pieces[0], pieces[1:]
        for p in rest:  # each goes on where half of the one before lies
            k = next(k for k in range(len(p), 0, -1) if held.endswith(p[:k]))
            held += p[k:]
        assert set(word) == set(held) and len(pieces) * 24 >= len(word.encode())
    a, b = (toxicity.features(toxicity.words_of("w" * 24 + x)) for x in ("one", "two"))
    assert any((x != y).any() for x, y in zip(a, b))
    starts = toxicity.windows(500)
    assert all(y - x <= toxicity.WINDOW // 2 for x, y in zip(starts, starts[1:])) and starts[-1] == 500 - toxicity.WINDOW


def lines_by_brute_force(rows):
    """Every text without the line pairs that another document, or an earlier place, holds; by bytes."""
    def pairs_of(text):
        split = (text or "").split("\n")
        at = [i for i, x in enumerate(split) if x.strip()]
        return split, [(i, j, split[i] + "\n" + split[j]) for i, j in zip(at, at[1:]) if len(split[i]) + len(split[j]) >= lines.LEAST_CHARS]

    owners, times = defaultdict(list), defaultdict(int)
    for number, text in rows:
        for _, _, p in pairs_of(text)[1]:
            owners[p].append(number)
            times[p] += 1
    out = []
    for number, text in rows:
        split, found = pairs_of(text)
        going, staying, seen = set(), set(), set()
        for i, j, p in found:
            known = [x for x in owners[p] if x is not None]
            if times[p] < 2:
                continue
            if known and min(known) != number or p in seen:
                going |= {i, j}
            else:
                staying |= {i, j}
                seen.add(p)
        going -= staying
        left = [i for i, x in enumerate(split) if x.strip() and i not in going]
        body = [i for i, x in enumerate(split) if x.strip()]
        keep = []
        for i, x in enumerate(split):
            if x.strip():
                if i not in going:
                    keep.append(x)
            else:
                before = max((k for k in body if k < i), default=None)
                after = min((k for k in body if k > i), default=None)
                if not going or not ((before is None or before in going) and (after is None or after in going)):
                    keep.append(x)
        out.append((number, text if not going else "\n".join(keep)))
        assert going or len(left) == len(body)
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(21)
    v = [f"v{i}" for i in range(400)]
    p = [prose(rng, 8, v) for _ in range(12)]
    rows += [(10_000 + i, "\n".join([prose(rng, 8, v), *p[i % 4 : i % 4 + 2 + i % 5], "", prose(rng, 8, v)])) for i in range(40)]
    rows += [(None, "\n".join(p[:4])), (20_000, f"\n\n{p[0]}\n\n \n{p[1]}\n"), (20_001, f"{p[0]}\n\n{p[1]}\n\nown line of mine"), (20_002, "\n".join([p[5]] * 6)),
             (20_003, "\n".join([*p[5:8], *p[5:8], "end"])), (20_004, "a\nb\nc"), (20_005, "a\nb\nc"), (20_006, "\n\n"), (20_007, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup(df)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == lines_by_brute_force(rows)


def test_short_passages_are_found(spark):
    rng = random.Random(22)
    v = [f"v{i}" for i in range(5000)]
    rows, shared = [], {}
    for i in range(300):
        own = [[prose(rng, 9, v) for _ in range(rng.randrange(1, 7))] for _ in range(4)]
        passage = [prose(rng, 9, v) for _ in range(2 + i % 4)]
        rows += [(2 * i, "\n".join(own[0] + passage + own[1])), (2 * i + 1, "\n".join(own[2] + passage + own[3]))]
        shared[2 * i + 1] = passage, own[2] + own[3]
    out = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert out[i] == (text if i % 2 == 0 else "\n".join(shared[i][1]))


def test_shards_are_even_without_numbers_and_by_typed_order(spark):
    rng = random.Random(30)
    v = [f"s{i}" for i in range(500)]
    copy = prose(rng, 150, v)
    rows = [(None, copy if i % 2 else prose(rng, 150, v), rng.choice([None, "en", "de"]), f"https://example.org/{i % 40}", rng.choice([10.5, 2.5, 9.0, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double")
    got = sharding.shard(df).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 16
    assert len(got) == 3000 and len(sizes) == 16 and all(abs(x - mean) <= 0.05 * mean for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    told = sharding.with_ordinal(df.select("n_chars", "source"), "n_chars", "o").distinct().collect()
    assert {r["n_chars"]: r["o"] for r in told} == {None: None, 2.5: 1, 9.0: 2, 10.5: 3}
    many = sharding.with_ordinal(df.select("source"), "source", "o").distinct().collect()
    assert [r["source"] for r in sorted(many, key=lambda r: r["o"])] == sorted({r[3] for r in rows})


def test_ranks_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_BROADCAST", 2)
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string")
    assert sorted((str(r["x"]), r["o"]) for r in sharding.with_ordinal(df, "x", "o").collect()) == [("None", None), ("a", 1), ("b", 2), ("b", 2), ("c", 3)]
