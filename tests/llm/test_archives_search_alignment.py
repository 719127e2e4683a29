"""WARC archives, lexical search and token alignment against round trips and brute force."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.llm import alignment, lexical, queries, warc
from oracle import compare, duck

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["op11_warc", "op12_lexical"])
def test_sql_twins(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert compare(df, df.collect(), duck(sf), queries.ORACLES[name]) is None


# WARC


def page_rows(rng):
    big = "".join(rng.choice("abcdefgh \n<>é漢") for _ in range(40_000))
    rows = [(i, f"http://x.org/{i}", rng.choice(["<p>one</p>", "<p>two</p>", f"<p>{i}</p>", "", "\r\n\r\nWARC/1.1\r\n\r\n", big])) for i in range(200)]
    return rows + [(None, "http://x.org/a b\r\nWARC-Type: revisit", "<p>one</p>"), (None, None, None), (300, None, None), (7, "http://x.org/again", rows[7][2]),
                   (-5, "http://x.org/neg", "\x1f\x8b\x08 \x00"), (301, "ü", "only nulls"), rows[9], rows[9]]


def expected(rows, least=0):
    first = {}
    for number, _, html in rows:
        if number is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(number, first.get(html or "", number))
    out = Counter()
    for number, _, html in rows:
        to = first.get(html or "")
        revisit = to is not None and to != number
        raw = (html or "").encode()
        out[number, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


@pytest.mark.parametrize("least,segment", [(0, warc.SEGMENT), (12, 1_000)])
def test_archives_round_trip(spark, least, segment):
    rows = page_rows(random.Random(1))
    df = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit("clash")).withColumn("first", F.lit(1))
    folder = warc.write(df, least_bytes=least, segment=segment)
    got = warc.sound(warc.read(spark, folder)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows, least)
    html = defaultdict(set)
    for number, _, text in rows:
        html[number].add((text or "").encode())
    assert all(bytes(r.payload) in html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got} >= {"http://x.org/3", "urn:page:None", "http://x.org/a%20b%0D%0AWARC-Type:%20revisit"}


def test_archives_are_plain_gzip_members(spark):
    rows = page_rows(random.Random(2))
    folder = warc.write(spark.createDataFrame(rows, PAGES), segment=1_000)
    for f in spark.read.format("binaryFile").load(folder).where("path like '%part-%'").collect():
        raw, n, at = bytes(f.content), 0, 0
        whole = gzip.decompress(raw) if raw else b""
        for offset, head, block in warc.Archive(io.BytesIO(raw)).records():
            assert head is not None and raw[offset : offset + 3] == b"\x1f\x8b\x08" and offset == (0 if n == 0 else offset)
            assert whole.startswith(b"WARC/1.1\r\n", at)
            at = whole.index(b"\r\n\r\n", at) + 4 + len(block) + 4
            n += 1
        assert at == len(whole)


def test_no_pages(spark):
    folder = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read(spark, folder).collect() == []


def test_damaged_records_are_told_and_passed_over():
    def page(i, text, segment=warc.SEGMENT):
        raw = text.encode()
        return warc.record(i, f"http://x.org/{i}", raw, len(raw), warc.base32_sha1(raw), None, None, "2024-01-01T00:00:00Z", segment)

    def read(raw):
        return [(r.get("page_id"), r.get("error")) for r in warc.rows_of(io.BytesIO(raw))]

    a, b, c = page(1, "one" * 50), page(2, "two" * 50), page(3, "three" * 50)
    assert read(a + b + c) == [(1, None), (2, None), (3, None)]
    cut = read(a + b + c[:-6])
    assert cut[:2] == [(1, None), (2, None)] and cut[2][0] is None and "inside a member" in cut[2][1]
    flipped = bytearray(b)
    flipped[len(b) // 2] ^= 255
    hit = read(a + bytes(flipped) + c)
    assert hit[0] == (1, None) and hit[-1] == (3, None) and hit[1][0] is None and hit[1][1]
    assert read(b"") == []
    assert read(b"no archive")[0][1]

    def changed(raw, old, new):
        return gzip.compress(gzip.decompress(raw).replace(old, new))

    assert read(a + changed(b, b"twotwo", b"twoowt") + c) == [(1, None), (None, "block digest differs"), (3, None)]
    longer = read(a + re.sub(rb"", b"", changed(b, b"\r\nContent-Length: 2", b"\r\nContent-Length: 9")) + c)
    assert longer[0] == (1, None) and longer[1][0] is None and longer[-1] == (3, None)
    assert read(changed(a, b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:X"))[0][1] == "payload digest differs"
    parts = page(4, "x" * 3_000 + "y" * 100, 1_000)
    offsets = [o for o, *_ in warc.Archive(io.BytesIO(parts)).records()]
    assert len(offsets) == 4 and read(parts) == [(4, None)]
    lost = read(a + parts[: offsets[1]] + parts[offsets[2] :] + c)
    assert lost[0] == (1, None) and lost[-1] == (3, None) and all(n is None and e for n, e in lost[1:-1])


def test_members_are_inflated_piece_by_piece():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else n)

    raw = b"".join(warc.record(i, "u", b"x" * 70_000 * i, 70_000 * i, warc.base32_sha1(b"x" * 70_000 * i), None, None, "2024-01-01T00:00:00Z") for i in range(5))
    assert [r["payload_bytes"] for r in warc.rows_of(Slow(raw))] == [70_000 * i for i in range(5)]


# Lexical search


def brute_search(docs, items, k=50):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    low = {c: c + 32 for c in range(65, 91)}
    terms = [find((t or "").translate(low)) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(find((text or "").translate(low)))
    out = []
    for item, q in asked.items():
        scored = []
        for (number, _), c, t in zip(docs, counts, terms):
            m = 50 + 50 * len(t) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in q if c[x])
            if s > 0:
                scored.append((-s, number is None, number, s))
        out += [(item, r + 1, n, s) for r, (_, _, n, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("ids", F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, **kw).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    v = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Größe", "漢字", "A1", "naïve"]
    docs = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(400)]
    docs += [(500 + i, "W1 w2, w3; same text") for i in range(70)] + [docs[0], docs[0], (1, "another w2"), (None, "w1 w2 w3"), (None, None), (600, ""), (601, "!? \x00"),
             (602, "w5 " * 30_000), (2**60, "größe GRÖSSE İ K w2")]
    items = [(i, " ".join(rng.choice(v) for _ in range(12))) for i in range(12)] + [
        (20, None), (21, ""), (22, "nowhere-found zzz"), (23, "same"), (24, "w1"), (24, "text"), (None, "w2 w3"), (25, "w2 W2 w2"), (25, "w2 W2 w2")]
    want = brute_search(docs, items)
    assert want and searched(spark, docs, items) == want
    monkeypatch.setattr(lexical, "_PASS_TERMS", 40)  # several passes
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, k=3) == brute_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_balls_prune_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(lexical, "_LEAF", 8)
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 40, 3_000)
    row = np.repeat(np.arange(3_000), 12)
    term = (topics[row] * 10 + rng.integers(0, 10, len(row))).astype(np.int64)
    both = np.unique(row * 1_000 + term)
    row, term = both // 1_000, both % 1_000
    value = rng.integers(1, 10**6, len(row))
    weights = rng.integers(0, 9_000, 400)
    items = [(i, np.sort(rng.choice(10, 5, replace=False)) + 10 * int(i)) for i in range(40)] + [(99, np.sort(rng.choice(400, 30, replace=False)))]
    search = lexical.Search(items, weights, 20)
    for a in range(0, 3_000, 1_000):  # three blocks
        mine = (row >= a) & (row < a + 1_000)
        search.block(np.arange(a, a + 1_000).astype(object), row[mine] - a, term[mine], value[mine])
    for (_, terms), (scores, names) in zip(items, search.best):
        w = np.zeros(400, np.int64)
        w[terms] = weights[terms]
        whole = np.bincount(row, w[term] * value, 3_000).astype(np.int64)
        order = sorted(np.flatnonzero(whole), key=lambda i: (-whole[i], i))[:20]
        assert scores.tolist() == whole[order].tolist() and names.tolist() == [int(i) for i in order]
    assert search.opened < search.leaves / 4, (search.opened, search.leaves)


# Alignment


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner()


TEXTS = [
    "Hello world, this is plain text.", "héllo 𓀀漢 wörld\n x", "汉字 汉字 a b 　z", "  two\t\n blanks   between  ", " ", "\n", "\x00 a\x01 \x1f y\x85 z",
    "ﬁ ² ½ Ⅷ é ‍ 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>", "it's don't 've WE'LL", "﻿a b", "a▁b c d", "x" * 5_000, "ñ" * 3_000,
    "mixed 漢 in latin ünder words and漢 more", None, "", "repeat repeat repeat", "repeat repeat repeat", "1234567890 12 1 a1b2",
]


def brute(aligner, text):
    """Tokens of the whole text by their decoded bytes alone."""
    if not text:
        return None
    letters = alignment.byte_letters()
    coded = aligner.a.encode(" " + text, add_special_tokens=False)
    ids = [coded.ids, aligner.b.encode(text)]
    parts = [[bytes(letters[c] for c in t) for t in coded.tokens],
             [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(aligner.b.id_to_piece, ids[1])]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, links, at = [], [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        upto = [e.index(cut) + 1 for e in ends]
        groups.append("|".join(",".join(map(str, i[a:b])) for i, a, b in zip(ids, at, upto)))
        links.append((ids[0][upto[0] - 1], ids[1][upto[1] - 1]))
        at = upto
    return len(ids[0]), len(ids[1]), ";".join(groups), links


def table(aligner, texts):
    found = [brute(aligner, t) for t in texts]
    n = Counter(x for f in found if f for x in f[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return [(0,) * 6 + ("",) if f is None else (
        f[0], f[1], len(f[3]), len(f[3]), sum(n[x] == most[x[1]] for x in f[3]), sum(n[x] for x in f[3]), hashlib.sha256(f[2].encode()).hexdigest())
        for f in found]


def test_stretches_equal_whole_texts(aligner, sf):
    rows = duck(sf).execute("SELECT text FROM documents WHERE length(text) < 4000 ORDER BY doc_id").fetchall()
    texts = TEXTS + [r[0] for r in rows]
    for text, got in zip(texts, aligner.align(texts)):
        want = brute(aligner, text)
        assert (got is None) == (want is None)
        if got:
            assert (got[0], got[1], got[3]) == want[:3] and got[2] == len(want[3])
            assert [(x >> 32, x & 0xFFFFFFFF) for x in got[4].tolist()] == want[3]
    assert brute(aligner, "a▁b c d") is None and aligner.align(["漢"])[0][:3] == brute(aligner, "漢")[:2] + (len(brute(aligner, "漢")[3]),)


@pytest.mark.parametrize("frequent", [500_000, 20])
def test_alignment_equals_brute_force(spark, sf, aligner, frequent):
    rows = duck(sf).execute("SELECT doc_id, text FROM documents WHERE length(text) < 1500 ORDER BY doc_id").fetchall()
    rows += [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no number"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit("clash")).withColumn("n_a", F.lit(None).cast("int"))
    got = Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
                  for r in alignment.align(df, frequent=frequent).collect())
    assert got == Counter(zip([r[0] for r in rows], table(aligner, [r[1] for r in rows])))


def test_alignment_of_no_documents(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spans_that_tokens_share_are_counted_by_bytes():
    ends = alignment.Aligner._ends
    # ' ' | three bytes of one character | 'ab': the three share the span 1-4.
    assert ends(np.array([0, 1, 1, 1, 4]), np.array([1, 4, 4, 4, 6]), np.array([1, 1, 1, 1, 2])).tolist() == [1, 2, 3, 4, 6]
    # Pieces with empty spans before the one that holds the character.
    assert ends(np.array([0, 1, 1, 1]), np.array([1, 1, 1, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]
