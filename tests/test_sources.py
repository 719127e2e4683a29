"""Readers and writers on forged files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.sources import dicom, files, ragged, submission, tables


def element(group, el, vr, value, order="<", explicit=True):
    if isinstance(value, str):
        value = value.encode() + b" " * (len(value) % 2)
    head = struct.pack(order + "HH", group, el)
    if not explicit:
        return head + struct.pack(order + "I", len(value)) + value
    if vr in dicom.LONG_VR:
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", len(value)) + value
    return head + vr.encode() + struct.pack(order + "H", len(value)) + value


def forge(px, syntax="1.2.840.10008.1.2.1", bits=16, stored=None, signed=0, photometric="MONOCHROME2 ",
          skip=(), slope=None, sequence=False):
    order = ">" if syntax.endswith("1.2.2") else "<"
    explicit = syntax != "1.2.840.10008.1.2"
    rows, cols = px.shape
    stored = stored or bits

    def us(v):
        return struct.pack(order + "H", v)

    parts = [
        ((0x0008, 0x0031), "TM", "121314.5"), ((0x0018, 0x0050), "DS", "8"),
        ((0x0020, 0x0032), "DS", "1.5\\-2\\3"), ((0x0020, 0x0037), "DS", "1\\0\\0\\0\\1\\0"),
        ((0x0020, 0x1041), "DS", "4.25"), ((0x0028, 0x0004), "CS", photometric),
        ((0x0028, 0x0010), "US", us(rows)), ((0x0028, 0x0011), "US", us(cols)),
        ((0x0028, 0x0030), "DS", "0.5\\0.75"), ((0x0028, 0x0100), "US", us(bits)),
        ((0x0028, 0x0101), "US", us(stored)), ((0x0028, 0x0102), "US", us(bits - 1)),
        ((0x0028, 0x0103), "US", us(signed)),
    ]
    if slope:
        parts += [((0x0028, 0x1052), "DS", slope[1]), ((0x0028, 0x1053), "DS", slope[0])]
    body = b"".join(element(*t, vr, v, order, explicit) for t, vr, v in parts if t not in skip)
    if sequence:
        tag = struct.pack(order + "HH", 0x0040, 0x0275)
        lead = (tag + b"SQ\0\0" if explicit else tag) + struct.pack(order + "I", 0xFFFFFFFF)
        body += lead + b"\xfe\xff\x00\xe0junk" + dicom.SEQUENCE_END
    kind = f"{order}{'i' if signed else 'u'}{bits // 8}"
    body += element(0x7FE0, 0x0010, "OW" if bits == 16 else "OB", px.astype(kind).tobytes(), order, explicit)
    meta = element(0x0002, 0x0010, "UI", syntax)
    return b"\0" * 128 + b"DICM" + meta + body


PX = np.arange(12).reshape(3, 4) * 7


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2"])
@pytest.mark.parametrize("bits,signed", [(8, 0), (16, 0), (16, 1)])
def test_transfer_syntaxes(syntax, bits, signed):
    px = PX - 20 if signed else PX
    rec = dicom.decode(forge(px, syntax, bits, signed=signed, sequence=True))
    assert (rec["rows"], rec["cols"]) == (3, 4)
    assert rec["px"].tolist() == px.ravel().tolist()
    assert rec["position"] == [1.5, -2.0, 3.0] and rec["col_dc"] == [0.0, 1.0, 0.0]
    assert rec["acquisition_time"] == 121314.5 and rec["pixel_spacing"] == [0.5, 0.75]


def test_unpadding_and_rescale():
    rec = dicom.decode(forge(PX * 16, stored=12))
    assert rec["px"].tolist() == PX.ravel().tolist()  # four halvings
    rec = dicom.decode(forge(PX, slope=("2", "-3")))
    assert rec["px"].tolist() == (PX.ravel() * 2 - 3).tolist()


@pytest.mark.parametrize("bad", [
    b"\0" * 200,
    forge(PX, "1.2.840.10008.1.2.1.99"),
    forge(PX, photometric="RGB "),
    forge(PX, skip={(0x0028, 0x0010)}),
    forge(PX)[:-4],
])
def test_rejected(bad):
    with pytest.raises(ValueError):
        dicom.decode(bad)


def test_read_frames(spark, tmp_path):
    for frame in (1, 2):
        d = tmp_path / "7" / "study" / "sax_5"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"IM-0001-{frame:04d}.dcm").write_bytes(forge(PX + frame))
    (d / "IM-0001-0003.dcm").write_bytes(b"broken")
    df = dicom.read_frames(spark, str(tmp_path), all_elements=True).orderBy("frame_number")
    rows = df.collect()
    assert [(r.patient_id, r.seq_type, r.seq_number, r.frame_number) for r in rows] == [(7, "sax", 5, i) for i in (1, 2, 3)]
    assert rows[1].px[0] == 2.0 and rows[2].error == "not DICOM format" and rows[2].px is None
    tags = df.where("error is null").select(
        files.has_tag(F.col("elements"), "0020,1041").alias("a"), files.has_tag(F.col("elements"), "0000,0001").alias("b"),
        files.tag_numbers(F.col("elements"), "0028,0010").alias("rows"), files.tag_text(F.col("elements"), "0020,1041").alias("t"),
    ).first()
    assert (tags.a, tags.b, tags.rows, tags.t) == (True, False, [3.0], "4.25")
    meta = dicom.read_frames(spark, str(tmp_path), pixels=False, only="frame_number = 2").collect()
    assert len(meta) == 1 and meta[0].px is None and meta[0].rows == 3


def test_listing(spark, tmp_path):
    for name in ("sax_1", "sax_2"):
        d = tmp_path / name
        d.mkdir()
        for i in range(1, 31 if name == "sax_1" else 30):
            (d / f"IM-0001-{i:04d}.dcm").write_bytes(b"x")
    (tmp_path / "sax_1" / "IM-0001-0031.dcm").write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path), ".dcm")
    assert found.count() == 31 + 29
    whole = files.complete_directories(found).collect()
    assert [r.frame for r in whole] == list(range(1, 31)) and "sax_1" in whole[0].dir
    assert {r.files for r in files.list_directories(found).collect()} == {31, 29}
    only = files.list_files(spark, str(tmp_path / "sax_1"), ".dcm", recursive=False, name=r"IM-\d*-000\d\.dcm")
    assert only.count() == 9


def test_ragged_files(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    c = ragged.read_centres(spark, put("c.txt", "a/b.dcm 1 2\nx.dcm 3 4\nb.dcm 9 8\n")).collect()
    assert {(r.image, r.x, r.y) for r in c} == {("b", 9, 8), ("x", 3, 4)}
    l = ragged.read_landmarks(spark, put("l.txt", "i 1 2 3 4\nj 1 2 3\ni 5 6\n")).collect()
    assert {r.image: [(p.x, p.y) for p in r.pts] for r in l} == {"i": [(5.0, 6.0)], "j": [(1.0, 2.0)]}
    k = ragged.read_contours(spark, put("k.txt", "i\t1\t2\t3\t4\t5\t6\t7\t8\t\n")).first()
    assert k.rect.w == 3.0 and [(p.x, p.y) for p in k.pts] == [(5.0, 6.0), (7.0, 8.0)]
    s = ragged.read_training_shapes(spark, put("s.txt", "i 0 0 4 2 1 1 2 2\n"), 2).first()
    assert (s.box.centroid_x, s.box.centroid_y) == (2.0, 1.0) and len(s.pts) == 2
    with pytest.raises(Exception, match="wrong number of landmarks"):
        ragged.read_training_shapes(spark, put("s2.txt", "i 0 0 4 2 1 1\n"), 2).collect()
    b = ragged.read_boxes(spark, put("N_1_positive.csv", "p.dcm, 1,2 3,4\n"), r"N_\d*_positive\.csv").first()
    assert (b.path, b.x, b.y, b.w, b.h) == ("p.dcm", 1, 2, 3, 4)
    r = ragged.read_frame_range(spark, put("r.txt", "5 10 20\n5 1 2\n"))
    people = spark.createDataFrame([(5,), (6,)], "patient_id int")
    got = {x.patient_id: (x.min_frame, x.max_frame) for x in ragged.frame_range(people, r).collect()}
    assert got == {5: (10, 20), 6: (None, None)}
    assert ragged.frame_range(people, None).first().min_frame == 12
    a = ragged.read_areas(spark, put("a.txt", "sax_1\t1.5\t2\n")).first()
    assert a.sequence == "sax_1" and a.areas == [1.5, 2.0]
    sigma = ragged.read_parameter(spark, put("v.txt", "3.5\n4.5\n"), 1)
    assert spark.range(1).select(sigma.alias("s")).first().s == 4.5


def test_writers(spark, tmp_path):
    pts = spark.sql("select 'sax_1' sequence, 1 frame, array(named_struct('x', 1.0D, 'y', 2.0D), named_struct('x', 3.0D, 'y', 4.0D)) pts")
    ragged.write_landmarks(pts, str(tmp_path / "lm"))
    assert spark.read.text(str(tmp_path / "lm")).collect()[0].value == "sax_1\t1\t1.0\t2.0"
    ragged.write_ragged(pts, str(tmp_path / "rg"), ["sequence"], "pts")
    assert [(p.x, p.y) for p in ragged.read_landmarks(spark, str(tmp_path / "rg")).first().pts] == [(1.0, 2.0), (3.0, 4.0)]
    areas = spark.createDataFrame([("s", 1, 2.0), ("s", 3, 4.0)], "sequence string, frame int, area double")
    ragged.write_areas(areas, str(tmp_path / "ar"), 3)
    assert spark.read.text(str(tmp_path / "ar")).first().value.split("\t")[0:2] == ["s", "2.0"]
    arr = spark.createDataFrame([([1.0, 2.0, 3.0],)], "px array<double>")
    tables.write_arrays(arr, str(tmp_path / "px"))
    assert tables.read_arrays(spark, str(tmp_path / "px"), 3).first().px == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="unexpected row length"):
        tables.read_arrays(spark, str(tmp_path / "px"), 4).collect()


def test_submission_round_trip(spark, tmp_path):
    vols = spark.createDataFrame([(1, 0, 50.0), (1, 1, 120.0)], "study int, is_diastole int, volume double")
    rows = submission.gaussian_rows(vols, 13.5)
    submission.write_submission(rows, str(tmp_path / "s"))
    back = {r.id: r for r in submission.read_submission(spark, str(tmp_path / "s")).collect()}
    assert set(back) == {"1_Systole", "1_Diastole"}
    p = back["1_Systole"].p
    assert len(p) == 600 and p[50] == 0.5 and p == sorted(p) and p[599] == 1.0
    assert back["1_Diastole"].target == "Diastole"


def test_tables(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",".join(str(i) for i in range(29)) + "\n")
    assert tables.read_features(spark, str(tmp_path / "f.csv")).first().v_max_cpr == 11.0
    (tmp_path / "l.csv").write_text("Id,Diastole,Systole\n3,100.5,50\n")
    r = tables.read_labels(spark, str(tmp_path / "l.csv")).first()
    assert (r.study_id, r.systole, r.diastole) == (3, 50.0, 100.5)


def png(img, kind, filters):
    h, w = img.shape[:2]
    n = 1 if kind == 0 else 3
    flat = img.reshape(h, w * n).astype(int)
    lines = b""
    for y in range(h):
        prev = flat[y - 1] if y else np.zeros(w * n, int)
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]])
        corner = np.concatenate([np.zeros(n, int), prev[:-n]])
        est = np.abs(np.stack([prev - corner, left - corner, left + prev - 2 * corner])).argmin(0)
        guess = {0: 0, 1: left, 2: prev, 3: (left + prev) // 2, 4: np.choose(est, [left, prev, corner])}[filters[y]]
        lines += bytes([filters[y]]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png(spark, tmp_path):
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (5, 6))
    (tmp_path / "a.png").write_bytes(png(grey, 0, [0, 1, 2, 3, 4]))
    rgb = rng.integers(0, 256, (5, 3, 3))
    (tmp_path / "b.png").write_bytes(png(rgb, 2, [4, 3, 2, 1, 0]))
    (tmp_path / "c.png").write_bytes(b"nonsense")
    got = {r.path[-5:]: r for r in files.read_png(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "c.png"}
    assert got["c.png"].px is None and "PNG" in got["c.png"].error and got["a.png"].error is None
    assert got["a.png"].px == grey.ravel().tolist() and got["a.png"].width == 6
    assert np.allclose(got["b.png"].px, (rgb @ np.array([0.299, 0.587, 0.114])).ravel())


def test_png_of_16_bits_and_palette():
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def whole(depth, kind, lines, more=b""):
        head = struct.pack(">IIBBBBB", 2, 2, depth, kind, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + more + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    deep = b"".join(b"\0" + struct.pack(">2H", *row) for row in ((0, 65535), (257, 25700)))
    assert files.decode_png(whole(16, 0, deep))[2].tolist() == [0.0, 255.0, 1.0, 100.0]
    palette = chunk(b"PLTE", bytes([0, 0, 0, 9, 9, 9, 200, 200, 200]))
    assert np.allclose(files.decode_png(whole(8, 3, b"\0\x02\x01\0\x00\x02", palette))[2], [200, 9, 0, 200])


def test_dicom_walk_takes_all_types_and_cut_files():
    def explicit(tag, vr, body, wide=False):
        size = b"\0\0" + struct.pack("<I", len(body)) if wide else struct.pack("<H", len(body))
        return struct.pack("<HH", *tag) + vr + size + body

    head = b"\0" * 128 + b"DICM"
    data = head + explicit((0x10, 0x1010), b"AS", b"034Y") + explicit((0x10, 0x1011), b"ZZ", b"skip", wide=True) + explicit((0x28, 0x10), b"US", b"\x05\0")
    el = dicom.elements(data)
    assert el["0010,1010"][2] == b"034Y" and el["0010,1011"][0] == "UN" and el["0028,0010"][2] == b"\x05\0"
    for n in range(132, len(data)):
        dicom.elements(data[:n])
