"""Pages as WARC archives: one gzip member per record, payloads that repeat written once.

**Writing.**  Equal payloads are found by their SHA-256; of those of at least ``least_bytes``
bytes the row with the smallest page number is the ``response``, the others are ``revisit``
records that refer to it.  Rows that share that smallest number and payload are all
responses; null numbers come after all others, and a group without a number has responses
only.  A null payload counts as empty, a null address as ``urn:page:<number>``.

Every task writes one archive with Spark's text writer, so archives reach any store that
Spark reaches and files of failed attempts never count.  That writer ends each row with a
separator.  A gzip member ends with its size, lowest byte first: as long as a record stays
under 16 MiB the last byte is zero, and that zero is the separator.  Longer payloads are
written as WARC segments (``continuation`` records), which keeps that true and bounds what a
reader holds.

**Reading.**  A sequential reader inflates a member piece by piece, takes the head up to its
empty line, then exactly ``Content-Length`` bytes, and compares block and payload with their
digests.  A damaged record gives a row with ``error`` (all else null but ``offset``); reading goes
on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.session import ensure_checkpoint_dir, kept

SEGMENT = 8 << 20  # bytes of a block; with its head far under 2^24
_PIECE = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "page_id": "long", "url": "string", "record_type": "string", "payload": "binary", "payload_bytes": "long",
    "payload_digest": "string", "refers_to": "long", "archive": "string", "offset": "long", "error": "string",
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head], f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(data) + squeeze.flush()


def _clean(value: str) -> str:
    """A head's value may not hold a line end."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id: int | None, digest: str, part: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{part}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None,
           first_url: str | None, date: str, segment: int = SEGMENT) -> bytes:
    """A page's gzip members.  ``payload`` None: a revisit of page ``first``; size and digest are the full payload's."""
    revisit = payload is None
    url = _clean(url) if url is not None else f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", date),
            ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(first, digest)), ("Refers-To-Page-Id", str(first))]
        head.append(("WARC-Refers-To-Target-URI", _clean(first_url) if first_url is not None else f"urn:page:{first}"))
    if len(block) <= segment:
        return _member(head, block)
    out = [_member([*head, ("WARC-Segment-Number", "1")], block[:segment])]
    for k, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(page_id, digest, k)), ("WARC-Date", date), ("WARC-Target-URI", url),
                ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", _urn(page_id, digest))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_member(more, block[at : at + segment]))
    return b"".join(out)


class Damaged(Exception):
    pass


class Member:
    """One gzip member of an archive, inflated no further than asked for."""

    def __init__(self, archive: "Archive"):
        self.archive, self.inflate, self.held = archive, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.archive.take()
        try:
            got = self.inflate.decompress(data, _PIECE)
        except zlib.error as e:
            raise Damaged(f"not inflatable: {e}") from e
        if self.inflate.eof:
            self.archive.give_back(self.inflate.unused_data)
        elif not data and not got:
            raise Damaged("archive ends inside a member")
        self.held += got
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not self._more():
                raise Damaged("no end of the head")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise Damaged(f"member ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def close(self) -> None:
        if self.exactly(4) != b"\r\n\r\n":
            raise Damaged("no empty lines after the block")
        while self._more():
            pass
        if self.held:
            raise Damaged("member goes on after its record")


class Archive:
    """Members of one stream, in order."""

    def __init__(self, stream):
        self.stream, self.ready, self.offset = stream, b"", 0  # offset: of the next byte that take() gives

    def take(self) -> bytes:
        data, self.ready = self.ready or self.stream.read(_PIECE), b""
        self.offset += len(data)
        return data

    def give_back(self, data: bytes) -> None:
        self.ready = data + self.ready
        self.offset -= len(data)

    def seek_member(self, start: int) -> bool:
        """On to the next place from ``start`` that looks like the beginning of a member."""
        self.stream.seek(start)
        self.ready, self.offset, data = b"", start, b""
        while more := self.take():
            data = data[-2:] + more
            at = data.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.give_back(data[at:])
                return True
        return False

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes] | tuple[int, None, str]]:
        """``offset``, head by lower-case name, block; of a damaged record ``offset``, None, what is wrong."""
        while True:
            first = self.take()
            if not first:
                return
            self.give_back(first)
            start = self.offset
            try:
                member = Member(self)
                lines = member.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise Damaged("no WARC record")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
                    raise Damaged("no Content-Length")
                block = member.exactly(int(head["content-length"]))
                member.close()
                if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                    raise Damaged("block digest differs")
                yield start, head, block
            except Damaged as e:
                yield start, None, str(e)
                if not self.seek_member(start + 1):
                    return


def _whole(offset: int, head: dict[str, str], block: bytes) -> dict:
    """A row of what a record and its segments hold."""
    top, _, payload = block.partition(b"\r\n\r\n")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    told = re.search(rb"(?im)^content-length: *([0-9]{1,18})\r?$", top)
    kind = head.get("warc-type")
    if kind == "response":
        if base32_sha1(payload) != digest:
            raise Damaged("payload digest differs")
        if told is None or int(told[1]) != len(payload):
            raise Damaged("payload length differs")
    elif kind != "revisit" or told is None:
        raise Damaged(f"unexpected record: {kind}")
    number = {k: int(v) if re.fullmatch("-?[0-9]{1,19}", v := head.get(k, "")) else None for k in ("page-id", "refers-to-page-id")}
    return {"page_id": number["page-id"], "url": head.get("warc-target-uri"), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": int(told[1]), "payload_digest": digest,
            "refers_to": number["refers-to-page-id"], "offset": offset}


def rows_of(stream) -> Iterator[dict]:
    """Rows of one archive in its order; segments of a record are put together."""
    opened = None  # offset, head and blocks of a record whose segments still come
    for offset, head, block in Archive(stream).records():
        if head is None:
            yield {"offset": offset, "error": block}
            continue
        more = head.get("warc-type") == "continuation"
        if opened and not more:
            yield {"offset": opened[0], "error": "segments are missing"}
            opened = None
        if more:
            if (not opened or head.get("warc-segment-origin-id") != opened[1].get("warc-record-id")
                    or head.get("warc-segment-number") != str(len(opened[2]) + 1)):
                yield {"offset": offset, "error": "segment without what goes before it"}
                continue
            opened[2].append(block)
            total = head.get("warc-segment-total-length")
            if total is None:
                continue
            (offset, head, blocks), opened = opened, None
            block = b"".join(blocks)
            if str(len(block)) != total:
                yield {"offset": offset, "error": "segments of another total length"}
                continue
        elif head.get("warc-segment-number") == "1":
            opened = offset, head, [block]
            continue
        try:
            yield _whole(offset, head, block)
        except Damaged as e:
            yield {"offset": offset, "error": str(e)}
    if opened:
        yield {"offset": opened[0], "error": "segments are missing"}


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = 32 << 20,
          date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes a record for every row and returns the folder of the archives, of about ``archive_bytes`` before compression.

    Payloads held by more than a thousandth of all rows (so fewer than 1,000) are looked up
    in a broadcast table and lose their copies before the shuffle; the others meet their
    group's first page in the join that also deals the rows to archives.
    """
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("html"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), F.octet_length(text).cast("long").alias("size"), F.sha1(text).alias("sha1"))
    page = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = kept(own.groupBy("key").agg(F.count("*").alias("n"), F.min(page).alias("first"), F.first("size").alias("size")))
    rows, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    copied = groups.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull())
    hot = copied.where(F.col("n") * 1000 > rows).select("key", F.col("first").alias("hot"))
    rest = copied.where(F.col("n") * 1000 <= rows).select(F.col("key").alias("place"), F.col("first"))
    # Rows of hot payloads are dealt anew, by a key that no payload has (16 bytes instead of 32).
    salt = F.unhex(F.md5(F.concat_ws("/", F.coalesce(F.col("page_id"), F.spark_partition_id()), "url", F.hex("key"))))
    again = F.col("hot").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot.page_id"))
    dealt = own.join(F.broadcast(hot), "key", "left").select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "size", "sha1", "hot", F.when(F.col("hot").isNull(), F.col("key")).otherwise(salt).alias("place"))
    archives = max(1, min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // archive_bytes))
    told = dealt.repartition(archives, "place").join(rest, "place", "left").withColumn("first", F.coalesce("hot", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    ready = told.select("page_id", "url", F.when(~revisit, F.col("html").cast("binary")).alias("payload"), "size", "sha1",
                        F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                yield pa.RecordBatch.from_arrays([pa.array([
                    record(r["page_id"], r["url"], r["payload"], r["size"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(),
                           r["first"], r["first_url"], date, segment) for r in batch.slice(at, 100).to_pylist()], pa.binary())], names=["value"])

    # Each value ends with the zero byte that the writer puts behind it.
    members = ready.mapInArrow(run, "value binary")
    members.select(F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value")).write.option(
        "lineSep", "\x00").text(folder)
    return folder


def read(spark: SparkSession, folder: str, payload: bool = True, pattern: str = "part-*") -> DataFrame:
    """A row for each record of the archives in ``folder`` (columns: ``FIELDS``), digests verified.

    ``payload_bytes`` and ``payload_digest`` are the full payload's, for revisits too, which
    hold none themselves.  Archives are taken whole by Spark's binary reader, of 2 GB at most.
    """
    names = [k for k in FIELDS if payload or k != "payload"]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for row in rows_of(pa.BufferReader(content.as_buffer())):
                    rows.append({**row, "archive": path})
                    held += row.get("payload_bytes") or 0
                    if held > 8 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], kinds[FIELDS[k]]) for k in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{k} {FIELDS[k]}" for k in names))


def sound(records: DataFrame) -> DataFrame:
    """The same rows; fails with the first damaged record's message instead of passing over it."""
    message = F.concat(F.col("archive"), F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), F.col("error"))
    return records.where(F.when(F.col("error").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
