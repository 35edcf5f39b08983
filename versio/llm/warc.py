"""Legacy web archives: ARC files of either version converted to WARC.

An ARC file begins with a version block (``filedesc://``) whose body names the
version and the fields of the header line that starts every record; the last
field is the length of the record's content. The converter reads header lines
and declared lengths, and gives each record what WARC asks for: a type, an
identifier (a UUID of the file's place below the folder and the position), an ISO timestamp, and SHA-1 digests
of block and payload. Of records with equal payloads one stays a response and
the others become revisits of it.

Archives are read with Spark's text source as a stream of lines of each file,
so a worker holds one record at a time and any store that Spark reads will do.
Compressed files (``.gz``) are never split, hence their lines come in order;
other files (``.arc``, ``.warc``) are read whole. Both formats are written with
Spark's text sink, whose line separator is the format's end of a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.llm.common import BROADCAST_ROWS, written

#: What ends a record: a line feed after an ARC record, two CR LF after a WARC record.
ARC_END, WARC_END = "\n", "\r\n\r\n"
#: The header line's fields for each ARC version; fixed values of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Archives are compressed once and read a few times, so speed counts more than the last tenth of their size.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
#: Name space of the identifiers.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")


class _Feed:
    """Bytes of one file, from the pieces between separators."""

    def __init__(self, pieces: Iterator[bytes], separator: bytes) -> None:
        self.pieces, self.separator, self.held, self.at, self.position = pieces, separator, b"", 0, 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at:] + piece + self.separator, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        searched = self.at
        while (end := self.held.find(b"\n", searched)) < 0:
            searched = len(self.held) - self.at
            if not self._more():
                if self.at == len(self.held):
                    return None
                end = len(self.held)
                break
        out = self.held[self.at:end]
        self.position += end + 1 - self.at
        self.at = min(end + 1, len(self.held))
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer at the end."""
        parts, left = [], n
        while left:
            part = self.held[self.at:self.at + left]
            parts.append(part)
            left -= len(part)
            self.at += len(part)
            if left and not self._more():
                break
        out = b"".join(parts)
        self.position += len(out)
        return out


def _scan(spark: SparkSession, path: str, end: str, parse: Callable, schema: str) -> DataFrame:
    """``parse(file, feed)`` yields the rows of each file below ``path``, named by its place there."""
    root = f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"

    def lines(names_like: str, separator: bytes, **how: object) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", names_like).option("recursiveFileLookup", "true").text(path, **how).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = ((f.as_py(), v.as_py()) for b in batches for f, v in zip(b.column(0), b.column(1), strict=True))
            held, size = [], 0
            for file, group in groupby(pieces, lambda x: x[0]):
                for row in parse(file.partition(root)[2] or file, _Feed((v for _, v in group), separator)):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 4 << 20 or len(held) >= 1000:
                        yield _batch(held, names, types)
                        held, size = [], 0
            yield _batch(held, names, types)

        types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]
        return rows.mapInArrow(run, schema)

    streamed = lines("*.gz", end.encode(), lineSep=end)
    whole = lines("*.{arc,warc}", b"", wholetext=True)
    return streamed.union(whole)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def arc_records(feed: _Feed) -> Iterator[dict]:
    """Records of an ARC file, the version block included. A header line has the fields of the file's
    version, told apart from the right since a URL may hold spaces. Lines that are no header are
    skipped; a record that ends before its declared length is marked ``truncated``."""
    fields = ARC_FIELDS[1].split()
    while (at := feed.position) is not None and (line := feed.line()) is not None:
        own = ARC_FIELDS[2].split() if line.startswith(b"filedesc://") and len(line.split(b" ")) >= 10 else fields
        parts = line.rstrip(b"\r").rsplit(b" ", len(own) - 1)
        if len(parts) != len(own) or not parts[-1].isdigit():
            continue
        block = feed.take(length := int(parts[-1]))
        head = dict(zip(own, (p.decode("utf-8", "replace") for p in parts), strict=True))
        if head["URL"].startswith("filedesc://"):
            said = block.split(b"\n")
            version = said[0].split(b" ")[0]
            if len(said) > 1 and said[1].startswith(b"URL "):
                fields = said[1].decode("utf-8", "replace").split()
            elif version.isdigit() and int(version) in ARC_FIELDS:
                fields = ARC_FIELDS[int(version)].split()
        yield {"at": at, "url": head["URL"], "ip": head.get("IP-address", ""), "date": head.get("Archive-date", ""), "mime": head.get("Content-type", ""), "block": block, "truncated": len(block) < length}


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Status and header lines with the empty line after them, and the payload. Without an HTTP status
    line all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := block.find(e)) >= 0]
    if not ends:
        return block, b""
    i, n = min(ends)
    return block[:i + n], block[i + n:]


def warc_date(date: str) -> str:
    """ISO form of an ARC date: 14 digits, or 12 or 8 without the missing parts; anything else is the epoch."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?", date)
    if not m:
        return "1970-01-01T00:00:00Z"
    y, mo, d, h, mi, s = (x or "00" for x in m.groups())
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data).digest()


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def read_arc(spark: SparkSession, path: str, *, key_header: str | None = None, payloads: bool = True) -> DataFrame:
    """One row for each record of the ARC files (``.gz`` or ``.arc``) below ``path``: ``record_id``, ``url``,
    ``ip``, ``warc_date``, ``mime``, ``type`` (warcinfo, response, resource), ``truncated``, ``key`` (integer
    value of the HTTP header ``key_header``, else null), ``payload_bytes``, ``payload_digest``,
    ``block_digest`` and, if ``payloads``, ``head`` and ``payload``."""
    wanted = re.compile(rb"(?im)^" + re.escape(key_header.encode()) + rb":[ \t]*(-?\d+)[ \t]*\r?$") if key_header else None

    def parse(file: str, feed: _Feed) -> Iterator[tuple]:
        for r in arc_records(feed):
            head, payload = http_parts(r["block"])
            kind = "warcinfo" if r["url"].startswith("filedesc://") else "response" if head else "resource"
            key = int(m[1]) if wanted and (m := wanted.search(head)) else None
            raw = _sha1(payload)
            row = (str(uuid.uuid5(_SPACE, f"{file} {r['at']}")), r["url"], r["ip"], warc_date(r["date"]), r["mime"], kind, r["truncated"], key, len(payload), _digest(raw), _digest(_sha1(r["block"])) if head else _digest(raw))
            yield (*row, head, payload) if payloads else row

    schema = "record_id string, url string, ip string, warc_date string, mime string, type string, truncated boolean, key bigint, payload_bytes bigint, payload_digest string, block_digest string"
    return _scan(spark, path, ARC_END, parse, schema + ", head binary, payload binary" * payloads)


def revisits(records: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Records that repeat another's payload of at least ``least_bytes`` bytes, with the one they revisit:
    that with the largest key (null keys come first), then the largest identifier."""
    rows = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    same = ["payload_digest", "payload_bytes"]
    order = F.struct(F.col("key").isNotNull(), "key", "record_id", "url", "warc_date")
    first = rows.groupBy(*same).agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.select(*same, "record_id").join(first, same).where("record_id <> first.record_id")
    return found.select(F.col("record_id").alias("revisit_id"), F.col("first.record_id").alias("to_id"), F.col("first.key").alias("to_key"), F.col("first.url").alias("to_url"), F.col("first.warc_date").alias("to_date"))


def warc_text(revisit: Column) -> Column:
    """The WARC record of a row of ``read_arc`` joined with ``revisits``, without the end of the record."""
    block = F.when(revisit, F.col("head")).when(F.col("type") == "warcinfo", F.col("payload")).otherwise(F.concat("head", "payload"))
    kind = F.when(revisit, "revisit").otherwise(F.col("type"))
    http = F.col("type") == "response"
    mime = F.when(http, "application/http; msgtype=response").when(F.col("type") == "warcinfo", "text/plain").otherwise(F.coalesce(F.nullif("mime", F.lit("")), F.lit("application/octet-stream")))

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"))
        return text if when is None else F.when(when, text)

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))

    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), line("WARC-Type", kind), line("WARC-Record-ID", urn("record_id")), line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("url"), F.col("type") != "warcinfo"), line("WARC-Filename", F.regexp_replace("url", "^filedesc://", ""), F.col("type") == "warcinfo"),
        line("WARC-IP-Address", F.col("ip"), (F.col("type") != "warcinfo") & ~F.col("ip").isin("", "-", "0.0.0.0")),
        line("WARC-Payload-Digest", F.col("payload_digest"), http), line("WARC-Block-Digest", F.col("block_digest"), ~revisit),
        line("WARC-Truncated", F.lit("length"), F.col("truncated") | revisit), line("WARC-Profile", F.lit(REVISIT_PROFILE), revisit),
        line("WARC-Refers-To", urn("to_id"), revisit), line("WARC-Refers-To-Target-URI", F.col("to_url"), revisit), line("WARC-Refers-To-Date", F.col("to_date"), revisit),
        line("X-Record-Key", F.col("key")), line("X-Refers-To-Key", F.col("to_key"), revisit), line("X-Payload-Length", F.col("payload_bytes"), http),
        line("Content-Type", mime), line("Content-Length", F.octet_length(block)))
    return F.concat(head, F.lit("\r\n\r\n"), block.cast("string"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, key_header: str | None = None, least_bytes: int = LEAST_REVISIT) -> None:
    """Convert the ARC files below ``arc_path`` to compressed WARC files below ``warc_path``.

    Version blocks become warcinfo records, HTTP records responses or revisits, others resources. The
    files are scanned twice: for digests alone, by which revisits are decided, and for the contents.
    Up to BROADCAST_ROWS revisits are broadcast; more are joined by a shuffle of the records.
    """
    known = written(revisits(read_arc(spark, arc_path, key_header=key_header, payloads=False), least_bytes), "revisits")
    rows = read_arc(spark, arc_path, key_header=key_header)
    joined = rows.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, rows["record_id"] == known["revisit_id"], "left")
    text = joined.select(warc_text(F.col("revisit_id").isNotNull()).alias("value"))
    text.write.options(lineSep=WARC_END, **GZIP).text(warc_path)


def warc_records(feed: _Feed) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, by declared lengths."""
    while (line := feed.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := feed.line()) is not None and (line := line.rstrip(b"\r")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        yield fields, feed.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row for each record of the WARC files (``.gz`` or ``.warc``) below ``path``: ``record_id``, ``type``,
    ``url``, ``warc_date``, ``key``, ``refers_to`` (identifier), ``refers_to_key``, ``payload_bytes``,
    ``payload_digest`` (SHA-1 in hex) and, if ``payloads``, ``payload``. Length and digest are those of the
    bytes read (which have to be those that the record states), for a revisit those of the payload it
    stands for."""
    def parse(file: str, feed: _Feed) -> Iterator[tuple]:
        def whole(x: str | None) -> int | None:
            return int(x) if x else None

        for f, block in warc_records(feed):
            kind, payload = f.get("warc-type"), http_parts(block)[1]
            stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
            said = base64.b32decode(stated) if stated else None
            raw, length = _sha1(payload), len(payload)
            if kind == "revisit":
                raw, length = said or b"", whole(f.get("x-payload-length"))
            elif said and said != raw:
                raise ValueError(f"{file}: the payload of {f.get('warc-record-id')} is not the one its digest states")
            row = (f.get("warc-record-id", "")[10:-1], kind, f.get("warc-target-uri"), f.get("warc-date"), whole(f.get("x-record-key")), f["warc-refers-to"][10:-1] if "warc-refers-to" in f else None, whole(f.get("x-refers-to-key")), length, raw.hex())
            yield (*row, payload) if payloads else row

    schema = "record_id string, type string, url string, warc_date string, key bigint, refers_to string, refers_to_key bigint, payload_bytes bigint, payload_digest string"
    return _scan(spark, path, WARC_END, parse, schema + ", payload binary" * payloads)


def arc_header(version: int, url: bytes, date: bytes, mime: bytes, length: int) -> bytes:
    """A header line of either version."""
    if version == 1:
        return b"%b 0.0.0.0 %b %b %d\n" % (url, date, mime, length)
    return b"%b 0.0.0.0 %b %b 200 - - 0 - %d\n" % (url, date, mime, length)


def write_arc(records: DataFrame, path: str) -> None:
    """Write ``records`` (``url``, ``date`` of 14 digits, ``mime``, ``block``) as compressed ARC files, one for
    each partition: of version 1 and of version 2 in turn. White space in a URL is percent-encoded."""
    rows = records.select(F.col("url").cast("binary"), F.col("date").cast("binary"), F.col("mime").cast("binary"), F.col("block").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        version = 1 + k % 2
        body = b"%d 0 Archive\n%b\n" % (version, ARC_FIELDS[version].encode())
        first = arc_header(version, b"filedesc://part-%d.arc" % k, b"19960923142103", b"text/plain", len(body)) + body
        filled = (b for b in batches if b.num_rows)
        for n, batch in enumerate(chain([None], filled)):
            if batch is None:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["value"])
                continue
            out = []
            for url, date, mime, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url or b"unknown:")
                out.append(arc_header(version, url, date, mime, len(block)) + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.options(lineSep=ARC_END, **GZIP).text(path)
