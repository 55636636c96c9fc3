"""WARC archives in Zstandard form: one frame for each record, and the archive's dictionary in a leading skippable frame.

Writing: each task trains a dictionary on the first records of an archive, puts it (compressed) into a skippable frame of
magic number 0x184D2A5D, and appends the records, each a frame of its own. Reading goes frame by frame, so one record is
in memory at a time; a frame is expanded no further than its record says it is long, skippable frames are passed over
wherever they are, headers, lengths and digests are checked, and a damaged record is reported, not skipped.

Of records with equal payloads (of at least ``least_revisit`` bytes) that of the smallest id is a response and the others
are revisits that refer to it and carry only HTTP headers (with the full length). Payloads that more than a
``HOT_SHARE``-th of all rows have (so at most that many payloads) are looked up in every task, and of their copies only
headers travel; all other payloads meet their first id by hash.

Cases: null and empty payloads are payloads of 0 bytes; rows that share the smallest id of their payload are all
responses; a null id is after all others and, if all are null, all are responses; null URLs become ``about:blank``; ids of
any type and URLs of any length are kept (signs of ids that a record id can't hold are escaped).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.cluster import HOT_SHARE, arrow_map, shared_dir, stored
from orelode.llm.files import open_file, write_file

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


_NO_ID = "<urn:no-page>"


def record_id(page_id: object) -> str:
    return _NO_ID if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(record_id: str) -> str | None:
    """The page's id (as text) in a record id."""
    return None if record_id == _NO_ID else unquote(record_id.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id: object, url: str, payload: bytes | None, refers_to: object = None, sha1: bytes | None = None, length: int | None = None) -> bytes:
    """A response record, or a revisit of ``refers_to``, of which only the payload's SHA-1 and length are needed."""
    if sha1 is None:
        sha1, length = hashlib.sha1(payload, usedforsecurity=False).digest(), len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(sha1).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return "".join(c if c not in "\r\n" else "%0A" for c in url) if url else "about:blank"


class Archive:
    """Records on their way to one file."""

    def __init__(self):
        self.records: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.records.append(data)
        self.size += len(data)

    def to_bytes(self) -> bytes:
        sample, n = [], 0
        for r in self.records:
            sample.append(r[: 64 << 10])
            n += len(sample[-1])
            if n >= SAMPLE_BYTES:
                break
        dictionary, out = None, []
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8) if len(sample) >= 16 and n > 4 * DICTIONARY_BYTES else None
        except zstandard.ZstdError:
            dictionary = None  # too little or too uniform: the archive goes without one
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
            out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        else:
            compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        return b"".join(out + [compressor.compress(r) for r in self.records])


class _Buffered:
    """A stream of which bytes can be looked at and given back."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def have(self, n: int) -> bool:
        while len(self.held) < n and (more := self.stream.read(max(n - len(self.held), 1 << 16))):
            self.held += more
        return len(self.held) >= n

    def take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.have(1):
                raise WarcError("a skippable frame is cut short")
            n -= len(self.take(n))


def frames(stream, most: int | None = None) -> Iterator[bytes]:
    """The contents of an archive's frames, one by one; ``stream`` has ``read(n)``.

    A frame that expands beyond what its record's headers say is refused on the way there; so is, given ``most``, any
    record of more bytes.
    """
    source, context, first = _Buffered(stream), zstandard.ZstdDecompressor(), True
    while source.have(1):
        if not source.have(8):
            raise WarcError("a frame is cut short")
        magic, size = struct.unpack("<II", source.held[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            source.take(8)
            if first and magic == DICTIONARY_MAGIC:
                if not source.have(size):
                    raise WarcError("the dictionary frame is cut short")
                packed = source.take(size)
                if packed[:4] == struct.pack("<I", ZSTD_MAGIC):
                    packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=64 << 20)
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed))
            else:
                source.skip(size)
        else:
            yield _expanded(source, context, most)
        first = False


def _expanded(source: _Buffered, context: zstandard.ZstdDecompressor, most: int | None) -> bytes:
    unit, parts, n, limit = context.decompressobj(), [], 0, most
    announced = False
    while not unit.eof:
        if not source.have(1):
            raise WarcError("a frame is cut short")
        fed = source.take(1 << 12)  # little at a time: a few bytes may stand for a great many
        try:
            parts.append(unit.decompress(fed))
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame is damaged: {e}") from e
        n += len(parts[-1])
        if not announced and n:
            parts = [b"".join(parts)]
            head = parts[0].find(b"\r\n\r\n")
            if head >= 0:
                announced = True
                said = _fields(parts[0][:head].split(b"\r\n")[1:]).get("content-length", "")
                if not said.isdigit():
                    raise WarcError("no Content-Length")
                limit = min(head + 8 + int(said), most if most is not None else head + 8 + int(said))
        if limit is not None and n > limit:
            raise WarcError(f"a record of over {limit} bytes")
        if unit.eof:
            source.held = unit.unused_data + source.held
    return b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:60]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def parse(data: bytes) -> dict:
    """A record's ``headers``, ``http`` headers and ``payload`` (of a revisit: None), all checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"no end of the WARC headers in {len(data)} bytes: {data[:40]!r}")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC record: {version[:20]!r}")
    headers = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n}, but {len(rest) - 4} bytes")
    http_head, gap, payload = rest[:n].partition(b"\r\n\r\n")
    http = _fields(http_head.split(b"\r\n")[1:]) if gap else {}
    if headers["warc-type"] == "revisit":
        return {"headers": headers, "http": http, "payload": None, "length": int(http.get("content-length", 0))}
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    if headers.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        raise WarcError("the payload doesn't fit its digest")
    if int(http.get("content-length", len(payload))) != len(payload):
        raise WarcError("the payload doesn't fit its length")
    return {"headers": headers, "http": http, "payload": payload, "length": len(payload)}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 0) -> DataFrame:
    """Archives of all rows; returns their list: ``path`` and ``n_records``."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"), body.alias("_body"), F.unhex(F.sha1(body)).alias("_sha1"))
    counted = source.select("_key", "_sha1", F.octet_length("_body").alias("_size")).groupBy("_sha1").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"), F.max("_size").alias("_size"))
    firsts = stored(counted.where((F.col("_n") > 1) & (F.col("_size") >= least_revisit)).drop("_size"))
    share = pages.count() // HOT_SHARE
    hot = firsts.where(F.col("_n") > share).select("_sha1", F.col("_first").alias("_hot"), F.lit(True).alias("_is_hot"))  # less than HOT_SHARE rows
    marked = source.join(F.broadcast(hot), "_sha1", "left")
    again = F.col("_is_hot") & ~F.col("_key").eqNullSafe(F.col("_hot")) & F.col("_hot").isNotNull()
    # copies of a hot payload go anywhere, without their bodies; the others to their hash
    anywhere = F.concat(F.lit(b"+"), F.monotonically_increasing_id().cast("string").cast("binary"))
    marked = marked.select("_key", "_url", F.when(~F.coalesce(again, F.lit(False)), F.col("_body")).alias("_body"), "_sha1", "_hot", "_is_hot", F.octet_length("_body").alias("_length"), F.when(F.col("_is_hot"), anywhere).otherwise(F.col("_sha1")).alias("_meet"))
    cold = firsts.where(F.col("_n") <= share).select(F.col("_sha1").alias("_meet"), "_first")
    # the pages stream past the (small) table of repeated payloads; they aren't sorted
    joined = marked.join(cold.hint("shuffle_hash"), "_meet", "left")
    first = F.coalesce("_hot", "_first")
    refers = F.when(~F.col("_key").eqNullSafe(first), first)
    ready = joined.select("_key", "_url", F.when(refers.isNull(), F.col("_body")).alias("_body"), refers.alias("_refers"), "_sha1", "_length")

    def run(batches):
        archive = Archive()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_key", "_url", "_body", "_refers", "_sha1", "_length")), strict=True):
                archive.add(record(*row))
                if archive.size >= ARCHIVE_BYTES:
                    yield _done(archive)
                    archive = Archive()
        if archive.records:
            yield _done(archive)

    def _done(archive: Archive) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([write_file(folder, ".warc.zst", archive.to_bytes())]), pa.array([len(archive.records)], pa.int64())], names=["path", "n_records"])

    return stored(arrow_map(ready, run, "path string, n_records bigint"))


def read_archives(listed: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each record of the listed archives: its headers and, of responses, the payload. Records of over ``most``
    bytes are an error (none by default: what a record says it holds is read)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def run(batches):
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with open_file(path) as f:
                    for data in frames(f, most):
                        r = parse(data)
                        h = r["headers"]
                        rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None, h["warc-payload-digest"].removeprefix("sha1:"), r["length"], r["payload"]))
                        size, seen = size + len(data), seen + 1
                        if size > 4 << 20:
                            yield _table(rows)
                            rows, size = [], 0
                if seen != n:
                    raise WarcError(f"{path}: {seen} records, not {n}")
                if rows:
                    yield _table(rows)

    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def _table(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spread = max(2, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return arrow_map(listed.repartition(spread), run, "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def warc_digest(pages: DataFrame) -> DataFrame:
    """The rows of query op5."""
    folder = shared_dir(pages.sparkSession) + "/warc"
    kind = pages.schema["page_id"].dataType
    found = read_archives(write_archives(pages, folder))
    key = lambda c: F.col(c).cast(kind)
    return found.select(key("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
firsts as (select html, min(page_id) as first_id from p group by html),
bits as (select page_id, html, hex, first_id,
  list_transform(range(32), lambda i:
    ('0x' || substr(hex || '', 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8)) & 31) as digits
  from p join firsts using (html))
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(digits, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + d::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from bits
"""
