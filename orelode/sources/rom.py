"""Cartridge images as tables: a Python data source that walks the headers and reads files by range.

``spark.read.format("rom").load(path)`` gives a row for each file of the innermost file system, with its place in the
image, its first and last ``PEEK`` bytes and (unless the option ``payload`` is "false") all of them; ``read_payloads`` reads
those of chosen rows later. Images may be on any store that ``pyarrow.fs`` opens. The headers of few images are walked to
plan, and each partition then seeks to its own files; many images are a partition each, walked by its task. No image is
ever in memory as a whole. Encrypted content gives one row with ``error`` set.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orelode.functions.archives import Broken
from orelode.functions.arrow import kernel
from orelode.sources.files import listed, locate

UNIT = 0x200
NONE = 0xFFFFFFFF
#: Sizes of the signature by its kind, as written and byte-swapped: fixed values.
SIGNATURES = {0x010003: 0x23C, 0x010004: 0x13C, 0x010005: 0x7C, 0x03000100: 0x23C, 0x04000100: 0x13C, 0x03000300: 0x23C}
SCHEMA = "rom_id string, title_id string, product_code string, container string, file_idx bigint, path string, ext string, file_offset bigint, file_size bigint, image string, head binary, tail binary, payload binary, error string"
BUNDLE_BYTES = 64 << 20
#: First and last bytes of each file that are always read, and images of which the headers are walked before the tasks start.
PEEK, WALKED_FIRST = 48, 64


#: The index of a paired file starts so; sizes of packed resources that are read, and how far a stream may stand behind their start.
LS_MAGIC, LS_LEAST, LS_MOST, LS_SEARCH = b"of\x01\0", 100, 50 << 20, 512
ZLIB_STARTS = (b"\x78\x9c", b"\x78\xda", b"\x78\x01", b"\x78\x5e")
RESOURCE_KINDS = (b"BCH\0", b"CGFX", b"CTPK")


class Encrypted(Broken):
    """The content can't be read without keys."""


class Source:
    """Reads at absolute places, from a file or from bytes."""

    def __init__(self, data: bytes | str):
        if isinstance(data, bytes):
            self.file = pa.BufferReader(data)
        else:
            system, path = locate(data)
            self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if 0 <= at < self.size else b""

    def ints(self, at: int, layout: str) -> tuple[int, ...]:
        raw = self.read(at, struct.calcsize("<" + layout))
        try:
            return struct.unpack("<" + layout, raw)
        except struct.error as e:
            raise Broken(f"data ends at {at}") from e

    def close(self) -> None:
        self.file.close()


@dataclass
class Image:
    title_id: str
    product_code: str
    container: str
    files: list[tuple[str, int, int]]


def open_image(source: Source, name: str = "") -> Image:
    """Walk the containers down to the file system; all offsets are absolute."""
    extension = name.lower().rpartition(".")[2]
    at, chain, title = 0, [], 0
    magic = source.read(0x100, 4)
    if extension == "3ds" or (extension not in ("cia", "cxi", "app", "ncch") and magic == b"NCSD"):
        if magic != b"NCSD":
            raise Broken("no NCSD magic")
        (title,) = source.ints(0x108, "Q")
        parts = [source.ints(0x120 + 8 * i, "II") for i in range(8)]
        if not parts[0][1]:
            raise Broken("no first partition")
        at, chain = parts[0][0] * UNIT, ["NCSD"]
    elif extension == "cia" or (extension not in ("cxi", "app", "ncch") and magic != b"NCCH"):
        at, chain = _cia_content(source), ["CIA"]
    if source.read(at + 0x100, 4) != b"NCCH":
        raise Broken("no NCCH magic")
    (own_title,) = source.ints(at + 0x108, "Q")
    product = source.read(at + 0x150, 16).split(b"\0")[0].decode("ascii", "replace")
    if not source.read(at + 0x18F, 1)[0] & 4:
        raise Encrypted("the content is encrypted")
    start, size = source.ints(at + 0x1B0, "II")
    if not start or not size:
        raise Broken("no file system")
    files = list(walk_romfs(source, at + start * UNIT))
    return Image(f"{title or own_title:016X}", product, "/".join([*chain, "NCCH", "RomFS"]), files)


def _cia_content(source: Source) -> int:
    """Sections follow each other at multiples of 64."""
    head, _, _, cert, ticket, tmd = source.ints(0, "IHHIII")
    at = 0
    for size in (head, cert, ticket, tmd):
        at = -(-(at + size) // 64) * 64
    return at


def walk_romfs(source: Source, base: int) -> Iterator[tuple[str, int, int]]:
    """(path, place, size) of each file, folder by folder; loops in the tables end the walk of a chain."""
    if source.read(base, 4) != b"IVFC":
        raise Broken("no IVFC magic")
    level = _level3(source, base)
    head = source.ints(level, "10I")
    dirs, files, data = level + head[3], level + head[7], level + head[9]
    queue, seen_dirs, seen_files = deque([(0, "")]), set(), set()
    while queue:
        at, parent = queue.popleft()
        if at in seen_dirs or dirs + at + 0x18 > source.size:
            continue
        seen_dirs.add(at)
        _, sibling, child, first, _, length = source.ints(dirs + at, "6I")
        if at and length > 1024:
            continue
        name = source.read(dirs + at + 0x18, length).decode("utf-16-le", "replace") if at else ""
        path = f"{parent}/{name}" if name else parent
        while first != NONE and first not in seen_files and files + first + 0x20 <= source.size:
            seen_files.add(first)
            _, after, start, size, _, length = source.ints(files + first, "IIQQII")
            if length > 1024:
                break
            own = source.read(files + first + 0x20, length).decode("utf-16-le", "replace")
            yield (f"{path}/{own}" if path else own), data + start, max(0, min(size, source.size - data - start))
            first = after
        queue.extend((x, p) for x, p in ((child, path), (sibling, parent)) if x != NONE)


def _level3(source: Source, base: int) -> int:
    for guess in (0x1000, 0x2000, 0x3000, 0x4000):
        if base + guess + 8 <= source.size and source.ints(base + guess, "I")[0] == 0x28 and source.ints(base + guess + 4, "I")[0] < 0x100000:
            return base + guess
    up = lambda x: -(-x // 0x1000) * 0x1000
    (master,), (one,), (two,) = (source.ints(base + x, "I") for x in (0x08, 0x2C, 0x3C))
    guess = up(up(up(0x60 + master) + one) + two)
    if source.ints(base + guess, "I")[0] != 0x28:
        raise Broken("no file tables")
    return base + guess


# building images, for tests and examples


def build_romfs(files: list[tuple[str, bytes]]) -> bytes:
    """A file system image; folders come from the paths."""
    folders: dict[str, list[int]] = {"": []}
    for i, (path, _) in enumerate(files):
        parts = path.strip("/").split("/")
        for n in range(1, len(parts)):
            folders.setdefault("/".join(parts[:n]), [])
        folders["/".join(parts[:-1])].append(i)
    pad = lambda b: b + bytes(-len(b) % 4)
    names = {f: pad(f.rpartition("/")[2].encode("utf-16-le")) for f in folders}
    at, dir_at = 0, {}
    for f in folders:
        dir_at[f] = at
        at += 0x18 + len(names[f])
    file_names = [pad(p.strip("/").rpartition("/")[2].encode("utf-16-le")) for p, _ in files]
    at, file_at = 0, []
    for n in file_names:
        file_at.append(at)
        at += 0x20 + len(n)
    data, starts = bytearray(), []
    for _, payload in files:
        data += bytes(-len(data) % 16)
        starts.append(len(data))
        data += payload
    dirs = b""
    for f, own in folders.items():
        children = [x for x in folders if x and x.rpartition("/")[0] == f]
        siblings = [x for x in folders if x and f and x.rpartition("/")[0] == f.rpartition("/")[0]]
        after = siblings[siblings.index(f) + 1 :] if f else []
        raw = f.rpartition("/")[2].encode("utf-16-le")
        dirs += struct.pack("<6I", dir_at[f.rpartition("/")[0]], dir_at[after[0]] if after else NONE, dir_at[children[0]] if children else NONE, file_at[own[0]] if own else NONE, NONE, len(raw)) + names[f]
    table = b""
    for i, (path, payload) in enumerate(files):
        folder = path.strip("/").rpartition("/")[0]
        own = folders[folder]
        after = own[own.index(i) + 1 :]
        raw = path.strip("/").rpartition("/")[2].encode("utf-16-le")
        table += struct.pack("<IIQQII", dir_at[folder], file_at[after[0]] if after else NONE, starts[i], len(payload), NONE, len(raw)) + file_names[i]
    head = 0x28
    level = struct.pack("<10I", head, head, 0, head, len(dirs), head + len(dirs), 0, head + len(dirs), len(table), head + len(dirs) + len(table) + (-(len(dirs) + len(table) + head) % 16))
    body = level + dirs + table
    body += bytes(-len(body) % 16) + bytes(data)
    return (b"IVFC" + struct.pack("<II", 0x10000, 0)).ljust(0x1000, b"\0") + body


def build_ncch(romfs: bytes, title: int, product: str, encrypted: bool = False) -> bytes:
    head = bytearray(UNIT)
    head[0x100:0x104] = b"NCCH"
    struct.pack_into("<Q", head, 0x108, title)
    head[0x150:0x160] = product.encode().ljust(16, b"\0")
    head[0x18F] = 0 if encrypted else 4
    struct.pack_into("<II", head, 0x1B0, 1, -(-len(romfs) // UNIT))
    return bytes(head) + romfs + bytes(-len(romfs) % UNIT)


def build_ncsd(ncch: bytes, title: int) -> bytes:
    head = bytearray(UNIT)
    head[0x100:0x104] = b"NCSD"
    struct.pack_into("<IQ", head, 0x104, 1 + len(ncch) // UNIT, title)
    struct.pack_into("<II", head, 0x120, 1, len(ncch) // UNIT)
    return bytes(head) + ncch


def build_cia(ncch: bytes) -> bytes:
    sizes = (0x2020, 0xA00, 0x350, 0xB34)
    out = bytearray(struct.pack("<IHHIIII", sizes[0], 0, 0, *sizes[1:], 0)).ljust(sizes[0], b"\0")
    for size in sizes[1:]:
        out += bytes(-len(out) % 64) + bytes(size)
    return bytes(out + bytes(-len(out) % 64)) + ncch


# one file that holds all resources, and another one that says where


def ls_rows(index: bytes) -> list[tuple[int, int, int]]:
    """(hash of the name, place, packed size) of the resources in an ``ls`` file; none if it isn't one."""
    if index[:4] != LS_MAGIC or len(index) < 8:
        return []
    count = int.from_bytes(index[4:8], "little")
    return list(struct.iter_unpack("<III", index[8 : 8 + (len(index) - 8) // 12 * 12]))[:count] if 0 < count <= 100_000 else []


def inflate_resource(packed: bytes) -> bytes | None:
    """A resource, unpacked: its zlib stream stands somewhere in its first bytes, behind padding."""
    for at in range(min(LS_SEARCH, len(packed) - 1)):
        if packed[at : at + 2] in ZLIB_STARTS:
            try:
                return zlib.decompress(packed[at:])
            except zlib.error:
                pass
    return None


def paired_resources(source: Source, files: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Resources of a ``dt`` file by its ``ls`` file, as files of their own (their path tells that they are packed)."""
    top = {path.lower().lstrip("/"): (at, n) for path, at, n in files}
    if "ls" not in top or "dt" not in top:
        return []
    start, end = top["dt"][0], sum(top["dt"])
    return [(f"{RESOURCE}{name:08X}.bch", start + at, n) for name, at, n in ls_rows(source.read(*top["ls"])) if LS_LEAST <= n <= LS_MOST and start + at + n <= end]


RESOURCE = "dt_smash_"


# the data source


@dataclass
class Bundle(InputPartition):
    """Files of one image that a task reads (None: all of them, once the task has walked its headers)."""

    path: str
    image: Image | None
    files: list[tuple[int, str, int, int]] | None
    error: str | None = None


def _walked(path: str) -> tuple[Image | None, list[tuple[int, str, int, int]], str | None]:
    """An image's head, all its files, and why there are none."""
    source = Source(path)
    try:
        image = open_image(source, path)
        files = [*image.files, *paired_resources(source, image.files)]
    except Broken as e:
        return None, [], str(e)
    finally:
        source.close()
    return Image(image.title_id, image.product_code, image.container, []), [(i, *f) for i, f in enumerate(files)], None


def payload_of(source: Source, path: str, at: int, n: int) -> bytes | None:
    """A file's bytes; of a packed resource what is in it, None if that isn't of a kind that counts."""
    data = source.read(at, n)
    if not path.startswith(RESOURCE):
        return data
    data = inflate_resource(data)
    return data if data and data[:4] in RESOURCE_KINDS else None


class RomReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options.get("path", "").split(",")
        self.payload = options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[Bundle]:
        paths = [x for p in self.paths for x in listed(p, (".3ds", ".cia", ".cxi", ".app", ".ncch"))]
        if len(paths) > WALKED_FIRST:
            return [Bundle(p, None, None) for p in paths]
        out = []
        for path in paths:
            head, files, error = _walked(path)
            bundle, size = [], 0
            for f in files:
                bundle.append(f)
                size += f[3]
                if size >= BUNDLE_BYTES:
                    out.append(Bundle(path, head, bundle))
                    bundle, size = [], 0
            if bundle or error:
                out.append(Bundle(path, head, bundle, error))
        return out or [Bundle("", None, [])]

    def read(self, part: Bundle) -> Iterator[tuple]:
        name, image, files, error = part.path.rpartition("/")[2], part.image, part.files, part.error
        if files is None:
            image, files, error = _walked(part.path)
        if error:
            yield name, *[None] * 12, error
        if not files:
            return
        source = Source(part.path)
        for i, path, at, n in files:
            extension = path.rpartition(".")[2].lower() if "." in path else ""
            whole = payload_of(source, path, at, n) if self.payload or path.startswith(RESOURCE) else None
            if whole is None and (self.payload or path.startswith(RESOURCE)):
                continue
            size = n if whole is None else len(whole)
            head = source.read(at, min(PEEK, n)) if whole is None else whole[:PEEK]
            tail = source.read(at + max(0, n - PEEK), min(PEEK, n)) if whole is None else whole[-PEEK:]
            yield name, image.title_id, image.product_code, image.container, i, path, f".{extension}" if extension else "", at, n if path.startswith(RESOURCE) else size, part.path, head, tail, whole if self.payload else None, None
        source.close()


def read_payloads(found: DataFrame) -> DataFrame:
    """Rows that were read without payloads, with them: each task reads its rows' ranges of the images."""

    def run(rows):
        opened: dict[str, Source] = {}
        for r in rows:
            source = opened.get(r["image"])
            if source is None:
                source = opened[r["image"]] = Source(r["image"])
            yield (*[r[c] for c in names], payload_of(source, r["path"], r["file_offset"], r["file_size"]))
        for source in opened.values():
            source.close()

    kept = found.drop("payload")
    names = kept.columns
    return kernel(kept, run, kept.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", payload binary")


class RomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RomReader:
        return RomReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RomSource)
