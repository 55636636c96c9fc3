"""Extraction: files to textures, through any nesting of archives and compression.

``unpack`` goes level by level: a round turns container rows into rows of their members and keeps texture rows; rounds
end when no container is left, or at ``MAX_DEPTH``, where what is left becomes a failure row. Ordinals of members within
their parents (``seq``) give every texture its place in a serial visit, whatever order the tasks run in.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions import archives, lz, pixels, textures
from orelode.functions.arrow import kernel
from orelode.functions.identify import identify

MAX_DEPTH = 8
MARKS = {"nintendo_lz": "[lz]", "yaz0": ">decompressed", "blz": "[blz_decompressed]", "zlib": "[zlib_decompressed]", "gzip_container": "[gzip_decompressed]"}
UNPACKERS = {"nintendo_lz": lz.unpack_lz, "yaz0": lz.unpack_yaz0, "blz": lz.unpack_blz, "zlib": lz.unpack_zlib, "gzip_container": lz.unpack_sized_gzip}
BLOBS = "rom_id string, file_idx bigint, seq array<int>, chain string, payload binary, title_id string, scan_all boolean"
#: What an inflated blob starts or, 0x28 bytes before its end, stands with if it may hold textures: fixed values, in which some kinds
#: that have readers are missing (hence ``only_known`` below).
KNOWN_STARTS = (b"BCH\0", b"CGFX", b"CTPK", b"SARC", b"NARC", b"darc", b"Yaz0", b"ZAR\x01", b"GAR\x02", b"ARC\0", b"TEX\0", b"ctxb", b"jIMG", b"CPK ", b"ARC0")
ROUND = f"kind string, {BLOBS}, name string, format string, width int, height int, crop_width int, crop_height int, mips int, parser string, confidence string, note string"


def _wrapped(data: bytes) -> bytes | None:
    """The model inside a small wrapper of one of three kinds."""
    start = {b"PC": 0x80, b"PT": 0x80, b"GR": int.from_bytes(data[4:8], "little")}.get(data[:2])
    return data[start:] if start and data[start : start + 4] == b"BCH\0" else None


#: Extensions of members that are opened in two kinds of archives; in the first one those without one are too. Fixed values.
CPK_OPEN = ("ctpk", "bch", "bcres", "cgfx", "bflim", "bclim", "ctxb", "sarc", "arc", "garc", "narc", "szs", "zar", "gar", "darc", "bin", "dat", "bcmdl", "bctex", "stex", "jtex", "jarc", "cpk")
ZAR_OPEN = ("ctxb", "cmb", "cgfx", "bch", "ctpk", "bflim", "zsi")


def _members(kind: str, data: bytes):
    """An archive's entries that are opened; of one kind those that say what they are come first, and one that holds models
    of the newer kind holds none of the older that count."""
    found, error = archives.expand(kind, data)
    extension = lambda n: n.rpartition("/")[2].rpartition(".")[2].lower() if "." in n.rpartition("/")[2] else ""
    if kind == "cpk":
        found = [(n, p) for n, p in found if extension(n) in ("", *CPK_OPEN)]
    elif kind == "zar":
        found = [(n, p) for n, p in found if extension(n) in ZAR_OPEN]
    if kind == "garc":
        if any(p.startswith(b"CGFX") for _, p in found):
            found = [(n, p) for n, p in found if not n.endswith(".bch")]
        # of what is packed, only two kinds are opened here
        found = sorted(((n, p) for n, p in found if p[:1] != b"\x13" or not n.endswith(".bin")), key=lambda e: e[0].endswith(".bin"))
    return found, error


def known_kind(data: bytes) -> bool:
    return data[:4] in KNOWN_STARTS or data[-0x28:-0x24] in (b"FLIM", b"CLIM")


def _open(row: dict, only_known: bool = False):
    """Rows of one blob: its members, its textures, or why there are none."""
    data, chain, seq, title, scan_all = row["payload"], row["chain"], row["seq"], row["title_id"], bool(row["scan_all"])
    key = (row["rom_id"], row["file_idx"])
    none = (None,) * 9

    def texture(t, i, parser=None, confidence=None, mark=""):
        crop = t.crop or (None, None)
        return ("texture", *key, [*seq, i], chain + mark, t.data, title, scan_all, t.name, t.format, t.width, t.height, *crop, t.mips, parser or t.parser, confidence or t.confidence, None)

    def blob(i, name, payload, deeper):
        return ("blob", *key, [*seq, i], name, payload, title, deeper, *none, None)

    def other(kind, note):
        return (kind, *key, seq, chain, None, title, scan_all, *none, note)

    parts = list(textures.sectioned(data))
    if parts:
        yield from (texture(t, i) for i, t in enumerate(parts))
        return
    inner = _wrapped(data)
    if inner is not None:
        data, chain = inner, chain + "[unwrap]"
    kind = identify(data, chain)
    if kind in UNPACKERS:
        inner = UNPACKERS[kind](data)
        if inner is None:
            yield other("failure", f"{kind}: not sound")
        elif only_known and kind != "yaz0" and not known_kind(inner):
            yield other("unknown", inner[:4].hex())
        else:
            yield blob(0, chain + MARKS[kind], inner, scan_all)
        return
    n = 0
    if kind in archives.READERS:
        found, error = _members(kind, data)
        for i, (name, payload) in enumerate(found):
            yield blob(i, f"{chain}{'/' if kind == 'sarc' else '>'}{name}", payload, scan_all and kind in ("sarc", "narc"))
        if error:
            yield other("failure", f"{kind}: {error}")
        n = len(found)
    elif kind in textures.READERS:
        found, error = textures.textures(kind, data, title)
        yield from (texture(t, i) for i, t in enumerate(found))
        if error:
            yield other("failure", f"{kind}: {error}")
        n = len(found)
    if n or (kind and not scan_all):
        return
    for name, part in archives.embedded(data):
        for t in textures.textures(name.partition("@")[0], part)[0]:
            yield texture(t, n, name, "medium" if t.confidence == "high" else t.confidence, f"[+{name.partition('+')[2]}]")
            n += 1
    if not n and scan_all and (t := textures.guessed(data)):
        yield texture(t, 0)
        n = 1
    if not n and not kind:
        yield other("unknown", data[:4].hex())


def _round(blobs: DataFrame, only_known: bool) -> DataFrame:
    def run(rows):
        for row in rows:
            yield from _open(row, only_known)

    return kernel(blobs, run, ROUND)


def _whole(row: dict, only_known: bool, depth_limit: int | None):
    """All of a blob's textures and failures at once, depth first."""
    todo = [(row, 0)]
    while todo:
        blob, depth = todo.pop()
        for out in _open(blob, only_known):
            if out[0] != "blob":
                yield out
            elif depth_limit is not None and depth + 1 >= depth_limit:
                yield ("failure", *out[1:5], None, *out[6:8], *(None,) * 9, "too deep")
            else:
                todo.append((dict(zip(_BLOB_COLUMNS, out[1:8], strict=True)), depth + 1))


_BLOB_COLUMNS = [c.split()[0] for c in BLOBS.split(", ")]


def unpack(blobs: DataFrame, mode: str = "levels", depth_limit: int | None = MAX_DEPTH, only_known: bool = False) -> DataFrame:
    """Texture, failure and unknown rows of ``blobs`` (columns of ``BLOBS``, of which the last two may be missing).

    ``levels`` deals members out anew in each round, which suits images with few large archives; ``fused`` opens each file
    in one go, which suits many small ones. Both give the same rows. Members below ``depth_limit`` levels become failures;
    None opens any depth. ``only_known`` leaves out inflated blobs that don't start like a file of ``KNOWN_STARTS``.
    """
    for name, kind in (("title_id", "string"), ("scan_all", "boolean")):
        if name not in blobs.columns:
            blobs = blobs.withColumn(name, F.lit(None).cast(kind))
    blobs = blobs.select("rom_id", F.col("file_idx").cast("bigint").alias("file_idx"), *_BLOB_COLUMNS[2:])
    if mode == "fused":
        def run(rows):
            for row in rows:
                yield from _whole(row, only_known, depth_limit)

        return kernel(blobs, run, ROUND)
    out, depth = None, 0
    while depth_limit is None or depth < depth_limit:
        opened = _round(blobs, only_known).persist()
        done = opened.where("kind <> 'blob'")
        out = done if out is None else out.unionByName(done)
        blobs = opened.where("kind = 'blob'").select(*_BLOB_COLUMNS)
        if blobs.isEmpty():
            return out
        depth += 1
        blobs = blobs.repartition(F.col("rom_id"), F.col("file_idx"), F.col("seq"))
    left = blobs.select(F.lit("failure").alias("kind"), "rom_id", "file_idx", "seq", "chain", F.lit("too deep").alias("note"))
    return out.unionByName(left, allowMissingColumns=True)


def paired_textures(headers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rows like ``unpack``'s of GDB1 headers (columns of ``BLOBS``) whose pixels are in another file of the same name but
    for its extension: a left join, so a header without one is a failure."""
    base = lambda c: F.lower(F.regexp_replace(c, r"\.[^./]*$", ""))
    own = headers.select(*[c for c in _BLOB_COLUMNS if c in headers.columns], base("chain").alias("_base"))
    other = pixels.select("rom_id", base("chain").alias("_base"), F.col("payload").alias("_pixels")).dropDuplicates(["rom_id", "_base"])

    def run(rows):
        for r in rows:
            key, title = (r["rom_id"], r["file_idx"]), r.get("title_id")
            try:
                if r["_pixels"] is None:
                    raise ValueError("no file of pixels")
                for i, t in enumerate(textures.read_gdb1(r["payload"], r["_pixels"])):
                    yield ("texture", *key, [*r["seq"], i], r["chain"], t.data, title, None, t.name, t.format, t.width, t.height, None, None, t.mips, t.parser, t.confidence, None)
            except ValueError as e:
                yield ("failure", *key, r["seq"], r["chain"], None, title, None, *(None,) * 9, f"gdb1: {e}")

    return kernel(own.join(other, ["rom_id", "_base"], "left"), run, ROUND)


def decode_textures(found: DataFrame) -> DataFrame:
    """Records of texture rows: hashes and quality numbers of the decoded (and cropped) images, no pixels."""

    def run(rows):
        for r in rows:
            image = pixels.decode(r["format"], r["width"], r["height"], r["payload"])
            if r["crop_width"]:
                image = image[: r["crop_height"], : r["crop_width"]]
            m = pixels.metrics(image)
            head = image.reshape(-1, 4)[:2000]
            noise = r["parser"] == "bch" and bool((head == head[0]).all() or (max(image.shape[:2]) > 8 * max(1, min(image.shape[:2])) and len({bytes(p) for p in head}) <= 3))
            raw = image.tobytes()
            yield (r["rom_id"], r["file_idx"], r["seq"], r["chain"], r["name"], r["format"], image.shape[1], image.shape[0], r["mips"], len(r["payload"]), r["confidence"], r["parser"], hashlib.sha1(raw, usedforsecurity=False).hexdigest(), hashlib.sha1(r["payload"], usedforsecurity=False).hexdigest(), hashlib.md5(raw, usedforsecurity=False).hexdigest(), noise, *m.values())

    schema = "rom_id string, file_idx bigint, seq array<int>, chain string, name string, format string, width int, height int, mips int, raw_data_size bigint, confidence string, parser string, sha1_rgba string, sha1_source_blob string, content_hash string, is_noise boolean, pct_transparent double, variance_score double, stddev double, mean_luminance double, unique_colors_sampled int, pct_dominant_color double"
    return kernel(found.where("kind = 'texture'"), run, schema)


def with_flags(records: DataFrame) -> DataFrame:
    """``flags`` and ``is_suspicious`` by the thresholds of each family of formats."""
    alpha, packed, grey = F.col("format").isin("A8", "A4"), F.col("format").isin("ETC1", "ETC1A4"), F.col("format").isin("LA8", "L8", "LA4", "L4")
    judged = ~((F.col("width") <= 16) & (F.col("height") <= 16)) & ~alpha & (F.col("format") != "HILO8")
    solid = F.col("pct_dominant_color") > F.when(packed, 99.0).when(grey, 97.0).otherwise(95.0)
    flat = (F.col("width") > 16) & (F.col("height") > 16) & (F.col("stddev") < F.when(packed | grey, 3.0).otherwise(5.0))
    extreme = (F.col("mean_luminance") < F.when(packed | grey, 2.0).otherwise(5.0)) | (F.col("mean_luminance") > F.when(packed | grey, 253.0).otherwise(250.0))
    dims = (F.col("width") == 0) | (F.col("height") == 0) | (F.col("width") > 4096) | (F.col("height") > 4096)
    flags = F.array_compact(F.array(F.when(F.col("format") == "HILO8", "INFO_NORMAL_MAP"), F.when(judged & solid, "SUSPICIOUS_SOLID"), F.when(judged & flat, "SUSPICIOUS_LOW_VARIANCE"), F.when(judged & extreme, "SUSPICIOUS_EXTREME"), F.when(dims, "SUSPICIOUS_DIMS")))
    return records.withColumn("flags", flags).withColumn("is_suspicious", F.exists("flags", lambda f: f.startswith("SUSPICIOUS")))


def numbered(records: DataFrame) -> DataFrame:
    """``id`` in the order of a serial visit within each image, and ``duplicate_of``; noise takes a number and then goes.

    Rows are dealt out by ranges of (image, file, place): a row's number is that in its range plus the counts of its image
    in the ranges before, so one large image is numbered by many tasks. Only sums per range and image are joined back.
    """
    order = ["rom_id", "file_idx", "seq"]
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).persist()
    sums = ranged.groupBy("rom_id", "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("rom_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select(F.col("rom_id").alias("_rom"), F.col("_part").alias("_range"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("rom_id", "_part").orderBy("file_idx", "seq")) - 1
    n = ranged.withColumn("_own", own).join(before, F.col("rom_id").eqNullSafe(F.col("_rom")) & (F.col("_part") == F.col("_range"))).select(*records.columns, (F.col("_own") + F.col("_before")).alias("_n"))
    n = n.withColumn("id", F.concat(F.lit("tex_"), F.when(F.col("_n") < 10_000, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string"))))
    n = n.where(~F.col("is_noise"))
    first = n.groupBy("rom_id", "content_hash").agg(F.min(F.struct("_n", "id")).alias("f"))
    out = n.join(first, ["rom_id", "content_hash"])
    return out.withColumn("duplicate_of", F.when(F.col("id") != F.col("f.id"), F.col("f.id"))).drop("_n", "f", "is_noise")
