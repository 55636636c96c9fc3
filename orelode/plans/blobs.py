"""Queries over bytes: documents as pixel data, streams and archive members, pages as files."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import archives, lz, pixels
from orelode.functions.arrow import kernel
from orelode.operators import classify as C
from orelode.plans.registry import query, table

# pixels


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    return d.select("doc_id", F.encode("text", "UTF-8").alias("data"))


def channel_sums(blobs: DataFrame, name: str) -> DataFrame:
    """Each blob as an image of one tile's width: sums of its channels, and one that depends on every pixel's place."""

    def run(rows):
        for r in rows:
            data = r["data"]
            tiles = -(-len(data) * 8 // (64 * pixels.BITS[name]))
            image = pixels.decode(name, 8, 8 * tiles, data).reshape(-1, 4).astype(np.int64)
            place = np.arange(len(image)) % 251 + 1
            yield (r["doc_id"], len(image), *image.sum(axis=0).tolist(), int((image @ [1, 2, 3, 4]) @ place))

    return kernel(blobs, run, "doc_id bigint, n_pixels bigint, sum_r bigint, sum_g bigint, sum_b bigint, sum_a bigint, placed bigint")


_5 = lambda e: f"((({e}) << 3) | (({e}) >> 2))"
_6 = lambda e: f"((({e}) << 2) | (({e}) >> 4))"
#: name: (bytes of a pixel; 0: two pixels in a byte), red, green, blue and alpha from the little-endian word v.
_SQL_CHANNELS = {
    "RGBA8": (4, "v >> 24 & 255", "v >> 16 & 255", "v >> 8 & 255", "v & 255"),
    "RGB8": (3, "v >> 16 & 255", "v >> 8 & 255", "v & 255", "255"),
    "RGBA5551": (2, _5("v >> 11 & 31"), _5("v >> 6 & 31"), _5("v >> 1 & 31"), "(v & 1) * 255"),
    "RGB565": (2, _5("v >> 11 & 31"), _6("v >> 5 & 63"), _5("v & 31"), "255"),
    "RGBA4": (2, "(v >> 12 & 15) * 17", "(v >> 8 & 15) * 17", "(v >> 4 & 15) * 17", "(v & 15) * 17"),
    "LA8": (2, "v >> 8 & 255", "v >> 8 & 255", "v >> 8 & 255", "v & 255"),
    "HILO8": (2, "v & 255", "v >> 8 & 255", "255", "255"),
    "L8": (1, "v", "v", "v", "255"),
    "A8": (1, "255", "255", "255", "v"),
    "LA4": (1, "(v >> 4) * 17", "(v >> 4) * 17", "(v >> 4) * 17", "(v & 15) * 17"),
    "L4": (0, "v * 17", "v * 17", "v * 17", "255"),
    "A4": (0, "255", "255", "255", "v * 17"),
}
_BYTES = """bytes as (select doc_id, unnest(x) as hx, generate_subscripts(x, 1) - 1 as i from
  (select doc_id, regexp_extract_all(hex(encode(text)) || repeat('00', ({unit} - strlen(text) % {unit}) % {unit}), '..') as x from documents where length(text) > 0)),
raw as (select doc_id, i, ('0x' || hx)::bigint as v from bytes)"""
_PLACE = "(k // 64) * 64 + 8 * ((k >> 1 & 1) | (k >> 2 & 2) | (k >> 3 & 4)) + ((k & 1) | (k >> 1 & 2) | (k >> 2 & 4))"


def _pixel_sql(name: str) -> str:
    width, *rgba = _SQL_CHANNELS[name]
    if width == 0:
        px = "px as (select doc_id, 2 * i + h as k, (v >> (4 * h)) & 15 as v from raw, (values (0), (1)) t(h))"
    elif width == 1:
        px = "px as (select doc_id, i as k, v from raw)"
    else:
        px = f"px as (select doc_id, i // {width} as k, sum(v << (8 * (i % {width})))::bigint as v from raw group by all)"
    r, g, b, a = (f"({c})::bigint" for c in rgba)
    sums = ", ".join(f"sum({c})::bigint as sum_{n}" for c, n in ((r, "r"), (g, "g"), (b, "b"), (a, "a")))
    return f"with {_BYTES.format(unit=8 * pixels.BITS[name])}, {px} select doc_id, count(*) as n_pixels, {sums}, sum(({r} + 2 * {g} + 3 * {b} + 4 * {a}) * (({_PLACE}) % 251 + 1))::bigint as placed from px group by doc_id"


def _etc1_sql(name: str) -> str:
    """Words as two halves; base colours of both parts; sixteen pixels of each block; tiles of four blocks."""
    alpha = name == "ETC1A4"
    size = 16 if alpha else 8
    at = "i % 16 - 8" if alpha else "i % 8"
    own = "i % 16 >= 8" if alpha else "true"
    channel = lambda c, s: f"""case when hi >> 1 & 1 = 1 then
      case part when 0 then {_5(f'hi >> {s} & 31')} else {_5(f'greatest(0, least(31, (hi >> {s} & 31) + (hi >> {s - 3} & 7) - 8 * (hi >> {s - 1} & 1)))')} end
      else (hi >> (case part when 0 then {s + 1} else {s - 3} end) & 15) * 17 end as base_{c}"""  # noqa: E731
    steps = " ".join(f"when {2 * t + big} then {int(pixels.ETC1_STEPS[t, big])}" for t in range(8) for big in (0, 1))
    part = lambda test, where: f"sum(case when {test} then v << (8 * ({where})) else 0 end)::bigint"
    halves = f"{part(f'{own} and {at} < 4', f'case when {own} and {at} < 4 then {at} else 0 end')} as lo, {part(f'{own} and {at} >= 4', f'case when {own} and {at} >= 4 then {at} - 4 else 0 end')} as hi"
    alphas = f"{part('i % 16 < 4', 'case when i % 16 < 4 then i % 16 else 0 end')} as alpha_lo, {part('i % 16 between 4 and 7', 'case when i % 16 between 4 and 7 then i % 16 - 4 else 0 end')} as alpha_hi" if alpha else "0 as alpha_lo, 0 as alpha_hi"
    words = f"words as (select doc_id, i // {size} as block, {halves}, {alphas} from raw group by all)"
    return f"""with {_BYTES.format(unit=4 * size)}, {words},
    px0 as (select *, x * 4 + y as n, case when hi & 1 = 1 then (y >= 2)::int else (x >= 2)::int end as part from words, (select unnest(range(4)) as x), (select unnest(range(4)) as y)),
    px1 as (select *, {channel("r", 27)}, {channel("g", 19)}, {channel("b", 11)}, hi >> (case part when 0 then 5 else 2 end) & 7 as tab, lo >> n & 1 as big, lo >> (n + 16) & 1 as neg from px0),
    px2 as (select doc_id, (case 2 * tab + big {steps} end) * (1 - 2 * neg) as step, base_r, base_g, base_b,
      {"((case when n < 8 then alpha_lo else alpha_hi end) >> (4 * (n % 8)) & 15) * 17" if alpha else "255"} as a, (block // 4) * 64 + 8 * (4 * (block % 4 // 2) + y) + 4 * (block % 2) + x as place from px1),
    px as (select doc_id, greatest(0, least(255, base_r + step))::bigint as r, greatest(0, least(255, base_g + step))::bigint as g, greatest(0, least(255, base_b + step))::bigint as b, a::bigint as a, place from px2)
    select doc_id, count(*) as n_pixels, sum(r)::bigint as sum_r, sum(g)::bigint as sum_g, sum(b)::bigint as sum_b, sum(a)::bigint as sum_a, sum((r + 2 * g + 3 * b + 4 * a) * (place % 251 + 1))::bigint as placed from px group by doc_id"""


def _decoder(name: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return channel_sums(_payload(spark, sf_dir), name)

    build.__name__ = f"decode_{name.lower()}"
    return build


for _name in pixels.NAMES:
    query(_etc1_sql(_name) if _name.startswith("ETC1") else _pixel_sql(_name))(_decoder(_name))


@query(f"with {_BYTES.format(unit=64)}, t as (select doc_id, i // 64 as tile, count(distinct v) as tones, sum(v)::bigint as light, min(v) as lo, max(v) as hi from raw group by all) select lang, count(*) as tiles, count(*) filter (where tones = 1) as solid, sum(light)::bigint as light, max(hi - lo)::bigint as contrast from t join documents using (doc_id) group by lang")
def tile_quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as 8x8 grey tiles: solid ones and light by language."""
    langs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "lang", F.encode("text", "UTF-8").alias("data"))

    def run(rows):
        for r in rows:
            image = pixels.decode("L8", 8, 8 * -(-len(r["data"]) // 64), r["data"])[..., 0].reshape(-1, 64).astype(np.int64)
            low, high = image.min(axis=1), image.max(axis=1)
            yield r["lang"], len(image), int((low == high).sum()), int(image.sum()), int((high - low).max())

    tiles = kernel(langs, run, "lang string, tiles bigint, solid bigint, light bigint, contrast bigint")
    return tiles.groupBy("lang").agg(F.sum("tiles").alias("tiles"), F.sum("solid").alias("solid"), F.sum("light").alias("light"), F.max("contrast").alias("contrast"))


@query(f"with {_BYTES.format(unit=1)} select doc_id, count(*) as n, sum(v)::bigint as s1, sum(v * v)::bigint as s2, min(v)::bigint as lo, max(v)::bigint as hi from raw group by doc_id")
def pixel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer moments of the bytes."""

    def run(rows):
        for r in rows:
            v = np.frombuffer(r["data"], np.uint8).astype(np.int64)
            yield r["doc_id"], len(v), int(v.sum()), int((v * v).sum()), int(v.min()), int(v.max())

    return kernel(_payload(spark, sf_dir), run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, lo bigint, hi bigint")


@query(f"with {_BYTES.format(unit=1)}, c as (select doc_id, v, count(*) as n from raw group by all) select doc_id, (max(n) * 1000 // sum(n))::bigint as dominant_per_1000, count(*) as tones from c group by doc_id")
def dominant_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(rows):
        for r in rows:
            counts = np.bincount(np.frombuffer(r["data"], np.uint8), minlength=256)
            yield r["doc_id"], int(counts.max()) * 1000 // len(r["data"]), int((counts > 0).sum())

    return kernel(_payload(spark, sf_dir), run, "doc_id bigint, dominant_per_1000 bigint, tones bigint")


@query()
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quality numbers of the documents as RGB565 images; colours of large ones from a sample of fixed seed."""

    def run(rows):
        for r in rows:
            m = pixels.metrics(pixels.decode("RGB565", 8, 8 * -(-len(r["data"]) // 128), r["data"]))
            yield (r["doc_id"], *m.values())

    return kernel(_payload(spark, sf_dir), run, "doc_id bigint, pct_transparent double, variance_score double, stddev double, mean_luminance double, unique_colors_sampled int, pct_dominant_color double")


# codecs and archives


def _packable(data: bytes, pack) -> bytes:
    """``data`` packed, with something behind it if the format can't hold it alone: one takes neither what grows nor what
    shrinks to less than a sixth."""
    noise = b"".join(hashlib.sha256(i.to_bytes(4, "big")).digest() for i in range(len(data) // 64 + 4))
    for tail in (b"", bytes(len(data) // 2 + 64), noise):
        packed = pack(data + tail)
        if packed is not None:
            return packed
    raise ValueError("the format can't hold this")


def _codec(name: str):
    pack, unpack = lz.CODECS[name]

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(rows):
            for r in rows:
                n = len(r["data"])
                back = unpack(_packable(r["data"], pack))[:n]
                yield r["doc_id"], len(back), hashlib.md5(back, usedforsecurity=False).hexdigest()

        return kernel(_payload(spark, sf_dir), run, "doc_id bigint, n_bytes bigint, md5 string")

    build.__name__ = f"roundtrip_{name}"
    return build


_TEXTS = "select doc_id, strlen(text)::bigint as n_bytes, md5(text) as md5 from documents where length(text) > 0"
for _name in lz.CODECS:
    query(_TEXTS)(_codec(_name))


def _archive(name: str):
    pack = archives.PACKERS[name]
    lead = {"gar": 8, "capcom_arc": 4}.get(name, 0)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(rows):
            # a batch's documents are the members of one archive; fillers bring it to the least number of members
            entries = [(f"{r['doc_id']}.bin", r["doc_id"].to_bytes(8, "little", signed=True) + r["data"]) for r in rows]
            fill = [("fill.bin", b"\xff" * 16)] * max(0, 10 - len(entries))
            found, error = archives.expand(name, pack(entries + fill))
            if error:
                raise ValueError(error)
            for _, payload in found:
                body = payload[lead:]
                size = next((len(p) for _, p in entries if body.startswith(p[:8])), None)
                if size is not None:
                    body = body[8:size]
                    yield int.from_bytes(payload[lead : lead + 8], "little", signed=True), len(body), hashlib.md5(body, usedforsecurity=False).hexdigest()

        return kernel(_payload(spark, sf_dir), run, "doc_id bigint, n_bytes bigint, md5 string")

    build.__name__ = f"expand_{name}"
    return build


for _name in archives.PACKERS:
    query(_TEXTS)(_archive(_name))


@query("select md5(text) as md5, sha1(text) as sha1, doc_id from documents")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), "doc_id")


@query()
def xxh64_seed0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case XXH64 of seed 0 (the engine's own function has another seed)."""

    def run(rows):
        import xxhash

        for r in rows:
            yield r["doc_id"], xxhash.xxh64(r["data"]).hexdigest().upper()

    return kernel(_payload(spark, sf_dir), run, "doc_id bigint, xxh64 string")


@query("select doc_id, (1 + doc_id % 3)::bigint as hits, ('ctpk@embedded+0x' || (doc_id % 7)) as first_name from documents where length(text) > 0")
def embedded_magic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that start anywhere in a blob: how many, and the first one's name."""

    def run(rows):
        for r in rows:
            found = list(archives.embedded(b"x" * (r["doc_id"] % 7) + b"CTPK" + r["data"] + b"BCH\0" * (r["doc_id"] % 3)))
            yield r["doc_id"], len(found), found[0][0]

    return kernel(_payload(spark, sf_dir), run, "doc_id bigint, hits bigint, first_name string")


# files: pages by their URLs

_FILES = """files as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') || case page_id % 9 when 0 then '.tex' when 1 then '.txt' when 2 then '.bch' when 3 then '/tex/a' when 4 then '.json' when 5 then '.ctpk' when 6 then '' when 7 then '.arc' else '.xyz' end as path, encode(html) as data,
 case page_id % 11 when 0 then '4352414700000000' when 1 then '53415243' when 2 then '59617A30' when 3 then '1000400000' when 4 then '42434800' when 5 then '43475458' when 6 then '789C0000' when 7 then '000000001F8B' when 8 then '63747862' when 9 then '54455800' else '' end as lead from pages)"""
_EXT = "case when instr(path, '.') > 0 then '.' || lower(regexp_extract(path, '[^.]*$')) else '' end"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a path, the first and last 48 bytes and the size of the contents, with magics put before some."""
    p = table(spark, sf_dir, "pages")
    ends = (".tex", ".txt", ".bch", "/tex/a", ".json", ".ctpk", "", ".arc")
    leads = ("4352414700000000", "53415243", "59617A30", "1000400000", "42434800", "43475458", "789C0000", "000000001F8B", "63747862", "54455800")
    pick = lambda n, values, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (i, v)]), (F.col("page_id") % n).cast("int")), F.lit(other))
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    data = F.concat(F.unhex(pick(11, leads, "")), F.encode("html", "UTF-8"))
    return p.select("page_id", F.concat(bare, pick(9, ends, ".xyz")).alias("path"), data.alias("data")).select("page_id", "path", F.substring("data", 1, 48).alias("head"), F.substring("data", -48, 48).alias("tail"), F.octet_length("data").cast("bigint").alias("size"))


_SKIP = ", ".join(f"'{x}'" for x in C.SKIP_EXTENSIONS)
_OPEN = ", ".join(f"'{x}'" for x in C.OPEN_EXTENSIONS)
_FOLDERS = " or ".join(f"contains(lower(path), '{x}')" for x in C.OPEN_FOLDERS)
_MAGIC4 = ", ".join(f"'{m.hex().upper()}'" for m in C.OPEN_MAGICS)
_FOOT = ", ".join(f"'{m.hex().upper()}'" for m in C.FOOTERS)
_HEADED = f"{_FILES}, h as (select page_id, path, lead || hex(data) as hx, {_EXT} as ext from files), f as (select *, length(hx) // 2 as size from h)"


@query(f"""with {_HEADED} select page_id, path, ext, case when ext in ({_SKIP}) then false when ext in ({_OPEN}) then true when {_FOLDERS} then true
when hx[:8] in ({_MAGIC4}) or hx[:2] in ('10', '11', '13') or hx[9:12] = '1F8B' or (size >= 40 and hx[length(hx) - 79:length(hx) - 72] in ({_FOOT})) then true else false end as opened from f""")
def prefilter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("page_id", "path", C.extension(F.col("path")).alias("ext"), C.worth_opening(F.col("path"), F.col("head"), F.col("tail")).alias("opened"))


@query(f"""with {_HEADED}, t as (select ext, case when size < 4 then null when hx[:8] = '59617A30' then 'yaz0' when hx[:2] in ('10', '11', '13') and 16384 * 2 >= size and 16384 <= 20 * size then 'nintendo_lz' when hx[:8] = '43524147' then 'garc' when hx[:8] = '53415243' then 'sarc' when hx[:4] = '789C' then 'zlib'
 when hx[:8] = '63747862' then 'ctxb' when hx[:8] = '42434800' then 'bch' when hx[:8] = '54455800' then 'capcom_tex' when ext = '.tex' then 'capcom_tex' when ext = '.bch' then 'bch' when hx[9:12] = '1F8B' then 'gzip_container' when ext = '.ctpk' then 'ctpk' when ext = '.arc' then 'sarc' end as detected_type from f)
select detected_type, count(*) as n from t group by detected_type""")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    kind = C.fingerprint(F.col("path"), F.col("head"), F.col("tail"), F.col("size"))
    return f.select(kind.alias("k")).groupBy(F.col("k.detected_type").alias("detected_type")).agg(F.count("*").alias("n"))


@query(f"with {_HEADED} select ext, count(*) as n, sum(size)::bigint as bytes, arg_min(path, page_id) filter (where size > 32) as sample_path from f group by ext")
def ext_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("ext", C.extension(F.col("path")))
    first = F.min(F.when(F.col("size") > 32, F.struct("page_id", "path")))
    return f.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), first["path"].alias("sample_path"))


@query(f"""with {_HEADED} select page_id, case when size >= 4 then ('0x' || hx[7:8] || hx[5:6] || hx[3:4] || hx[1:2])::bigint end as le32, case when size >= 4 then ('0x' || hx[:8])::bigint end as be32, case when size >= 6 then ('0x' || hx[11:12] || hx[9:10])::bigint end as le16_at4 from f""")
def read_ints_le_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.col("head")
    return files(spark, sf_dir).select("page_id", C.u32(head, 0).alias("le32"), C.u32(head, 0, big=True).alias("be32"), C.u16(head, 4).alias("le16_at4"))


@query(f"with {_HEADED} select page_id, ext, hx[:8] as magic from f where hx[:8] in ('424B4844', '414B504B', '43534152', '4E555333', '52494646') or ext in ({_SKIP})")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("ext", C.extension(F.col("path")))
    return f.where(C.magic_is(F.col("head"), *C.SKIP_MAGICS) | F.col("ext").isin(*C.SKIP_EXTENSIONS)).select("page_id", "ext", F.hex(F.substring("head", 1, 4)).alias("magic"))
