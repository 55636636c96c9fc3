"""Queries over files that say little of themselves: listed and guessed textures, headers that differ by game, files in
pairs, packed members that share streams, archives without a table; and names that are matched or made."""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions import archives, lz, texture_builders
from orelode.functions.arrow import kernel
from orelode.functions.textures import textures
from orelode.operators import names as N
from orelode.operators.extract import paired_textures, unpack
from orelode.plans.headers import _SCHEMA, _TEXTS, _row, _texts
from orelode.plans.manifest import RECORDS, records
from orelode.plans.registry import query, table
from orelode.sources import rom

MIB = 1 << 20


def _md5(data: bytes) -> str:
    return hashlib.md5(data, usedforsecurity=False).hexdigest()


def _only(kind: str, data: bytes, title: str | None = None):
    found, error = textures(kind, data, title)
    if error or len(found) != 1:
        raise ValueError(f"{kind}: {error or found}")
    return found[0]


# register files


@query("select doc_id, strlen(text)::bigint as n_bytes, md5(text) as md5, 'tex_' || doc_id as name from documents where length(text) > 0")
def header_bch_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures that a list names, set up in one of three units."""

    def run(rows):
        for r in rows:
            w, h, px = texture_builders.image_of(r["data"])
            t = _only("bch", texture_builders.build_bch_list([(f"tex_{r['doc_id']}", w, h, px)], r["doc_id"] % 3))
            yield (*_row(r["doc_id"], len(r["data"]), t.data), t.name)

    return kernel(_texts(spark, sf_dir), run, f"{_SCHEMA}, name string")


@query(_TEXTS)
def bch_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures that nothing tells of: two sizes, a format and a place among the words."""

    def run(rows):
        for r in rows:
            w, h, px = texture_builders.image_of(r["data"])
            h = 1 << (h - 1).bit_length()
            while h > 2048:  # a side has 2,048 pixels at most
                w, h = 2 * w, h // 2
            head = (b"BCH\0" + struct.pack("<7I", 0x2A01, 0, 0, 0, 0x50, 0, 0)).ljust(0x40, b"\0") + struct.pack("<4I", w, h, 7, 0)
            yield _row(r["doc_id"], len(r["data"]), _only("bch", head + px.ljust(w * h, b"\0")).data)

    return kernel(_texts(spark, sf_dir), run, _SCHEMA)


@query("select doc_id, (1 + doc_id % 2)::bigint as textures, 'listed' as first_name from documents where length(text) > 0")
def bch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guess counts where nothing is listed: of two guesses in each file, one or none."""

    def run(rows):
        for r in rows:
            told = texture_builders.build_bch_list([("listed", *texture_builders.image_of(r["data"]))])
            found, error = textures("bch", told + struct.pack("<4I", 128, 8, 7, 4 * (r["doc_id"] % 2)))
            if error:
                raise ValueError(error)
            yield r["doc_id"], len(found), found[0].name

    return kernel(_texts(spark, sf_dir), run, "doc_id bigint, textures bigint, first_name string")


# headers that differ by game


def _parts(rows):
    """Texts in parts of a MiB at most, each filled up to a power of two."""
    for r in rows:
        for i in range(0, len(r["data"]), MIB):
            part = r["data"][i : i + MIB]
            yield r["doc_id"], i // MIB, len(part), part.ljust(1 << max(4, (len(part) - 1).bit_length()), b"\0")


@query("""with k as (select doc_id, strlen(text) as n, greatest(4, ceil(log2(strlen(text))))::int as k, md5(text) as md5 from documents where length(text) > 0)
select doc_id, 0::bigint as part, (1 << (k // 2))::int as width, (1 << (k - k // 2))::int as height, 'ETC1A4' as format,
case when k % 2 = 0 or k between 11 and 17 then 'high' else 'medium' end as confidence, 'capcom_tex/rer_payload/full_payload/hdr=0x14/profile_fmt' as parser, md5 from k""")
def capcom_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without a size, of two families of games: the payload alone says it."""

    def run(rows):
        for key, part, n, px in _parts(rows):
            title, code = ("0004000000060200", 0x0C) if key % 2 == 0 else ("0004000000126300", 0x0D)
            t = _only("capcom_tex", b"TEX\0\xa5" + bytes(8) + bytes([code, 1, 0]) + bytes(4) + px, title)
            yield key, part, t.width, t.height, t.format, t.confidence, t.parser, _md5(t.data[:n])

    return kernel(_texts(spark, sf_dir), run, "doc_id bigint, part bigint, width int, height int, format string, confidence string, parser string, md5 string")


def _layout(key: int, px: bytes) -> tuple[bytes, bytes]:
    """A TEX file whose layout goes by the document, and the pixels in it."""
    w, h = 128, len(px) // 128
    if key % 5 == 0:
        return b"TEX\0" + struct.pack("<HHHBBI", 1, w, h, 1, 7, 16) + px, px
    if key % 5 == 1:
        return b"\x01\x02\x03\x04" + struct.pack("<BBHHHI", 7, 1, w, h, 0, len(px)) + px, px
    if key % 5 == 2:
        return b"TEX\0" + bytes([0xFF] * 4) + struct.pack("<HHHBBI", 0xFFFF, w, h, 1, 7, 0x14) + px, px
    square = px[: 1 << (len(px).bit_length() - 1)]
    if key % 5 == 3:  # nothing but a size that fits
        return b"TEX\0" + bytes([0xFF] * 16) + square[:MIB], square[:MIB]
    return b"nothing at all", b""


_LAYOUTS = "with k as (select doc_id, doc_id % 5 as layout, 128 * 8 * greatest(1, ceil(strlen(text) / 1024.0)::bigint) as n from documents where length(text) > 0)"


@query(f"""{_LAYOUTS}, s as (select *, case when layout < 3 and n // 128 > 1024 then 'failed' when layout < 3 then 'parsed' when layout = 3 then 'partial' else 'failed' end as status from k)
select layout::int as layout, status, count(*) as n from s group by all""")
def tex_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files of several layouts are read: for sure, by guess or not at all."""

    def run(rows):
        for r in rows:
            data, _ = _layout(r["doc_id"], texture_builders.image_of(r["data"])[2])
            found, _ = textures("capcom_tex", data)
            tall = r["doc_id"] % 5 < 3 and len(data) > 128 * 1024 + 32
            status = "failed" if not found or tall else "partial" if found[0].confidence == "low" else "parsed"
            yield r["doc_id"] % 5, status

    return kernel(_texts(spark, sf_dir), run, "layout int, status string").groupBy("layout", "status").agg(F.count("*").alias("n"))


@query(f"""{_LAYOUTS} select doc_id, case layout when 0 then 'standard_tex' when 1 then 'mt_mobile' else 'shifted_tex' end as parser, case layout when 0 then 'high' else 'medium' end as confidence, 128::int as width, (n // 128)::int as height, strlen(text)::bigint as n_bytes, md5(text) as md5
from k join documents using (doc_id) where layout < 3 and n // 128 <= 1024""")
def capcom_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fixed layouts (images of up to 1,024 rows have them), told apart by what their fields make sense as."""

    def run(rows):
        for r in rows:
            px = texture_builders.image_of(r["data"])[2]
            if r["doc_id"] % 5 < 3 and len(px) // 128 <= 1024:
                t = _only("capcom_tex", _layout(r["doc_id"], px)[0])
                yield r["doc_id"], t.parser.removeprefix("capcom_tex/"), t.confidence, t.width, t.height, len(r["data"]), _md5(t.data[: len(r["data"])])

    return kernel(_texts(spark, sf_dir), run, "doc_id bigint, parser string, confidence string, width int, height int, n_bytes bigint, md5 string")


# files in pairs


@query("select doc_id as file_idx, case when doc_id % 5 = 0 then 'failure' else 'texture' end as kind, case when doc_id % 5 <> 0 then md5(text) end as md5 from documents where length(text) > 0")
def companion_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and their pixels in two files; every fifth header has none."""

    def run(rows):
        for r in rows:
            header, pixels = texture_builders.build_gdb1(*texture_builders.image_of(r["data"]))
            yield "rom", r["doc_id"], [], f"/A/{r['doc_id']}.texturegdb", header, len(r["data"])
            if r["doc_id"] % 5:
                yield "rom", r["doc_id"], [], f"/a/{r['doc_id']}.texturebin", pixels, len(r["data"])

    files = kernel(_texts(spark, sf_dir), run, "rom_id string, file_idx bigint, seq array<int>, chain string, payload binary, n int")
    headers = files.where("chain like '%.texturegdb'").drop("n")
    found = paired_textures(headers, files.where("chain like '%.texturebin'").drop("n"))
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_idx"), F.octet_length("text").alias("n"))
    return found.join(sizes, "file_idx").select("file_idx", "kind", F.md5(F.substring("payload", F.lit(1), F.col("n"))).alias("md5"))


@query("select doc_id, strlen(text)::bigint as n_bytes, md5(text) as md5, 'dt_smash_' || lpad(hex(doc_id), 8, '0') || '.bch' as path from documents where length(text) > 0")
def paired_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of one file by the index in another; too small ones are left out."""

    def run(rows):
        for r in rows:
            packed = b"\xcc" * 16 + zlib.compress(texture_builders.BUILDERS["ctpk"](*texture_builders.image_of(r["data"])), 0)
            index = b"of\x01\0" + struct.pack("<I", 2) + struct.pack("<III", r["doc_id"] & 0xFFFFFFFF, 8, len(packed)) + struct.pack("<III", 1, 8, 50)
            source = rom.Source(index + bytes(8) + packed)
            for path, at, n in rom.paired_resources(source, [("/ls", 0, len(index)), ("/dt", len(index), 8 + len(packed))]):
                t = _only("ctpk", rom.inflate_resource(source.read(at, n)))
                yield (*_row(r["doc_id"], len(r["data"]), t.data), path)

    return kernel(_texts(spark, sf_dir), run, f"{_SCHEMA}, path string")


# packed members, archives without a table, and what is left out


@query(_TEXTS)
def cpk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed members: of its own stream, of a stream that holds more, or of the stream of the member before."""

    def run(rows):
        for r in rows:
            whole = texture_builders.BUILDERS["ctpk"](*texture_builders.image_of(r["data"]))
            stream, filler = lz.pack_crilayla(whole), b"\x01" * 64
            kind = r["doc_id"] % 3
            entries = [("a.ctpk", stream)] + [("b.ctpk", filler)] * (kind == 2)
            data = archives.pack_cpk(entries, [len(whole) // 2 if kind == 1 else len(whole), len(whole)][: len(entries)])
            found, error = archives.expand("cpk", data)
            if error or len(found) != len(entries):
                raise ValueError(error)
            yield _row(r["doc_id"], len(r["data"]), _only("ctpk", found[-1][1]).data)

    return kernel(_texts(spark, sf_dir), run, _SCHEMA)


@query("select doc_id, md5(text) as md5, 1::bigint as plain, 1::bigint as packed from documents where length(text) > 0 and strlen(text) < 4000000")
def arc0_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in an archive whose table can't be read: one as it is, one packed in a part of its own."""

    def run(rows):
        for r in rows:
            if len(r["data"]) >= 4_000_000:
                continue  # larger streams are no part of the format
            inner = texture_builders.BUILDERS["bch"](*texture_builders.image_of(r["data"]))
            stream = struct.pack("<I", len(inner) << 3 | 1) + lz.pack_lz10(inner)[4:]
            data = (b"ARC0" + struct.pack("<I12xI", 0x48, 0x48)).ljust(0x48, b"\0") + bytes(16) + inner + b"XPCK" + bytes(12) + stream
            found, error = archives.expand("arc0", data)
            if error:
                raise ValueError(error)
            good = [name for name, payload in found if [_md5(t.data[: len(r["data"])]) for t in textures("bch", payload)[0][:1]] == [_md5(r["data"])]]
            yield r["doc_id"], _md5(r["data"]), sum(n.startswith("arc0@") for n in good), sum(n.startswith("arc0>xpck") for n in good)

    return kernel(_texts(spark, sf_dir), run, "doc_id bigint, md5 string, plain bigint, packed bigint")


@query(_TEXTS)
def expand_fe_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that say their own size and hold packed textures at one of a few places."""

    def run(rows):
        for r in rows:
            found, error = archives.expand("fe_arc", archives.pack_fe_arc([("", texture_builders.BUILDERS["ctpk"](*texture_builders.image_of(r["data"])))]))
            if error or [n for n, _ in found] != ["fe_arc_ctpk_0000.ctpk"]:
                raise ValueError(error)
            yield _row(r["doc_id"], len(r["data"]), _only("ctpk", found[0][1]).data)

    return kernel(_texts(spark, sf_dir), run, _SCHEMA)


@query("select doc_id as file_idx, case when doc_id % 2 = 0 then 'texture' else 'unknown' end as kind from documents where length(text) > 0")
def only_known_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflated files that start like nothing known are left out."""

    def run(rows):
        for r in rows:
            data = r["data"] if r["doc_id"] % 2 else texture_builders.BUILDERS["ctpk"](*texture_builders.image_of(r["data"]))
            yield "rom", r["doc_id"], [], f"/{r['doc_id']}.z", lz.pack_zlib(data)

    blobs = kernel(_texts(spark, sf_dir), run, "rom_id string, file_idx bigint, seq array<int>, chain string, payload binary")
    return unpack(blobs, "fused", only_known=True).select("file_idx", "kind")


# names

_GAMES = "games as (select distinct lower(p_name) || case p_size % 4 when 0 then ' rev a' else '' end as game from part)"
_WANTED = "wanted as (select p_partkey as id, regexp_extract(lower(p_name), '^[^ ]*') || case p_partkey % 3 when 0 then ' x tail' when 1 then ' ring' else ' gear beta' end as pattern from part)"


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lower("p_name"), F.when(F.col("p_size") % 4 == 0, " rev a").otherwise("")).alias("game")).distinct()


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.regexp_extract(F.lower("p_name"), "^[^ ]*", 0), F.when(k % 3 == 0, " x tail").when(k % 3 == 1, " ring").otherwise(" gear beta")).alias("pattern"))


def match_by_words(wanted: DataFrame, games: DataFrame, least: int = 3) -> DataFrame:
    """For each pattern (``id``, ``pattern``) the ``game`` with most of its words; of equal ones a revised one, then the first.

    Words of one letter don't count; with fewer than ``least`` common words (or than the pattern has) there is no match.
    Words meet by equality, so only pairs that share one are made.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "['.]", ""), " +"), lambda w: F.length(w) > 1))
    asked = wanted.withColumn("_words", words("pattern")).withColumn("_need", F.least(F.lit(least), F.size("_words")))
    told = games.select("game", F.explode(words("game")).alias("_word"))
    both = asked.select("id", "_need", F.explode("_words").alias("_word")).join(told, "_word").groupBy("id", "_need", "game").agg(F.count("*").alias("score"))
    best = both.groupBy("id", "_need").agg(F.min(F.struct((-F.col("score")).alias("s"), (~F.contains("game", F.lit("rev"))).alias("r"), "game")).alias("b"))
    return wanted.join(best.where(-F.col("b.s") >= F.col("_need")).select("id", F.col("b.game").alias("game"), (-F.col("b.s")).alias("score")), "id", "left")


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[''.]', '', 'g'), ' +'), lambda w: length(w) > 1))"


@query(f"""with {_GAMES}, {_WANTED}, c as (select id, pattern, game, len(list_intersect({_WORDS('pattern')}, {_WORDS('game')})) as score, least(3, len({_WORDS('pattern')})) as need from wanted, games),
r as (select *, row_number() over (partition by id order by score desc, contains(game, 'rev') desc, game) as n from c where score > 0)
select w.id, w.pattern, r.game, r.score::bigint as score from wanted w left join r on r.id = w.id and n = 1 and r.score >= need""")
def name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_by_words(_wanted(spark, sf_dir), _games(spark, sf_dir))


def match_by_substring(wanted: DataFrame, games: DataFrame, least: int, most: int) -> DataFrame:
    """For each pattern (``id``, ``pattern``; of ``least`` to ``most`` letters) how many names hold it, and the first of them.

    Names are short: their substrings of those lengths are listed and meet the patterns by equality.
    """
    letters = F.length("game")
    spans = games.select("game", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), letters))).alias("n")).where(F.col("n") <= F.length("game"))
    parts = spans.select("game", "n", F.explode(F.sequence(F.lit(1), F.length("game") - F.col("n") + 1)).alias("at")).select("game", F.substring(F.lower("game"), F.col("at"), F.col("n")).alias("pattern")).distinct()
    found = parts.groupBy("pattern").agg(F.count("*").alias("found"), F.min("game").alias("first_game"))
    return wanted.withColumn("pattern", F.lower("pattern")).join(found, "pattern", "left").select("id", "pattern", F.coalesce("found", F.lit(0)).alias("found"), "first_game")


@query(f"""with {_GAMES}, w as (select p_partkey as id, substr(lower(p_name), 1 + (p_partkey % 4)::bigint, (3 + p_partkey % 5)::bigint) as pattern from part)
select id, pattern, (select count(*) from games where contains(game, pattern)) as found, (select min(game) from games where contains(game, pattern)) as first_game from w where length(pattern) >= 3""")
def pattern_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a pattern: what regression thresholds are looked up by."""
    k = F.col("p_partkey")
    w = table(spark, sf_dir, "part").select(k.alias("id"), F.substring(F.lower("p_name"), (1 + k % 4).cast("int"), (3 + k % 5).cast("int")).alias("pattern")).where("length(pattern) >= 3")
    return match_by_substring(w, _games(spark, sf_dir), 3, 7)


_KINDS = "case p when 0 then 'NLG .data/.dict' when 1 then 'proprietary .arc' when 2 then '.bin (magic=' || m || ')' when 3 then 'compressed (.cmp/.lz)' when 4 then 'Switch BNTX' when 5 then '.dat/raw (magic=' || m || ')' else 'unknown' end"


@query(f"""with g as (select c_name as game, c_custkey % 7 as p, coalesce(['BCH', 'TEX'][1 + (c_custkey % 3)::int], '?') as m from customer where c_custkey % 4 = 0), k as (select game, {_KINDS} as kind from g)
select kind, count(*) as games, array_to_string(list(game order by game)[1:4], ', ') || case when count(*) > 4 then '...' else '' end as sample from k group by kind""")
def format_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games without a texture by the kind of file that they mostly hold; of each group the first four."""
    k = F.col("c_custkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("data", "arc", "bin", "lz", "bntx", "dat", "other")]), (1 + k % 7).cast("int"))
    magic = F.when(k % 3 == 0, "BCH").when(k % 3 == 1, "TEX")
    games = table(spark, sf_dir, "customer").where(k % 4 == 0).select(F.col("c_name").alias("game"), N.failing_kind(ext, magic).alias("kind"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("game"))
    first = games.withColumn("n", place).where("n <= 4").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "game"))), lambda s: s["game"]), ", ").alias("sample"))
    counts = games.groupBy("kind").agg(F.count("*").alias("games"))
    return counts.join(first, "kind").select("kind", "games", F.concat("sample", F.when(F.col("games") > 4, "...").otherwise("")).alias("sample"))


@query(f"with {RECORDS} select seq, 'tex1_' || width || 'x' || height || '_' || upper(content_hash[:16]) || '_' || code || '.png' as file from records")
def replacement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("seq", N.replacement_name(F.col("width"), F.col("height"), F.substring("content_hash", 1, 16), F.col("code")).alias("file"))


@query("""select page_id, case when trim(regexp_replace(u, '[<>:"/\\\\|?*]', '', 'g')) = '' then 'output' else trim(regexp_replace(u, '[<>:"/\\\\|?*]', '', 'g')) end as folder from (select page_id, case page_id % 5 when 0 then ' ?* ' else url || ' ' end as u from pages)""")
def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 5 == 0, " ?* ").otherwise(F.concat("url", F.lit(" ")))
    return table(spark, sf_dir, "pages").select("page_id", N.output_folder(name).alias("folder"))
