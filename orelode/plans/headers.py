"""Queries over texture files and nested images that are built from the documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import archives, lz
from orelode.functions.arrow import kernel
from orelode.functions.texture_builders import BUILDERS, build_gdb1, image_of
from orelode.functions.textures import read_gdb1, textures
from orelode.operators.extract import decode_textures, numbered, unpack, with_flags
from orelode.plans.registry import query, table

_TEXTS = "select doc_id, strlen(text)::bigint as n_bytes, md5(text) as md5 from documents where length(text) > 0"
_SCHEMA = "doc_id bigint, n_bytes bigint, md5 string"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.encode("text", "UTF-8").alias("data"))


def _row(doc_id: int, size: int, pixels: bytes) -> tuple:
    # the padding goes; powers of two may have added more
    return doc_id, size, hashlib.md5(pixels[:size], usedforsecurity=False).hexdigest()


def _header(kind: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(rows):
            for r in rows:
                width, height, px = image_of(r["data"])
                if kind in ("cgfx", "bflim"):  # these hold powers of two
                    height = _power(height)
                    px = px.ljust(width * height, b"\0")
                found, error = textures(kind, BUILDERS[kind](width, height, px))
                if error or len(found) != 1 or found[0].format != "L8" or found[0].width != width:
                    raise ValueError(f"{kind}: {error or found}")
                yield _row(r["doc_id"], len(r["data"]), found[0].data)

        return kernel(_texts(spark, sf_dir), run, _SCHEMA)

    build.__name__ = f"header_{kind}"
    return build


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


for _kind in BUILDERS:
    query(_TEXTS)(_header(_kind))


@query(_TEXTS)
def header_gdb1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and pixel files as two tables, joined by their name."""
    both = kernel(_texts(spark, sf_dir), _gdb1_files, "doc_id bigint, n_bytes bigint, path string, data binary")
    headers = both.where("path like '%.texturegdb'").select("doc_id", "n_bytes", F.lower(F.regexp_replace("path", r"\.[^.]*$", "")).alias("base"), F.col("data").alias("header"))
    pixels = both.where("path like '%.texturebin'").select(F.lower(F.regexp_replace("path", r"\.[^.]*$", "")).alias("base"), F.col("data").alias("pixels"))

    def run(rows):
        for r in rows:
            (t,) = read_gdb1(r["header"], r["pixels"])
            yield _row(r["doc_id"], r["n_bytes"], t.data)

    return kernel(headers.join(pixels, "base"), run, _SCHEMA)


def _gdb1_files(rows):
    for r in rows:
        header, pixels = build_gdb1(*image_of(r["data"]))
        yield r["doc_id"], len(r["data"]), f"Tex/{r['doc_id']}.texturegdb", header
        yield r["doc_id"], len(r["data"]), f"tex/{r['doc_id']}.texturebin", pixels


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a texture inside an archive inside a compressed file; every fourth one deeper."""

    def run(rows):
        for r in rows:
            inner = BUILDERS["ctpk"](*image_of(r["data"]))
            blob = archives.pack_sarc([("tex/a.ctpk", inner), ("note.txt", b"none")])
            if r["doc_id"] % 4 == 0 and len(r["data"]) <= 1 << 17:  # the second kind has at most 1,024 rows of pixels
                blob = archives.pack_garc([("x", lz.pack_zlib(blob)), ("y", BUILDERS["capcom_tex"](*image_of(r["data"])))])
            yield "rom", r["doc_id"], [], f"/data/{r['doc_id']}.bin", lz.pack_yaz0(blob) if r["doc_id"] % 2 else lz.pack_sized_gzip(blob)

    return kernel(_texts(spark, sf_dir), run, "rom_id string, file_idx bigint, seq array<int>, chain string, payload binary")


_NESTED = """select doc_id as file_idx, count(*) as textures, sum(is_ctpk)::bigint as ctpk from (
 select doc_id, 1 as is_ctpk from documents where length(text) > 0 union all select doc_id, 0 from documents where length(text) > 0 and doc_id % 4 = 0 and strlen(text) <= 131072) group by doc_id"""


@query(_NESTED)
def nested_extract_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(unpack(nested_files(spark, sf_dir), "fused"))


@query(_NESTED)
def nested_extract_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(unpack(nested_files(spark, sf_dir), "levels"))


def _count(found: DataFrame) -> DataFrame:
    t = found.where("kind = 'texture'")
    return t.groupBy(F.col("file_idx").cast("bigint").alias("file_idx")).agg(F.count("*").alias("textures"), F.count_if(F.col("parser") == "ctpk").alias("ctpk"))


@query("""with t as (select doc_id, 0 as k, 'ctpk' as parser, 'high' as confidence, text from documents where length(text) > 0
 union all select doc_id, 1, 'capcom_tex/standard_tex', 'high', text from documents where length(text) > 0 and doc_id % 4 = 0 and strlen(text) <= 131072),
n as (select *, row_number() over (order by doc_id, k) - 1 as i, 8 * greatest(1, ceil(strlen(text) / 1024.0))::bigint as height from t), f as (select text, height, min(i) as first_i from n group by all), name as (select i, 'tex_' || case when i < 10000 then lpad(i::varchar, 4, '0') else i::varchar end as id from n)
select id, doc_id as file_idx, parser, confidence, 'L8' as format, 128::int as width, height::int as height, (128 * height)::bigint as raw_data_size, case when i <> first_i then (select id from name m where m.i = first_i) end as duplicate_of from n join f using (text, height) join name using (i)""")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the nested files: ids in the order of a serial visit, sizes and duplicates."""
    found = numbered(with_flags(decode_textures(unpack(nested_files(spark, sf_dir), "fused"))))
    return found.select("id", "file_idx", "parser", "confidence", "format", "width", "height", "raw_data_size", "duplicate_of")
