"""The verbs: scan, extract, report, build_pack and import_dump. Each returns tables; files are written only where asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode import sinks
from orelode.operators import classify as C
from orelode.operators import names as N
from orelode.operators.extract import MAX_DEPTH, decode_textures, numbered, paired_textures, unpack, with_flags
from orelode.sources import rom

FLAGS = ("SUSPICIOUS_SOLID", "SUSPICIOUS_LOW_VARIANCE", "SUSPICIOUS_EXTREME", "SUSPICIOUS_DIMS")
STAGING = "This pack holds no hashes of a running program and can't replace textures yet: import a dump and build it again."


@dataclass
class Options:
    """``scan_all`` opens every file, and takes what nothing else fits for raw pixels; ``mode``, ``depth_limit`` and
    ``only_known`` are those of ``unpack``; ``output`` is a folder for images and reports."""

    scan_all: bool = False
    mode: str = "levels"
    output: str | None = None
    raw: bool = False
    compat_unique_only: bool = False
    depth_limit: int | None = MAX_DEPTH
    only_known: bool = False


def files(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    rom.register(spark)
    return spark.read.format("rom").option("payload", str(payload).lower()).load(path)


def read_file(spark: SparkSession, image: str, path: str) -> bytes | None:
    """One file of an image by its path (leading slashes and case don't matter); None if it isn't there."""
    same = F.lower(F.regexp_replace("path", "^/+", "")) == path.lower().lstrip("/")
    row = rom.read_payloads(files(spark, image, payload=False).where(same)).select("payload").first()
    return bytes(row.payload) if row and row.payload is not None else None


def _judged(found: DataFrame) -> DataFrame:
    """What files are by their names, first and last bytes, and whether they are worth opening."""
    head, tail, size = F.col("head"), F.col("tail"), F.col("file_size")
    kind = C.fingerprint(F.col("path"), head, tail, size).alias("fingerprint")
    return found.select(*[c for c in found.columns if c not in ("head", "tail")], kind, C.worth_opening(F.col("path"), head, tail).alias("worth"), C.magic_is(head, *C.SKIP_MAGICS).alias("skipped"), F.substring("head", 1, 4).alias("magic"))


def scan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What images hold: files, extensions and types of contents, most frequent first."""
    found = _judged(files(spark, path, payload=False).where("error is null"))
    ext = found.groupBy("rom_id", "ext").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")).orderBy(F.desc("n"), "ext")
    kinds = found.where("worth").groupBy("rom_id", F.col("fingerprint.detected_type").alias("detected_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detected_type")
    title = found.select("rom_id", "title_id", "product_code").distinct().withColumn("game", N.title_name(F.col("title_id"), F.col("product_code")))
    return {"files": found.drop("payload"), "extensions": ext, "types": kinds, "titles": title}


def extract(spark: SparkSession, path: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Records, failures, unknown files and reports of all images under ``path``."""
    o = options or Options()
    every = files(spark, path, payload=False)
    found = _judged(every.where("error is null and file_size >= 8"))
    # only files that are opened, and those that others need, are read as a whole
    opened = rom.read_payloads(found.where(F.lit(o.scan_all) | (F.col("worth") & ~F.col("skipped"))).drop("fingerprint"))
    columns = ("rom_id", "file_idx", F.array().cast("array<int>").alias("seq"), F.col("path").alias("chain"), "payload", "title_id", F.lit(o.scan_all).alias("scan_all"))
    header = F.col("ext") == ".texturegdb"
    rows = unpack(opened.where(~header).select(*columns), o.mode, o.depth_limit, o.only_known)
    pixels = rom.read_payloads(found.where(F.col("ext") == ".texturebin").drop("fingerprint")).select("rom_id", F.col("path").alias("chain"), "payload")
    rows = rows.unionByName(paired_textures(opened.where(header).select(*columns), pixels)).persist()
    records = numbered(with_flags(decode_textures(rows))).persist()
    failures = rows.where("kind = 'failure'").select("rom_id", "chain", F.col("note").alias("reason")).unionByName(every.where("error is not null").select("rom_id", F.lit("").alias("chain"), F.col("error").alias("reason")))
    unknowns = rows.where("kind = 'unknown'").select("rom_id", "chain", F.col("note").alias("magic")).unionByName(found.where("skipped").select("rom_id", F.col("path").alias("chain"), F.lower(F.hex("magic")).alias("magic")))
    tex = tex_report(opened, rows)
    out = {"records": records, "failures": failures, "unknowns": unknowns, "tex": tex, **report(records, o.compat_unique_only)}
    if o.output:
        images = sinks.write_images(rows, records, o.output, o.raw)
        images.write.mode("overwrite").parquet(f"{o.output}/images")
        for name in ("records", "failures", "unknowns", "summary", "quality", "formats", "tex"):
            out[name].write.mode("overwrite").json(f"{o.output}/{name}")
        sinks.write_reports(out, o.output)
        sinks.write_contact_sheets(rows, records, o.output).write.mode("overwrite").parquet(f"{o.output}/contact_sheets")
    return out


def tex_report(opened: DataFrame, rows: DataFrame) -> DataFrame:
    """How each TEX file was read: ``parsed`` (high or medium confidence), ``partial`` (low) or ``failed``, with the layout."""
    tex = opened.where((F.col("ext") == ".tex") | C.magic_is(F.col("magic"), b"TEX\0", b"\0XET")).select("rom_id", "file_idx", "path", "file_size")
    read = rows.where("kind = 'texture' and size(seq) = 1 and parser like 'capcom_tex/%'").select("rom_id", "file_idx", "format", "width", "height", "parser", "confidence")
    status = F.when(F.col("parser").isNull(), "failed").when(F.col("confidence") == "low", "partial").otherwise("parsed")
    return tex.join(read, ["rom_id", "file_idx"], "left").withColumn("status", status)


def tex_status_counts(tex: DataFrame) -> DataFrame:
    """The counts of ``tex_report`` by image."""
    count = lambda x: F.count_if(F.col("status") == x).alias(x)
    return tex.groupBy("rom_id").agg(F.count("*").alias("total"), count("parsed"), count("partial"), count("failed"))


def report(records: DataFrame, unique_only: bool = False) -> dict[str, DataFrame]:
    """Counts and quality of a manifest; with ``unique_only`` duplicates don't count towards the score."""
    counted = records.where("duplicate_of is null") if unique_only else records
    flag = lambda name: F.count_if(F.col("is_suspicious") & F.array_contains("flags", name)).alias(name.lower())
    summary = records.groupBy("rom_id").agg(F.count("*").alias("textures"), F.countDistinct("content_hash").alias("unique_textures"), F.count_if("is_suspicious").alias("suspicious"), F.sum("raw_data_size").alias("raw_bytes"))
    suspicious = F.col("is_suspicious") & F.col("duplicate_of").isNull()
    quality = counted.groupBy("rom_id").agg(F.count("*").alias("total"), F.count_if(~suspicious).alias("valid"), *[flag(f) for f in FLAGS], F.count_if(F.array_contains("flags", "INFO_NORMAL_MAP")).alias("normal_maps"))
    quality = quality.withColumn("quality_score", F.round(F.col("valid") / F.col("total"), 3))
    formats = records.groupBy("rom_id", "format", "parser", "confidence").agg(F.count("*").alias("n"))
    return {"summary": summary, "quality": quality, "formats": formats}


def import_dump(records: DataFrame, dump_files: DataFrame) -> dict[str, DataFrame]:
    """Hashes from the names of dumped files (column ``filename``) onto the records that they show.

    A dump belongs to the first record of its size, first of all of one whose format's name contains its own; of several
    dumps of a record the last name counts.
    """
    dumped = dump_files.select("filename", N.dump_tokens(F.col("filename")).alias("t")).select("filename", "t.*")
    firsts = records.groupBy("width", "height", F.col("format").alias("own")).agg(F.min("id").alias("id"))
    other = ~F.contains(F.col("own"), F.col("format"))
    best = dumped.join(firsts, ["width", "height"]).groupBy("filename", "hash").agg(F.min(F.struct(other.alias("other"), "id")).alias("b"))
    hits = best.where("hash <> ''").select("filename", "hash", F.col("b.id").alias("id"))
    last = hits.groupBy("id").agg(F.max_by("hash", "filename").alias("dump_hash"))
    return {"records": records.join(last, "id", "left"), "matched": hits, "unmatched": dumped.join(hits, "filename", "left_anti")}


def dump_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``filename`` of the PNG files of one folder (not of those in it)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))


def library(spark: SparkSession, folder: str) -> DataFrame:
    """Images of one folder by name, with their size in MB."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.where(F.lower("path").rlike(r"\.(3ds|cia)$")).select(name.alias("name"), F.round(F.col("length") / (1 << 20), 1).alias("size_mb")).orderBy("name")


def build_pack(records: DataFrame) -> dict[str, DataFrame]:
    """Where each texture goes in a pack: by its hash if it has one, else by a readable name."""
    has = "dump_hash" in records.columns
    hash_ = F.col("dump_hash") if has else F.lit(None).cast("string")
    source = F.regexp_extract("chain", "^[^>\\[]*", 0)
    name = F.coalesce(F.concat(hash_, F.lit(".png")), N.pack_name(source, F.col("id"), F.col("width"), F.col("height"), F.col("format")))
    path = F.col("decoded_png_path") if "decoded_png_path" in records.columns else F.lit(None).cast("string")
    rows = records.select(F.coalesce(hash_, "id").alias("key"), "id", path.alias("source"), name.alias("file"), hash_.isNotNull().alias("mapped"), "width", "height", "format")
    meta = rows.agg(F.count("*").alias("texture_count"), F.count_if("mapped").alias("mapped_count"), F.count_if(~F.col("mapped")).alias("unmapped_count"), F.countDistinct("file").alias("files_distinct"))
    meta = meta.withColumn("warning", F.when(F.col("unmapped_count") > 0, STAGING))
    return {"files": rows, "meta": meta, "mappings": rows.groupBy("key").agg(F.max_by(F.struct("id", "file", "width", "height", "format"), "id").alias("entry"))}
