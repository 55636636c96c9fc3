"""What an extraction leaves: images and raw pixels as files, manifests and reports as JSON.

Images are written by the tasks that decode them; paths may be any that ``pyarrow.fs`` opens. Records go through Spark's
own writers; only the one-line summaries are put together on the driver.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions import pixels
from orelode.functions.arrow import arrow_kernel, kernel
from orelode.functions.png import encode_png
from orelode.operators import names as N
from orelode.sources.files import locate

SCHEMA_VERSION = 2


def _put(uri: str, data: bytes) -> None:
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def write_images(found: DataFrame, records: DataFrame, folder: str, raw: bool = False) -> DataFrame:
    """PNG files (and ``.bin`` with ``raw``) of the records that aren't duplicates; returns ``rom_id``, ``id`` and
    ``decoded_png_path`` (under a folder for each image)."""
    keep = records.where("duplicate_of is null").select("rom_id", "file_idx", "seq", "id", F.col("chain").alias("source"))
    named = found.where("kind = 'texture'").join(keep, ["rom_id", "file_idx", "seq"])
    index = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    size = lambda c, o: F.coalesce(c, o)
    code = F.array_position(F.array(*[F.lit(n) for n in pixels.NAMES]), F.col("format")) - 1
    file = N.output_name(index, F.col("name"), code, size(F.col("crop_width"), F.col("width")), size(F.col("crop_height"), F.col("height")))
    source = F.regexp_extract("source", "^[^>\\[]*", 0)
    ready = named.select("rom_id", "id", F.concat_ws("/", N.output_folder(F.col("rom_id")), N.output_path(source, file)).alias("path"), "payload", "format", "width", "height", "crop_width", "crop_height")

    def run(rows):
        for r in rows:
            image = pixels.decode(r["format"], r["width"], r["height"], r["payload"])
            if r["crop_width"]:
                image = image[: r["crop_height"], : r["crop_width"]]
            _put(f"{folder}/{r['path']}", encode_png(image))
            if raw:
                _put(f"{folder}/{r['path'].rpartition('.')[0]}.bin", r["payload"])
            yield r["rom_id"], r["id"], r["path"]

    return kernel(ready, run, "rom_id string, id string, decoded_png_path string")


def manifest_lines(records: DataFrame) -> DataFrame:
    """``rom_id``, ``id`` and ``line``: each record as JSON in which absent values are left out."""
    return records.select("rom_id", "id", F.to_json(F.struct("id", *[c for c in records.columns if c not in ("id", "rom_id")])).alias("line"))


def write_manifests(records: DataFrame, folder: str, titles: DataFrame | None = None) -> DataFrame:
    """``manifest.json`` of each image under ``folder/<image>``: the envelope and all its records in the order of their ids;
    returns ``rom_id`` and ``path``. A task writes one image's manifest as a stream, line by line."""
    lines = manifest_lines(records)
    head = lines.groupBy("rom_id").agg(F.count("*").alias("n"))
    if titles is not None:
        head = head.join(titles.select("rom_id", "title_id", "game"), "rom_id", "left")
    head = head.select("rom_id", F.lit("").alias("id"), F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in head.columns if c not in ("rom_id", "n")], F.col("rom_id").alias("rom_file"), F.col("n").alias("texture_count"))).alias("line"))
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = head.unionByName(lines).repartition(tasks, "rom_id").sortWithinPartitions("rom_id", F.length("id"), "id")

    def run(batches):
        out, own, first = None, None, True

        def close():
            out.write(b"\n]}")
            out.close()

        for batch in batches:
            for rom, key, line in zip(*(batch.column(c).to_pylist() for c in ("rom_id", "id", "line")), strict=True):
                if not key:
                    if out is not None:
                        close()
                    path = f"{folder}/{output_folder(rom)}/manifest.json"
                    system, place = locate(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out, own, first = system.open_output_stream(place, compression=None), rom, True
                    out.write(line[:-1].encode() + b', "textures": [\n')
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([path])], names=["rom_id", "path"])
                else:
                    out.write((b"" if first else b",\n") + line.encode())
                    first = False
        if out is not None:
            close()

    return arrow_kernel(ordered, run, "rom_id string, path string")


def read_manifests(spark, folder: str) -> DataFrame:
    """Records of all manifests under a folder; a folder without one is an error."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(folder)
    return found.select(F.col("rom_file").alias("rom_id"), F.explode("textures").alias("t")).select("rom_id", "t.*")


def output_folder(name: str | None) -> str:
    """``names.output_folder`` of one value."""
    return re.sub(r'[<>:"/\\|?*]', "", name or "").strip() or "output"


def write_json(path: str, value: object) -> None:
    _put(path, json.dumps(value, indent=2, ensure_ascii=False).encode())


def quality_text(row: dict) -> str:
    """A quality report as text: a line for each number."""
    return "\n".join(["Quality report", "=" * 14, *[f"{k}: {v}" for k, v in row.items()]]) + "\n"


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """The reports of one line an image as files of their own, and the manifests; images' names are folders."""
    write_manifests(tables["records"], folder).write.mode("overwrite").parquet(f"{folder}/manifests")
    for name in ("summary", "quality"):
        for r in tables[name].toLocalIterator():  # a line for each image
            row = r.asDict(recursive=True)
            base = f"{folder}/{output_folder(row['rom_id'])}/{name}"
            write_json(f"{base}.json", row)
            if name == "quality":
                _put(f"{base}.txt", quality_text(row).encode())


def write_pack(pack: dict[str, DataFrame], images: str, folder: str) -> DataFrame:
    """Copies a pack's images (``source`` under ``images``) to their names in ``folder``, each by the task that has its row, and
    writes ``pack.json``; returns ``file`` and ``copied``."""

    def run(rows):
        for r in rows:
            try:
                system, place = locate(f"{images}/{r['source']}")
                with system.open_input_file(place) as f:
                    _put(f"{folder}/{r['file']}", f.read())
                yield r["file"], True
            except FileNotFoundError:
                yield r["file"], False

    write_json(f"{folder}/pack.json", pack["meta"].first().asDict())
    return kernel(pack["files"].where("source is not null").select("file", "source").dropDuplicates(["file"]), run, "file string, copied boolean")


def swap_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` over the JSON table at ``path`` that it may have been read from: beside it first, then in its place."""
    system, place = locate(path)
    fresh = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").json(fresh)
    system.delete_dir(place)
    system.move(locate(fresh)[1], place)


#: Images of a contact sheet, its columns and the sides of its cells.
SHEET_IMAGES, SHEET_COLUMNS, SHEET_CELL = 600, 10, 64


def thumbnail(image: np.ndarray, cell: int = SHEET_CELL) -> np.ndarray:
    """An RGBA image in a cell: its nearest pixels, and white around them."""
    h, w = image.shape[:2]
    n = max(h, w, 1)
    y, x = np.arange(max(1, h * cell // n)) * n // cell, np.arange(max(1, w * cell // n)) * n // cell
    out = np.full((cell, cell, 4), 255, np.uint8)
    out[: len(y), : len(x)] = image[np.minimum(y, h - 1)][:, np.minimum(x, w - 1)]
    return out


def write_contact_sheets(found: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """``contact_sheet.png`` of the first ``SHEET_IMAGES`` different textures of each image, row by row; returns ``rom_id`` and
    ``images``. Tasks make the thumbnails; one task has those of an image, which are of a fixed size."""
    n = F.row_number().over(Window.partitionBy("rom_id").orderBy(F.length("id"), "id"))
    first = records.where("duplicate_of is null").select("rom_id", "file_idx", "seq", "id").withColumn("n", n).where(F.col("n") <= SHEET_IMAGES)
    shown = found.where("kind = 'texture'").join(first, ["rom_id", "file_idx", "seq"]).select("rom_id", "n", "format", "width", "height", "crop_width", "crop_height", "payload")

    def small(rows):
        for r in rows:
            image = pixels.decode(r["format"], r["width"], r["height"], r["payload"])
            if r["crop_width"]:
                image = image[: r["crop_height"], : r["crop_width"]]
            yield r["rom_id"], r["n"], thumbnail(image).tobytes()

    cells = kernel(shown, small, "rom_id string, n int, pixels binary")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sheet(batches):
        own, parts = None, []

        def done() -> pa.RecordBatch:
            rows = -(-len(parts) // SHEET_COLUMNS)
            raster = np.full((rows * SHEET_CELL, SHEET_COLUMNS * SHEET_CELL, 4), 255, np.uint8)
            for i, part in enumerate(parts):
                top, left = i // SHEET_COLUMNS * SHEET_CELL, i % SHEET_COLUMNS * SHEET_CELL
                raster[top : top + SHEET_CELL, left : left + SHEET_CELL] = np.frombuffer(part, np.uint8).reshape(SHEET_CELL, SHEET_CELL, 4)
            _put(f"{folder}/{output_folder(own)}/contact_sheet.png", encode_png(raster))
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([len(parts)], pa.int32())], names=["rom_id", "images"])

        for batch in batches:
            for rom, part in zip(batch.column("rom_id").to_pylist(), batch.column("pixels").to_pylist(), strict=True):
                if rom != own and parts:
                    yield done()
                    parts = []
                own = rom
                parts.append(part)
        if parts:
            yield done()

    return arrow_kernel(cells.repartition(tasks, "rom_id").sortWithinPartitions("rom_id", "n"), sheet, "rom_id string, images int")
