"""Images end to end: container chain, data source, nested extraction, packs, files, streams."""

import os

import pytest

from orelode import api
from orelode.functions import archives, lz, texture_builders
from orelode.operators.extract import unpack
from orelode.sources import rom

PIXELS = os.urandom(128 * 64)
CTPK = texture_builders.build_ctpk(128, 64, PIXELS)
DEEP = lz.pack_yaz0(archives.pack_garc([("a", lz.pack_lz11(archives.pack_sarc([("t.ctpk", CTPK), ("n.txt", b"nothing")]))), ("b", CTPK)]))
FILES = [("a/tex/one.ctpk", CTPK), ("a/deep.bin", DEEP), ("readme.txt", b"skip me, I am text"), ("sound.dat", b"RIFF" + bytes(40)), ("empty.bin", b"")]
TITLE = 0x0004000000055E00


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    ncch = rom.build_ncch(rom.build_romfs(FILES), TITLE, "CTR-P-TEST")
    (d / "game.3ds").write_bytes(rom.build_ncsd(ncch, TITLE))
    (d / "locked.cxi").write_bytes(rom.build_ncch(rom.build_romfs(FILES), 5, "CTR-P-X", encrypted=True))
    return d


@pytest.mark.parametrize(("wrap", "name", "chain"), [(lambda n: rom.build_ncsd(n, TITLE), "x.3ds", "NCSD/NCCH/RomFS"), (rom.build_cia, "x.cia", "CIA/NCCH/RomFS"), (lambda n: n, "x.cxi", "NCCH/RomFS"), (lambda n: rom.build_ncsd(n, TITLE), "", "NCSD/NCCH/RomFS"), (rom.build_cia, "", "CIA/NCCH/RomFS")])
def test_containers(wrap, name, chain):
    source = rom.Source(wrap(rom.build_ncch(rom.build_romfs(FILES), TITLE, "CTR-P-TEST")))
    image = rom.open_image(source, name)
    assert image.container == chain and image.title_id == f"{TITLE:016X}"
    assert {p.lstrip("/"): source.read(at, n) for p, at, n in image.files} == dict(FILES)


def test_encrypted_and_foreign():
    with pytest.raises(rom.Encrypted):
        rom.open_image(rom.Source(rom.build_ncch(rom.build_romfs(FILES), 5, "X", encrypted=True)), "a.cxi")
    with pytest.raises(rom.Broken):
        rom.open_image(rom.Source(bytes(4096)), "a.3ds")


def test_scan(spark, folder):
    found = api.scan(spark, str(folder))
    assert found["files"].count() == len(FILES)
    assert [r.game for r in found["titles"].collect()] == ["Pokemon Y"]


@pytest.mark.parametrize("mode", ["levels", "fused"])
def test_extract(spark, folder, tmp_path, mode):
    out = api.extract(spark, str(folder), api.Options(mode=mode, output=str(tmp_path / "out")))
    rows = out["records"].orderBy("id").collect()
    assert [r.format for r in rows] == ["L8"] * 3 and [(r.width, r.height) for r in rows] == [(128, 64)] * 3
    assert [r.duplicate_of for r in rows] == [None, rows[0].id, rows[0].id]
    assert sorted(r.chain for r in rows) == sorted(["/a/tex/one.ctpk", "/a/deep.bin>decompressed>0000.bin[lz]/t.ctpk", "/a/deep.bin>decompressed>0001.ctpk"])
    assert {r.reason for r in out["failures"].collect()} == {"the content is encrypted"}
    assert "52494646" in {r.magic for r in out["unknowns"].collect()}
    assert len(list((tmp_path / "out").rglob("textures/**/*.png"))) == 1 and len(list((tmp_path / "out").rglob("contact_sheet.png"))) == 1
    records = out["records"]
    dumps = spark.createDataFrame([("tex1_128x64_ABCDEF0123456789_L8_mip0.png",), ("tex1_8x8_ABCDEF0123456789_L8.png",)], "filename string")
    merged = api.import_dump(records, dumps)
    assert merged["records"].where("dump_hash = 'abcdef0123456789'").count() == 1 and merged["unmatched"].count() == 1
    meta = api.build_pack(merged["records"])["meta"].first()
    assert (meta.texture_count, meta.mapped_count, meta.unmapped_count) == (3, 1, 2) and meta.warning


def test_embedded_wrapped_and_skipped(spark):
    bch = texture_builders.build_bch(128, 64, PIXELS)
    cgfx = texture_builders.build_cgfx(128, 64, PIXELS)
    blobs = [b"????????" * 3 + CTPK, b"PC".ljust(0x80, b"\0") + bch, archives.pack_garc([("a", bch), ("b", cgfx)]), b"nothing at all here"]
    df = spark.createDataFrame([("r", i, [], f"f{i}", b) for i, b in enumerate(blobs)], "rom_id string, file_idx int, seq array<int>, chain string, payload binary")
    for mode in ("levels", "fused"):
        rows = sorted((r.file_idx, r.kind, r.parser, r.confidence, r.chain) for r in unpack(df, mode).collect() if r.kind == "texture")
        assert rows == [(0, "texture", "ctpk@embedded+0x18", "medium", "f0[+0x18]"), (1, "texture", "bch", "medium", "f1[unwrap]"), (2, "texture", "cgfx", "high", "f2>0001.cgfx")]


def test_depth_limit(spark):
    blob = CTPK
    for _ in range(9):
        blob = archives.pack_sarc([("x", blob)])
    df = spark.createDataFrame([("r", 0, [], "x", blob)], "rom_id string, file_idx int, seq array<int>, chain string, payload binary")
    for mode in ("levels", "fused"):
        assert [r.note for r in unpack(df, mode).where("kind = 'failure'").collect()] == ["too deep"]


def test_stream(spark, tmp_path):
    from orelode.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ctpk").write_bytes(CTPK)
    (tmp_path / "in" / "b.ctpk").write_bytes(CTPK)
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_pairs_titles_guesses_and_packed_resources(spark, tmp_path):
    """Files that need another file or the image's title, and raw pixels: through the data source and the verbs."""
    import zlib

    header, pixels = texture_builders.build_gdb1(128, 64, PIXELS)
    packed = bytes([0xCC]) * 16 + zlib.compress(CTPK, 0)
    index = b"of\x01\0" + (2).to_bytes(4, "little") + b"".join(x.to_bytes(4, "little") for x in (0xABCDEF01, 8, len(packed), 7, 0, 99))
    # literal bytes of a header: 64 x 64 of the family's format 0x0C, behind 0x14 bytes
    tex = bytes.fromhex("54455800A500002001100002010C010000000000") + os.urandom(4096)
    files = [("t/a.texturegdb", header), ("T/A.texturebin", pixels), ("t/lone.texturegdb", header), ("body.tex", tex), ("ls", index), ("dt", bytes(8) + packed), ("raw.dat", os.urandom(8192)), ("bad.tex", b"TEX\0" + b"\xff" * 18)]
    title = 0x0004000000060200
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g?.3ds").write_bytes(rom.build_ncsd(rom.build_ncch(rom.build_romfs(files), title, "CTR-P-TEST"), title))
    out = api.extract(spark, str(tmp_path / "in"), api.Options(scan_all=True, output=str(tmp_path / "out")))
    found = {r.chain: (r.format, r.width, r.height, r.parser, r.confidence) for r in out["records"].collect()}
    assert found["/t/a.texturegdb"][:4] == ("L8", 128, 64, "gdb1")
    assert found["body.tex"] == ("ETC1A4", 64, 64, "capcom_tex/rer_payload/full_payload/hdr=0x14/profile_fmt", "high")
    assert found["dt_smash_ABCDEF01.bch"][:4] == ("L8", 128, 64, "ctpk")
    assert found["raw.dat"][3:] == ("raw_heuristic", "low")
    assert "gdb1: no file of pixels" in {r.reason for r in out["failures"].collect()}
    assert {(r.path, r.status) for r in out["tex"].collect()} == {("body.tex", "parsed"), ("bad.tex", "failed")}
    assert [(r.total, r.parsed, r.partial, r.failed) for r in api.tex_status_counts(out["tex"]).collect()] == [(2, 1, 0, 1)]
    import json

    from orelode import sinks

    folder = tmp_path / "out" / "g.3ds"
    manifest = json.loads((folder / "manifest.json").read_text())
    assert manifest["schema_version"] == 2 and manifest["texture_count"] == len(manifest["textures"]) == len(found)
    assert [t["id"] for t in manifest["textures"]] == sorted(t["id"] for t in manifest["textures"])
    assert json.loads((folder / "quality.json").read_text())["total"] == len(found) and "valid" in (folder / "quality.txt").read_text()
    assert sinks.read_manifests(spark, str(tmp_path / "out")).count() == len(found)
    # a pack of the images that were written, by the command line; and an import of a dump
    from orelode.__main__ import main

    assert main(["build-pack", str(tmp_path / "out")]) == 0
    assert len(list((tmp_path / "out" / "pack").glob("*.png"))) == len(list(folder.rglob("textures/**/*.png"))) > 0
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "tex1_64x64_ABCDEF0123456789_ETC1A4_mip0.png").write_bytes(b"x")
    assert main(["import-dump", str(tmp_path / "out"), "--dump", str(tmp_path / "dump")]) == 0
    assert json.loads((tmp_path / "out" / "import_dump_report.json").read_text()) == {"matched": 1, "unmatched": 0}
    assert spark.read.json(str(tmp_path / "out" / "records")).where("dump_hash = 'abcdef0123456789'").count() == 1
    assert main(["report", str(tmp_path)]) == 1
    assert api.read_file(spark, str(tmp_path / "in"), "T/a.TEXTUREBIN") == pixels and api.read_file(spark, str(tmp_path / "in"), "none") is None
    sheet = (folder / "contact_sheet.png").read_bytes()
    assert sheet[:8] == b"\x89PNG\r\n\x1a\n" and [r.images for r in spark.read.parquet(str(tmp_path / "out" / "contact_sheets")).collect()] == [len(found) - sum(r.duplicate_of is not None for r in out["records"].collect())]
    assert [(r.name, r.size_mb) for r in api.library(spark, str(tmp_path / "in")).collect()] == [("g?.3ds", 0.0)]


def test_fingerprints_of_literal_headers():
    """Readers on bytes that are written out by hand, not by the builders."""
    from orelode.functions import textures

    # 8,192 bytes of a register file with nothing told: sizes 64 and 32, format 12, place 0
    words = b"".join(x.to_bytes(4, "little") for x in (64, 32, 12, 0))
    bch = b"BCH\0" + b"".join(x.to_bytes(4, "little") for x in (0, 0, 0, 0, 0x50, 0, 0)) + bytes(0x20) + words + bytes(range(256)) * 4
    found, error = textures.textures("bch", bch)
    assert error is None and [(t.format, t.width, t.height, len(t.data)) for t in found] == [("ETC1", 64, 32, 1024)]
    # the header's fixed fields of four layouts
    px = bytes(128 * 64)
    cases = {
        b"TEX\0\x01\0" + bytes.fromhex("80004000010710000000") + px: ("standard_tex", "high", 128, 64),
        b"\x01\x02\x03\x04\x07\x01" + bytes.fromhex("80004000000000200000") + px: ("mt_mobile", "medium", 128, 64),
        b"TEX\0" + b"\xff" * 6 + bytes.fromhex("80004000010714000000") + px: ("shifted_tex", "medium", 128, 64),
        b"TEX\0" + b"\xff" * 16 + px: ("payload_bruteforce/hdr=0x14", "low", 128, 128),
    }
    for data, want in cases.items():
        (t,), error = textures.textures("capcom_tex", data)
        assert error is None and (t.parser.removeprefix("capcom_tex/"), t.confidence, t.width, t.height) == want
    # a table of levels behind the header: 4,096 bytes for the first level of 64 x 64 and three smaller ones
    levels = b"".join(x.to_bytes(4, "little") for x in (4096, 5120, 5376, 0))
    data = bytes.fromhex("54455800A500002001100002010C010000000000") + levels + bytes(5441)
    (t,), _ = textures.textures("capcom_tex", data, "0004000000060200")
    assert (t.format, t.width, t.height, t.parser) == ("ETC1A4", 64, 64, "capcom_tex/rer_payload/mip_table/entries=3/profile_fmt")
    # 24 bits: any of the sizes with the game's formats
    data = bytes.fromhex("54455800A500046002080001060B010000000000") + bytes(393216)
    (t,), _ = textures.textures("capcom_tex", data, "0004000000060200")
    assert t.format == "RGB8" and {t.width, t.height} == {256, 512}
    # a model of sections: offsets, the section's type, name, size and format
    section = bytes(8) + b"texture\0".ljust(32, b"\0") + b"skin\0".ljust(0x40, b"\0") + bytes.fromhex("40002000 2800") + bytes(0x12)
    body = b"PC\x02\0" + b"".join(x.to_bytes(4, "little") for x in (16, 16 + 0x80 + 1024, 16 + 0x80 + 1024)) + section + bytes(1024)
    assert len(section) == 0x80
    assert [(t.name, t.format, t.width, t.height, len(t.data)) for t in textures.sectioned(body)] == [("skin", "ETC1", 64, 32, 1024)]


def test_bch_sections_are_probed():
    """Without anything told, the last pair of sizes of each entry counts, and the last word that may be its format."""
    from orelode.functions import bch
    from orelode.functions.archives import View

    entry = lambda *w: b"".join(x.to_bytes(4, "little") for x in w)
    rows = [entry(16, 32, 5, 64, 128, 12), entry(999, 999, 999, 999, 999, 999), entry(8, 8, 3, 999, 999, 999)]
    head = bytearray(0x80)
    head[:4] = b"BCH\0"
    head[0x14:0x18] = (0xF0).to_bytes(4, "little")
    head[8:12] = (0x20).to_bytes(4, "little")
    head[0x44:0x4C] = entry(0x80, 3)
    data = bytes(head) + b"".join(rows) + bytes(9000)
    found = [(t.width, t.height, t.format) for t in bch.probed(View(data))]
    assert found[:2] == [(128, 64, "ETC1"), (8, 8, "RGB565")]
