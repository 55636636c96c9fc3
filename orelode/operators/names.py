"""Names of files in and out: built and taken apart with string expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelode.functions.pixels import BITS, NAMES

#: Names that codes may be asked for, lower-case letters and digits of hexadecimal.
_HEX = "^[0-9a-f]+$"


def format_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i, n in enumerate(NAMES) for x in (i, n)])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("UNKNOWN_0x"), F.hex(code)))


def format_bits(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(NAMES) for x in (i, BITS[n])]), code.cast("int"))


def texture_bytes(width: Column, height: Column, code: Column) -> Column:
    return F.floor((width.cast("bigint") * height * format_bits(code) + 7) / 8)


def next_power_of_two(v: Column) -> Column:
    """The least power of two that isn't smaller; 1 for anything below 2."""
    x = F.greatest(v, F.lit(1)).cast("bigint") - 1
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return x + 1


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def output_name(index: Column, name: Column, code: Column, width: Column, height: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[\\/ ]", "_"), r"[^\p{L}\p{N}_.-]", "")
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat(F.lit("tex_"), _four(index), F.lit("_"), F.when(F.coalesce(name, F.lit("")) != "", F.concat(clean, F.lit("_"))).otherwise(""), format_name(code), F.lit("_"), size, F.lit(".png"))


def _four(index: Column) -> Column:
    text = index.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def output_path(source: Column, name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(source, r"\\", "/"), "^/+", "")
    folder = F.regexp_extract(clean, "^(.*/)[^/]*$", 1)
    return F.concat(F.lit("textures/"), folder, name)


def pack_name(source: Column, tex_id: Column, width: Column, height: Column, name: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(source, r"^.*/", ""), r"(?<=[^.])\.[^.]*$", "")
    base = F.when(F.coalesce(source, F.lit("")) != "", base).otherwise(tex_id)
    return F.concat(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("_"), name, F.lit(".png"))


def dump_tokens(filename: Column) -> Column:
    """A struct of hash, width, height, format and mip, from the parts of a dumped file's name; later parts win.

    A hash has eight hexadecimal digits or more once all leading ``0`` and ``x`` are gone.
    """
    base = F.regexp_replace(filename, r"\.[^.]*$", "")
    parts = F.split(F.translate(base, "-", "_"), "_")
    dims = F.filter(parts, lambda p: F.lower(p).rlike("^[0-9]+x[0-9]+$"))
    mips = F.filter(parts, lambda p: F.lower(p).rlike("^mip[+-]?[0-9]+$"))
    formats = F.filter(parts, lambda p: F.upper(p).isin(*NAMES))
    other = F.filter(parts, lambda p: ~(F.lower(p).rlike("^[0-9]+x[0-9]+$") | F.lower(p).rlike("^mip[+-]?[0-9]+$") | F.upper(p).isin(*NAMES)))
    bare = F.filter(F.transform(other, lambda p: F.regexp_replace(F.lower(p), "^[0x]+", "")), lambda p: (F.length(p) >= 8) & p.rlike(_HEX))
    whole = F.regexp_replace(F.lower(base), "^[0x]+", "")
    hash_ = F.coalesce(F.try_element_at(bare, F.lit(-1)), F.when((F.length(base) >= 8) & whole.rlike(_HEX), whole), F.lit(""))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    size = F.split(F.lower(last(dims)), "x")
    return F.struct(hash_.alias("hash"), F.coalesce(size[0].cast("int"), F.lit(0)).alias("width"), F.coalesce(size[1].cast("int"), F.lit(0)).alias("height"), F.coalesce(F.upper(last(formats)), F.lit("")).alias("format"), F.coalesce(F.substring(last(mips), 4, 9).cast("int"), F.lit(0)).alias("mip"))


#: Titles by id: fixed values.
TITLES = {
    "0004000000060200": "Resident Evil: Revelations",
    "0004000000035D00": "Resident Evil: Revelations",
    "0004000000060100": "Resident Evil: Revelations",
    "0004000000194200": "Corpse Party",
    "0004000000055E00": "Pokemon Y",
    "0004000000055D00": "Pokemon X",
    "0004000000175E00": "Pokemon Omega Ruby",
    "000400000011C400": "Pokemon Omega Ruby",
    "000400000011C500": "Pokemon Alpha Sapphire",
    "0004000000175F00": "Pokemon Alpha Sapphire",
    "0004000000030800": "Mario Kart 7",
    "0004000000033500": "Zelda: Ocarina of Time 3D",
    "0004000000033400": "Zelda: Ocarina of Time 3D",
    "000400000008F900": "Zelda: Majora's Mask 3D",
    "000400000008F800": "Zelda: Majora's Mask 3D",
    "0004000000086400": "Animal Crossing: New Leaf",
    "0004000000086300": "Animal Crossing: New Leaf",
    "0004000000030600": "Super Mario 3D Land",
    "0004000000030500": "Super Mario 3D Land",
}


def title_name(title_id: Column, product: Column) -> Column:
    padded = F.lpad(F.replace(F.upper(title_id), F.lit("0X"), F.lit("")), 16, "0")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), padded)
    code = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), ("CTR-P-", "CTR-N-"), product)
    by_product = F.when(F.coalesce(product, F.lit("")) != "", F.when(code != "", F.concat(F.lit("Game "), code)).otherwise(product))
    return F.coalesce(known, by_product, F.concat(F.lit("Game "), F.right(padded, F.lit(8))))


def replacement_name(width: Column, height: Column, xxh64: Column, code: Column) -> Column:
    """The name under which an emulator looks for a texture's replacement: size, hash of the stored bytes and format."""
    return F.concat(F.lit("tex1_"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("_"), F.upper(xxh64), F.lit("_"), code.cast("string"), F.lit(".png"))


def output_folder(name: Column) -> Column:
    """A title as a folder's name, without the signs that file systems don't take."""
    clean = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', ""))
    return F.when(F.coalesce(clean, F.lit("")) == "", "output").otherwise(clean)


def failing_kind(ext: Column, magic: Column) -> Column:
    """What kind of files a title without textures mostly has, by their extension and first bytes."""
    with_magic = lambda text: F.concat(F.lit(f"{text} (magic="), F.coalesce(magic, F.lit("?")), F.lit(")"))
    return F.when(ext.isin("data", "dict"), "NLG .data/.dict").when(ext == "arc", "proprietary .arc").when(ext == "bin", with_magic(".bin")).when(ext.isin("cmp", "lz", "lzs"), "compressed (.cmp/.lz)").when(ext == "bntx", "Switch BNTX").when(ext.isin("dat", "no_ext"), with_magic(".dat/raw")).otherwise("unknown")
