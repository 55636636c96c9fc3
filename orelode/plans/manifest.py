"""Reports over manifest records: the relational layer, on records derived from parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.pixels import BITS, NAMES
from orelode.operators import names as N
from orelode.plans.registry import query, table

CONFIDENCE = {"A": "high", "N": "medium", "R": "low"}
FLAGS = ("SUSPICIOUS_SOLID", "SUSPICIOUS_LOW_VARIANCE", "SUSPICIOUS_EXTREME", "SUSPICIOUS_DIMS", "INFO_NORMAL_MAP")

_NAME_CASE = "case code " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end"
_BITS_CASE = "case code " + " ".join(f"when {i} then {BITS[n]}" for i, n in enumerate(NAMES)) + " end"
#: The records as SQL: a row for each line item.
RECORDS = f"""
base as (select l_orderkey * 8 + l_linenumber as seq, l_orderkey as file_idx, l_linenumber as line, l_partkey % 14 as code,
  (1::bigint << (3 + p_size % 6)::bigint)::bigint as width, (1::bigint << (3 + l_linenumber % 6)::bigint)::bigint as height,
  'parser' || (l_suppkey % 5) as parser, case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'low' end as confidence,
  md5((l_partkey % 700) || ':' || l_linenumber) as content_hash, l_discount >= 0.08 as suspicious, l_quantity::bigint as quantity,
  p_name as name, p_brand as brand, l_partkey as part
  from lineitem join part on l_partkey = p_partkey),
records as (select *, {_NAME_CASE} as format, width * height * ({_BITS_CASE}) // 8 as raw_size from base)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    power = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (3 + c % 6).cast("int"))
    code = F.col("l_partkey") % 14
    confidence = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    rows = items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_orderkey").alias("file_idx"),
        F.col("l_linenumber").alias("line"),
        code.alias("code"),
        power(F.col("p_size")).alias("width"),
        power(F.col("l_linenumber")).alias("height"),
        F.concat(F.lit("parser"), (F.col("l_suppkey") % 5).cast("string")).alias("parser"),
        confidence.alias("confidence"),
        F.md5(F.concat_ws(":", (F.col("l_partkey") % 700).cast("string"), F.col("l_linenumber").cast("string"))).alias("content_hash"),
        (F.col("l_discount") >= 0.08).alias("suspicious"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("l_partkey").alias("part"),
    )
    return rows.withColumn("format", N.format_name(F.col("code"))).withColumn("raw_size", N.texture_bytes(F.col("width"), F.col("height"), F.col("code")))


@query(f"with {RECORDS} select format, count(*) as textures, (count(*) * 10000 // (select count(*) from records))::bigint as per_10000 from records group by format")
def format_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    counts = r.groupBy("format").agg(F.count("*").alias("textures"))
    total = counts.agg(F.sum("textures").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("format", "textures", F.expr("textures * 10000 div total").alias("per_10000"))  # one row


@query(f"with {RECORDS} select parser, format, count(*) as n from records group by grouping sets ((parser), (format))")
def parser_format_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.groupingSets([["parser"], ["format"]], "parser", "format").agg(F.count("*").alias("n"))


@query(f"""with {RECORDS} select count(*) as recognised, count(*) filter (where not suspicious) as valid, count(*) filter (where suspicious) as suspicious,
count(distinct content_hash) as unique_textures, count(*) - count(distinct content_hash) as duplicates, sum(raw_size)::bigint as raw_bytes, count(distinct file_idx) as files from records""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.agg(F.count("*").alias("recognised"), F.count_if(~F.col("suspicious")).alias("valid"), F.count_if("suspicious").alias("suspicious"), F.countDistinct("content_hash").alias("unique_textures"), (F.count("*") - F.countDistinct("content_hash")).alias("duplicates"), F.sum("raw_size").alias("raw_bytes"), F.countDistinct("file_idx").alias("files"))


@query(f"with {RECORDS} select confidence, format, parser, suspicious, count(*) as n, max(raw_size) as largest from records group by all")
def report_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("confidence", "format", "parser", "suspicious").agg(F.count("*").alias("n"), F.max("raw_size").alias("largest"))


@query(f"""with {RECORDS} select seq, content_hash, min(seq) over (partition by content_hash) as first_seq,
case when seq > min(seq) over (partition by content_hash) then 'tex_' || min(seq) over (partition by content_hash) end as duplicate_of from records""")
def first_occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("seq", "content_hash")
    first = r.groupBy("content_hash").agg(F.min("seq").alias("first_seq"))  # combined before the shuffle, unlike a window
    out = r.join(first, "content_hash")
    return out.select("seq", "content_hash", "first_seq", F.when(F.col("seq") > F.col("first_seq"), F.concat(F.lit("tex_"), F.col("first_seq").cast("string"))).alias("duplicate_of"))


@query(f"with {RECORDS}, k as (select content_hash, min(struct_pack(seq := seq, format := format, width := width, height := height, raw_size := raw_size)) as k from records group by content_hash) select k.seq, content_hash, k.format, k.width, k.height, k.raw_size from k")
def deduplicated_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    keep = F.struct("seq", "format", "width", "height", "raw_size")
    return r.groupBy("content_hash").agg(F.min(keep).alias("k")).select("k.seq", "content_hash", "k.format", "k.width", "k.height", "k.raw_size")


@query(f"with {RECORDS} select content_hash, count(*) as copies, min(seq) as first_seq from records group by content_hash having count(*) > 1 order by copies desc, content_hash limit 10")
def top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("seq").alias("first_seq")).where("copies > 1").orderBy(F.desc("copies"), "content_hash").limit(10)


@query(f"with {RECORDS} select width, height, count(*) as n from records group by width, height order by n desc, width, height limit 15")
def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("width", "height").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width", "height").limit(15)


@query(f"with {RECORDS} select file_idx, line, row_number() over (order by file_idx, line) - 1 as global_id from records")
def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_global_id(records(spark, sf_dir).select("file_idx", "line"), ["file_idx", "line"], "global_id")


def with_global_id(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Running numbers from 0 in total order, without a window over all rows.

    Rows are dealt out by ranges; a number within each range, plus the counts of the ranges before it. The counts are a
    line for each task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).persist()
    before, total = {}, 0
    for r in sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before[r["_part"]] = total
        total += r["n"]
    base = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    start = F.try_element_at(base, F.col("_part")) if base is not None else F.lit(0)
    return ranged.withColumn(name, (local + start).cast("bigint")).drop("_part")


@query(f"with {RECORDS}, n as (select *, row_number() over (order by file_idx, line) - 1 as i from records) select seq, i::bigint as position from n where (i + 1) % 20 = 0")
def sample_every_20th(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = with_global_id(records(spark, sf_dir).select("seq", "file_idx", "line"), ["file_idx", "line"], "position")
    return numbered.where("(position + 1) % 20 = 0").select("seq", "position")


@query(f"with {RECORDS}, f as (select seq from records where not suspicious order by seq limit 600), n as (select seq, row_number() over (order by seq) - 1 as i from f) select seq, (i % 10)::bigint as col, (i // 10)::bigint as row from n")
def contact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = records(spark, sf_dir).where(~F.col("suspicious")).select("seq").orderBy("seq").limit(600)  # a contact sheet shows 600
    n = F.row_number().over(Window.orderBy("seq")) - 1
    return first.withColumn("i", n.cast("bigint")).select("seq", (F.col("i") % 10).alias("col"), F.expr("i div 10").alias("row"))


@query(f"""with {RECORDS} select count(*) as total_textures, count(*) filter (where not suspicious) as valid, count(*) filter (where suspicious) as suspicious,
(count(*) filter (where not suspicious) * 1000 // count(*))::bigint as score_per_1000, count(*) filter (where suspicious and quantity % 4 = 0) as solid, count(*) filter (where suspicious and quantity % 4 = 1) as low_variance,
count(*) filter (where suspicious and quantity % 4 = 2) as extreme, count(*) filter (where suspicious and quantity % 4 = 3) as dims, count(*) filter (where format = 'HILO8') as normal_maps from records""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flagged(records(spark, sf_dir))
    hit = lambda i: F.count_if(F.col("suspicious") & F.array_contains("flags", FLAGS[i]))
    return r.agg(F.count("*").alias("total_textures"), F.count_if(~F.col("suspicious")).alias("valid"), F.count_if("suspicious").alias("suspicious"), F.expr("count_if(not suspicious) * 1000 div count(*)").alias("score_per_1000"), hit(0).alias("solid"), hit(1).alias("low_variance"), hit(2).alias("extreme"), hit(3).alias("dims"), F.count_if(F.array_contains("flags", FLAGS[4])).alias("normal_maps"))


def flagged(r: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("format") == "HILO8", FLAGS[4]), *[F.when(F.col("suspicious") & (F.col("quantity") % 4 == i), FLAGS[i]) for i in range(4)]))
    return r.withColumn("flags", flags)


@query(f"with {RECORDS} select seq, 'tex_' || seq || '.png' as file from records where suspicious order by seq limit 100")
def flagged_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("suspicious").select("seq", F.concat(F.lit("tex_"), F.col("seq").cast("string"), F.lit(".png")).alias("file")).orderBy("seq").limit(100)


@query(f"with {RECORDS} select brand, seq from records order by brand, seq limit 12")
def previews_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("brand", "seq").orderBy("brand", "seq").limit(12)


@query(f"""with {RECORDS} select seq, case when width < 16 then 'dims' when quantity % 17 = 0 then 'no pixels' end as reason, not (width < 16 or quantity % 17 = 0) as ok from records""")
def failures_unknowns_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("width") < 16, "dims").when(F.col("quantity") % 17 == 0, "no pixels")
    return records(spark, sf_dir).select("seq", reason.alias("reason"), reason.isNull().alias("ok"))


@query(f"""with {RECORDS} select seq, 'tex_' || case when part < 1000 then lpad(part::varchar, 4, '0') else part::varchar end || '_' || regexp_replace(regexp_replace(name, '[\\\\/ ]', '_', 'g'), '[^\\p{{L}}\\p{{N}}_.-]', '', 'g') || '_' || format || '_' || width || 'x' || height || '.png' as file,
'textures/' || lower(brand) || '/' || seq || '.png' as path from records""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    source = F.concat(F.lit("/"), F.lower("brand"), F.lit("/"), F.col("name"))
    return r.select("seq", N.output_name(F.col("part"), F.col("name"), F.col("code"), F.col("width"), F.col("height")).alias("file"), N.output_path(source, F.concat(F.col("seq").cast("string"), F.lit(".png"))).alias("path"))


@query(f"with {RECORDS} select seq, regexp_replace(brand || part, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '_' || width || 'x' || height || '_' || format || '.png' as pack_file from records")
def pack_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    source = F.concat(F.lit("/tex.d/"), F.col("brand"), F.col("part").cast("string"), F.lit(".tex"))
    return r.select("seq", N.pack_name(source, F.lit("x"), F.col("width"), F.col("height"), F.col("format")).alias("pack_file"))


# packs and dumps

_DUMPS = "dumps as (select s_suppkey as dump, (1::bigint << (3 + s_suppkey % 9)::bigint)::bigint as width, (1::bigint << (3 + (s_suppkey // 7) % 6)::bigint)::bigint as height, case s_suppkey % 3 when 0 then 'ETC1' when 1 then 'RGBA8' else 'L8' end as format, lower(md5(s_name))[:16] as hash from supplier)"


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    power = lambda c, n: F.call_function("shiftleft", F.lit(1).cast("bigint"), (3 + c % n).cast("int"))
    fmt = F.when(F.col("s_suppkey") % 3 == 0, "ETC1").when(F.col("s_suppkey") % 3 == 1, "RGBA8").otherwise("L8")
    return s.select(F.col("s_suppkey").alias("dump"), power(F.col("s_suppkey"), 9).alias("width"), power(F.expr("s_suppkey div 7"), 6).alias("height"), fmt.alias("format"), F.substring(F.md5(F.col("s_name").cast("binary")), 1, 16).alias("hash"))


@query(f"""with {RECORDS}, {_DUMPS}, firsts as (select width, height, format, min(seq) as seq from records group by all),
c as (select d.dump, d.hash, f.seq, contains(f.format, d.format) as same from dumps d join firsts f on d.width = f.width and d.height = f.height),
best as (select dump, hash, seq, same, row_number() over (partition by dump order by same desc, seq) as n from c)
select dump, hash, seq, same as format_matches from best where n = 1""")
def dump_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_dumps(dumps(spark, sf_dir), records(spark, sf_dir))


def match_dumps(dumped: DataFrame, r: DataFrame) -> DataFrame:
    """For each dump the first texture of its size, those first whose format's name contains the dump's.

    Only the first texture of each size and format can be one, so the records shrink to these before the join.
    """
    firsts = r.groupBy("width", "height", F.col("format").alias("own")).agg(F.min("seq").alias("seq"))
    found = dumped.join(firsts, ["width", "height"]).withColumn("other", ~F.contains("own", "format"))
    return found.groupBy("dump", "hash").agg(F.min(F.struct("other", "seq")).alias("b")).select("dump", "hash", "b.seq", (~F.col("b.other")).alias("format_matches"))


@query(f"with {RECORDS}, {_DUMPS} select dump, hash from dumps d where not exists (select 1 from records r where r.width = d.width and r.height = d.height and contains(r.format, d.format))")
def dump_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = records(spark, sf_dir).select("width", "height", F.col("format").alias("own")).distinct()
    d = dumps(spark, sf_dir)
    on = (d["width"] == sizes["width"]) & (d["height"] == sizes["height"]) & F.contains(sizes["own"], d["format"])
    return d.join(sizes, on, "left_anti").select("dump", "hash")


@query(f"""with {RECORDS}, {_DUMPS}, firsts as (select width, height, format, min(seq) as seq from records group by all),
c as (select d.dump, d.hash, f.seq, contains(f.format, d.format) as same from dumps d join firsts f on d.width = f.width and d.height = f.height),
best as (select dump, hash, seq, row_number() over (partition by dump order by same desc, seq) as n from c),
last as (select seq, arg_max(hash, dump) as dump_hash from best where n = 1 group by seq)
select seq, coalesce(dump_hash, 'tex_' || seq) as mapping_key, dump_hash is not null as mapped from records left join last using (seq)""")
def pack_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    last = match_dumps(dumps(spark, sf_dir), r).groupBy("seq").agg(F.max_by("hash", "dump").alias("dump_hash"))
    out = r.select("seq").join(last, "seq", "left")
    return out.select("seq", F.coalesce("dump_hash", F.concat(F.lit("tex_"), F.col("seq").cast("string"))).alias("mapping_key"), F.col("dump_hash").isNotNull().alias("mapped"))


@query(f"""with {RECORDS}, {_DUMPS}, firsts as (select width, height, format, min(seq) as seq from records group by all),
c as (select d.dump, f.seq, row_number() over (partition by d.dump order by contains(f.format, d.format) desc, f.seq) as n from dumps d join firsts f on d.width = f.width and d.height = f.height), hit as (select distinct seq from c where n = 1)
select format, count(*) as files, count(distinct brand || '_' || width || 'x' || height || '_' || format) as distinct_files, count(hit.seq) as mapped, count(*) - count(hit.seq) as unmapped from records left join hit using (seq) group by format""")
def pack_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack's counters by format: files, names, and how many records a dump has given a hash."""
    r = records(spark, sf_dir)
    hit = match_dumps(dumps(spark, sf_dir), r).select("seq", F.lit(1).alias("hit")).distinct()
    named = r.join(hit, "seq", "left").withColumn("file", F.concat_ws("_", "brand", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")), "format"))
    return named.groupBy("format").agg(F.count("*").alias("files"), F.countDistinct("file").alias("distinct_files"), F.count("hit").alias("mapped"), (F.count("*") - F.count("hit")).alias("unmapped"))


@query("""with f as (select s_suppkey, case s_suppkey % 4 when 0 then 'tex1_' || (8 << (s_suppkey % 5)::int) || 'x64_' || upper(md5(s_name)[:16]) || '_ETC1_mip' || (s_suppkey % 3) || '.png' when 1 then '0x' || md5(s_name)[:8] || '_512x512.png' when 2 then md5(s_name) || '.png' else 'menu-' || s_suppkey || '.png' end as file from supplier),
t as (select *, case s_suppkey % 4 when 0 then ltrim(md5(s.s_name)[:16], '0x') when 1 then case when regexp_full_match(md5(s.s_name)[:8], '[0-9]+') then '' else ltrim(md5(s.s_name)[:8], '0x') end when 2 then ltrim(md5(s.s_name), '0x') else '' end as h from f join supplier s using (s_suppkey))
select s_suppkey, file, case when length(h) >= 8 then h else '' end as hash, case s_suppkey % 4 when 0 then (8 << (s_suppkey % 5)::int)::int when 1 then 512 else 0 end as width, case s_suppkey % 4 when 0 then 64 when 1 then 512 else 0 end as height, case s_suppkey % 4 when 0 then 'ETC1' else '' end as format, case s_suppkey % 4 when 0 then (s_suppkey % 3)::int else 0 end as mip from t""")
def dump_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k, digest = F.col("s_suppkey"), F.md5(F.col("s_name").cast("binary"))
    size = F.call_function("shiftleft", F.lit(8), (k % 5).cast("int")).cast("string")
    file = F.when(k % 4 == 0, F.concat(F.lit("tex1_"), size, F.lit("x64_"), F.upper(F.substring(digest, 1, 16)), F.lit("_ETC1_mip"), (k % 3).cast("string"), F.lit(".png")))
    file = file.when(k % 4 == 1, F.concat(F.lit("0x"), F.substring(digest, 1, 8), F.lit("_512x512.png"))).when(k % 4 == 2, F.concat(digest, F.lit(".png"))).otherwise(F.concat(F.lit("menu-"), k.cast("string"), F.lit(".png")))
    return s.select("s_suppkey", file.alias("file")).withColumn("t", N.dump_tokens(F.col("file"))).select("s_suppkey", "file", "t.*")


_TITLES = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in N.TITLES.items())


@query(f"""with t as (select c_custkey, case c_custkey % 3 when 0 then lower(hex(1125899906842624 + (c_custkey % 40) * 256 + 198656)) else lower(hex(c_custkey)) end as tid, case c_custkey % 2 when 0 then 'CTR-P-' || upper(c_mktsegment[:4]) else '' end as product from customer),
p as (select *, lpad(upper(tid), 16, '0') as padded from t), k(id, title) as (values {_TITLES})
select c_custkey, padded as title_id, coalesce(title, case when product <> '' then 'Game ' || product[7:] end, 'Game ' || right(padded, 8)) as title from p left join k on id = padded""")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tid = F.lower(F.hex(F.when(k % 3 == 0, F.lit(1125899906842624) + (k % 40) * 256 + 198656).otherwise(k)))
    product = F.when(k % 2 == 0, F.concat(F.lit("CTR-P-"), F.upper(F.substring("c_mktsegment", 1, 4)))).otherwise("")
    return c.select("c_custkey", F.lpad(F.upper(tid), 16, "0").alias("title_id"), N.title_name(tid, product).alias("title"))


@query("""with d as (select c_custkey, c_name, c_mktsegment, c_nationkey from customer) select n_name as status, count(*) as games, (count(*) * 1000 // (select count(*) from customer))::bigint as per_1000, min(c_name) as first_game from d join nation on c_nationkey = n_nationkey group by n_name""")
def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    total = c.agg(F.count("*").alias("total"))
    by = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("status")).agg(F.count("*").alias("games"), F.min("c_name").alias("first_game"))
    return by.crossJoin(F.broadcast(total)).select("status", "games", F.expr("games * 1000 div total").alias("per_1000"), "first_game")  # one row


@query("select event_id, event_type, round(value)::bigint as whole from events where event_type in ('click', 'purchase') order by ts desc, event_id limit 50")
def history_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    return e.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", F.round("value").cast("bigint").alias("whole"))


@query("select distinct user_id, false as queued from events where event_type = 'purchase' and user_id not in (select user_id from events where event_type = 'signup') union all select distinct user_id, true from events where event_type = 'signup'")
def queue_append_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    queue = e.where("event_type = 'signup'").select("user_id").distinct()
    new = e.where("event_type = 'purchase'").select("user_id").distinct().join(queue, "user_id", "left_anti")
    return new.withColumn("queued", F.lit(False)).unionByName(queue.withColumn("queued", F.lit(True)))
