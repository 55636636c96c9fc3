"""Guesses and look-ups as joins: sizes to formats, chains of levels, neighbours in tables of offsets, as-of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.pixels import BITS, NAMES
from orelode.functions.textures import BFLIM_CODES
from orelode.operators import names as N
from orelode.plans.registry import query, table

_FORMATS = ", ".join(f"({i}, '{n}', {BITS[n]})" for i, n in enumerate(NAMES))
def formats(spark: SparkSession) -> DataFrame:
    """The 14 pixel formats: a fixed table."""
    return spark.createDataFrame([(i, n, BITS[n]) for i, n in enumerate(NAMES)], "code int, format string, bits int")


@query(f"with f(code, format, bits) as (values {_FORMATS}), t as (select p_partkey, 8 * (1 + p_size % 32) as w, 8 * (1 + p_partkey % 16) as h, (p_partkey % 16)::int as code from part) select p_partkey, coalesce(format, 'UNKNOWN_0x' || upper(hex(t.code))) as format, bits as bits, ((w * h * bits + 7) // 8)::bigint as n_bytes from t left join f using (code)")
def format_dim_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    w, h, code = 8 * (1 + F.col("p_size") % 32), 8 * (1 + F.col("p_partkey") % 16), F.col("p_partkey") % 16
    return p.select("p_partkey", N.format_name(code).alias("format"), N.format_bits(code).alias("bits"), N.texture_bytes(w, h, code).alias("n_bytes"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_partkey < 2 then 1 else (1::bigint << ceil(log2(l_partkey))::bigint)::bigint end as pow2, l_partkey > 0 and l_partkey & (l_partkey - 1) = 0 as is_pow2 from lineitem")
def next_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.next_power_of_two(v).alias("pow2"), N.is_power_of_two(v).alias("is_pow2"))


_BFLIM = ", ".join(f"({code}, '{name}')" for code, name in BFLIM_CODES.items())


@query(f"with b(code, format) as (values {_BFLIM}) select s_suppkey, (s_suppkey % 24)::bigint as code, format from supplier join b on code = s_suppkey % 24")
def format_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame(list(BFLIM_CODES.items()), "code bigint, format string")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 24).alias("code"))
    return s.join(F.broadcast(codes), "code").select("s_suppkey", "code", "format")  # 16 rows


@query(f"""with f(code, format, bits) as (values {_FORMATS}), d as (select 8 << i as w from range(8) t(i)), s as (select o_orderkey, (o_orderkey % 64 + 1) * 1024 as n from orders)
select o_orderkey, n::bigint as n_bytes, count(*) as candidates, min(code * 10000000 + w.w * 2000 + h.w)::bigint as first_candidate from s join f on true join d w on true join d h on n between w.w * h.w * bits // 8 and w.w * h.w * bits // 8 + 256 group by all""")
def size_to_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which formats and sizes a payload could be, with 256 bytes to spare.

    The 896 possible sizes are a fixed table, exploded to the payload sizes that they admit per distinct remainder class;
    payloads meet it by equality on the size.
    """
    side = spark.range(8).select(F.call_function("shiftleft", F.lit(8), F.col("id").cast("int")).cast("bigint").alias("w"))
    sizes = formats(spark).crossJoin(side).crossJoin(side.withColumnRenamed("w", "h"))  # fixed: 14 x 8 x 8
    sizes = sizes.withColumn("least", F.expr("w * h * bits div 8")).withColumn("rank", F.col("code") * 10000000 + F.col("w") * 2000 + F.col("h"))
    admitted = sizes.select("rank", F.explode(F.sequence("least", F.col("least") + 256)).alias("n_bytes")).groupBy("n_bytes").agg(F.count("*").alias("candidates"), F.min("rank").alias("first_candidate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 64 + 1) * 1024).alias("n_bytes"))
    return o.join(admitted, "n_bytes").select("o_orderkey", "n_bytes", "candidates", "first_candidate")


@query("""with s as (select p_partkey, (1024::bigint << (p_partkey % 11)::bigint)::bigint as pixels from part), c as (select p_partkey, pixels, 1::bigint << i as w, pixels // (1::bigint << i) as h from s, range(2, 11) t(i)),
k as (select *, 1 + 2 * (w = h)::int + (greatest(w, h) <= 4 * least(w, h))::int + (w between 32 and 512 and h between 32 and 512)::int as score from c where h between 4 and 1024 and h & (h - 1) = 0),
r as (select *, row_number() over (partition by p_partkey order by score desc, w) as n from k) select p_partkey, w::bigint as width, h::bigint as height, score::int as score from r where n = 1""")
def pow2_dims_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.call_function("shiftleft", F.lit(1024).cast("bigint"), (F.col("p_partkey") % 11).cast("int")).alias("pixels"))
    c = s.withColumn("i", F.explode(F.sequence(F.lit(2), F.lit(10)))).withColumn("w", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i"))).withColumn("h", F.expr("pixels div w"))
    good = c.where(F.col("h").between(4, 1024) & N.is_power_of_two(F.col("h")))
    near, mid = F.greatest("w", "h") <= 4 * F.least("w", "h"), F.col("w").between(32, 512) & F.col("h").between(32, 512)
    score = 1 + 2 * (F.col("w") == F.col("h")).cast("int") + near.cast("int") + mid.cast("int")
    best = good.groupBy("p_partkey").agg(F.min(F.struct((-score).alias("s"), "w", "h")).alias("b"))
    return best.select("p_partkey", F.col("b.w").alias("width"), F.col("b.h").alias("height"), (-F.col("b.s")).alias("score"))


@query("""with t(i) as (select unnest(range(2, 11))), l(j) as (select unnest(range(0, 9))), levels as (select i, j, greatest(1, (1 << i) >> j) as side from t, l where j <= i), sums as (select i, j, sum(side * side) over (partition by i order by j) as total from levels),
p as (select s_suppkey, (s_suppkey % 9 + 2)::bigint as i, (s_suppkey % 4)::bigint as j from supplier), q as (select s_suppkey, total as n_bytes from p join sums using (i, j))
select s_suppkey, n_bytes::bigint as n_bytes, min(s.i)::bigint as log_side, min(s.j)::bigint as levels_less_one, count(*) as matches from q join sums s on s.total = n_bytes group by all""")
def mipchain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side and number of levels whose squares add up to the payload: chains are a fixed table of running sums."""
    i = spark.range(2, 11).select(F.col("id").alias("i"))
    levels = i.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("i", F.lit(8).cast("bigint")))))
    levels = levels.withColumn("side", F.greatest(F.lit(1).cast("bigint"), F.expr("shiftright(shiftleft(1L, cast(i as int)), cast(j as int))")))
    sums = levels.withColumn("total", F.sum(F.col("side") * F.col("side")).over(Window.partitionBy("i").orderBy("j"))).select("i", "j", "total")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 + 2).alias("i"), (F.col("s_suppkey") % 4).alias("j"))
    q = p.join(F.broadcast(sums), ["i", "j"]).select("s_suppkey", F.col("total").alias("n_bytes"))  # 72 rows
    chains = sums.groupBy("total").agg(F.min("i").alias("log_side"), F.min("j").alias("levels_less_one"), F.count("*").alias("matches"))
    return q.join(F.broadcast(chains), q["n_bytes"] == chains["total"]).select("s_suppkey", "n_bytes", "log_side", "levels_less_one", "matches")


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), c as (select event_id as click_id, user_id, ts from events where event_type = 'click')
select p.event_id, p.user_id, c.click_id from p asof left join c on p.user_id = c.user_id and p.ts >= c.ts""")
def asof_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last click of its user before it: one sort by user and time instead of a range join."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    before = Window.partitionBy("user_id").orderBy("ts", F.col("event_type")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("click_id", F.last(click, ignorenulls=True).over(before)).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query("""with s as (select distinct l_suppkey as off, 'bch/struct' as parser from lineitem where l_linenumber = 1), h as (select l_partkey % 5000 as off, min(l_orderkey) as k from lineitem where l_linenumber > 1 and l_quantity > 25 group by 1)
select off, parser, null::bigint as first_order from s union all select off, 'bch' as parser, k from h where off not in (select off from s)""")
def struct_heuristic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the exact parser, and those of the guessing one at places that the first hasn't."""
    items = table(spark, sf_dir, "lineitem")
    exact = items.where("l_linenumber = 1").select(F.col("l_suppkey").alias("off")).distinct()
    guess = items.where("l_linenumber > 1 and l_quantity > 25").groupBy((F.col("l_partkey") % 5000).alias("off")).agg(F.min("l_orderkey").alias("first_order"))
    new = guess.join(exact, "off", "left_anti").select("off", F.lit("bch").alias("parser"), "first_order")
    return exact.select("off", F.lit("bch/struct").alias("parser"), F.lit(None).cast("bigint").alias("first_order")).unionByName(new)


_BY = "partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity"


def _offsets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return items, Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"select l_suppkey, l_orderkey, l_linenumber, (sum(l_quantity::bigint) over ({_BY} rows unbounded preceding) - l_quantity::bigint)::bigint as data_offset from lineitem")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, w = _offsets(spark, sf_dir)
    q = F.col("l_quantity").cast("bigint")
    return items.select("l_suppkey", "l_orderkey", "l_linenumber", (F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - q).alias("data_offset"))


@query(f"select l_suppkey, l_orderkey, l_linenumber, lead(l_orderkey) over ({_BY}) - l_orderkey as entry_size from lineitem")
def next_offset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, w = _offsets(spark, sf_dir)
    return items.select("l_suppkey", "l_orderkey", "l_linenumber", (F.lead("l_orderkey").over(w) - F.col("l_orderkey")).alias("entry_size"))


@query(f"select l_suppkey, l_orderkey, l_linenumber, coalesce(lag(l_quantity::bigint) over ({_BY}), 0)::bigint as packed_size, coalesce(lag(l_linenumber) over ({_BY}) % 2 = 1, false) as is_packed from lineitem")
def prev_entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, w = _offsets(spark, sf_dir)
    return items.select("l_suppkey", "l_orderkey", "l_linenumber", F.coalesce(F.lag(F.col("l_quantity").cast("bigint")).over(w), F.lit(0)).alias("packed_size"), F.coalesce(F.lag("l_linenumber").over(w) % 2 == 1, F.lit(False)).alias("is_packed"))


@query("""with f as (select s_suppkey, case s_suppkey % 3 when 0 then 'tex/f' || s_suppkey // 3 || '.texturegdb' when 1 then 'TEX/f' || s_suppkey // 3 || '.texturebin' else 'x/' || s_suppkey || '.bin' end as path from supplier),
b as (select lower(regexp_replace(path, '\\.[^.]*$', '')) as base, max(s_suppkey) as k from f where path like '%.texturebin' group by 1)
select f.s_suppkey as gdb, b.k as bin from f left join b on lower(regexp_replace(path, '\\.[^.]*$', '')) = base where path like '%.texturegdb'""")
def companion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with the file of the same base name that holds their pixels; of several the last counts."""
    k = F.col("s_suppkey")
    third = F.expr("s_suppkey div 3").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("tex/f"), third, F.lit(".texturegdb"))).when(k % 3 == 1, F.concat(F.lit("TEX/f"), third, F.lit(".texturebin"))).otherwise(F.concat(F.lit("x/"), k.cast("string"), F.lit(".bin")))
    f = table(spark, sf_dir, "supplier").select(k, path.alias("path")).withColumn("base", F.lower(F.regexp_replace("path", r"\.[^.]*$", "")))
    bins = f.where("path like '%.texturebin'").groupBy("base").agg(F.max("s_suppkey").alias("bin"))
    return f.where("path like '%.texturegdb'").join(bins, "base", "left").select(F.col("s_suppkey").alias("gdb"), "bin")


@query("""with recursive dirs(kind, id, parent_kind, parent, name) as (select 'region', r_regionkey::bigint, 'root', 0::bigint, r_name from region union all select 'nation', n_nationkey, 'region', n_regionkey, n_name from nation union all select 'customer', c_custkey, 'nation', c_nationkey, c_name from customer),
walk(kind, id, path, depth) as (select kind, id, '/' || name, 1 from dirs where parent_kind = 'root' union all select d.kind, d.id, w.path || '/' || d.name, w.depth + 1 from dirs d join walk w on d.parent_kind = w.kind and d.parent = w.id)
select kind, id, path, depth::int as depth from walk""")
def directory_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a tree of folders, level by level: a recursive query over parent links."""
    part = lambda t, kind, id_, up, parent, name: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(id_).cast("bigint").alias("id"), F.lit(up).alias("parent_kind"), parent.cast("bigint").alias("parent"), F.col(name).alias("name"))
    dirs = part("region", "region", "r_regionkey", "root", F.lit(0), "r_name").unionByName(part("nation", "nation", "n_nationkey", "region", F.col("n_regionkey"), "n_name")).unionByName(part("customer", "customer", "c_custkey", "nation", F.col("c_nationkey"), "c_name"))
    return spark.sql("""with recursive walk(kind, id, path, depth) as (
      select kind, id, concat('/', name), 1 from {dirs} where parent_kind = 'root'
      union all select d.kind, d.id, concat(w.path, '/', d.name), w.depth + 1 from {dirs} d join walk w on d.parent_kind = w.kind and d.parent = w.id)
      select * from walk""", dirs=dirs)


@query("select doc_id, 'lo' as sample from documents where doc_id % 1 = 0 and text is null union all select doc_id, case when length(text) < 64 then 'tiny' when length(text) < 4096 then 'small' else 'large' end from documents where text is not null")
def blob_size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n.isNull(), "lo").when(n < 64, "tiny").when(n < 4096, "small").otherwise("large").alias("sample"))
