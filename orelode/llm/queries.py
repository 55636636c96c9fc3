"""The queries of this subpackage, by the names under which ``__spark_entry__.py`` registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelode.llm.decontaminate import contamination_digest
from orelode.llm.fertility import quality_digest
from orelode.llm.gated_lm import score_digest
from orelode.llm.jaccard_join import component_digest
from orelode.llm.language_id import language_digest
from orelode.llm.repair_codec import shard_digest
from orelode.llm.sentence_fst import piece_digest
from orelode.llm.token_counts import count_digest
from orelode.llm.warc import WARC_SQL, warc_digest
from orelode.llm.window_dedup import dedup_digest


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_digest(_read(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_digest(_read(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(_read(spark, sf_dir, "pages"))


def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_digest(_read(spark, sf_dir, "documents"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(_read(spark, sf_dir, "documents"))


def op10_sentence_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gated_lm, op2_jaccard_join, op3_fertility, op4_decontaminate, op5_warc_zstd, op6_repair_shards, op7_token_counts, op8_window_dedup, op9_language_id, op10_sentence_fst)}


_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD_SQL = f"""
with recursive d as (select doc_id, {_PLAIN_WORDS.format(_FOLD.format("text"))} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + greatest(0, least(3, len(w)) - 1)], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id), t as (select * from s join n using (doc_id)),
links as (select a.doc_id as x, b.doc_id as y from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 190 * count(*) >= 90 * (a.n + b.n)),
sym as (select x, y from links union all select y, x from links),
walk(x, y) as (select doc_id, doc_id from n union select w.x, b.y from walk w join sym b on w.y = b.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.least_id, d.doc_id) as component_id
from d left join n using (doc_id) left join (select x as doc_id, min(y) as least_id from walk group by x) c using (doc_id)
"""

CONTAMINATION_SQL = f"""
with d as (select doc_id, {_ALNUM_WORDS.format(_FOLD.format("text"))} as w from documents), b as (select item_id::varchar as item, {_ALNUM_WORDS.format(_FOLD.format("text"))} as w from benchmark),
iw as (select item, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from iw))),
hit as (select distinct doc_id, k, i, item from dw join iw using (k, s)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit where item is not null) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

WINDOWS_SQL = f"""
with d as (select doc_id, {_PLAIN_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
hit as (select doc_id, i from win join (select s from win group by s having count(*) > 1) using (s)),
gone as (select doc_id, list(distinct p) as g from (select doc_id, unnest(range(i, i + 35)) as p from hit) group by doc_id),
pos as (select doc_id, w, coalesce(g, []) as g from d left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, len(g)::bigint as n_removed, sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(g, i)), ' ')) as kept_sha256 from pos
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD_SQL, "op4_decontaminate": CONTAMINATION_SQL, "op5_warc_zstd": WARC_SQL, "op8_window_dedup": WINDOWS_SQL}
