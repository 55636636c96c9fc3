"""A training-data pipeline of five of the operators in ``orelode.llm``, from the raw table ``documents`` to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelode.llm.cluster import folders_made, remove_folders, stored
from orelode.llm.decontaminate import remove_spans
from orelode.llm.jaccard_join import keep_one
from orelode.llm.language_id import keep_identified
from orelode.llm.sentence_fst import encode_texts
from orelode.llm.window_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of tables behind the result of the stage that was called last.
_behind: list[str] = []


def _stage(f: Stage) -> Stage:
    """``f``, which first removes the last stage's tables: its result has been written, and is this one's input."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_folders(spark, [x for x in _behind if x in folders_made()])
        before = set(folders_made())
        out = f(spark, docs, sf_dir)
        _behind[:] = [x for x in folders_made() if x not in before]
        return out

    return run_stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others (no letters, or like none of the languages) go.

    Null and empty texts go; equal texts stay or go together; a null ``lang`` is a document to judge, not to learn from; an
    empty table stays one. The columns, whatever their names, and the rows that stay are unchanged."""
    return keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, the one of the smallest id.

    Of rows with the same smallest id, or with none, that of the smallest MD5 stays, of equal rows one; null ids come after
    all others; texts without words are linked with nothing and stay, once each. Columns and texts are unchanged."""
    return keep_one(docs, k=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere too; documents left without words go.

    White space after a removed word goes with it; null, empty and short texts stay as they are; ids don't matter; ``n_chars``
    follows the text, all other columns stay."""
    return remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are mostly such passages go.

    Null and empty texts stay; null items and items without words are no passages; repeated items count once; an empty
    benchmark leaves all as it is; ``n_chars`` follows the text, all other columns stay."""
    return remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it.

    Null and empty texts have none; a row for each row, in any order; of the other columns only the id stays."""
    return encode_texts(docs, ["doc_id"])


STAGES: list[tuple[str, Stage]] = [(f.__name__, _stage(f)) for f in (identify_language, join_near_duplicates, cut_repeats, cut_benchmark, encode_pieces)]

#: SQL can't express the first and the last stage; tests/llm/test_pipeline.py holds stages two to five against plain versions
#: on what the one before kept, and the first by its verdicts on texts of other scripts, other languages and gibberish.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
