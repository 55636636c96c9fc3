"""What every operator here needs from the cluster: code on the executors, a shared folder, Arrow maps, blocks of bytes.

Nothing is kept on a machine's own disk: tables that cut lineage go to the folder in ``spark.checkpoint.dir``, which
driver and executors share. Only where that setting is unset and everything runs on one machine (tests) a temporary
folder takes its place; elsewhere a missing setting is an error.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes in an Arrow batch from the JVM, which is held in memory on both sides.
BATCH_BYTES = "1m"
#: Bytes of text that the vectorised kernels take at once (one longer text goes alone).
CHUNK_BYTES = 1 << 20

_made: list[str] = []
_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: their Python needn't have the driver's path."""
    sc = spark.sparkContext
    if sc not in _shipped:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        target = Path(tempfile.mkdtemp()).resolve() / f"{PACKAGE.name}_code.zip"
        target.write_bytes(data.getvalue())
        sc.addPyFile(str(target))
        _shipped[sc] = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; removed when the driver ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orelode-")
        sc.setCheckpointDir(base)
    made = f"{base.rstrip('/')}/orelode-{uuid.uuid4().hex}"
    _made.append(made)
    atexit.register(_remove, sc, made)
    return made


def folders_made() -> list[str]:
    """The folders of ``shared_dir`` that still stand, in order."""
    return list(_made)


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders whose tables nobody reads any more; others go when the driver ends."""
    for path in folders:
        _remove(spark.sparkContext, path)
        _made.remove(path)


def other_columns(df: DataFrame, text: str) -> Column:
    """All columns but ``text`` as one struct, which no name can clash with (and never an empty one)."""
    return F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text])


def original_columns(df: DataFrame, text: str, body: str, row: str = "_row") -> list[Column]:
    """``df``'s columns again, from ``other_columns`` and the text in ``body`` (``n_chars``, if any, follows the text)."""
    out = []
    for i, c in enumerate(df.columns):
        value = F.col(body) if c == text else F.length(body).cast(df.schema[i].dataType) if c == "n_chars" and body == "_clean" else F.col(f"{row}.c{i}")
        out.append(value.alias(c))
    return out


def _remove(sc, path: str) -> None:
    try:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the context has ended
        pass


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark) + "/t"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes (a session's own setting is left alone) and this package on the executors."""
    spark = df.sparkSession
    ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(offsets_of(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def offsets_of(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array; nulls have no bytes."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) else b"")
    if not len(arr):
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_of(docs: DataFrame, *keys: str, text: str = "text", text_as: str = "body") -> DataFrame:
    """Only the named key columns and the text, so that columns of other names can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias(text_as))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer lies: ``name`` itself if it is a path, else a file of the ``public_tokenizers`` folder."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: A key that more than one in so many rows have is hot; there are fewer of them than this.
HOT_SHARE = 4096


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row for each ``key``, which is binary and never null), null where there is none.

    Rows of hot keys (fewer than ``HOT_SHARE`` keys) look them up in a broadcast table and go anywhere; all others meet by
    hash, so no task gets all the rows of a key that many have.
    """
    many = left.count() // HOT_SHARE
    hot = stored(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select(key))
    values = F.struct(F.lit(True).alias("_"), *[F.col(c) for c in right.columns if c != key])
    marked = left.join(F.broadcast(stored(right.join(F.broadcast(hot), key, "left_semi")).select(key, values.alias("_hot"))), key, "left")
    anywhere = F.concat(F.lit(b"+"), F.monotonically_increasing_id().cast("string").cast("binary"))
    marked = marked.withColumn("_meet", F.when(F.col("_hot").isNotNull(), anywhere).otherwise(F.col(key)))
    joined = marked.join(right.select(F.col(key).alias("_meet"), values.alias("_cold")), "_meet", "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in right.columns if c != key])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of ``df``'s size, or the bytes of its texts where Catalyst knows none (rows from Python, joins):
    only to choose numbers of buckets, never what is computed."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate < 1 << 50:
        return estimate
    sizes = [F.coalesce(F.sum(F.octet_length(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return int(df.select(sum(sizes[1:], sizes[0])).first()[0]) if sizes else 0


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 48) -> int:
    """A power of two of buckets, so that each holds about ``bytes_each`` of ``df``'s input."""
    n = max(least, plan_bytes(df) // bytes_each)
    return min(1 << 20, 1 << (n - 1).bit_length())


def by_bucket(df: DataFrame, fn: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema: str, buckets: int) -> DataFrame:
    """``fn(bucket, rows)`` for each value of the column ``bucket``; the rows of one bucket at a time are in memory.

    Rows are packed blobs (one for each task and bucket), so there are few of them.
    """
    tasks = max(2, min(buckets, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16)))

    def run(batches):
        current, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current and rows:
                    yield from fn(current, rows)
                    rows = []
                current = row["bucket"]
                rows.append(row)
        if rows:
            yield from fn(current, rows)

    return arrow_map(df.repartition(tasks, "bucket").sortWithinPartitions("bucket"), run, schema)
