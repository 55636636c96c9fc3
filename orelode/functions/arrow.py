"""Byte kernels as Arrow maps: batches of bounded bytes, plain functions, this package on the executors."""

from __future__ import annotations

import io
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of a batch, and rows that a kernel is given at a time: cells may be megabytes.
BATCH_BYTES, CHUNK_ROWS = "1m", 64
_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _ship(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc not in _shipped:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        target = Path(tempfile.mkdtemp()).resolve() / f"{PACKAGE.name}_kernels.zip"
        target.write_bytes(data.getvalue())
        sc.addPyFile(str(target))
        _shipped[sc] = True


def arrow_kernel(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors; a session's own size of batches is left alone."""
    _ship(df)
    if not df.sparkSession._jsparkSession.sessionState().conf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def kernel(df: DataFrame, fn: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over the rows of a batch at a time; it yields tuples in the order of ``schema``."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in (b.slice(at, CHUNK_ROWS) for b in batches for at in range(0, b.num_rows, CHUNK_ROWS)):
            rows = list(fn(batch.to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return arrow_kernel(df, run, out)
