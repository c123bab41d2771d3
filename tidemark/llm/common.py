"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch hands to Python code at a time, so that long texts are not held together.
SLICE = 512
#: What the JVM hands to a worker at a time. It grows a batch by doubling and both sides hold one for every task, so Spark's
#: 10,000 rows or 64 MB take some hundred MB beside an executor's heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _tidied(batches: Iterator[pa.RecordBatch], function: Callable) -> Iterator[pa.RecordBatch]:
    """A task's function; then what it has freed goes back to the system, as the worker's allocators keep it for long else."""
    yield from function(batches)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call beside glibc
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow in batches of `BATCH`, which holds for the session from then on, as plans are made later."""
    for key, most in BATCH.items():
        df.sparkSession.conf.set(key, most)
    return df.mapInArrow(partial(_tidied, function=function), schema)


def _rows(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    one = make()
    for batch in slices(batches):
        columns = [c.to_pylist() for c in batch.columns]
        out = [one(*row) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: pa.Schema) -> DataFrame:
    """One output row per input row. make() runs once per task and returns the function of a row."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return in_arrow(df, partial(_rows, make=make, schema=schema), from_arrow_schema(schema))


def id_draw(doc_id: Column, purpose: str) -> Column:
    """A number in [0, 1) fixed by the id and the purpose."""
    n = 1 << 30
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(purpose)), F.lit(n)).cast("double") / float(n)


_OPEN: list[Scratch] = []


@atexit.register
def close_all() -> None:
    """Delete the intermediate tables of every query so far; results not yet read need them, so by default at exit."""
    while _OPEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            _OPEN.pop().close()


class Scratch:
    """Intermediate tables in the shared folder of spark.checkpoint.dir, so that no executor's loss undoes them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        _OPEN.append(self)

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write a table, and read it from there."""
        df.write.options(**{"compression": "zstd"} | options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def release(self, last: bool = False) -> None:
        """Free the files of shuffles that were read, but for the last query's, whose plan Spark's listeners hold until another ends.

        last: the last query's too, by a query of one row after it. Spark deletes the files once the driver's JVM
        sees that nothing refers to them.
        """
        if last:
            self.spark.range(1).collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Delete all of them."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _keep(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable], at: int) -> Iterator[pa.RecordBatch]:
    keep = make()
    for batch in slices(batches):
        yield batch.filter(pa.array([bool(keep(x)) for x in batch.column(at).to_pylist()], pa.bool_()))


def keep_rows(df: DataFrame, make: Callable[[], Callable], column: str) -> DataFrame:
    """The rows of df for whose column the function that make() returns is true; all columns pass untouched."""
    return in_arrow(df, partial(_keep, make=make, at=df.columns.index(column)), df.schema)
