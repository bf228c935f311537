"""Plumbing shared by the operators of this subpackage.

Work that must outlive an executor goes to the folder named by
``spark.checkpoint.dir``. Only a local session, as in tests, may leave that unset; it gets a
temporary folder. On a cluster such a folder would be lost with its machine, so that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a batch function at once; long texts make a row large, so batches stay small.
ROWS = 512
#: Characters handed to a batch function at once, unless a single row is longer.
CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spanlake-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/spanlake/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(schema: T.StructType | str) -> tuple[T.StructType, pa.Schema]:
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return struct, to_arrow_schema(struct)


def pieces(batch: pa.RecordBatch, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ROWS rows and about CHARS characters of column ``text``."""
    if text is None:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= ROWS or held + n > CHARS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: T.StructType | str, text: str | None = None) -> DataFrame:
    """Run ``make()`` once per task; the function it returns maps columns as lists to columns as lists."""
    struct, out = arrow_schema(schema)
    names = df.columns
    at = names.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, at):
                got = work({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, struct)


def filter_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of ``df`` whose text passes; every column goes through untouched, whatever its name."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bucket(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo ``n``; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def broadcast_value(spark: SparkSession, value):
    """A Python object of bounded size for every task."""
    return spark.sparkContext.broadcast(value)
