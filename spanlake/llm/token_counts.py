"""Token counts by separator scan over flat, unindexed token files.

``write_token_files`` lays documents out as bare little-endian ids of two or four bytes, each document
followed by an end-of-document id, with no index of any kind. ``scan_token_files`` finds the
documents again: files are cut into blocks of a fixed number of ids, every block is searched
for separators with one vectorised comparison, and a prefix scan over the blocks stitches
documents that cross block boundaries.

Defined results: a null or empty text is a document of zero tokens; equal rows are separate
documents; an empty table gives no files and no rows; bytes after the last separator of a
file form one open document (``closed`` false) unless there are none. The separator is the
largest id of the files' width, which no vocabulary that fits the width reaches, so a text
may hold anything, the vocabulary's own end-of-text mark included. A caller's own separator may
be an id that texts hold; it would split them, so writing such a document fails, as does an id
too large for the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import arrow_schema, materialize, new_path, pieces, read
from .bpe import Encoder, default_tokenizer

#: Bytes of an id in the files that ``count_tokens`` writes: vocabularies under 65,536 fit two.
ID_BYTES = 2
#: Ids in a block: 2 or 4 MB of file.
BLOCK_IDS = 1 << 20
MANIFEST = "doc_id long, file string, ordinal long"


def separator(id_bytes: int) -> int:
    """The end-of-document id of files of this width: all bits set."""
    return (1 << 8 * id_bytes) - 1


def write_token_files(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, eod: int | None = None, id_bytes: int = 4) -> DataFrame:
    """Write one flat file per task under ``path``; return which document stands where (file, ordinal).

    A task that is run again writes another file; the manifest names those that count.
    """
    vocabulary = tokenizer or default_tokenizer()
    eod = separator(id_bytes) if eod is None else eod
    struct, out = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        encode, kind, ordinal, name, sink = Encoder.of(vocabulary).encode, f"<u{id_bytes}", 0, "", None
        mark = np.array([eod], kind).tobytes()
        try:
            for batch in batches:
                for part in pieces(batch, 1):
                    if sink is None:
                        store, folder = fs.FileSystem.from_uri(path)
                        store.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.bin"
                        sink = store.open_output_stream(f"{folder}/{name}")
                    ids = [np.frombuffer(x, "<u4") for x in encode([t or "" for t in part.column(1).to_pylist()])]
                    every = np.concatenate(ids)
                    if len(every) and every.max() >> (8 * id_bytes):
                        raise ValueError(f"an id does not fit {id_bytes} bytes")
                    if (every == eod).any():
                        raise ValueError(f"a document holds the separator id {eod}")
                    for x in ids:
                        sink.write(x.astype(kind).tobytes() + mark)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64())], schema=out)
                    ordinal += n
        finally:
            if sink is not None:
                sink.close()

    return df.select(id_col, text_col).mapInArrow(run, struct)


def scan_token_files(spark: SparkSession, path: str, *, eod: int | None = None, block_ids: int = BLOCK_IDS, id_bytes: int = 4) -> DataFrame:
    """One row per document found: file, ordinal, start (ids before it), n_tokens, closed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    return scan_blocks(files, eod=eod, block_ids=block_ids, id_bytes=id_bytes)


def scan_blocks(files: DataFrame, *, eod: int | None = None, block_ids: int = BLOCK_IDS, id_bytes: int = 4) -> DataFrame:
    """As ``scan_token_files`` for a table of (path, length in bytes)."""
    size = id_bytes * block_ids
    eod = separator(id_bytes) if eod is None else eod
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block"))
    struct, out = arrow_schema("file string, block long, size long, ends array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        from pyarrow import fs

        for batch in batches:
            for path, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = fs.FileSystem.from_uri(path if "://" in path else unquote(path.replace("file:", "file://", 1)))
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(min(size, length - block * size), block * size), f"<u{id_bytes}")
                ends = np.flatnonzero(ids == eod).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([block]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int32()))], schema=out)

    found = materialize(blocks.repartition(F.col("path"), F.col("block")).mapInArrow(run, struct), "separators")
    # The scan: what lies to the left of a block is its count of separators and the place of the last one.
    tall = found.select("file", "block", "size", F.size("ends").alias("n_ends"), F.when(F.size("ends") > 0, F.col("block") * block_ids + F.element_at("ends", -1)).alias("last"))
    left = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tall.select("file", "block", F.coalesce(F.sum("n_ends").over(left), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(left) + 1, F.lit(0)).alias("open_at"))
    docs = found.join(carry, ["file", "block"]).select(
        "file",
        F.inline(
            F.transform(
                "ends",
                lambda e, i: F.struct(
                    (F.col("before") + i).alias("ordinal"),
                    F.when(i == 0, F.col("open_at")).otherwise(F.col("block") * block_ids + F.try_element_at("ends", i) + 1).alias("start"),
                    (F.col("block") * block_ids + e).alias("end"),
                ),
            )
        ),
    )
    closed = docs.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = tall.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum("size").alias("ids"))
    tail = whole.filter("ids > start").select("file", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_ids: int = BLOCK_IDS, id_bytes: int = ID_BYTES) -> DataFrame:
    """Write the documents as flat token files, scan those, and name the documents found: doc_id, file, ordinal, start, n_tokens."""
    spark = df.sparkSession
    path = new_path(spark, "tokens")
    manifest = materialize(write_token_files(df, path, id_col=id_col, text_col=text_col, tokenizer=tokenizer, id_bytes=id_bytes), "manifest")
    if manifest.isEmpty():
        return manifest.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    found = scan_token_files(spark, path, block_ids=block_ids, id_bytes=id_bytes).drop("closed")
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
