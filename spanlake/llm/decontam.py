"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item's windows of ten words (a shorter item: all its words) are the patterns. For each
pattern length a shift table over blocks of two neighbouring words says how far the search may
jump; where it may not, the block's suffix bucket names the patterns that end there, and each
is compared word by word. Nearly all positions are never looked at.

Defined results: null, empty and word-less texts have no words and no hits; items without words
have no windows; items of one id count once, windows of items with a null id hit but are not
listed; an empty benchmark hits nothing; equal documents are each reported. Pattern tables are
collected in blocks of about BLOCK_CHARS characters, one at a time, and the documents are searched
once for each block, so the benchmark's size is not bounded by one machine's memory.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import broadcast_value, filter_rows, map_batches, materialize, read

WINDOW = 10
#: Characters of test items whose patterns one broadcast holds: about 100 bytes of tables each.
BLOCK_CHARS = 2_000_000
_WORDS = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters a-z, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """Patterns are word lists of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = m = len(patterns[0])
        self.b = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for number, p in enumerate(patterns):
            for end in range(b - 1, m):
                block = p[end - b + 1 : end + 1]
                self.shift[block] = min(self.shift.get(block, self.far), m - 1 - end)
            self.bucket.setdefault(p[m - b :], []).append((list(p), number))

    def find(self, text: list[bytes]):
        """(start, pattern number) of every occurrence, in order of place."""
        m, far, shift, bucket, n = self.m, self.far, self.shift, self.bucket, len(text)
        i = m - 1
        if self.b == 2:
            while i < n:
                block = (text[i - 1], text[i])
                step = shift.get(block, far)
                if step:
                    i += step
                    continue
                here = text[i - m + 1 : i + 1]
                for p, number in bucket[block]:
                    if p == here:
                        yield i - m + 1, number
                i += 1
        else:
            for i, word in enumerate(text):
                for _, number in bucket.get((word,), ()):
                    yield i, number


class Finder:
    """All windows of a block of test items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ws = words(text)
            k = min(window, len(ws))
            for i in range(len(ws) - k + 1 if k else 0):
                by_length.setdefault(k, {}).setdefault(tuple(ws[i : i + k]), set()).add(item)
        self.searches = [(WuManber(list(p)), [frozenset(x) for x in p.values()]) for p in by_length.values()]

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans [start, end) and the ids of the items whose windows occur."""
        spans, ids = [], set()
        for search, owners in self.searches:
            for start, number in search.find(ws):
                spans.append((start, start + search.m))
                ids |= owners[number]
        return merged(spans), ids


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def finders(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS):
    """A broadcast Finder for each block of test items in turn; the one before it is given up, so its results must be written by then."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    if blocks > 1:
        items = materialize(items, "items")
    spark, shared = benchmark.sparkSession, None
    for k in range(blocks):
        if shared is not None:
            shared.destroy()
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = broadcast_value(spark, Finder([tuple(r) for r in part], window))
        yield shared, blocks


def find_overlap(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans (hit words, as [start, end)), items (ids as text, sorted) per document."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"

    def search(table, docs, schema):
        def make():
            def work(cols):
                counts, spans, items = [], [], []
                for text in cols["text"]:
                    ws = words(text)
                    s, ids = table.value.hits(ws) if table else ([], set())
                    counts.append(len(ws))
                    spans.append([{"start": a, "stop": b} for a, b in s])
                    items.append(sorted(x for x in ids if x is not None))
                return cols | {"n_words": counts, "spans": spans, "items": items}

            return work

        return map_batches(docs, make, schema, "text")

    found = None
    for table, blocks in finders(benchmark, item_col=item_col, text_col=item_text_col, window=window, block_chars=block_chars):
        if blocks == 1:
            return search(table, docs, schema)
        if found is None:
            docs = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "documents")
        part = materialize(search(table, docs, schema + ", uid long"), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return search(None, docs, schema)
    both = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def make():
        def work(cols):
            return cols | {"spans": [[{"start": a, "stop": b} for a, b in merged([(x["start"], x["stop"]) for x in s])] for s in cols["spans"]]}

        return work

    return map_batches(both.drop("uid"), make, schema)


def contamination(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_overlap(df, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def uncontaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``df`` in which no window of the benchmark occurs."""
    for table, blocks in finders(benchmark, window=window, block_chars=block_chars):

        def make(table=table):
            return lambda texts: [not any(next(s.find(ws), None) for s, _ in table.value.searches) for ws in map(words, texts)]

        df = filter_rows(df, text_col, make)
        if blocks > 1:
            df = materialize(df, "clean")
    return df


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks),
hits AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM di) JOIN bw USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
