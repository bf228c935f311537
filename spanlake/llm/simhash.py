"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint is embedded as the bit counts of equal segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so a range join with
radius ``bits`` on the grid of vectors finds every pair that can link; XOR and a bit count then
verify each candidate exactly. More segments make a finer grid with more cells in reach, so
their number follows from the number of fingerprints. Only one side of each pair of grid cells
is generated, and every cell is split by what it and its neighbours hold, into blocks of at most
about CELL by AROUND fingerprints. A task emits a spanning forest of the links that it verified
rather than the links, so a group of copies never becomes all its pairs. Components come from
repeated contraction of that forest.

Defined results: null, empty and word-less texts have fingerprint zero and link like any
other; equal texts share a fingerprint; a component is named by its smallest doc_id (null
only if all its ids are null); an empty table gives no rows; a repeated row is returned as
often as it occurs. ``one_of_each`` keeps one row of each component: that of the smallest doc_id,
null ids last; among equal ids that of the least text hash, then any, as those rows are equal in
id and text.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, map_batches, materialize, read

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints of a cell, and of the cells around it, in a block of the join.
CELL, AROUND = 16_384, 65_536
#: Rows from which a fingerprint counts as hot, and how many hot ones there may be.
HOT_ROWS, HOT_MOST = 100_000, 50_000
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; of a frame with row numbers also row and a hash of the text."""

    def make():
        def work(cols):
            fps = np.array([fingerprint(t, shingle, seed) for t in cols.pop("text")], np.uint64).view(np.int64)
            return cols | {"fp": fps.tolist()}

        return work

    text = F.col(text_col).cast("string")
    more = [F.col(row_col).alias("row"), F.xxhash64(text).alias("hash")] if row_col else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *more, text.alias("text"))
    return map_batches(docs, make, "doc_id long, " + "row long, hash long, " * bool(row_col) + "fp long", "text")


def contract(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (i, j); a label is a member of its group, and its own label."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def cells_of(fps: np.ndarray) -> np.ndarray:
    """Bit counts of each fingerprint's four 16-bit segments."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)


def link_cells(own: np.ndarray, others: np.ndarray | None, bits: int, fine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``own`` and ``others``, or within ``own`` if there are none, as (member, root).

    ``fine`` first compares bit counts of four segments; without it all pairs are compared at once.
    """
    within = others is None
    fps = own if within else np.concatenate([own, others])
    labels, n = np.arange(len(fps)), len(own)
    code, shifts = np.array([32768, 1024, 32, 1], np.int64), np.array([15, 10, 5, 0])
    place = cells_of(fps) @ code if fine else np.zeros(len(fps), np.int64)

    def grouped(lo: int, hi: int):
        order = lo + np.argsort(place[lo:hi], kind="stable")
        keys, at = np.unique(place[order], return_index=True)
        return keys, np.split(order, at[1:]) if len(order) else []

    keys, rows_of = grouped(0, n)
    keys2, cols_of = (keys, rows_of) if within else grouped(n, len(fps))
    grid = (keys2[:, None] >> shifts) & 31
    held_i, held_j, held = [], [], 0
    for key, rows in zip(keys.tolist(), rows_of, strict=True):
        near = np.flatnonzero(np.abs(grid - ((key >> shifts) & 31)).sum(axis=1) <= bits)
        near = near[keys2[near] >= key] if within else near
        if not len(near):
            continue
        cols = np.concatenate([cols_of[k] for k in near.tolist()])
        for start in range(0, len(rows), 2048):
            for from_ in range(0, len(cols), 65_536):
                r, c = rows[start : start + 2048], cols[from_ : from_ + 65_536]
                x, y = np.nonzero(np.bitwise_count(fps[r][:, None] ^ fps[c][None, :]) <= bits)
                i, j = r[x], c[y]
                apart = labels[i] != labels[j]
                if apart.any():
                    held_i.append(i[apart])
                    held_j.append(j[apart])
                    held += len(held_i[-1])
                if held > 500_000:
                    labels = contract(labels, np.concatenate(held_i), np.concatenate(held_j))
                    held_i, held_j, held = [], [], 0
    if held:
        labels = contract(labels, np.concatenate(held_i), np.concatenate(held_j))
    member = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[member], fps[labels[member]]


def reach(segments: int, bits: int) -> list[tuple[int, ...]]:
    """Steps from a cell to the later ones of the cells within ``bits``: of every pair of cells one is a step from the other."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(segments):
        steps = [(*s, d) for s in steps for d in range(-bits, bits + 1) if sum(map(abs, s)) + abs(d) <= bits]
    return [s for s in steps if s > (0,) * segments]


def copies(n: int, segments: int, bits: int = BITS, cell: int = CELL, around: int = AROUND) -> float:
    """Expected rows of the join for each of ``n`` random fingerprints."""
    width = 64 // segments
    share = (math.comb(2 * width, width) / 4**width) ** segments  # of all fingerprints, in the cell of a random one
    steps = len(reach(segments, bits))
    return 1 + steps * (1 + n * share / cell) + steps * n * share / around


def segments_for(n: int, bits: int = BITS, cell: int = CELL) -> int:
    """The number of segments that copies ``n`` fingerprints least."""
    return min((2, 4, 8), key=lambda k: copies(n, k, bits, cell))


def links(distinct: DataFrame, *, bits: int = BITS, cell: int = CELL, around: int = AROUND, segments: int | None = None) -> DataFrame:
    """Forest edges (a, b) between linking fingerprints of ``distinct`` (column fp, no repeats)."""
    segments = segments or segments_for(distinct.count(), bits, cell)
    width = 64 // segments
    mask = (1 << width) - 1
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
    # A cell's name: its bit counts in places of seven bits, so that a step to another cell is an addition.
    name = sum((F.shiftleft(count(k), 7 * k) for k in range(1, segments)), count(0))
    placed = distinct.select("fp", name.alias("at"))
    ahead = [sum(d << 7 * k for k, d in enumerate(s)) for s in reach(segments, bits)]
    sizes = materialize(placed.groupBy("at").agg(F.count("*").alias("n")), "cells")
    # What the cells hold from which a step leads here; steps over the edge of the grid lead to names that no cell has.
    later = F.explode(F.array(*[F.lit(d).cast("long") for d in ahead])).alias("step")
    into = sizes.select("at", "n", later).select((F.col("at") - F.col("step")).alias("at"), "n")
    ahead_of = into.join(sizes.select("at"), "at", "left_semi").groupBy("at").agg(F.sum("n").alias("ahead"))
    parts = lambda c, most: F.ceil(F.coalesce(F.col(c), F.lit(0)) / most).cast("int")
    cells = materialize(sizes.join(ahead_of, "at", "left").select("at", parts("n", cell).alias("rows"), parts("ahead", around).alias("cols")), "cells")
    # The grid of two or four segments has at most 17**4 cells, however many fingerprints there are.
    few = F.broadcast if segments <= 4 else lambda df: df
    of = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n).cast("int")
    mine = placed.join(few(cells), "at").withColumn("i", of(F.col("rows"), "row"))
    theirs = placed.select("fp", "at", later).select("fp", (F.col("at") - F.col("step")).alias("at")).join(few(cells), "at").withColumn("j", of(F.col("cols"), "column"))
    # Blocks (at, i, j): part i of a cell by part j of what is ahead of it (j < 0: by part -1 - j of itself, which is not before i).
    to_others = mine.filter("cols > 0").select("at", "i", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "fp", F.lit(True).alias("own"))
    to_own = mine.select("at", "i", F.explode(F.sequence(F.col("i"), F.col("rows") - 1)).alias("j"), "fp", F.lit(True).alias("own")).withColumn("j", -1 - F.col("j"))
    from_own = mine.filter("i > 0").select("at", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i"), (-1 - F.col("i")).alias("j"), "fp", F.lit(False).alias("own"))
    from_others = theirs.select("at", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "j", "fp", F.lit(False).alias("own"))
    blocks = to_others.unionByName(to_own).unionByName(from_own).unionByName(from_others)
    struct, out = arrow_schema("a long, b long")

    def join(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        own = table["own"].to_numpy()
        rows, cols = np.sort(fps[own]), np.sort(fps[~own])
        a, b = link_cells(rows, cols if len(cols) else None, bits, segments < 4) if len(rows) and (len(cols) or table["j"][0].as_py() < 0) else (fps[:0], fps[:0])
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

    return blocks.groupBy("at", "i", "j").applyInArrow(join, struct)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): each round hooks every node to its least neighbour and contracts."""
    edges = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near")
        hook = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")), "hooks")
        # one more step up: a node's target may itself have moved
        hook = materialize(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), "hooks")
        if roots is None:
            roots = hook.select("node", F.col("top").alias("root"))
        else:
            roots = roots.join(hook.select(F.col("node").alias("root"), "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = materialize(roots, "roots")
        moved = edges.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b")
        edges = materialize(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.toDF("node", "root") if roots is None else roots


def group(docs: DataFrame, *, bits: int = BITS, cell: int = CELL, around: int = AROUND, segments: int | None = None) -> DataFrame:
    """docs (doc_id, fp and others) with component_id, the least doc_id, and component_fp, one fingerprint of the component."""
    least = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(least.select("fp"), bits=bits, cell=cell, around=around, segments=segments)).withColumnRenamed("node", "fp")
    linked = least.join(roots, "fp")
    named = materialize(linked.groupBy("root").agg(F.min("least").alias("component")), "components")
    of_fp = least.select("fp", "least", "n").join(linked.join(named, "root").select("fp", "component", "root"), "fp", "left")
    of_fp = materialize(of_fp.select("fp", "n", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("component_fp")), "members")
    # A hot fingerprint's rows stay where they are: the hot ones are few whatever the input, the others have few rows each.
    bound = max(HOT_ROWS, (least.agg(F.sum("n")).first()[0] or 0) // HOT_MOST)
    hot = F.broadcast(of_fp.filter(F.col("n") > bound).drop("n"))
    return docs.join(hot, "fp").unionByName(docs.join(hot, "fp", "left_anti").join(of_fp.filter(F.col("n") <= bound).drop("n"), "fp"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row."""
    docs = materialize(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    return group(docs, bits=bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` with one row of each group."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    # Rows get numbers of their own, under column names that clash with none.
    rows = materialize(df.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    docs = materialize(fingerprints(rows, id_col=at[id_col], text_col=at[text_col], shingle=shingle, row_col="row"), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row")
    keep = group(docs, bits=bits).groupBy("component_fp").agg(F.min(order).alias("first")).select("first.row")
    return rows.join(keep, "row", "left_semi").select(*[F.col(n).alias(c) for c, n in at.items()])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
