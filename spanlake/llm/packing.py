"""Best-fit packing of documents into sequences with a grouping genetic algorithm.

A document is its token ids and an end id. Documents longer than a sequence are cut into full
pieces with the shorter piece first; full pieces fill sequences alone, so only the shorter
ones are packed. They are dealt into regions of a bounded size; in each region several
islands evolve packings of the same pieces: crossover injects a parent's fullest bins whole,
removes what they duplicate, and best-fits the displaced pieces. Between epochs each island
gets its neighbour's elite. A region's best packing becomes its sequences, but for the pieces of
its emptiest bins: those of FAN regions meet in a region of their own and evolve again, from the
bins that they come in, and so on in a tree, so that part-filled bins do not add up with regions.

Defined results: a null text is empty, so one end id; equal rows are separate documents, also
with equal or null ids; an empty table gives no rows; ties between packings go to the lower
island. Every piece is in exactly one sequence, offsets have no gaps.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, materialize, map_batches, read
from .bpe import Encoder, default_tokenizer

CAPACITY, END_ID = 1024, 2
#: Pieces in a region: bounds what one task holds.
REGION = 16_384
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 4, 20, 2
#: Regions whose emptiest bins meet, and how many bins each of them sends.
FAN, EMPTIEST = 4, 1024
#: A sequence's id is its region, then its level in the tree (WHOLE: full pieces), then its number.
REGION_BITS, LEVEL_BITS, WHOLE = 40, 36, 15


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items`` (in this order) into the fullest of ``bins`` that still holds them; open new bins where none does."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for b, r in enumerate(room):
        by_room[r].append(b)
        free |= 1 << r
    for i in items:
        n = sizes[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b] = [*bins[b], i]  # bins are shared between packings
        r -= n
        room[b] = r
        by_room[r].append(b)
        free |= 1 << r


def fitness(packing: tuple, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller full bins, which leave better gaps."""
    filled = (capacity - np.array(packing[1])) / capacity
    return -len(filled), float(filled @ filled)


def fill(sizes: list[int], items: list[int], capacity: int, skip: int = 0) -> tuple[list[list[int]], list[int]]:
    """Bins filled one after the other: the largest piece left, and of the others, from the ``skip``-th that fits on, those that best fit the rest together."""
    left = sorted(items, key=lambda i: (sizes[i], -i))
    rising = [sizes[i] for i in left]
    bins, room = [], []
    while left:
        target = capacity - rising[-1]
        # sums[k]: a bit for each sum of some of the k largest pieces that fit
        sums, fits = [1], (2 << target) - 1
        top = min(len(left) - 1, bisect.bisect_right(rising, target))
        top = max(top - skip, min(top, skip))
        for k in range(top - 1, -1, -1):
            m = sums[-1]
            m |= m << rising[k] & fits
            sums.append(m)
            if m >> target:
                break
        total = sums[-1].bit_length() - 1
        room.append(target - total)
        taken = [len(left) - 1]
        for k in range(len(sums) - 1, 0, -1):
            if not sums[k - 1] >> total & 1:
                taken.append(top - k)
                total -= rising[top - k]
        bins.append([left[k] for k in taken])
        for k in sorted(taken, reverse=True):
            del left[k], rising[k]
    return bins, room


def cross(sizes: list[int], a: tuple, b: tuple, capacity: int, rng: np.random.Generator) -> tuple:
    """Inject a run of b's fullest bins into a; best-fit what is displaced, into the bins there are or bin by bin."""
    if a is b:
        bins, room, displaced = list(a[0]), list(a[1]), []
    else:
        order = np.argsort(np.array(b[1]), kind="stable")
        half = max(1, len(order) // 2)
        start, width = int(rng.integers(half)), 1 + int(rng.integers(half))
        chosen = order[start : start + width].tolist()
        inside = {i for k in chosen for i in b[0][k]}
        bins, room, displaced = [b[0][k] for k in chosen], [b[1][k] for k in chosen], []
        for items, r in zip(*a, strict=True):
            if inside.isdisjoint(items):
                bins.append(items)
                room.append(r)
            else:
                displaced += [i for i in items if i not in inside]
    # some bins are opened too, the emptier ones rather, so that their pieces may find better places
    keys = rng.random(len(room)) * (np.array(room) + rng.choice([1, 8, 64]))
    worst = np.argsort(-keys, kind="stable")[: int(2 ** rng.uniform(1, 9))]
    for k in sorted(worst.tolist(), reverse=True):
        displaced += bins.pop(k)
        room.pop(k)
    if rng.random() < 0.5:
        displaced.sort(key=lambda i: (-sizes[i], i))
        best_fit(sizes, displaced, bins, room, capacity)
        return bins, room
    more = fill(sizes, displaced, capacity, int(rng.integers(8)))
    return bins + more[0], room + more[1]


def evolve(sizes: list[int], elites: list[tuple], seed: int, capacity: int, population: int = POPULATION, generations: int = GENERATIONS, thorough: bool = True) -> tuple:
    """One island's epoch: from the elites and best-fit starts (``thorough``: one of them bin by bin) to its best packing."""
    rng = np.random.default_rng(seed)
    pool = list(elites)
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    least = -(-sum(sizes) // capacity)
    if thorough:
        pool += [fill(sizes, falling, capacity, skip) for skip in (0, 1, 3)]
    order = falling
    while len(pool) < max(population, len(elites) + 2 + 3 * thorough):
        bins, room = [], []
        best_fit(sizes, order, bins, room, capacity)
        pool.append((bins, room))
        order = np.argsort(-(np.array(sizes) + rng.normal(0, 0.05, len(sizes)) * capacity), kind="stable").tolist()
    ranked = sorted(((fitness(x, capacity), x) for x in pool), key=lambda y: y[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1][0]) <= least:
            break
        a, b = (int(x) for x in rng.integers(min(3, len(ranked)), size=2))
        child = cross(sizes, ranked[a][1], ranked[b][1], capacity, rng)
        fit = fitness(child, capacity)
        # a packing crossed with itself only has some bins repacked: the child takes its place
        worse = a if a == b else len(ranked) - 1
        if fit >= ranked[worse][0]:
            ranked[worse] = (fit, child)
            ranked.sort(key=lambda y: y[0], reverse=True)
    return ranked[0][1]


def encode_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """uid, doc_id, n_ids and the crc32 of each piece, first piece first; uid tells equal documents apart."""
    vocabulary = tokenizer or default_tokenizer()

    def make():
        encode, end = Encoder.of(vocabulary).encode, np.array([end_id], "<u4").tobytes()

        def work(cols):
            lengths, crcs = [], []
            for ids in encode([t or "" for t in cols["text"]]):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                view = memoryview(ids)
                cuts = [0, *range(4 * first, 4 * n + 1, 4 * capacity)]
                lengths.append(n)
                crcs.append([zlib.crc32(view[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)])
            return {"doc_id": cols["doc_id"], "n_ids": lengths, "crcs": crcs}

        return work

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(map_batches(docs, make, "doc_id long, n_ids long, crcs array<long>", "text").withColumn("uid", F.monotonically_increasing_id()), "pieces")


def _island_epoch(epoch: int, capacity: int, out: pa.Schema):
    """One epoch of one island of one region, as a function of the island's rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        region_id, island = table["region"][0].as_py(), table["island"][0].as_py()
        sizes = table["size"].to_pylist()
        real = [i for i, s in enumerate(sizes) if s]
        small = [sizes[i] for i in real]
        elites = []
        for name in ("bin", "elite"):
            where = [x for x, s in zip(table[name].to_pylist(), sizes, strict=True) if s and x is not None]
            if where:
                held: dict[int, list[int]] = {}
                for i, b in enumerate(where):
                    held.setdefault(b, []).append(i)
                bins = list(held.values())
                elites.append((bins, [capacity - sum(small[i] for i in x) for x in bins]))
        best = evolve(small, elites, seed=hash((region_id, island, epoch)) & 0x7FFFFFFF, capacity=capacity, thorough=epoch == island == 0)
        bin_of = [0] * len(sizes)
        for b, x in enumerate(best[0]):
            for i in x:
                bin_of[real[i]] = b
        made = {"bin": pa.array(bin_of, pa.int32()), "n_bins": pa.array([len(best[0])] * len(sizes), pa.int32())}
        return pa.Table.from_arrays([made[f.name] if f.name in made else table[f.name] for f in out], schema=out)

    return run


def _settle(level: int, last: bool, capacity: int, out: pa.Schema):
    """Places of a region's pieces by its best packing; unless it is the last level, those of its emptiest bins go up."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("bin", "ascending"), ("uid", "ascending")])
        region = t["region"][0].as_py()
        size, bins, full = (t[c].to_numpy() for c in ("size", "bin", "full"))
        before = np.cumsum(size) - size
        offset = before - before[np.searchsorted(bins, bins)]
        room = capacity - np.bincount(bins, size)
        emptiest = np.zeros(len(room), bool)
        if not last:
            emptiest[np.lexsort((np.arange(len(room)), -room))[:EMPTIEST]] = True
        base = region << REGION_BITS
        made = {
            "region": pa.array([region // FAN] * len(t)),
            "up": pa.array(emptiest[bins] & (size > 0)),
            "bin": pa.array((region % FAN * 2**16 + bins).astype(np.int32)),
            "sequence_id": pa.array(base + (level << LEVEL_BITS) + bins.astype(np.int64)),
            "offset": pa.array(offset.astype(np.int64)),
            "full_from": pa.array(base + (WHOLE << LEVEL_BITS) + np.cumsum(full) - full),
        }
        return pa.Table.from_arrays([made[f.name] if f.name in made else t[f.name].combine_chunks() for f in out], schema=out)

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items (uid, n_ids) to uid, sequence_id and offset of the first piece, and the sequence of its first full piece."""
    regions = max(1, -(-items.count() // region))
    first = (F.col("n_ids") - 1) % capacity + 1
    # bin: the piece's bin so far, null before the first epoch. elite: that of the neighbouring island.
    pieces = items.select(F.pmod(F.xxhash64("uid"), F.lit(regions)).alias("region"), "uid", F.when(first == capacity, 0).otherwise(first).cast("int").alias("size"), F.expr(f"n_ids div {capacity}").cast("long").alias("full"), F.lit(None).cast("int").alias("bin"))
    struct, out = arrow_schema("region long, island int, uid long, size int, full long, bin int, n_bins int")
    settled, settled_out = arrow_schema("region long, uid long, size int, full long, up boolean, bin int, sequence_id long, offset long, full_from long")
    placed, level = None, 0
    while True:
        state = pieces.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)]))).withColumn("elite", F.lit(None).cast("int"))
        for epoch in range(epochs):
            done = materialize(state.groupBy("region", "island").applyInArrow(_island_epoch(epoch, capacity, out), struct), "islands")
            if epoch + 1 < epochs:
                shifted = done.select("region", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "uid", F.col("bin").alias("elite"))
                state = done.drop("n_bins").join(shifted, ["region", "island", "uid"])
        best = done.groupBy("region").agg(F.min(F.struct("n_bins", "island")).alias("best"))
        chosen = done.join(F.broadcast(best) if regions <= 100_000 else best, "region").filter(F.col("island") == F.col("best.island"))
        here = materialize(chosen.select("region", "uid", "size", "full", "bin").groupBy("region").applyInArrow(_settle(level, regions == 1, capacity, settled_out), settled), "settled")
        # A piece that goes up keeps the place of its full pieces.
        placed = here if level == 0 else placed.unionByName(here)
        if regions == 1:
            break
        pieces = here.filter("up").select("region", "uid", "size", F.lit(0).cast("long").alias("full"), "bin")
        regions, level = -(-regions // FAN), level + 1
    if level == 0:
        return placed.select("uid", "sequence_id", "offset", "full_from")
    # one row of a piece is settled, one (of level 0) knows its full pieces
    return placed.groupBy("uid").agg(F.max(F.when(~F.col("up"), F.col("sequence_id"))).alias("sequence_id"), F.max(F.when(~F.col("up"), F.col("offset"))).alias("offset"), F.max("full_from").alias("full_from"))


def pack_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    docs = encode_documents(df, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, tokenizer=tokenizer)
    where = pack(docs.select("uid", "n_ids"), capacity=capacity, region=region, islands=islands, epochs=epochs)
    first = (F.col("n_ids") - 1) % capacity + 1
    rows = docs.join(where, "uid").select("doc_id", "n_ids", first.alias("first"), "sequence_id", "offset", "full_from", F.posexplode("crcs").alias("piece", "ids_crc32"))
    short = (F.col("piece") == 0) & (F.col("first") < capacity)
    return rows.select(
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("first")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(short, F.col("sequence_id")).otherwise(F.col("full_from") + F.col("piece") - (F.col("first") < capacity).cast("int")).alias("sequence_id"),
        F.when(short, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
