"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes a bounded sample of labelled rows (EXAMPLES, those of least hash). Every word of
the examples is a term; a term's weight is its inverse document frequency, counted over all
documents of the corpus, times how strongly it marks the label among the examples (FLOOR for a
term that does not). Examples lie in blocks, like by like. Postings of common terms keep their
largest weight in each block, so a block whose bound is under the k-th best cosine so far is not
read; lists with few postings a block are read whole. The neighbours found are exactly the k
nearest. They vote by cosine; votes pass through a monotone calibration fitted on the examples
with themselves left out.

Defined results: null and empty texts, and texts without a word of any example, have no terms,
no evidence and the rate of such examples; equal cosines go to the example of the lower number;
with no labelled rows every score is 0; rows whose label or id is null are not learned from;
repeated labelled rows count once; texts are always scored whole.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, broadcast_value, bucket, filter_rows, map_batches, pieces, read

#: Labelled rows that are learned from, examples in an index block, and texts searched at once.
EXAMPLES, BLOCK, AT_ONCE = 8192, 64, 64
#: Terms that more than one in so many examples holds are common: their postings lie by block.
COMMON = 16
#: Rounding that a bound or a cosine of four bytes may have.
SLACK = 1e-5
NEIGHBOURS, THRESHOLD, PRIOR_VOTES = 15, 0.7, 0.5
#: Weight of a term that does not mark the label; cases taken off its positives; chi-square at which it weighs a quarter.
FLOOR, DOUBT, HALF = 0.05, 1.5, 15.0
_LETTERS = bytes(b if b >= 128 or chr(b) in string.ascii_letters else 32 for b in range(256))


def word_counts(text: str | None) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for w in (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split():
        counts[w] = counts.get(w, 0) + 1
    return counts


def spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [start, stop) in a row, and the ranges' lengths."""
    n = stops - starts
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - n), n), n


class BlockMaxIndex:
    """Postings of unit vectors: of common terms a row per example, blocks of them with each term's largest weight; of others lists."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int = BLOCK, common: int = COMMON):
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        held = np.bincount(term, minlength=terms)
        often = held * common > n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        some = often[term]
        self.rows = np.zeros((self.blocks * block, int(often.sum())), np.float32)
        self.rows[example[some], self.column[term[some]]] = weight[some]
        self.most = self.rows.reshape(self.blocks, block, -1).max(axis=1)
        order = np.flatnonzero(~some)
        if (np.diff(term[order]) < 0).any():
            order = order[np.argsort(term[order], kind="stable")]
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.where(often, 0, held))])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights): cosines and numbers of the k examples of largest cosine (above zero), best first, ties by number; ``but`` are left out."""
        m, size = len(queries), self.blocks * self.block
        common, listed = np.zeros((m, self.rows.shape[1])), np.zeros((m, size))
        for i, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            common[i, column[column >= 0]] = weights[column >= 0]
            at, n = spans(self.starts[terms], self.starts[terms + 1])
            listed[i] = np.bincount(self.example[at], np.repeat(weights, n) * self.weight[at], size)
        query, lists = common.astype(np.float32), listed.astype(np.float32)
        bound = query @ self.most.T + lists.reshape(m, self.blocks, self.block).max(axis=2)
        scores, unread, least = np.full((m, size), -1, np.float32), bound > 0, np.zeros(m, np.float32)
        # the blocks of best bounds give a first k-th best; then all blocks that may still hold a better one
        for few in (2 + k // self.block, self.blocks):
            reads = unread & (bound >= least[:, None] - SLACK)
            if few < self.blocks:
                reads &= bound >= np.partition(bound, self.blocks - few, axis=1)[:, [self.blocks - few]]
            unread &= ~reads
            for b in np.flatnonzero(reads.any(axis=0)).tolist():
                rows, here = np.flatnonzero(reads[:, b]), slice(b * self.block, (b + 1) * self.block)
                scores[rows, here] = query[rows] @ self.rows[here].T + lists[rows, here]
            if but is not None:
                scores[np.arange(m), but] = -1
            if size > k:
                least = np.maximum(np.partition(scores, size - k, axis=1)[:, size - k], 0)
        out = []
        for i in range(m):
            found = np.flatnonzero((scores[i] > 0) & (scores[i] >= least[i] - SLACK))
            exact = (self.rows[found] * common[i]).sum(axis=1) + listed[i, found]
            best = np.argsort(-exact, kind="stable")[:k]
            out.append((exact[best], found[best]))
        return out


class Examples:
    """The examples' words: ``example``, ``term`` and ``count`` are the postings, in order of terms."""

    def __init__(self, n: int, example: np.ndarray, term: np.ndarray, count: np.ndarray, terms: pa.Array, weights: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.n, self.terms, self.weights = n, terms, weights
        self.held = np.bincount(term, minlength=len(terms)).astype(np.int32)
        self.example, self.count = example[order].astype(np.int32), count[order].astype(np.int32)
        self._made: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the postings, the examples' vectors of length one; in four bytes, as workers are small."""
        term = np.repeat(np.arange(len(self.held), dtype=np.int32), self.held)
        weight = np.log(self.count, dtype=np.float32)
        weight += 1
        weight *= self.weights.astype(np.float32)[term]
        length = np.sqrt(np.bincount(self.example, weight * weight, self.n)).astype(np.float32)
        weight /= length[self.example]
        return term, weight

    @property
    def index(self) -> BlockMaxIndex:
        def make():
            term, weight = self._postings()
            return BlockMaxIndex(self.example, term, weight, self.n, len(self.held))

        return self._once("index", make)

    def vectors(self) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """The vectors of the examples, by number."""
        term, weight = self._postings()
        order = np.argsort(self.example, kind="stable").astype(np.int32)
        term, weight, at = term[order], weight[order], np.concatenate([[0], np.cumsum(np.bincount(self.example, minlength=self.n))])
        return lambda i: (term[at[i] : at[i + 1]], weight[at[i] : at[i + 1]])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and their weights, of length one."""
        of = self._once("place", lambda: {w: i for i, w in enumerate(self.terms.to_pylist())}).get
        known = [(i, n) for w, n in word_counts(text).items() if (i := of(w)) is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        at, n = np.array(known, np.int64).T
        x = (1 + np.log(n)) * self.weights[at]
        return at, x / math.sqrt(float(x @ x))


class Model:
    """Calibrated votes of the nearest examples; ``shared`` is the broadcast of Examples."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, base: float, silent: float, shared, k: int):
        self.ids, self.labels, self.base, self.silent, self.shared, self.k = ids, labels.astype(np.float64), base, silent, shared, k
        self.steps: tuple[list[float], list[float]] = ([], [])

    def vote(self, cosines: np.ndarray, near: np.ndarray) -> float:
        """The cosine-weighted share of positive neighbours, with a little of the base rate."""
        return float((cosines @ self.labels[near] + PRIOR_VOTES * self.base) / (cosines.sum() + PRIOR_VOTES))

    def score(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the calibrated score, and the cosines and numbers of the neighbours."""
        out = []
        for a in range(0, len(texts), AT_ONCE):
            queries = [self.shared.value.vector(t) for t in texts[a : a + AT_ONCE]]
            for (terms, _), (cosines, near) in zip(queries, self.shared.value.index.nearest(queries, self.k), strict=True):
                raw = self.vote(cosines, near)
                out.append((float(np.interp(raw, *self.steps)) if len(terms) else self.silent, cosines, near))
        return out


def marking(count: np.ndarray, positive: np.ndarray, base: float) -> np.ndarray:
    """How strongly terms mark the label, 0 to 1: by the chi-square of a term that is commoner with it than by chance."""
    expected = count * base
    above = np.maximum(0.0, positive - DOUBT - expected)
    strength = above**2 / np.maximum(expected, 1e-9) + above**2 / np.maximum(count - expected, 1e-9)
    return (strength / (strength + HALF)) ** 2


def isotonic(x: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators fit as interpolation points; ends are pulled in by one pseudo-case so that no score is certain."""
    pools: list[list[float]] = []
    for a, b in sorted(zip(x, y, strict=True)):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools.pop()
            pools.append([a1 + a2, b1 + b2, n1 + n2])
    return [p[0] / p[2] for p in pools], [(p[1] + 0.05) / (p[2] + 0.1) for p in pools]


def document_frequencies(corpus: DataFrame, terms: pa.Array, *, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each of ``terms`` occurs, and the number of texts."""
    shared = broadcast_value(corpus.sparkSession, terms)
    struct, out = arrow_schema("term int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value.to_pylist())}
        found, texts = np.zeros(len(place), np.int64), 0
        for batch in batches:
            for part in pieces(batch, 0):
                texts += part.num_rows
                at = [i for t in part.column(0).to_pylist() for w in set(word_counts(t)) if (i := place.get(w)) is not None]
                found += np.bincount(np.array(at, np.int64), minlength=len(place))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(found[some], texts), pa.int64())], schema=out)

    got = corpus.select(F.col(text_col).cast("string")).mapInArrow(count, struct).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    n = np.zeros(len(terms) + 1, np.int64)  # the last place, -1, has the number of texts
    n[got["term"].to_numpy()] = got["n"].to_numpy()
    return n[:-1], int(n[-1])


def learn(labelled: DataFrame, corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on at most ``examples`` rows of ``labelled``, with term counts of all of ``corpus``; the driver holds the examples' words."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and y is not null")
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    spark = labelled.sparkSession
    # A broadcast filter: the ids are at most ``examples``.
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("y", (F.col("y") > 0).cast("int")).distinct()

    def split():
        def work(cols):
            got = [word_counts(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "y": cols["y"], "words": [list(g) for g in got], "counts": [list(g.values()) for g in got]}

        return work

    got = map_batches(sample, split, "doc_id long, y int, words array<binary>, counts array<int>", "text").toArrow().combine_chunks()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending"), ("y", "ascending")]))
    lists = [got[c].combine_chunks() if isinstance(got[c], pa.ChunkedArray) else got[c] for c in ("words", "counts")]
    coded = pc.cast(lists[0].flatten(), pa.binary()).dictionary_encode()
    # terms in order of their words, whatever the order of rows
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms, term = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    example = np.repeat(np.arange(got.num_rows), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
    in_docs, n_docs = document_frequencies(corpus, terms, text_col=text_col) if len(terms) else (np.zeros(0), 0)
    ids, labels, count = got["doc_id"].to_numpy(), got["y"].to_numpy(), lists[1].flatten().to_numpy()
    base = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.0
    marks = marking(np.bincount(term, minlength=len(terms)), np.bincount(term, labels[example], len(terms)), float(labels.mean()) if len(labels) else 0.0)
    weights = (np.log((1 + n_docs) / (1 + in_docs)) + 1) * (FLOOR + (1 - FLOOR) * marks)
    spoken = np.bincount(example, minlength=len(ids)) > 0
    silent = float((labels[~spoken].sum() + base) / ((~spoken).sum() + 1)) if len(ids) else 0.0
    place, order = likeness(example, term, count, marks, ids, spoken)
    model = Model(ids[order], labels[order], base, silent, broadcast_value(spark, Examples(len(order), place[example], term, count, terms, weights)), neighbours)
    if len(order):
        model.steps = isotonic(left_out_votes(spark, model), model.labels.tolist())
    return model


def likeness(example: np.ndarray, term: np.ndarray, count: np.ndarray, marks: np.ndarray, ids: np.ndarray, spoken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The examples' places and their order: like stands by like, so that blocks have tight bounds, by strongest mark, then by commonest word."""
    of = np.argsort(example, kind="stable")
    at = np.flatnonzero(np.diff(example[of], prepend=-1))
    mark, common = np.full(len(ids), -1), np.full(len(ids), -1)
    for rows in np.split(of, at[1:]) if len(at) else []:
        strongest = term[rows[np.argmax(marks[term[rows]])]]
        mark[example[rows[0]]] = strongest if marks[strongest] > 0.25 else -1
        common[example[rows[0]]] = term[rows[np.argmax(count[rows])]]
    order = np.lexsort((ids, common, mark))
    order = order[spoken[order]]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    return place, order


def left_out_votes(spark: SparkSession, model: Model) -> list[float]:
    """Each example's vote by the others."""

    def make():
        known = model.shared.value
        vector = known.vectors()

        def work(cols):
            votes = []
            for a in range(0, len(cols["id"]), AT_ONCE):
                some = cols["id"][a : a + AT_ONCE]
                votes += [model.vote(*x) for x in known.index.nearest([vector(i) for i in some], model.k, some)]
            return {"id": cols["id"], "vote": votes}

        return work

    n = len(model.ids)
    got = map_batches(spark.range(0, n, 1, max(1, min(16, n // 256))), make, "id long, vote double").toArrow()
    votes = np.zeros(n)
    votes[got["id"].to_numpy()] = got["vote"].to_numpy()
    return votes.tolist()


def score_documents(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, evidence (the neighbours' ids, cosines and labels)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def work(cols):
            got = model.score(cols["text"])
            return {
                "doc_id": cols["doc_id"],
                "score": [s for s, _, _ in got],
                "predicted": [int(s >= threshold) for s, _, _ in got],
                "evidence": [[{"example": int(model.ids[i]), "cosine": c, "label": int(model.labels[i])} for c, i in zip(cosines.tolist(), near.tolist(), strict=True)] for _, cosines, near in got],
            }

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, make, f"doc_id {kind}, score double, predicted int, evidence array<struct<example:bigint,cosine:double,label:int>>", "text")


def drop_toxic(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` that score under ``threshold``."""
    return filter_rows(df, text_col, lambda: lambda texts: [s < threshold for s, _, _ in model.score(texts)])


def labelled_rows(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Labelled documents that may be learned from: those whose crc32(doc_id) modulo 3 is not 1."""
    docs = (documents if documents is not None else read(spark, sf_dir, "documents")).select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(bucket(F.col("doc_id"), 3) != 1)
    # The least hashes are taken before the join, so that only the sample's texts move.
    picked = labels.filter("toxic is not null").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(EXAMPLES)
    return docs.join(F.broadcast(picked), "doc_id")


def op2_tfidf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(labelled_rows(spark, sf_dir), docs))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")
