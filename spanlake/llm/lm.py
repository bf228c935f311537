"""LM scoring by masked pseudo-likelihood.

A window network predicts every word from two words on either side; a document's score is the
sum of the conditional log-probabilities of all its words. Words are the corpus's commonest
(counted over all documents) and hash classes for the rest; a rare word's score has the factor
P(word | hash class) by the counts of all documents, which stay a distributed table. The network's
output is factored: classes of 64, then the word in its class. Texts are cut into words once and
kept in chunks, each with its own word list. Training is data-parallel numpy: every task runs
Adam over the positions of all its documents, every one in each round; the tasks' weights are averaged by the number of positions, in a tree on the
executors, for each round. What is gathered (counts and weights of every task) grows with the
corpus.

Defined results: null and empty texts have no words, score 0 and a null mean; equal rows get
equal scores; an empty table gives no rows. Texts are scored whole.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, broadcast_value, materialize, pieces, read

WIDTH, COMMON, RARE = 64, 3840, 256
TOKENS, EDGE = COMMON + RARE, COMMON + RARE
EMBED, HIDDEN, SIDE = 16, 32, 2
ROUNDS, BATCH, RATE, SEED = 2, 4096, 0.01, 5
#: Weights in a row of the averaging, and tasks averaged at once.
CHUNK, FAN = 4096, 64
#: Words and tokens at which a chunk of documents ends.
COUNTED, CHUNK_TOKENS = 150_000, 1_000_000
#: Positions scored at once.
AT_ONCE = 8192
_KEEP = bytes(b | 32 if chr(b) in string.ascii_uppercase else b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Words(dict):
    """Token of a word; rare words share RARE hash classes."""

    def __missing__(self, word: bytes) -> int:
        return COMMON + zlib.crc32(word) % RARE


def chunks(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in chunks: a chunk's words and their counts, its documents' ids and lengths, and the places of all
    their words among the chunk's (little-endian 32-bit)."""
    from pyspark import TaskContext

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct, out = arrow_schema(f"chunk long, words array<binary>, counts array<long>, doc_ids array<{kind}>, lengths array<long>, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        place = _Places()
        names, lengths, held, n = [], [], [], 0

        def ended() -> pa.RecordBatch:
            nonlocal chunk, place, names, lengths, held, n
            ids = np.concatenate([np.zeros(0, "<u4"), *held])
            made = [chunk], [list(place)], [np.bincount(ids, minlength=len(place))], [names], [lengths], [ids.tobytes()]
            chunk, place, names, lengths, held, n = chunk + 1, _Places(), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

        for batch in batches:
            for part in pieces(batch, 1):
                of = place.__getitem__
                for ws in map(words, part.column(1).to_pylist()):
                    held.append(np.fromiter(map(of, ws), "<u4", len(ws)))
                    lengths.append(len(ws))
                    n += len(ws)
                names += part.column(0).to_pylist()
                if len(place) > COUNTED or n > CHUNK_TOKENS:
                    yield ended()
        if names:
            yield ended()

    return docs.mapInArrow(run, struct)


class _Places(dict):
    """Words in order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def word_totals(table: DataFrame) -> DataFrame:
    """word and n, its count over all chunks."""
    return table.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))


def commonest(totals: DataFrame) -> dict[bytes, int]:
    """The words of largest count, by falling count; little more than COMMON reach the driver."""
    # classes of counts, so that only words that may be among them are sorted
    of = F.floor(F.log2("n") * 16).cast("int")
    least, held = 0, 0
    for r in totals.groupBy(of.alias("klass")).count().orderBy(F.desc("klass")).collect():
        least, held = r["klass"], held + r["count"]
        if held >= COMMON:
            break
    top = totals.filter(of >= least).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return {bytes(r["word"]): i for i, r in enumerate(top)}


def class_totals(totals: DataFrame, vocab: dict[bytes, int]) -> np.ndarray:
    """Count of the rare words of each hash class."""
    shared = spark_words(totals.sparkSession, vocab)
    rare = totals.join(F.broadcast(shared), "word", "left_anti")
    out = np.zeros(RARE, np.int64)
    for r in rare.groupBy((F.crc32("word") % RARE).cast("int").alias("klass")).agg(F.sum("n").alias("n")).collect():
        out[r["klass"]] = r["n"]
    return out


def spark_words(spark: SparkSession, vocab: dict[bytes, int]) -> DataFrame:
    return spark.createDataFrame([(bytearray(w),) for w in vocab], "word binary")


def token_of(vocab: dict[bytes, int], chunk_words: list[bytes]) -> np.ndarray:
    """The token of each of a chunk's words."""
    of = Words(vocab).__getitem__
    return np.fromiter(map(of, chunk_words), np.uint16, len(chunk_words))


def shapes() -> dict[str, tuple]:
    return {"embed": (TOKENS + 1, EMBED), "hide": (2 * SIDE * EMBED, HIDDEN), "hide_b": (HIDDEN,), "klass": (HIDDEN, WIDTH), "klass_b": (WIDTH,), "word": (WIDTH, HIDDEN, WIDTH), "word_b": (WIDTH, WIDTH)}


def initial(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 0.1 if len(s) > 1 else 0, s)).ravel() for s in shapes().values()]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, s in shapes().items():
        n = int(np.prod(s))
        out[name], at = flat[at : at + n].reshape(s), at + n
    return out


#: Logits are held within these bounds, so that their exponentials neither overflow nor vanish.
MOST_LOGIT = 40.0
_ONES = np.ones(WIDTH, np.float32)
#: Places of each token's pairs of neighbours among all weights of the embedding.
_PAIRS = np.arange((TOKENS + 1) * EMBED // 2).reshape(TOKENS + 1, -1)


def _normalise(x: np.ndarray) -> np.ndarray:
    """Turns logits into exponentials, in place; returns their sums."""
    np.clip(x, -MOST_LOGIT, MOST_LOGIT, out=x)
    np.exp(x, out=x)
    return x @ _ONES.astype(x.dtype, copy=False)


def hidden(p: dict, context: np.ndarray) -> np.ndarray:
    return np.tanh(p["embed"][context].reshape(len(context), -1) @ p["hide"] + p["hide_b"])


def by_class(klass: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, stop) of the runs of a sorted array."""
    present, starts = np.unique(klass, return_index=True)
    return list(zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(klass)], strict=True))


def log_probabilities(p: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(class | window) + log P(word | class, window) of each target."""
    order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
    h, klass, inner = h[order], target[order] // WIDTH, target[order] % WIDTH
    some = np.arange(len(h))
    x = h @ p["klass"]
    x += p["klass_b"]
    at = np.clip(x[some, klass], -MOST_LOGIT, MOST_LOGIT)
    logs = at - np.log(_normalise(x))
    for c, a, b in by_class(klass):
        np.matmul(h[a:b], p["word"][c], out=x[a:b])
        x[a:b] += p["word_b"][c]
    at = np.clip(x[some, inner], -MOST_LOGIT, MOST_LOGIT)
    logs += at - np.log(_normalise(x))
    out = np.empty(len(h), np.float64)
    out[order] = logs
    return out


def _loss_and_slopes(x: np.ndarray, at: np.ndarray, n: int) -> float:
    """Turns logits into the gradients of the loss's mean over ``n`` rows, in place; returns the summed loss."""
    x *= (1 / (_normalise(x) * n))[:, None]
    at = at + np.arange(0, x.size, x.shape[1])
    x = x.reshape(-1)
    hit = x.take(at, mode="clip")
    x[at] = hit - x.dtype.type(1 / n)
    return -float(np.log(hit).sum(dtype=np.float64)) - len(hit) * math.log(n)


def gradients(p: dict, g: dict, context: np.ndarray, target: np.ndarray) -> float:
    """Adds the mean loss's gradients to ``g``; returns the loss. Rows are taken together, sorted by class."""
    n = len(target)
    order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
    context, target = context.take(order, axis=0), target.take(order)
    klass, inner = target // WIDTH, target % WIDTH
    flat = p["embed"].take(context, axis=0, mode="clip").reshape(n, -1)
    h = flat @ p["hide"]
    h += p["hide_b"]
    np.tanh(h, out=h)
    d = h @ p["klass"]
    d += p["klass_b"]
    loss = _loss_and_slopes(d, klass, n)
    ones = np.ones(n, h.dtype)
    g["klass"] += h.T @ d
    g["klass_b"] += ones @ d
    dh = d @ p["klass"].T
    spans = [(p["word"][c], p["word_b"][c], g["word"][c], g["word_b"][c], h[a:b], d[a:b], dh[a:b], ones[a:b]) for c, a, b in by_class(klass)]
    for w, w_b, _, _, some, x, _, _ in spans:
        np.matmul(some, w, out=x)
        x += w_b
    loss += _loss_and_slopes(d, inner, n)
    held = np.empty((HIDDEN, WIDTH), h.dtype)
    for w, _, g_w, g_b, some, x, up, one in spans:
        g_w += np.matmul(some.T, x, out=held)
        g_b += one @ x
        up += x @ w.T
    h *= h
    dh *= np.subtract(1, h, out=h)
    g["hide"] += flat.T @ dh
    g["hide_b"] += ones @ dh
    # two neighbours are added as one complex number, at half the places
    pair = np.complex64 if h.dtype == np.float32 else np.complex128
    np.add.at(g["embed"].reshape(-1).view(pair), _PAIRS.take(context.ravel(), axis=0).reshape(-1), (dh @ p["hide"].T).reshape(-1).view(pair))
    return loss / n


class Adam:
    """Steps on one array, without further memory."""

    def __init__(self, flat: np.ndarray, rate: float = RATE):
        self.flat, self.rate, self.step = flat, rate, 0
        self.grad, self.first, self.second, self.held = (np.zeros_like(flat) for _ in range(4))

    def __call__(self) -> None:
        self.step += 1
        held, grad = self.held, self.grad
        self.first *= 0.9
        self.first += np.multiply(grad, 0.1, out=held)
        self.second *= 0.99
        np.multiply(grad, grad, out=held)
        held *= 0.01
        self.second += held
        np.sqrt(self.second, out=held)
        held += 1e-8
        np.divide(self.first, held, out=held)
        held *= self.rate * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        self.flat -= held
        grad[:] = 0


class Windows:
    """The positions of a chunk's documents, edges filled with EDGE."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        self.at = np.arange(len(tokens)) + SIDE * (1 + np.repeat(np.arange(len(lengths)), lengths))
        self.joined = np.full(len(tokens) + SIDE * (1 + len(lengths)), EDGE, np.uint16)
        self.joined[self.at] = tokens

    def __call__(self, which) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and targets of some positions."""
        at = self.at[which]
        return np.stack([self.joined[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1).astype(np.int64), self.joined[at].astype(np.int64)


def train_round(spark: SparkSession, table: DataFrame, vocab: dict[bytes, int], weights: np.ndarray, *, seed: int = SEED) -> np.ndarray:
    """One pass of every task over its documents from ``weights``, then the average by positions."""
    from pyspark import TaskContext

    shared = broadcast_value(spark, (weights, vocab))
    struct, out = arrow_schema("task int, chunk int, n long, weights array<float>")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocab = shared.value[0].copy(), shared.value[1]
        update, seen = Adam(flat), 0
        p, g = views(flat), views(update.grad)
        for batch in batches:
            for chunk_words, ids, lengths in zip(*(batch.column(i) for i in range(3)), strict=True):
                tokens = token_of(vocab, chunk_words.as_py())[np.frombuffer(ids.as_buffer(), "<u4")]
                of = Windows(tokens, lengths.values.to_numpy())
                order = np.random.default_rng(seed + update.step).permutation(len(tokens))
                for a in range(0, len(order), BATCH):
                    gradients(p, g, *of(order[a : a + BATCH]))
                    update()
                seen += len(tokens)
        if seen:
            n, task = -(-len(flat) // CHUNK), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([flat[k * CHUNK : (k + 1) * CHUNK] for k in range(n)], pa.list_(pa.float32()))], schema=out)

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("task", "ascending")])
        n = rows["n"].to_numpy().astype(np.float64)
        x = np.stack([np.asarray(r.values, np.float64) for r in rows["weights"]])
        return pa.Table.from_arrays([rows["task"][:1].combine_chunks(), rows["chunk"][:1].combine_chunks(), pa.array([int(n.sum())], pa.int64()), pa.array([(x * n[:, None]).sum(axis=0) / n.sum()], pa.list_(pa.float32()))], schema=out)

    parts = materialize(table.select("words", "ids", "lengths").mapInArrow(local, struct), "weights")
    left = parts.agg(F.max("task")).first()[0]
    if left is None:
        return weights
    left += 1
    while left > 1:  # a tree: no task holds the weights of more than FAN others
        parts = parts.withColumn("task", F.expr(f"task div {FAN}").cast("int")).groupBy("chunk", "task").applyInArrow(mean, struct)
        left = -(-left // FAN)
    return np.concatenate([np.array(r["weights"], np.float32) for r in sorted(parts.collect(), key=lambda r: r["chunk"])])


def score_chunks(table: DataFrame, vocab: dict[bytes, int], weights: np.ndarray, totals: DataFrame, classes: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood.

    The network scores a chunk where it lies; only the places of its rare words then move, to meet their counts.
    """
    spark = table.sparkSession
    shared = broadcast_value(spark, (vocab, weights, classes))
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    struct, out = arrow_schema(f"chunk long, doc_ids array<{kind}>, lengths array<long>, logs array<double>, n_rare array<long>, rare binary")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights, classes = shared.value
        p = views(weights)
        # what each word adds to the hidden layer in each place of the window
        adds = [np.ascontiguousarray(p["embed"] @ p["hide"][k * EMBED : (k + 1) * EMBED]) for k in range(2 * SIDE)]
        adds[0] += p["hide_b"]
        of_class = np.concatenate([np.zeros(COMMON), -np.log(np.maximum(classes, 1))])
        for batch in batches:
            for chunk, chunk_words, doc_ids, lengths, ids in zip(*batch.columns, strict=True):
                ids, n = np.frombuffer(ids.as_buffer(), "<u4"), lengths.values.to_numpy()
                tokens = token_of(vocab, chunk_words.as_py())[ids]
                of, logs = Windows(tokens, n), np.empty(len(ids))
                for a in range(0, len(ids), AT_ONCE):
                    context, target = of(slice(a, a + AT_ONCE))
                    places = np.ascontiguousarray(context.T)
                    h = adds[0].take(places[0], axis=0, mode="clip")
                    more = np.empty_like(h)
                    for k in range(1, 2 * SIDE):
                        h += adds[k].take(places[k], axis=0, out=more, mode="clip")
                    logs[a : a + AT_ONCE] = log_probabilities(p, np.tanh(h, out=h), target) + of_class[target]
                rare = tokens >= COMMON
                made = [chunk.as_py()], [doc_ids.values], [n], [per_document(logs, n)], [per_document(rare, n).astype(np.int64)], [ids[rare].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

    scored, scored_out = arrow_schema(f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")

    def finish(docs: pa.Table, counts: pa.Table) -> pa.Table:
        names, n, logs, n_rare, rare = (docs[c][0] for c in ("doc_ids", "lengths", "logs", "n_rare", "rare"))
        n, at, rare = n.values.to_numpy(), counts["place"].to_numpy(), np.frombuffer(rare.as_buffer(), "<u4")
        of_word = np.zeros(int(at.max(initial=-1)) + 1)
        of_word[at] = np.log(counts["n"].to_numpy())
        sums = logs.values.to_numpy() + per_document(of_word[rare], n_rare.values.to_numpy())
        return pa.Table.from_arrays([names.values, pa.array(n), pa.array(np.where(n > 0, sums, 0.0)), pa.array(sums / np.maximum(n, 1), mask=n == 0)], schema=scored_out)

    docs = table.select("chunk", "words", "doc_ids", "lengths", "ids").mapInArrow(predict, struct)
    rare = table.select("chunk", F.posexplode("words").alias("place", "word")).join(F.broadcast(spark_words(spark, vocab)), "word", "left_anti")
    # a word is once in a chunk, and common words are out, so no word has many rows
    counts = rare.join(totals, "word").select(F.col("chunk").alias("of"), "place", "n")
    return docs.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(finish, scored)


def per_document(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    total, ends = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]), np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def score_corpus(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Learn from all documents, then score all of them."""
    spark = df.sparkSession
    table = materialize(chunks(df, id_col=id_col, text_col=text_col), "words")
    totals = materialize(word_totals(table), "totals")
    vocab = commonest(totals)
    weights = initial()
    for k in range(rounds):
        weights = train_round(spark, table, vocab, weights, seed=SEED + 1000 * k)
    return score_chunks(table, vocab, weights, totals, class_totals(totals, vocab))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(read(spark, sf_dir, "documents"))
