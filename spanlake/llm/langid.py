"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (lower case; what is no letter is a space, runs of spaces are
one) in both directions and labels every position with a distribution over languages; a
document's probabilities are the mean over all its positions. Texts of any length are read in
windows of WINDOW bytes that overlap by twice CONTEXT, so that every position is labelled with
at least CONTEXT bytes of its text on either side. Training is plain numpy: backpropagation
through time with Adam over all windows of the whole texts of a bounded sample (DOCUMENTS rows,
chosen by hash, spread over the languages).

Defined results: a null text or one without a letter (str.isalpha) is ``und`` with score 0; with
nothing to learn from every document is ``und``; equal probabilities go to the language of
lower name; rows with a null text or language are not learned from; equal texts get equal
results; texts are read whole.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import broadcast_value, bucket, filter_rows, map_batches, read

#: Rows learned from, passes over them, windows in a step of training.
DOCUMENTS, EPOCHS, BATCH = 1024, 2, 64
EMBED, HIDDEN, SEED, RATE = 12, 16, 11, 0.01
#: Bytes of a window, and how many of them on either side are only read.
WINDOW, CONTEXT = 256, 16
#: Windows that are labelled at once, and the most labels of them (windows by languages).
AT_ONCE, LABELS_AT_ONCE = 1024, 8192
UNKNOWN, LEAST_SCORE = "und", 0.35
_KEEP = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase else 32 for b in range(256))


def spelled(text: str | None) -> bytes:
    """The bytes that the network reads; none where there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split())


def windows(texts: list[bytes], window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the texts (byte, window), which of their positions are labelled, and the text of each window."""
    step = window - 2 * context
    counts = np.array([-(-len(t) // step) for t in texts], np.int64)
    padded = b"".join(b" " * context + t.ljust(int(n) * step) + b" " * context for t, n in zip(texts, counts, strict=True) if n)
    of = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.arange(len(of)) * step + of_rank(of) * 2 * context
    place = np.arange(window)[:, None]
    whole = np.frombuffer(padded, np.uint8)
    data = np.lib.stride_tricks.sliding_window_view(whole, window)[starts].T if len(of) else np.zeros((window, 0), np.uint8)
    left = np.array([len(t) for t in texts], np.int64)[of] - k * step + context
    return data, (place >= context) & (place < window - context) & (place < left), of


def of_rank(of: np.ndarray) -> np.ndarray:
    """The number of different values before each one of a sorted array."""
    return np.cumsum(np.diff(of, prepend=of[:1]) > 0)


class Network:
    """Parameters and passes; bytes are (time, batch)."""

    def __init__(self, languages: list[str], embed: int = EMBED, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        make = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"embed": (rng.normal(0, 0.3, (256, embed))).astype(np.float32), "out": make(2 * hidden, len(languages)), "out_b": np.zeros(len(languages), np.float32)}
        for d in ("f", "b"):
            self.p |= {f"in_{d}": make(embed, 3 * hidden), f"rec_{d}": make(hidden, 3 * hidden), f"bias_{d}": np.zeros(3 * hidden, np.float32)}

    def _states(self, x: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction, in order of place."""
        h_n, (steps, n) = self.hidden, x.shape
        # A gate is 1 / (1 + exp(-a)) and the new state 2 / (1 + exp(-2 a)) - 1, an exponential being cheaper than a
        # tangent: the factors of a go into the tables. Every array is whole, as rows of a part of one are slow.
        parts = [(slice(k * h_n, (k + 1) * h_n), factor) for k, factor in enumerate((-1, -1, -2))]
        table = self.p["embed"] @ self.p[f"in_{d}"] + self.p[f"bias_{d}"]
        kind = table.dtype
        of_r, of_z, of_new = (np.ascontiguousarray(table[:, k]) * kind.type(factor) for k, factor in parts)
        rec_r, rec_z, rec_new = (np.ascontiguousarray(self.p[f"rec_{d}"][:, k]) * kind.type(factor) for k, factor in parts)
        out, h = np.empty((steps, n, h_n), kind), np.zeros((n, h_n), kind)
        r, z, new, through = (np.empty((n, h_n), kind) for _ in range(4))
        if keep is not None:
            keep |= {k: np.empty((steps, n, h_n), kind) for k in ("r", "z", "new", "u", "before")}
        # buffers are reused, as most of the time goes into moving memory; an infinite exponential makes a gate 0
        with np.errstate(over="ignore"):
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                at = x[t].astype(np.intp)
                for gate, of, rec in ((r, of_r, rec_r), (z, of_z, rec_z)):
                    of.take(at, 0, gate, "clip")
                    gate += np.matmul(h, rec, out=through)
                    np.exp(gate, out=gate)
                    gate += 1
                np.matmul(h, rec_new, out=through)
                if keep is not None:
                    keep["before"][t] = h
                    np.divide(1, r, out=keep["r"][t])
                    np.divide(1, z, out=keep["z"][t])
                    np.multiply(through, -0.5, out=keep["u"][t])
                through /= r
                of_new.take(at, 0, new, "clip")
                new += through
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                if keep is not None:
                    keep["new"][t] = new
                h = np.subtract(h, new, out=out[t])
                h /= z
                h += new
        return out

    def _by_language(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (language, time, batch) of every byte position; languages first, as sums along a short last axis are slow."""
        out, h_n = self.p["out"], self.hidden
        logits = out[:h_n].T @ self._states(x, "f").reshape(-1, h_n).T
        logits += out[h_n:].T @ self._states(x, "b").reshape(-1, h_n).T
        logits += self.p["out_b"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, *x.shape)

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, language) of every byte position."""
        return np.moveaxis(self._by_language(x), 0, 2)

    def gradients(self, x: np.ndarray, labelled: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the labelled positions, and its gradients by backpropagation through time."""
        steps, n = x.shape
        h_n, p = self.hidden, self.p
        kept: dict[str, dict] = {"f": {}, "b": {}}
        both = np.concatenate([self._states(x, d, kept[d]) for d in ("f", "b")], axis=2)
        logits = both @ p["out"] + p["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        delta = np.exp(logits)
        delta /= delta.sum(axis=2, keepdims=True)
        total = max(1, int(labelled.sum()))
        loss = float((-np.log(np.maximum(delta[:, np.arange(n), y], 1e-12)) * labelled).sum() / total)
        delta[:, np.arange(n), y] -= 1
        delta *= labelled[:, :, None] / np.array(total, delta.dtype)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        flat = lambda v: v.reshape(steps * n, -1)
        g["out"] = flat(both).T @ flat(delta)
        g["out_b"] = flat(delta).sum(axis=0)
        up = delta @ p["out"].T
        of = x.ravel()
        for k, d in enumerate(("f", "b")):
            held, rec, w_in = kept[d], p[f"rec_{d}"].T.copy(), p[f"in_{d}"]
            into, through = (np.empty((steps, n, 3 * h_n), up.dtype) for _ in range(2))
            carry = np.zeros((n, h_n), up.dtype)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                r, z, new = held["r"][t], held["z"][t], held["new"][t]
                dh = up[t, :, k * h_n : (k + 1) * h_n] + carry
                dn = into[t, :, 2 * h_n :]
                np.multiply(dh * (1 - z), 1 - new * new, out=dn)
                np.multiply(dn * held["u"][t], r * (1 - r), out=into[t, :, :h_n])
                np.multiply(dh * (held["before"][t] - new), z * (1 - z), out=into[t, :, h_n : 2 * h_n])
                through[t, :, : 2 * h_n] = into[t, :, : 2 * h_n]
                np.multiply(dn, r, out=through[t, :, 2 * h_n :])
                carry = dh * z + through[t] @ rec
            g[f"rec_{d}"] = flat(held["before"]).T @ flat(through)
            by_byte = np.stack([np.bincount(of, c, 256) for c in flat(into).T], axis=1).astype(up.dtype)
            g[f"bias_{d}"] = by_byte.sum(axis=0)
            g[f"in_{d}"] = p["embed"].T @ by_byte
            g["embed"] += by_byte @ w_in.T
        return loss, g


def train(samples: list[tuple[bytes, str]], *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network | None:
    """Fit a network to all windows of (spelled text, language) pairs; None if there are none."""
    samples = [x for x in samples if x[0]]
    languages = sorted({y for _, y in samples})
    if not languages:
        return None
    net, rng = Network(languages), np.random.default_rng(seed)
    at = {y: i for i, y in enumerate(languages)}
    data, labelled, of = windows([t for t, _ in samples])
    y = np.array([at[lang] for _, lang in samples])[of]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps = epochs * -(-len(of) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(of))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            _, g = net.gradients(data[:, rows], labelled[:, rows], y[rows])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            lr = rate * (1 - 0.9 * step / steps)
            step += 1
            lr *= np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, v in g.items():
                v = v / max(1.0, norm)
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.999 * second[name] + 0.001 * v * v
                net.p[name] -= (lr * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Each text's language and its probability, the mean over the text's positions."""
    bytes_of = [spelled(t) for t in texts]
    data, labelled, of = windows(bytes_of)
    sums = np.zeros((len(texts), len(net.languages)))
    at_once = max(1, min(AT_ONCE, LABELS_AT_ONCE // len(net.languages)))
    for a in range(0, len(of), at_once):
        some = slice(a, a + at_once)
        prob = np.einsum("ctn,tn->nc", net._by_language(np.ascontiguousarray(data[:, some])), labelled[:, some].astype(np.float32))
        np.add.at(sums, of[some], prob)
    out = []
    for total, t in zip(sums, bytes_of, strict=True):
        p = total / max(1, len(t))
        out.append((net.languages[int(p.argmax())], min(1.0, float(p.max()))) if t else (UNKNOWN, 0.0))
    return out


def label_positions(net: Network, text: str) -> tuple[bytes, np.ndarray]:
    """The bytes read and the probabilities (position, language) of each."""
    data, labelled, _ = windows([spelled(text)])
    prob = net.label(data)
    return spelled(text), prob.transpose(1, 0, 2)[labelled.T]


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = DOCUMENTS) -> Network | None:
    """Train on the whole texts of at most ``documents`` rows with a language, spread over the languages."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(documents).collect()
    if not counts:
        return None
    share = documents / len(counts)
    # about the wanted share of each language by hash, then the least hashes of all
    take = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * share / r["count"])))])
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("h", h / F.element_at(take, F.col("lang"))).filter("h < 1")
    chosen = near.select("doc_id", "lang", "h").orderBy("h", "doc_id").limit(documents)
    sample = near.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")

    def make():
        return lambda cols: {"lang": cols["lang"], "spelled": [spelled(t) for t in cols["text"]]}

    got = map_batches(sample.select("text", "lang"), make, "lang string, spelled binary", "text").collect()
    return train(sorted((bytes(r["spelled"]), r["lang"]) for r in got))


def identify(df: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = broadcast_value(df.sparkSession, net)

    def make():
        def work(cols):
            got = pooled(shared.value, cols["text"]) if shared.value else [(UNKNOWN, 0.0)] * len(cols["text"])
            return {"doc_id": cols["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

        return work

    return map_batches(docs, make, f"doc_id {kind}, lang_pred string, score double", "text")


def keep_identified(df: DataFrame, net: Network | None, *, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``df`` whose language is told with a score of at least ``least``."""
    shared = broadcast_value(df.sparkSession, net)

    def make():
        if shared.value is None:
            return lambda texts: [False] * len(texts)
        return lambda texts: [lang != UNKNOWN and s >= least for lang, s in pooled(shared.value, texts)]

    return filter_rows(df, text_col, make)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: those whose crc32(doc_id) modulo 4 is not 2."""
    return docs.filter(bucket(F.col("doc_id"), 4) != 2)


def op5_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, learn(learnable(docs)))
    return found.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
