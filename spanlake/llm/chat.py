"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is plain text. Every line that is not blank is observed through features: the kind
of speaker marker it starts with, whether a blank line stands before it, its length class, and
how it ends. States are role and place (a turn's first line or a later one). Transition and
feature tables are counts, with smoothing, over a bounded sample of transcripts whose roles are
known; Viterbi recovers the most likely states of all lines of a transcript, and turns are
rendered as ``<|role|>``, their text without marker, ``<|end|>``.

Conversations of any length are one transcript: where one lies in several parts, each part's
best path values from every state to every state are chained over the parts, then the parts
are decoded between the states found. Logarithms are whole numbers, so that gives the very path
that decoding in one piece would.

Defined results: null, empty and blank texts have no turns; with nothing to learn from, markers
alone decide; equally likely paths prefer the earlier state in the order of STATES; turns are
numbered from 0 in each transcript; equal transcripts are each parsed. Of a conversations table,
repeated rows count once, rows of equal turn follow a hash of role and text, a null turn comes
first, rows without a conversation are transcripts of their own, and roles other than ROLES are
written without a marker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, broadcast_value, map_batches, materialize, pieces, read

ROLES = ("system", "user", "assistant")
STATES = tuple((r, first) for r in ROLES for first in (True, False))
#: Transcripts that the tables are counted on.
EXAMPLES = 2000
#: Turns and characters at which a conversation's part ends; the parts are decoded as one.
TURNS, PART_CHARS = 4096, 4_000_000
#: Units of the whole-numbered logarithms, and the one of zero.
UNIT, NEVER = 1 << 16, -(1 << 60)
NAMES = {
    "system": "system sys instruction instructions context",
    "user": "user human question customer prompt q me",
    "assistant": "assistant ai bot answer agent response model a",
}
KIND = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(r"\s*(?:#{1,6}\s*|\[|<\|?|\*\*)?(" + "|".join(sorted(KIND, key=lambda x: (-len(x), x))) + r")(?:\s*(?:\]|\|?>|\*\*)?\s*:|\s*(?:\]|\|>|>|\*\*)|\s*$)\s*", re.IGNORECASE)
HEADED = re.compile(r"\s*(?:#{1,6}\s*|\[|<\|?|\*\*)")
SIZES = {"marker": 1 + len(ROLES), "blank": 2, "length": 5, "end": 3}
#: Marker styles of the transcripts that the query writes: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Instructions: ", "Human: ", "AI: "),
    ("### System\n", "### User\n", "### Assistant\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("", "", ""),
)


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's marker names, and where its text begins."""
    m = MARKER.match(line)
    if not m or (m.end() == len(line) and ":" not in m.group() and not HEADED.match(line)):
        return None, 0
    return KIND[m.group(1).lower()], m.end()


def observe(text: str | None) -> list[tuple[str, dict[str, int]]]:
    """(line, features) of the lines that are not blank."""
    out, blank = [], 1
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = 1
            continue
        role, at = marker(line)
        body = line[at:].rstrip()
        end = 0 if not body else 1 if body[-1] == "?" else 2
        out.append((line, {"marker": 0 if role is None else 1 + ROLES.index(role), "blank": blank, "length": min(4, len(body) // 60), "end": end}))
        blank = 0
    return out


class Hmm:
    """Log tables; ``counts`` come from transcripts with known states."""

    def __init__(self, examples: list[tuple[list[dict[str, int]], list[int]]], smooth: float = 0.5):
        n = len(STATES)
        start, move = np.full(n, smooth), np.full((n, n), smooth)
        emit = {k: np.full((n, size), smooth) for k, size in SIZES.items()}
        for s, (role, first) in enumerate(STATES):
            # prior knowledge: a marker names its role and stands on first lines
            emit["marker"][s, 1 + ROLES.index(role)] += 5 if first else 0
            emit["marker"][s, 0] += 3 if first else 12
            for t, (to, again) in enumerate(STATES):
                move[s, t] += 4 if (to == role) != again else 0
            start[s] += 3 if first else 0
        for features, states in examples:
            for i, (f, s) in enumerate(zip(features, states, strict=True)):
                for k, v in f.items():
                    emit[k][s, v] += 1
                if i:
                    move[states[i - 1], s] += 1
                else:
                    start[s] += 1
        for s, (role, _) in enumerate(STATES):
            for t, (to, again) in enumerate(STATES):
                if not again and to != role:  # a later line continues its own turn
                    move[s, t] = 0
        start[[s for s, (_, first) in enumerate(STATES) if not first]] = 0
        # a row more than states: what a transcript's first line comes from
        self.move = _whole(np.vstack([move / move.sum(axis=1, keepdims=True), start / start.sum()]))
        self.emit = {k: _whole(v / v.sum(axis=1, keepdims=True)) for k, v in emit.items()}

    def logs(self, features: list[dict[str, int]]) -> np.ndarray:
        """(line, state)"""
        return sum(self.emit[k][:, [f[k] for f in features]] for k in SIZES).T if features else np.zeros((0, len(STATES)), np.int64)

    def forward(self, before: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best values of paths that end in each state (the last: in none yet), from those before the lines; and where each came from."""
        back = np.zeros((len(logs), len(STATES)), np.uint8)
        best = before
        for i, row in enumerate(logs):
            paths = best[:, None] + self.move
            back[i] = paths.argmax(axis=0)
            best = np.append(np.maximum(paths.max(axis=0) + row, NEVER), NEVER)
        return best, back

    def transfer(self, logs: np.ndarray) -> np.ndarray:
        """Best values of paths over the lines from each state to each."""
        n = len(STATES) + 1
        best = np.full((n, n), NEVER)
        np.fill_diagonal(best, 0)
        for row in logs:
            to = (best[:, :, None] + self.move[None]).max(axis=1) + row
            best = np.hstack([np.maximum(to, NEVER), np.full((n, 1), NEVER)])
        return best

    def viterbi(self, features: list[dict[str, int]]) -> list[int]:
        if not features:
            return []
        best, back = self.forward(NOTHING, self.logs(features))
        return trace(back, int(best.argmax()))[0]


#: Values before a transcript's first line.
NOTHING = np.append(np.full(len(STATES), NEVER), 0)


def _whole(share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.round(np.log(np.maximum(share, 1e-300)) * UNIT), NEVER).astype(np.int64)


def trace(back: np.ndarray, last: int) -> tuple[list[int], int]:
    """The states of the path that ends in ``last``, and the state before it."""
    path = []
    for row in back[::-1]:
        path.append(last)
        last = int(row[last])
    return path[::-1], last


def lines_to_turns(seen: list, states: list[int]) -> list[tuple[str, str, bool]]:
    """(role, text, whether it begins a turn) of runs of lines; only the first may go on with a turn from before."""
    out: list[tuple[str, list[str], bool]] = []
    for (line, _), s in zip(seen, states, strict=True):
        role, first = STATES[s]
        if first:
            named, at = marker(line)
            out.append((role, [line[at:] if named == role else line], True))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((role, [line], False))
    return [(role, "\n".join(lines), begins) for role, lines, begins in out]


def turns(hmm: Hmm, text: str | None) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript."""
    seen = observe(text)
    return [(role, x.strip()) for role, x, _ in lines_to_turns(seen, hmm.viterbi([f for _, f in seen]))]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def written(turn_list: list[tuple[str | None, str | None]], style: int) -> str:
    """A transcript in one of STYLES; turns are set apart by a blank line."""
    marks = dict(zip(ROLES, STYLES[style % len(STYLES)], strict=True))
    return "\n\n".join(marks.get(role, "") + (text or "") for role, text in turn_list)


def known_states(turn_list: list[tuple[str | None, str | None]], style: int) -> tuple[list[dict[str, int]], list[int]]:
    """Features and true states of a written transcript."""
    features, states = [], []
    seen = iter(observe(written(turn_list, style)))
    marks = dict(zip(ROLES, STYLES[style % len(STYLES)], strict=True))
    for role, text in turn_list:
        lines = [x for x in (marks.get(role, "") + (text or "")).split("\n") if x.strip()]
        for i, _ in enumerate(lines):
            features.append(next(seen)[1])
            states.append(STATES.index((role, i == 0)))
    return features, states


def conversations_as_rows(df: DataFrame, *, turns_each: int = TURNS) -> DataFrame:
    """conv_id, part, starts, whole, turns: conversations in parts of at most ``turns_each`` turns.

    Rows are range-partitioned in order, so a long conversation lies in many tasks and its parts
    ascend. ``starts``: the part surely is its conversation's first; ``whole``: surely its only one.
    """
    from pyspark import TaskContext

    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct().withColumn("hash", F.xxhash64("role", "text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    struct, out = arrow_schema(f"conv_id {kind}, part long, starts boolean, whole boolean, turns array<struct<turn:bigint,role:string,text:string>>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held, chars, key = [], 0, None
        starts = part == 0

        def ended(ends: bool) -> pa.RecordBatch:
            nonlocal held, chars, part
            lone = key is None
            made = [key], [part], [starts or lone], [starts and ends or lone], [held]
            held, chars, part = [], 0, part + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

        for batch in batches:
            for piece in pieces(batch, 3):
                for conv, turn, role, text in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    other = conv is None or conv != key
                    if held and (other or len(held) >= turns_each or chars > PART_CHARS):
                        yield ended(other)
                        starts = other
                    key = conv
                    held.append({"turn": turn, "role": role, "text": text})
                    chars += len(text or "")
        if held:
            yield ended(False)

    ordered = rows.repartitionByRange("conv_id", "turn", "hash").sortWithinPartitions("conv_id", "turn", "hash", "role", "text")
    return materialize(ordered.select("conv_id", "turn", "role", "text").mapInArrow(cut, struct), "conversations")


def style_of(key: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(len(STYLES))).cast("int")


def learn(grouped: DataFrame, *, examples: int = EXAMPLES) -> Hmm:
    """Count the tables on the ``examples`` transcripts of least hash whose roles are all known; of long conversations their first parts."""
    known = grouped.filter("starts").filter(F.forall("turns", lambda t: F.coalesce(t["role"].isin(*ROLES), F.lit(False)))).withColumn("h", F.xxhash64("conv_id", "turns"))
    picked = known.orderBy("h").limit(examples).select(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), style_of(F.col("conv_id")).alias("style"))
    return Hmm([known_states([(t["role"], t["text"]) for t in r["turns"]], r["style"]) for r in picked.toLocalIterator()])


def parse_transcripts(df: DataFrame, hmm: Hmm, *, id_cols: tuple[str, ...] = ("conv_id",), text_col: str = "transcript") -> DataFrame:
    """The id columns, turn, role, text and rendered, one row per recovered turn; each row of ``df`` is a transcript."""
    names = [f"id{i}" for i in range(len(id_cols))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(id_cols, names, strict=True)], F.col(text_col).cast("string").alias("transcript"))
    shared = broadcast_value(df.sparkSession, hmm)
    ids = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def make():
        def work(cols):
            got = [turns(shared.value, t) for t in cols.pop("transcript")]
            return cols | {"turns": [[{"role": r, "text": x, "rendered": render(r, x)} for r, x in g] for g in got]}

        return work

    found = map_batches(rows, make, f"{ids}, turns array<struct<role:string,text:string,rendered:string>>", "transcript")
    found = found.select(*names, F.posexplode("turns").alias("turn", "t")).select(*names, F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "t.rendered")
    return found.toDF(*id_cols, "turn", "role", "text", "rendered")


def parse_parts(parts: DataFrame, hmm: Hmm) -> DataFrame:
    """As ``parse_transcripts`` for transcripts (conv_id, part, transcript) in parts that a blank line sets apart.

    A part sends the chains a row of its path values, then one of its ways back; texts stay where they are.
    """
    parts = materialize(parts.select("conv_id", "part", "transcript"), "parts")
    shared = broadcast_value(parts.sparkSession, hmm)
    kind = parts.schema["conv_id"].dataType.simpleString()
    n = len(STATES) + 1

    def features(text):
        seen = observe(text)
        return seen, shared.value.logs([f for _, f in seen])

    def values():
        return lambda cols: {"conv_id": cols["conv_id"], "part": cols["part"], "values": [shared.value.transfer(features(t)[1]).ravel().tolist() for t in cols["transcript"]]}

    sent, sent_out = arrow_schema(f"conv_id {kind}, part long, before array<long>")

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        before, out = NOTHING, []
        for v in table["values"]:
            out.append(before)
            before = np.maximum((before[:, None] + v.values.to_numpy().reshape(n, n)).max(axis=0), NEVER)
        return pa.Table.from_arrays([table["conv_id"].combine_chunks(), table["part"].combine_chunks(), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], schema=sent_out)

    found = map_batches(parts, values, f"conv_id {kind}, part long, values array<long>", "transcript")
    entered = materialize(parts.join(found.groupBy("conv_id").applyInArrow(chain, sent), ["conv_id", "part"]), "entered")

    def ways():
        def work(cols):
            entries, begun, best = [], [], []
            for before, text in zip(cols["before"], cols["transcript"], strict=True):
                after, back = shared.value.forward(np.array(before), features(text)[1])
                paths = [trace(back, s) for s in range(len(STATES))] if len(back) else [([], s) for s in range(len(STATES))]
                entries.append([e for _, e in paths])
                begun.append([sum(STATES[x][1] for x in path) for path, _ in paths])
                best.append(int(after.argmax()))
            return {"conv_id": cols["conv_id"], "part": cols["part"], "entries": entries, "begun": begun, "best": best}

        return work

    ends, ends_out = arrow_schema(f"conv_id {kind}, part long, last int, turn long")

    def unchain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        entries, begun, lasts, counts = table["entries"].to_pylist(), table["begun"].to_pylist(), [], []
        state = table["best"][-1].as_py()
        for e, b in zip(reversed(entries), reversed(begun), strict=True):
            lasts.append(state)
            # a conversation whose parts so far are blank ends in no state
            counts.append(b[state] if state < len(STATES) else 0)
            state = e[state] if state < len(STATES) else state
        counts = np.array(counts[::-1])
        return pa.Table.from_arrays([table["conv_id"].combine_chunks(), table["part"].combine_chunks(), pa.array(lasts[::-1], pa.int32()), pa.array(np.cumsum(counts) - counts, pa.int64())], schema=ends_out)

    back = map_batches(entered, ways, f"conv_id {kind}, part long, entries array<int>, begun array<int>, best int", "transcript")
    decoded = entered.join(back.groupBy("conv_id").applyInArrow(unchain, ends), ["conv_id", "part"]).select("conv_id", "part", "transcript", "before", "last", "turn")

    def decode():
        def work(cols):
            rows = {k: [] for k in ("conv_id", "part", "turn", "role", "text", "edge")}
            for conv, part, text, before, last, turn in zip(*(cols[c] for c in ("conv_id", "part", "transcript", "before", "last", "turn")), strict=True):
                seen, logs = features(text)
                if not seen:
                    continue
                path, _ = trace(shared.value.forward(np.array(before), logs)[1], last)
                got = lines_to_turns(seen, path)
                at = turn - (not got[0][2])
                for k, (role, x, begins) in enumerate(got):
                    for c, v in zip(rows, (conv, part, at + k, role, x, not begins or k == len(got) - 1), strict=True):
                        rows[c].append(v)
            return rows

        return work

    runs = materialize(map_batches(decoded, decode, f"conv_id {kind}, part long, turn long, role string, text string, edge boolean", "transcript"), "turns")
    # Only a part's first and last run may be pieces of one turn.
    edges = runs.filter("edge").groupBy("conv_id", "turn").agg(F.min_by("role", "part").alias("role"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    edges = edges.select("conv_id", "turn", "role", F.array_join(F.col("x.text"), "\n").alias("text"))

    def finish():
        def work(cols):
            texts = [x.strip() for x in cols["text"]]
            return cols | {"text": texts, "rendered": [render(r, x) for r, x in zip(cols["role"], texts, strict=True)]}

        return work

    return map_batches(edges.unionByName(runs.filter("not edge").select("conv_id", "turn", "role", "text")), finish, f"conv_id {kind}, turn long, role string, text string, rendered string", "text")


def parse_conversations(grouped: DataFrame, hmm: Hmm) -> DataFrame:
    """conv_id, turn, role, text and rendered of ``conversations_as_rows``, written as transcripts and parsed."""
    written = as_transcripts(grouped)
    return parse_transcripts(written.filter("whole"), hmm).unionByName(parse_parts(written.filter("not whole"), hmm))


def as_transcripts(grouped: DataFrame) -> DataFrame:
    """conv_id, part, whole, transcript: the turns written in the style that the conversation's id picks."""
    style = style_of(F.col("conv_id"))
    marks = F.array(*[F.create_map(*[x for role, m in zip(ROLES, s, strict=True) for x in (F.lit(role), F.lit(m))]) for s in STYLES])
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(F.element_at(F.element_at(marks, style + 1), t["role"]), F.lit("")), F.coalesce(t["text"], F.lit(""))))
    return grouped.select("conv_id", "part", "whole", F.array_join(lines, "\n\n").alias("transcript"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = conversations_as_rows(read(spark, sf_dir, "conversations"))
    return parse_conversations(grouped, learn(grouped))
