"""Chat transcripts: turns and roles by a hidden Markov model, then canonical turns.

A transcript given as one text (`parse_text`) is cut into lines. The hidden state of a line is a role and whether the line begins a turn of
that role or continues one; it is observed as the line's marker, its length, whether a question mark ends it, and whether one ends the line
before or that line is blank. A turn goes from a line that the most probable states begin one at to the next such line, and a marker is cut
off only there. The text is one value, so it is decoded in one task.

For `parse` the turns are already cut, and a transcript is a sequence of blocks of text, some of which begin with a speaker's marker in one of many styles, as in `Human:`, `[USER]`
or `### Response`. Roles are the hidden states. A block is observed as its marker's word, its number of lines, its length, the mean length
of its lines and whether a question mark ends it; the features are independent given the role. Start, transition and emission
probabilities are counted over a bounded sample of transcripts with known roles. The most probable roles (Viterbi) say who speaks, also
where no marker does; then markers are cut off and every block becomes `<|role|>` and its text.

A conversation is cut into segments of SEGMENT turn numbers. Each gives a matrix: the best score from any role before it to any role at its
end. Only these matrices of a conversation meet in one task (nine numbers a segment), which finds the best role at every segment's end; then
each segment is traced back on its own. So one conversation may be very long.

Null texts are empty blocks. Rows of one conversation go in order of turn (null first) and then text, so repeated rows follow each other;
null conversation ids are one conversation. A table without rows gives none. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
SEGMENT = 512
#: Conversations and blocks of them that the model is counted over.
MOST_CONVERSATIONS, MOST_BLOCKS = 2_000, 20_000

# Words with which transcripts name a speaker.
MARKERS = ("system", "context", "user", "human", "q", "question", "instruction", "prompt", "customer", "me", "assistant", "ai", "bot", "a", "answer", "response", "model", "agent")
_MARKER = re.compile(rf"\s*(?:\*\*|#+\s*|\[|<\|?|\()?\s*({'|'.join(sorted(MARKERS, key=len, reverse=True))})\s*(?:(?:\]|\|?>|\))\s*:?|\*\*\s*:|:\s*\*\*|:|(?<=[a-z])\s*\n)[ \t]*", re.I)
_HEADING = re.compile(r"\s*#+\s")
#: Values of each feature: marker (0: none), lines, length, mean line, question.
_WIDTHS = (len(MARKERS) + 1, 8, 12, 10, 2)
#: Of a line: marker, length, question, question before, blank before.
_LINE_WIDTHS = (len(MARKERS) + 1, 12, 2, 2, 2)


def parted(block: str | None) -> tuple[int, str]:
    """(marker's number from 1, or 0, the text without it)."""
    text = block or ""
    m = _MARKER.match(text)
    if not m or (m[0].endswith("\n") and not _HEADING.match(text)):
        return 0, text.strip()
    return 1 + MARKERS.index(m[1].lower()), text[m.end() :].strip()


def observed(block: str | None) -> tuple[tuple[int, ...], str]:
    """The features of a block and its text."""
    marker, text = parted(block)
    lines = text.count("\n") + 1 if text else 0
    size = len(text)
    return (marker, min(lines, 7), min(size.bit_length(), 11), min((size // max(lines, 1)).bit_length(), 9), int(text.endswith("?"))), text


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """Log probabilities (block, role) of what is observed."""
        table = np.array(seen, np.int64).reshape(-1, len(self.emit))
        return sum(e[:, column].T for e, column in zip(self.emit, table.T, strict=True)) if len(table) else np.empty((0, len(self.start)))


def counted(conversations: list[list[tuple[str, str | None]]]) -> Model:
    """A model from lists of (role, block), with one added to every count. Blocks of other roles count as a break."""
    n = len(ROLES)
    start, move, emit = np.ones(n), np.ones((n, n)), [np.full((n, w), 0.5) for w in _WIDTHS]
    for blocks in conversations:
        before = None
        for i, (role, block) in enumerate(blocks):
            if role not in ROLES:
                before = None
                continue
            r = ROLES.index(role)
            if i == 0:
                start[r] += 1
            if before is not None:
                move[before, r] += 1
            for e, x in zip(emit, observed(block)[0], strict=True):
                e[r, x] += 1
            before = r
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(log(start), log(move), [log(e) for e in emit])


def observed_lines(text: str | None) -> tuple[list[tuple[int, ...]], list[str], list[str]]:
    """The features of each line, the lines, and the lines without their markers."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    seen, plain, before = [], [], None
    for line in lines:
        marker, rest = parted(line + "\n")
        plain.append(rest if marker else line)
        seen.append((marker, min(len(rest).bit_length(), 11), int(rest.endswith("?")), int(before is not None and before.endswith("?")), int(before == "")))
        before = rest
    return seen, lines, plain


def counted_lines(conversations: list[list[tuple[str, str | None]]]) -> Model:
    """A model of lines from lists of (role, block): state 2 r begins a turn of role r, and 2 r + 1, only after these two, continues it."""
    n = 2 * len(ROLES)
    start, move, emit = np.ones(n), np.ones((n, n)), [np.full((n, w), 0.5) for w in _LINE_WIDTHS]
    for blocks in conversations:
        # Observed in the whole text, so that a line's features see the line before it.
        seen = iter(observed_lines("\n".join((b or "").replace("\r\n", "\n") for _, b in blocks))[0])
        before = None
        for i, (role, block) in enumerate(blocks):
            for k in range((block or "").replace("\r\n", "\n").count("\n") + 1):
                x = next(seen)
                if role not in ROLES:
                    before = None
                    continue
                state = 2 * ROLES.index(role) + (k > 0)
                if i == k == 0:
                    start[state] += 1
                if before is not None:
                    move[before, state] += 1
                for e, v in zip(emit, x, strict=True):
                    e[state, v] += 1
                before = state
    start[1::2] = 0
    for r in range(len(ROLES)):
        others = [s for s in range(n) if s // 2 != r]
        move[others, 2 * r + 1] = 0
    with np.errstate(divide="ignore"):
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return Model(log(start), log(move), [log(e) for e in emit])


def turns_of(text: str | None, model: Model) -> list[tuple[str, bool, str]]:
    """(role, whether a marker was cut off, text) of the turns of a transcript, by a model of lines."""
    seen, lines, plain = observed_lines(text)
    out: list[tuple[str, bool, list[str]]] = []
    for state, x, line, rest in zip(traced(model, model.scores(seen), None), seen, lines, plain, strict=True):
        if state % 2 == 0:
            out.append((ROLES[state // 2], x[0] > 0, [rest]))
        else:
            out[-1][2].append(line)
    return [(role, marked, "\n".join(held).strip()) for role, marked, held in out]


def transfer(model: Model, scores: np.ndarray, first: bool) -> np.ndarray:
    """The best score from each role before the blocks (all equal at a conversation's start) to each at their end."""
    best = model.start[None, :] + scores[0] + np.zeros((len(ROLES), 1)) if first else model.move + scores[0]
    for s in scores[1:]:
        best = (best[:, :, None] + model.move[None]).max(1) + s
    return best


def traced(model: Model, scores: np.ndarray, before: int | None, end: int | None = None) -> list[int]:
    """The best roles of the blocks, from the role before them (None: a conversation's start) to the role at their end (None: any)."""
    best = (model.start if before is None else model.move[before]) + scores[0]
    back = []
    for s in scores[1:]:
        way = best[:, None] + model.move
        back.append(way.argmax(0))
        best = way.max(0) + s
    roles = [int(best.argmax()) if end is None else end]
    for b in reversed(back):
        roles.append(int(b[roles[-1]]))
    return roles[::-1]


def fit(transcripts: DataFrame, conversations: int = MOST_CONVERSATIONS, blocks: int = MOST_BLOCKS) -> Model:
    """Counts a model of blocks over a sample of the conversations."""
    return counted(_sampled(transcripts, conversations, blocks))


def fit_lines(transcripts: DataFrame, conversations: int = MOST_CONVERSATIONS, blocks: int = MOST_BLOCKS) -> Model:
    """Counts a model of lines over a sample of the conversations."""
    return counted_lines(_sampled(transcripts, conversations, blocks))


def _sampled(transcripts: DataFrame, conversations: int, blocks: int) -> list[list[tuple[str, str | None]]]:
    """The (role, block) lists of the conversations with the smallest hashes of their ids; at most `blocks` rows reach the driver."""
    chosen = transcripts.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(conversations)
    rows = transcripts.join(F.broadcast(chosen), "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id", "turn").limit(blocks).select("conv_id", "turn", "role", "block").collect()
    held: dict[int, list[tuple[str, str | None]]] = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0)):
        held.setdefault(r.conv_id, []).append((r.role, r.block))
    return list(held.values())


def _segments(blocks: DataFrame, model: Model) -> DataFrame:
    """A row for each segment: its blocks' texts and scores, and its matrix."""
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, texts, seen = None, [], [], []

        def made() -> dict:
            scores = held.value.scores(seen)
            conv, segment, first = key
            return {"conv_id": conv, "segment": segment, "turns": turns, "texts": texts, "marked": [x[0] > 0 for x in seen], "scores": scores.ravel().tolist(), "matrix": transfer(held.value, scores, first).ravel().tolist()}

        out = []
        for batch in batches:
            for conv, segment, first, turn, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, segment, first) != key:
                    if seen:
                        out.append(made())
                    key, turns, texts, seen = (conv, segment, first), [], [], []
                x, text = observed(block)
                turns.append(turn)
                texts.append(text)
                seen.append(x)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if seen:
            out.append(made())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turns", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("marked", pa.list_(pa.bool_())), ("scores", pa.list_(pa.float64())), ("matrix", pa.list_(pa.float64()))])
    ordered = blocks.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "block")
    return ordered.select("conv_id", "segment", "first", "turn", "block").mapInArrow(run, "conv_id long, segment long, turns array<long>, texts array<string>, marked array<boolean>, scores array<double>, matrix array<double>")


def _ends(segments: DataFrame, model: Model) -> DataFrame:
    """conv_id, segment, before, end: the best role before and at the end of each segment of conversations that have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = object(), []
        for batch in batches:
            for conv, segment, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != key and held:
                    yield made(key, held)
                    held = []
                key = conv
                held.append((segment, matrix))
        if held:
            yield made(key, held)

    def made(conv: int | None, held: list) -> pa.RecordBatch:
        n = len(ROLES)
        best, back = np.array(held[0][1]).reshape(n, n)[0], []
        for _, m in held[1:]:
            way = best[:, None] + np.array(m).reshape(n, n)
            back.append(way.argmax(0))
            best = way.max(0)
        end = [int(best.argmax())]
        for b in reversed(back):
            end.append(int(b[end[-1]]))
        end = end[::-1]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(held), pa.int64()), pa.array([s for s, _ in held], pa.int64()), pa.array([None, *end[:-1]], pa.int32()), pa.array(end, pa.int32())], names=["conv_id", "segment", "before", "end"])

    ordered = segments.select("conv_id", "segment", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id long, segment long, before int, end int")


def parse(transcripts: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", block: str = "block", segment: int = SEGMENT) -> DataFrame:
    """conv_id, turn, role, marked (whether a marker was cut off), text, rendered: the blocks as canonical turns."""
    own = transcripts.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(block).cast("string").alias("block"))
    own = own.withColumn("segment", F.floor(F.coalesce("turn", F.lit(0)) / segment))
    spans = own.groupBy("conv_id").agg(F.min("segment").alias("least"), F.max("segment").alias("most"))
    several = spans.where("least < most").select(F.col("conv_id").alias("long_id"), "least")
    # A conversation of one segment needs no role from elsewhere; what follows tells its rows by `first` alone.
    own = own.join(several, F.expr("conv_id <=> long_id"), "left").withColumn("first", F.expr("least is null or segment = least"))
    segments = _segments(own.withColumn("segment", F.expr("if(least is null, 0, segment)")), model)
    ends = _ends(segments.join(several, F.expr("conv_id <=> long_id"), "left_semi"), model).select(F.col("conv_id").alias("e_id"), F.col("segment").alias("e_segment"), "before", "end")
    joined = segments.join(ends, F.expr("conv_id <=> e_id and segment = e_segment"), "left")
    held = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, turns, texts, marked, scores, before, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                roles = [ROLES[r] for r in traced(held.value, np.array(scores).reshape(-1, len(ROLES)), before, end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(turns), pa.int64()), pa.array(turns, pa.int64()), pa.array(roles), pa.array(marked), pa.array(texts, pa.string()), pa.array([f"<|{r}|>\n{t}\n" for r, t in zip(roles, texts, strict=True)])],
                    names=["conv_id", "turn", "role", "marked", "text", "rendered"],
                )

    return joined.select("conv_id", "turns", "texts", "marked", "scores", "before", "end").mapInArrow(run, "conv_id long, turn long, role string, marked boolean, text string, rendered string")


def joined(transcripts: DataFrame) -> DataFrame:
    """conv_id, text: the blocks of each conversation in order (turn, then block) as one text, a line feed between them."""
    ordered = transcripts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "block"))).alias("b"))
    return ordered.select("conv_id", F.array_join(F.transform("b", lambda b: F.coalesce(b["block"], F.lit(""))), "\n").alias("text"))


def parse_text(transcripts: DataFrame, model: Model, conv_id: str = "conv_id", text: str = "text") -> DataFrame:
    """conv_id, turn (from 0), role, marked, text, rendered: the turns found in transcripts of one text each, by a model of lines."""
    held = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(c, k, *t) for c, x in zip(*(c.to_pylist() for c in part.columns), strict=True) for k, t in enumerate(turns_of(x, held.value))]
                conv, turn, role, marked, texts = zip(*rows, strict=True)
                rendered = [f"<|{r}|>\n{t}\n" for r, t in zip(role, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role), pa.array(marked), pa.array(texts, pa.string()), pa.array(rendered)],
                    names=["conv_id", "turn", "role", "marked", "text", "rendered"],
                )

    own = transcripts.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "conv_id long, turn long, role string, marked boolean, text string, rendered string")


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, block: conversations as transcripts, in one of five styles each; every fourth marker, by hash, is left out."""
    styles = (("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("[SYSTEM] ", "[USER] ", "[ASSISTANT] "), ("### System\n", "### Instruction\n", "### Response\n"), ("**System:** ", "Q: ", "A: "))

    def marker(i: int) -> Column:
        style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
        chosen = F.lit("")
        for k, s in enumerate(styles):
            chosen = F.when(style == k, F.lit(s[i])).otherwise(chosen)
        return chosen

    hidden = F.pmod(F.xxhash64(F.lit("hidden"), "conv_id", "turn"), F.lit(4)) == 0
    mark = F.when(F.col("role") == "system", marker(0)).when(F.col("role") == "user", marker(1)).when(F.col("role") == "assistant", marker(2)).otherwise("")
    return conversations.select("conv_id", "turn", "role", F.when(hidden, F.coalesce("text", F.lit(""))).otherwise(F.concat(mark, F.coalesce("text", F.lit("")))).alias("block"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, found with its role in a transcript of one text in which some markers are missing."""
    transcripts = raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return parse_text(joined(transcripts), fit_lines(transcripts)).select("conv_id", "turn", "role", "marked", "rendered")
