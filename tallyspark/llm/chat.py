"""Chat formatting: incremental black-box rendering.

A template is any function from a list of turns to text. Rendering successive prefixes of a conversation
and comparing each output with the one before it shows where every turn stands, without knowledge of the
template; a template whose output for a prefix is not a prefix of the next output rewrites history and is
reported.

Rows of a conversation are sorted by Spark and stream through a task. A general template gets the whole
history at each turn, so that its conversations are compared over their full length; a conversation is then one
section, and its time grows with the square of its turns. A template declared local, whose output for some turns
is that of the turns before a border and that of those after it, is rendered within sections of SECTION
turns, so that time and memory stay in proportion to a conversation's length; digests run on over sections.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

SECTION = 32
#: Fixed: a turn is HEAD with its role, its text and TAIL. A backslash is put before the marks' first characters and before itself in texts and roles.
HEAD, TAIL = "### {role}:\n", "\n</turn>\n"
#: Fixed: the conversation that the query adds.
ADDED = (-7, [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")])
_ESCAPE, _UNESCAPE = re.compile(r"[\\#<\n:]"), re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    """Reversible: no control string is left, as its marks' first characters and line ends have a backslash before them."""
    return _ESCAPE.sub(lambda m: "\\" + ("n" if m[0] == "\n" else m[0]), text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def marked(turns: list[Turn]) -> str:
    """The default template."""
    return "".join(HEAD.format(role=escaped(role)) + escaped(text) + TAIL for role, text in turns)


def spans(render: Render, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The rendered text, each turn's span in it, and the turns at which the template rewrote what it had written.

    A span is what a turn adds to the output for the turns before it. At a rewriting turn it starts at the
    first character that changed.
    """
    text, found, rewrites = render([]), [], []
    opening = len(text)
    for i in range(len(turns)):
        now = render(turns[: i + 1])
        start = len(text)
        if not now.startswith(text):
            start = next((k for k, (a, b) in enumerate(zip(text, now, strict=False)) if a != b), min(len(text), len(now)))
            rewrites.append(i)
        found.append((min(start, opening) if not i else start, len(now)))
        text = now
    return text, found, rewrites


_BLOCK = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*)\n</turn>\n", re.S)


def parsed(block: str) -> tuple[str, int, int]:
    """Role of a turn's span and where its escaped text begins and ends."""
    m = _BLOCK.fullmatch(block)
    if not m:
        raise ValueError("a turn's span is not one marked turn")
    return unescaped(m[1]), m.start(2), m.end(2)


_OUT = pa.schema([("conv_id", pa.int64()), ("section", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("turns", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("rewrites", pa.bool_())])))])
_OUT_SQL = "conv_id bigint, section bigint, last boolean, text string, turns array<struct<start:bigint,end:bigint,role:string,text_start:bigint,text_end:bigint,rewrites:boolean>>"


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sections(render: Render, local: bool):
    def run(batches):
        conv, part, section, first = None, [], 0, True

        def out(last):
            text, found, rewrites = spans(render, part)
            turns = []
            for i, (a, b) in enumerate(found):
                role, s, e = parsed(text[a:b]) if render is marked else (part[i][0], 0, b - a)
                turns.append({"start": a, "end": b, "role": role, "text_start": a + s, "text_end": a + e, "rewrites": i in rewrites})
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "section": section, "last": last, "text": text, "turns": turns}], _OUT)

        for i, _, role, text in _rows(batches):
            if part and (i != conv or local and len(part) == SECTION):
                yield out(i != conv)
                section = section + 1 if i == conv else 0
                part = []
            elif first or i != conv:
                section = 0
            conv, first = i, False
            part.append((role or "", text or ""))
        if part:
            yield out(True)

    return run


def formatted(conversations: DataFrame, render: Render = marked, local: bool | None = None) -> DataFrame:
    """Sections (conv_id, section, last, text, turns) of rendered conversations, in order within a partition.

    local: render(a + b) == render(a) + render(b) for all turns, so that long conversations may be cut in sections;
    by default only the default template counts as local, and any other's conversation is one section.

    Rows are ordered by turn (null first), then role and text; a null role or text counts as empty, and rows with
    a null conv_id form one conversation. turns has the span of each turn in text, its role, the span of its
    text (read back from the marks of the default template), and whether the template rewrote history there.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_sections(render, render is marked if local is None else local), _OUT_SQL)


def _digests(batches):
    """One row for each conversation, read back from its sections."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    rows, n = [], 0

    def batch():
        return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, pa.schema(list(zip(names, types, strict=True))))

    state = None
    for conv, section, last, text, turns in _rows(batches):
        if section == 0:
            state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
        state[4] += len(text)
        for t in turns:
            said = unescaped(text[t["text_start"] : t["text_end"]])
            state[0] += 1
            state[1].update(f"{t['role']}\n{said}\n".encode())
            state[5] += t["rewrites"]
            if t["role"] == "assistant":
                state[2] += len(said)
                state[3].update(said.encode())
        if last:
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
            n += 1
            if n % 2000 == 0:
                yield batch()
                rows = []
    yield batch()


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, of all rows with a null conv_id together; see formatted() for nulls, ties and repeated rows."""
    added = spark.createDataFrame([(ADDED[0], i, r, t) for i, (r, t) in enumerate(ADDED[1])], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return formatted(rows).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long".replace("n_rewrites", "rewrites")).withColumnRenamed("rewrites", "n_rewrites")
