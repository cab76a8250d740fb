"""Chat formatting by black-box rendering of successive turn prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A template turns a list of (role, text) into one string.
Template = Callable[[list[tuple[str, str]]], str]

#: With a template declared local to the turn a rendering holds so many turns at most, and longer conversations
#: are rendered in sections. A black box has to be rendered once per prefix of the whole conversation, so the
#: work grows with the square of its turns.
SECTION = 64

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|<(?=/turn>)|#(?=##)|(?<=##)#")
_SCAN = re.compile(r"\\(.)|(</turn>\n)", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before backslashes and before what could be read as a control string."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _role(role: str) -> str:
    return re.sub(r"[\\:#<\n]", r"\\\g<0>", role)


def turn_template(turns: list[tuple[str, str]]) -> str:
    """``### Role: text</turn>`` and a line end for each turn, with control strings in texts escaped."""
    return "".join(f"{OPEN}{_role(r)}: {escape(t)}{CLOSE}\n" for r, t in turns)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """The turns of a string that ``turn_template`` made."""
    turns, at = [], 0
    while at < len(rendered):
        assert rendered.startswith(OPEN, at)
        role_from = at + len(OPEN)
        mark = re.compile(r"(?:\\.|[^\\:])*", re.DOTALL).match(rendered, role_from)
        body = mark.end() + 2
        end = next(m.start() for m in _SCAN.finditer(rendered, body) if m[2])
        turns.append((unescape(mark[0]), unescape(rendered[body:end])))
        at = end + len(CLOSE) + 1
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def locate(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """(rendering, [(start, stop, text start, text stop)] per turn, turns that rewrote history).

    The prefix of k turns is rendered for every k; what one output adds to the one before is the span of turn
    k. If the output before is not its prefix, turn k rewrote history and its span starts where they part. The
    text inside the span is bounded by rendering the turn with two probe texts: what these share at the front
    and back is the template's own.
    """
    before, spans, rewrites = template([]), [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = _common(before, now)
        if start < len(before):
            rewrites.append(k - 1)
        role = turns[k - 1][0]
        one, two = (template([*turns[: k - 1], (role, probe)]) for probe in ("a", "b"))
        front = _common(one, two)
        back = _common(one[front:][::-1], two[front:][::-1])
        spans.append((start, len(now), min(front, len(now)), max(front, len(now) - back)))
        before = now
    return before, spans, rewrites


def _columns() -> T.StructType:
    long = T.LongType()
    turn = T.StructType([
        T.StructField("role", T.StringType()), T.StructField("start", long), T.StructField("stop", long),
        T.StructField("text_start", long), T.StructField("text_stop", long), T.StructField("loss", T.BooleanType())])
    return T.StructType([
        T.StructField("conv_id", long), T.StructField("section", long), T.StructField("formatted", T.StringType()),
        T.StructField("turns", T.ArrayType(turn)), T.StructField("rewrites", T.ArrayType(T.IntegerType()))])


def format_conversations(
    rows: DataFrame, template: Template = turn_template, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",), section: int = SECTION,
    local: bool | None = None,
) -> DataFrame:
    """Return (conv_id, section, formatted, turns, rewrites): each conversation rendered as a whole.

    ``local`` declares that the template renders every turn by itself, whatever stands before and after it;
    only then are conversations rendered in sections of ``section`` turns. Without a declaration that holds of
    ``turn_template`` alone; every other template sees true prefixes of the whole conversation.

    ``turns`` has for each turn its role, its span and its text's span in ``formatted`` (code points), and
    whether its text is under the loss mask (roles in ``learn``). ``rewrites`` lists the turns of the section at
    which the template changed what it had rendered before; their loss spans are not to be trusted.

    Rows are taken by turn, then role, then text; repeated rows are repeated turns. Null turns come first,
    null roles and texts are empty, rows without conv_id form one conversation. Extra columns are ignored; no
    rows give no rows. One shuffle by conversation; rows then stream in order, so a conversation needs the
    memory of one section, or of the whole without sections. Sections of a conversation follow each other in one partition.
    """
    schema = _columns()
    if not (template is turn_template if local is None else local):
        section = 0
    narrow = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_ = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("section", pa.int64()), ("formatted", pa.string()),
        ("turns", pa.list_(pa.struct([
            ("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()),
            ("text_stop", pa.int64()), ("loss", pa.bool_())]))),
        ("rewrites", pa.list_(pa.int32()))])

    def render(name: int | None, number: int, turns: list[tuple[str, str]]) -> dict:
        formatted, spans, rewrites = locate(turns, template)
        return {
            "conv_id": name, "section": number, "formatted": formatted, "rewrites": rewrites,
            "turns": [
                {"role": r, "start": a, "stop": b, "text_start": c, "text_stop": d, "loss": r in learn}
                for (r, _), (a, b, c, d) in zip(turns, spans, strict=True)],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: int | None = None
        number, turns, any_row = 0, [], False
        for batch in batches:
            out = []
            for c, r, t in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True):
                if any_row and c != name:
                    if turns:
                        out.append(render(name, number, turns))
                    number, turns = 0, []
                elif section and len(turns) == section:
                    out.append(render(name, number, turns))
                    number, turns = number + 1, []
                name, any_row = c, True
                turns.append((r, t))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if turns:
            yield pa.RecordBatch.from_pylist([render(name, number, turns)], schema=kinds)

    return sorted_.mapInArrow(work, schema)


def digests(sections: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the renderings.

    ``sections`` must come straight from ``format_conversations`` with ``turn_template``: the sections of a
    conversation are read one after another, and the digests run on from one to the next.
    """
    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None   # id, turns, digest of turns, loss characters, digest of loss, characters

        def done() -> dict:
            return dict(zip(kinds.names, [
                state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]], strict=True))

        for batch in batches:
            out = []
            for name, number, formatted, turns in zip(*[
                    batch.column(c).to_pylist() for c in ("conv_id", "section", "formatted", "turns")], strict=True):
                if state is None or number == 0:
                    if state is not None:
                        out.append(done())
                    state = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for t in turns:
                    if t["loss"]:
                        text = unescape(formatted[t["text_start"] : t["text_stop"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(formatted)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=kinds)

    return sections.mapInArrow(work, schema)
