"""Chat formatting with typed content parts, reversible escaping and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of this template and of common chat formats that texts must not be able to forge.
TURN_START = "<|turn|>"
TURN_END = "<|end|>"
CONTROLS = (TURN_START, TURN_END, "<|part:", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")
_ESCAPED_ROLE = re.compile(r"\\([\\n]?)")
_TURN = re.compile(re.escape(TURN_START) + r"(.*?)\n(.*?)" + re.escape(TURN_END) + r"\n", re.S)


def escape(text: str) -> str:
    """Doubles each backslash and puts one after the first character of each control string, so no control string is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class PartVisitor:
    """Flattens the parts of a turn in order. Text is escaped, parts that follow each other as one text, so that none of them can
    complete a control string of another; images, audio, documents and parts of unknown types become numbered placeholders, and
    their references and expanded token counts are recorded. `spans` are the places of texts in what is put together."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.spans: list[tuple[int, int]] = []
        self._open: list[str] = []
        self._size = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._open.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach(part, 256, 0)  # a flat price

    def visit_audio(self, part: dict) -> None:
        self._attach(part, 0, 25)  # tokens a second

    def visit_document(self, part: dict) -> None:
        self._attach(part, 0, 600)  # tokens a page

    def visit_other(self, part: dict) -> None:
        self._attach(part, 0, 1)

    def _attach(self, part: dict, flat: int, per_unit: int) -> None:
        self._close()
        kind, tokens, number = escape(str(part.get("type"))), part.get("tokens"), len(self.attachments)
        tokens = flat + per_unit * max(0, int(part.get("size") or 0)) if tokens is None else int(tokens)
        self.attachments.append((number, kind, part.get("ref"), tokens))
        self._put(f"<|part:{kind}:{number}|>")

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self._size += len(piece)

    def _close(self) -> None:
        if text := escape("".join(self._open)):
            self.spans.append((self._size, self._size + len(text)))
            self._put(text)
        self._open.clear()

    def body(self) -> str:
        self._close()
        return "".join(self.pieces)


def format_parts(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[int, str, str | None, int]], list[tuple[int, int]]]:
    """A turn as text, its attachments, and the places of its texts. Line ends in a role are escaped like control strings."""
    visitor = PartVisitor()
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    head = TURN_START + escape(role or "").replace("\n", "\\n") + "\n"
    body = visitor.body()
    return f"{head}{body}{TURN_END}\n", visitor.attachments, [(len(head) + a, len(head) + b) for a, b in visitor.spans]


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[int, str, str | None, int]]]:
    """A turn as text, and its attachments."""
    return format_parts(role, parts)[:2]


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts (placeholders stay as they are) read back from formatted turns."""
    return [(_ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(body)) for role, body in _TURN.findall(formatted)]


def text_parts(text: Column) -> Column:
    """A text as the only part of a turn."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("size"), null.cast("long").alias("tokens")))


FORMATTED = "conv_id long, turn long, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>"


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted turns: conv_id, turn, formatted, loss, attachments (number, kind, ref, tokens). loss is the mask: start and stop in code
    points of what in `formatted` is learnt from, the (escaped) texts of turns of loss_role alone, without head, marks and placeholders.

    Input columns: conv_id, turn, role, parts (an array of structs of type, text, ref, size, tokens; other columns are
    ignored). A conversation is its turns' `formatted` put together by turn. Null roles and texts count as empty, null parts
    are left out, unknown part types become placeholders with one token per unit of size; rows that repeat a turn are
    formatted each on its own; an empty table gives an empty result. A task holds one batch of turns, of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(*format_parts(r, p), r == loss_role) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            loss = pa.array([[{"start": a, "stop": b} for a, b in spans] if own else [] for _, _, spans, own in done], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            kinds = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
            attached = pa.array([[{"number": n, "kind": k, "ref": r, "tokens": t} for n, k, r, t in found] for _, found, _, _ in done], pa.list_(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in done], pa.string()), loss, attached], names=["conv_id", "turn", "formatted", "loss", "attachments"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what is read back from its formatted turns (see DIGESTS).

    Rows are dealt by conversation, sorted by turn (then text) and read as a stream: a task holds one batch and the running
    digests, however long a conversation is. A digest is over all turns in order, so one conversation is one task's, even if it holds a
    third of all rows. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = object(), None, []

        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(list(map(pa.array, list(zip(*rows, strict=True)) or [[]] * 6, kinds)), names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != now or state is None:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, body in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learnt = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
            if rows:
                yield out(rows)
                rows.clear()
        close()
        if rows:
            yield out(rows)

    parts = formatted.select("conv_id", "formatted", "loss", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return parts.select("conv_id", "formatted", "loss").mapInArrow(run, DIGESTS)
