"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

SPACE = "▁"
#: Fixed values of the model format: piece types, and by how much an unknown character scores below the least piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Units of which a worker keeps the pieces. Beyond it the longer, rarer ones go; that costs time and changes nothing.
KEPT_UNITS = 1_000_000
SHORT = 8


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError("not a model file")


class Automaton:
    """Aho-Corasick over characters: goto, failure and output links as dictionaries and lists.

    `depth[s]` and `piece[s]` tell the piece that ends in state s (or -1), `out[s]` the next state down the failure links
    in which a piece ends (0: none)."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.piece, self.depth = [-1], [0]
        for text, number in pieces.items():
            state = 0
            for c in text:
                after = self.step[state].get(c)
                if after is None:
                    after = self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.piece.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = after
            self.piece[state] = number
        self.fail, self.out = [0] * len(self.step), [0] * len(self.step)
        queue = list(self.step[0].values())
        for state in queue:
            for c, after in self.step[state].items():
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[after] = self.step[back].get(c, 0)
                queue.append(after)
            link = self.fail[state]
            self.out[state] = link if self.piece[link] >= 0 else self.out[link]
        self.moves = [dict(x) for x in self.step]
        self.ends: dict[int, list[tuple[int, int]]] = {}

    def move(self, state: int, c: str) -> int:
        """The state after a character, by failure links; it is kept for the next time."""
        back = state
        while back and c not in self.step[back]:
            back = self.fail[back]
        after = self.step[back].get(c, 0)
        if len(self.moves[state]) < 512:
            self.moves[state][c] = after
        return after

    def matches(self, state: int) -> list[tuple[int, int]]:
        """Length and number of the pieces that end in a state, longest first, along the output links; kept likewise."""
        found, s = [], state if self.piece[state] >= 0 else self.out[state]
        while s:
            found.append((self.depth[s], self.piece[s]))
            s = self.out[s]
        self.ends[state] = found
        return found


class Model:
    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.remove_extra, self.escape, self.byte_fallback = True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix, self.remove_extra, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.remove_extra or not self.escape:
            raise ValueError("models that drop or keep blanks otherwise than one by one are not supported")
        normal = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.score = [s for _, s, _ in self.pieces]
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.unknown_score = min(s for _, s, kind in self.pieces if kind == NORMAL) - UNKNOWN_PENALTY
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.automaton = Automaton(normal)
        self.crossing = any(SPACE in text.lstrip(SPACE) for text in normal)
        # characters in no piece but alone: no piece spans the borders beside them
        inside = {c for text in normal if len(text) > 1 for c in text}
        self.line_alone = "\n" not in inside
        plain = {i: text.replace(SPACE, " ").encode() for text, i in normal.items()}
        self.plain = [plain.get(i, b"") for i in range(len(self.pieces))]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        self.kept: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """The pieces of greatest total score. The automaton reads each character once; at each position the output links give
        the pieces that end there, longest first, and relax the best score. Of equal scores the longest last piece stays."""
        moves, move, ends, matches = self.automaton.moves, self.automaton.move, self.automaton.ends, self.automaton.matches
        score, unknown, n = self.score, self.unknown, len(text)
        best, sizes, numbers = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        state = 0
        for i, c in enumerate(text, 1):
            after = moves[state].get(c)
            state = move(state, c) if after is None else after
            found = ends.get(state)
            if found is None:
                found = matches(state)
            top = None
            for size, number in found:
                total = best[i - size] + score[number]
                if top is None or total > top:
                    top, choice, width = total, number, size
            if not found or size != 1:  # no piece is this character alone
                total = best[i - 1] + self.unknown_score
                if top is None or total > top:
                    top, choice, width = total, unknown, 1
            best[i], sizes[i], numbers[i] = top, width, choice
        ids, i = [], n
        while i:
            number, size = numbers[i], sizes[i]
            if number == unknown and self.byte_fallback:
                ids += [self.bytes[b] for b in reversed(text[i - size : i].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(number)
            i -= size
        return ids[::-1]

    def segments(self, text: str) -> bytes:
        """Ids of a text in which blanks are written out, cut where no piece can span the border."""
        return b"".join([np.array(self.viterbi(x), "<u4").tobytes() for x in (_SEGMENT if self.line_alone else _BLANKS).findall(text)])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words; null counts as empty.

        No piece spans the border before a blank that follows another character, or beside a line end. So a text with single
        blanks alone is split at them, and equal units are solved once; any other text is solved segment by segment."""
        units: list[str] = []
        whole: dict[int, bytes] = {}
        ends = []
        for k, text in enumerate(texts):
            if not text:
                pass
            elif self.crossing or not (self.dummy_prefix and self.line_alone):
                whole[k] = np.array(self.viterbi((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)), "<u4").tobytes()
            elif "  " in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or SPACE in text:
                whole[k] = self.segments(SPACE + text.replace(" ", SPACE))
            else:
                units += text.replace("\n", " \n").split(" ")
            ends.append(len(units))
        found = list(map(self.kept.get, units))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            if len(self.kept) + len(missing) > KEPT_UNITS:
                self.kept = {u: x for u, x in self.kept.items() if len(u) <= SHORT}
                if len(self.kept) > KEPT_UNITS // 2:
                    self.kept = {}
            for i in missing:
                unit = units[i]
                if (ids := self.kept.get(unit)) is None:
                    ids = self.kept[unit] = self.segments(unit if unit[0] == "\n" else SPACE + unit)
                found[i] = ids
        return [whole[k] if k in whole else b"".join(found[a:b]) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids: byte pieces are put together, blanks restored, the added first blank dropped."""
        plain = self.plain
        text = b"".join([plain[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_BLANKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """One per worker process and file."""
    with open(path, "rb") as f:
        return Model(f.read())


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) of the whole texts. Null or empty text gives no ids; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in model.encode_all(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id and ids (null: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [model.decode(np.asarray(x.values.to_numpy(), "<u4").tobytes() if x.is_valid else b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids), text_sha256 of the decoded text, round_trip: whether
    it is the original text (null counts as empty). Encoding and decoding run over each whole text, one after the other."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in (batch.slice(low, 256) for low in range(0, batch.num_rows, 256)):
                rows, texts = [], part.column(1).to_pylist()
                for text, ids in zip(texts, model.encode_all(texts), strict=True):
                    back = model.decode(ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, list(zip(*rows, strict=True)) or [[]] * 4, kinds)], names=["doc_id", "n_pieces", "ids_crc32", "text_sha256", "round_trip"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, round_trip boolean")
