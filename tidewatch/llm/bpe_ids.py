"""Token ids of whole texts from a byte-level BPE file, with the ids of recurring words kept per worker."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Words of which a worker keeps the ids. Beyond it the longer, rarer ones go; that costs time and changes nothing.
KEPT_WORDS = 1_000_000
SHORT = 8
_UNIT = re.compile(r"\s*\S+|\s+$")
#: Marks a unit that has no blank before it; such units are the first of a text, or those of a text cut by pattern.
BARE = "\0"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextIds:
    """Little-endian 32-bit ids of texts.

    The pre-tokeniser cuts between a run of other characters than blanks and the blanks after it, so the ids of a text are
    those of its units (a run with the blanks before it) in order. In most texts single blanks and line ends alone stand
    between runs; they are cut by plain splitting, any other by a pattern. A unit is kept under its run, for a blank before
    it, under the line end and the run, or under BARE and the whole unit. A text that holds an added token of the file, which the
    tokenizer finds before it cuts anything, is given to it whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.line_end = self._encode(["\n"])[0]
        self.mark = {c: self._encode([c])[0] for c in ".,"}

    def _encode(self, units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_word(self, word: str, before: str) -> bytes:
        """Ids of a word of letters alone, which the pre-tokeniser leaves whole: the tokenizer's model reads it directly."""
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(before + plain)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        units: list[str] = []
        ends = []
        whole: dict[int, bytes] = {}
        for number, text in enumerate(texts):
            if not text:
                pass
            elif any(t in text for t in self.added):
                whole[number] = self._encode([text])[0]
            elif "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", " ").isprintable():
                units += [BARE + u for u in _UNIT.findall(text)]
            else:
                units.append(BARE)
                units += text.replace("\n", " \n").split(" ")
                first = len(units) - 1 - text.count(" ") - text.count("\n")
                units[first] = BARE + units[first]
                del units[first - 1]
            ends.append(len(units))
        found = list(map(self.kept.get, units))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            new = self._learn({units[i] for i in missing})
            for i in missing:
                found[i] = new[units[i]]
        return [whole[k] if k in whole else b"".join(found[a:b]) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        if len(self.kept) + len(units) > KEPT_WORDS:
            self.kept = {u: x for u, x in self.kept.items() if len(u) <= SHORT}
            if len(self.kept) > KEPT_WORDS // 2:
                self.kept = {}
        kept, out, ask, marked = self.kept, {}, [], []
        for unit in units:
            # a letter and a final stop or comma are never in one piece
            if unit[-1:] in self.mark and unit[-2:-1].isalpha() and unit[0] != BARE:
                marked.append(unit)
                if unit[:-1] not in kept and unit[:-1] not in units:
                    ask.append(unit[:-1])
            else:
                ask.append(unit)
        ask = list(dict.fromkeys(ask))
        other = []
        for unit in ask:
            if unit.isalpha():
                out[unit] = self._encode_word(unit, self.letters[32])
            elif unit[0] == "\n" and unit[1:].isalpha():
                out[unit] = self.line_end + self._encode_word(unit[1:], "")
            else:
                other.append(unit)
        for low in range(0, len(other), 8192):
            part = other[low : low + 8192]
            out.update(zip(part, self._encode([u[1:] if u[0] == BARE else u if u[0] == "\n" else " " + u for u in part]), strict=True))
        for unit in marked:
            base = unit[:-1]
            out[unit] = (out.get(base) or kept[base]) + self.mark[unit[-1]]
        kept.update(out)
        return out


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One per worker process and file."""
    return TextIds(path)
