"""Token ids of whole texts by the tokenizers library, every repeated piece encoded once.

A text is cut where no token can cross: for a tokenizer that drops white space, at
ASCII white space; for a byte-level one, before each single space and around other
white space, where its own pattern starts a new piece as well, and before a full stop or comma behind a Latin letter or
digit, so that a word is kept once, whether or not one follows it. A piece not seen before is cut again
where letters meet other signs, which both kinds of tokenizer do too, and a run of letters goes straight
to the tokenizer's merges. Pieces and runs repeat, so their ids are kept in bounded tables. Texts
with white space outside ASCII, texts that hold an added token of the tokenizer or the sign that stands for a cut, and pieces with an apostrophe, a dotted capital I (two signs
in lower case) or signs beyond the Latin letters, where the notions could differ, go through the library's whole pipeline as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that each half of a table keeps; about 200 bytes each.
KEPT = 200_000
#: So many times as many for a byte-level tokenizer: a dict takes the same room from 174 763 to 349 525 entries.
KEPT_BYTES = 1.7
#: Marks before which the byte-level pattern starts a piece where a Latin letter or a digit stands before them.
_MARKS = ".,"
_LETTER = "[0-9A-Za-zªµºÀ-ÖØ-öø-ɏ]"
_MARKED = re.compile(f"(?<={_LETTER})[{_MARKS}]")
#: A space and this sign stand for a cut without a space.
_CUT = "\x01"
_WRONG_CUT = re.compile(f" {_CUT}(?<!{_LETTER} {_CUT})")
_SPACED = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: White space besides space, tab and line ends: what the two notions of it differ in.
_ODD_SPACES = [chr(x) for x in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Where white space meets white space, it is one token but for its last sign.
_MANY_SPACES = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_RUNS = regex.compile(r" ?\p{L}+| ?[^\s\p{L}]+")
#: Below this sign a text is its own composed form, and all libraries agree on what a letter is.
_BEYOND_LATIN = "ɐ"


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    return signs | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in signs)}


def _holds[T: (str, bytes)](text: T, signs: Iterable[T]) -> bool:
    return any(map(text.__contains__, signs))


def _is_run(text: str) -> bool:
    """Whether text is one run of letters on which all libraries agree."""
    return text.isalpha() and (text.isascii() or max(text) < _BEYOND_LATIN)


class _Table(dict):
    """A dict that makes what it lacks. When it is full its entries become the older half, from which those asked for come back."""

    def __init__(self, make: object, times: float = 1):
        self.make, self.times, self.older = make, times, {}

    def __missing__(self, key: object) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)  # type: ignore[operator]
        if len(self) >= KEPT * self.times:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What the library takes out of a text before all else, such as <|endoftext|>.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowered_added = [t.encode().lower() for t in self.added]
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.signs = str.maketrans({chr(b): s for b, s in _byte_signs().items()})
        self.space = _byte_signs()[32]
        #: Ids by piece; without its space where that always stands before it, and as bytes where space is dropped.
        self.bare = _Table(self._bare, KEPT_BYTES)
        self.words = _Table(self._lowered) if drops_space else _Table(self._spaced, KEPT_BYTES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, signs: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _lowered(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters
            return self._merged(word.decode())
        parts = self._parts(text := word.decode())
        if len(parts) < 2:
            return self._run(text) if parts else self._whole(text)
        return b"".join([self.words[p.encode()] for p in parts])

    def _spaced(self, word: str) -> bytes:
        """What follows a single space up to the next one, the space included; or what follows a cut, up to the next."""
        if word.isascii() and word.isalpha():
            return self._merged(self.space + word)
        if word[:1] == _CUT:
            return self.bare[word[1:]]
        if _is_run(word):
            return self._merged(self.space + self._written(word))
        return self._bare(" " + word)

    def _bare(self, text: str) -> bytes:
        if _is_run(text):
            return self._merged(self._written(text))
        parts = self._parts(text)
        if len(parts) < 2:
            return self._run(text) if parts else self._whole(text)
        return b"".join([self.words[p[1:]] if p[0] == " " else self.bare[p] for p in parts])

    @staticmethod
    def _parts(piece: str) -> list[str]:
        """Runs of letters and of other signs; none where the piece must stay whole."""
        if "'" in piece or "İ" in piece or max(piece) >= _BEYOND_LATIN or piece[-1].isspace():
            return []
        return _RUNS.findall(piece)

    def _run(self, run: str) -> bytes:
        low = run.lower() if self.drops_space else run
        if not low[low[0] == " " :].isalpha():
            return self._whole(run)
        return self._merged(self._written(low))

    def _written(self, text: str) -> str:
        """text as the byte-level step writes it."""
        return text.encode().decode("latin-1").translate(self.signs)

    @staticmethod
    def _cut(text: str) -> str:
        """text with the sign of a cut, as a word of its own, before each mark behind a letter or digit."""
        cut = text
        for mark in _MARKS:
            cut = cut.replace(mark, f" {_CUT}{mark}")
        # most texts have no other marks; a search by pattern at every place is ten times as slow
        return _MARKED.sub(rf" {_CUT}\g<0>", text) if _WRONG_CUT.search(cut) else cut

    def ids(self, text: str) -> bytes:
        if _holds(text, _ODD_SPACES[:4] if text.isascii() else _ODD_SPACES):
            return self._whole(text)
        if self.drops_space:
            low = text.encode().lower()
            # in other case it is no added token, but a piece of it in lower case would be one
            if _holds(low, self.lowered_added):
                return self._whole(text)
            return b"".join(map(self.words.__getitem__, low.split()))
        if _CUT in text or _holds(text, self.added):
            return self._whole(text)
        if _holds(text, _MANY_SPACES):
            return b"".join(map(self.bare.__getitem__, _SPACED.findall(text)))
        lines = []
        for line in self._cut(text).split("\n"):
            first, *rest = line.split(" ")
            lines.append((self.bare[first] if first else b"") + b"".join(map(self.words.__getitem__, rest)))
        return self.bare["\n"].join(lines)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


_ENCODERS: dict = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The encoder of this worker; it outlives the task."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
