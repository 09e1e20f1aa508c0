"""Exact token ids and counts by the public tokenizers, with a word cache in each worker.

Both tokenizers cut a text before they merge: the lower-case one at all white space, the byte-level one before a single space between
two visible characters. What stands between two cuts is encoded alone, so its ids are kept in a bounded dictionary and most of a text
is looked up. That holds for texts of Latin-1 characters without control characters and without the strings of special tokens; any
other text goes to the library whole. The library makes the ids of every piece that is not in the dictionary.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: Bytes that a dictionary takes, roughly, and characters of a text that it takes; what comes later or is longer is encoded each time.
CACHE_BYTES, CACHE_LENGTH = 64 << 20, 64
#: The same for words with their ids, most of which occur seldom.
ID_CACHE_BYTES = 192 << 20
#: Characters of texts whose new words are encoded together, roughly, and words that one call of the model gets.
TEXT_CHARS, WORDS_A_CALL = 1 << 20, 32

_PLAIN = re.compile("[^\x00-\x08\x0e-\x1f\x7f-\x9fĀ-\U0010ffff]*")
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\xa0]|  | \n|\n ")
_ODD_SPACES = ("\t", "\r", "\x0b", "\x0c", "\xa0", "  ", " \n", "\n ")
#: Marks that end a word and are a piece of their own there.
_MARKS = frozenset(",.;:!?")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in seen}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Bounded(dict):
    """A dictionary that stops taking entries at ``CACHE_BYTES``."""

    room = CACHE_BYTES

    def keep(self, text: str, out):
        """``out``, kept for ``text`` if there is room."""
        size = 160 + 2 * len(text) + (len(out) if isinstance(out, bytes) else 0)
        if len(text) <= CACHE_LENGTH and size <= self.room:
            self.room -= size
            self[text] = out
        return out


class _Pieces(_Bounded):
    """Text without inner cuts -> what ``value`` makes of its token ids; made when first asked for."""

    def __init__(self, model, pattern, value, total):
        self.tokenize, self.find, self.value, self.total = model.tokenize, regex.compile(pattern).findall, value, total

    def of_one(self, piece: str):
        return self.value([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))])

    def __missing__(self, text: str):
        pieces = self.find(text)
        return self.keep(text, self.of_one(text) if pieces == [text] else self.total(map(self.__getitem__, pieces)))


class _Spaced(_Bounded):
    """The same for text that follows a space."""

    def __init__(self, pieces: _Pieces):
        self.pieces = pieces

    def __missing__(self, text: str):
        pieces = self.pieces.find(" " + text)
        return self.keep(text, self.pieces.of_one(pieces[0]) if len(pieces) == 1 else self.pieces.total(map(self.pieces.__getitem__, pieces)))


def _is_plain(text: str, specials: tuple[str, ...]) -> bool:
    return _PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in specials))


class ByteLevelCounter:
    """Number of tokens of a byte-level BPE file."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.pieces = _Pieces(self.library.model, self.PATTERN, len, sum)
        self.spaced = _Spaced(self.pieces)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not _is_plain(text, self.specials):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        first, *rest = _LONE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return sum(map(self.spaced.__getitem__, rest), sum(map(self.pieces.__getitem__, self.pieces.find(first))))


class _Learned(dict):
    """Text -> its ids. A text that is not known has an empty place in ``new`` until ``fill``; what is filled is kept while there is room."""

    def __init__(self, room: int):
        self.room, self.new = room, {}

    def __missing__(self, text: str) -> bytearray:
        out = self.new.get(text)
        if out is None:
            out = self.new[text] = bytearray()
        return out

    def fill(self, text: str, ids: bytes) -> None:
        self.new[text][:] = ids
        size = 160 + 2 * len(text) + len(ids)
        if size <= self.room and len(text) <= CACHE_LENGTH:
            self.room -= size
            self[text] = ids


class ByteLevelEncoder(ByteLevelCounter):
    """Ids of the same file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.find, self.pieces, self.spaced = self.pieces.find, _Learned(CACHE_BYTES), _Learned(ID_CACHE_BYTES)
        vocab = self.library.get_vocab(with_added_tokens=False)
        names = np.full(max(vocab.values()) + 1, "", object)
        names[[*vocab.values()]] = [*vocab]
        white = "".join(_LETTERS[b] for b in b" \t\n\r\x0b\x0c")
        space, line, hard = _LETTERS[ord(" ")], _LETTERS[ord("\n")], "".join(_LETTERS[b] for b in "\xa0".encode())
        self.begins = {" ": np.array([t[:1] == space for t in names]), "\n": np.array([t == line for t in names])}
        #: No token that letters can be part of has a lead behind a letter, nor a line end before one, so merges of words on the two sides of a lead can't meet and each has a first
        #: token of its own. A hard space, whose two bytes no Latin-1 letter has, is in tokens of white space only.
        self.apart = not any(re.search(f"[^{white}][{space}{line}]|{line}[^{white}]", t) for t in vocab if hard not in t)

    def _model(self, text: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))]

    def _letters(self, known: _Learned, words: list[str], lead: str) -> None:
        """Fill in words of letters, which stand behind a space or behind none; a number of them are encoded as one text, each behind ``lead``."""
        ids, dropped = [], 0 if lead == " " else 4
        for i in range(0, len(words), WORDS_A_CALL):
            ids += self._model(lead + lead.join(words[i : i + WORDS_A_CALL]))
        ids = np.array(ids, "<u4")
        at, data = np.flatnonzero(self.begins[lead][ids]) * 4, ids.tobytes()
        for w, i, j in zip(words, (at + dropped).tolist(), [*at[1:].tolist(), len(data)], strict=True):
            known.fill(w, data[i:j])

    def _learn(self) -> None:
        """Fill in what is new, words of letters together."""
        spaced, pieces, mixed, letters = self.spaced, self.pieces, [], str.isalpha
        for t in [t for t in spaced.new if not letters(t)]:
            if letters(t[:-1]) and t[-1] in _MARKS:
                mixed.append((t, [spaced[t[:-1]], pieces[t[-1]]]))
            else:
                mixed.append((t, [spaced[p[1:]] if p[0] == " " and letters(p[1:]) else pieces[p] for p in self.find(" " + t)]))
        for known, lead, before in ((spaced, " ", " "), (pieces, "\n", "")):
            words = [t for t in known.new if letters(t)]
            if self.apart and words:
                self._letters(known, words, lead)
            for t in () if self.apart else words:
                known.fill(t, np.array(self._model(before + t), "<u4").tobytes())
        for p in pieces.new:
            if not letters(p):
                pieces.fill(p, np.array(self._model(p), "<u4").tobytes())
        for t, parts in mixed:
            spaced.fill(t, b"".join(parts))
        spaced.new, pieces.new = {}, {}

    def _parts(self, text: str) -> list:
        """The ids of a text by parts, some of which are still to be filled in."""
        if not text:
            return []
        if not _is_plain(text, self.specials):
            return [np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        first, *rest = _LONE_SPACE.split(text) if any(map(text.__contains__, _ODD_SPACES)) else text.split(" ")
        return [*map(self.pieces.__getitem__, self.find(first)), *map(self.spaced.__getitem__, rest)]

    def all_ids(self, texts: list[str]):
        """The ids of each text in turn; what is new in about ``TEXT_CHARS`` of them is encoded together."""
        i = 0
        while i < len(texts):
            held, size = [], 0
            while i < len(texts) and size < TEXT_CHARS:
                held.append(self._parts(texts[i]))
                size += len(texts[i])
                i += 1
            self._learn()
            yield from map(b"".join, held)

    def ids(self, text: str) -> bytes:
        return next(self.all_ids([text]))


class LowerWordEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, of the lower-casing BPE file with word ends."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.words = _Pieces(self.library.model, self.PATTERN, lambda ids: np.array(ids, "<u4").tobytes(), b"".join)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not _is_plain(text, self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


class LowerWordCounter(LowerWordEncoder):
    """Number of ids of the same file."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Pieces(self.library.model, self.PATTERN, len, sum)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not _is_plain(text, self.specials):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.words.__getitem__, text.lower().split()))


@functools.cache
def byte_level_counter(path: str) -> ByteLevelCounter:
    return ByteLevelCounter(path)


@functools.cache
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@functools.cache
def lower_word_encoder(path: str) -> LowerWordEncoder:
    return LowerWordEncoder(path)


@functools.cache
def lower_word_counter(path: str) -> LowerWordCounter:
    return LowerWordCounter(path)
