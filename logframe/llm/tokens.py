"""Token ids of whole texts, with a bounded memory of the words met before.

Texts of a corpus repeat their words. The bytes of many texts are cut at once where no token can cross,
each distinct piece is encoded by the tokenizers library once, and a text's ids are those of its pieces
in turn.
"""

from __future__ import annotations

import os
import string
from array import array
from codecs import charmap_decode
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered, and their characters and ids together.
MEMORY, MEMORY_SIZE = 700_000, 16_000_000
#: Bytes of text that are cut and looked up at a time, or a single longer text.
GROUP = 8 << 20
#: How byte-level tokenizers write the bytes that have no visible character: those from 256 on, in turn.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LETTERS = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))

_LETTER, _DIGIT, _SIGN, _BREAK, _SPACE = range(1, 6)
#: What a byte is; 0: control characters and parts of characters beyond ASCII.
_KIND = np.zeros(256, np.uint8)
for _signs, _kind in ((string.ascii_letters, _LETTER), (string.digits, _DIGIT), (string.punctuation, _SIGN), ("\n", _BREAK), (" ", _SPACE)):
    _KIND[list(_signs.encode())] = _kind
#: By the kinds of two bytes (eight times the first and the second): a word ends between them whatever follows.
_ENDS = np.zeros(64, bool)
for _a in (_LETTER, _DIGIT, _SIGN):
    for _b in range(_LETTER, _SPACE + 1):
        _ENDS[8 * _a + _b] = _b >= _BREAK or _a != _SIGN and _a != _b
#: Whether a byte begins a visible character: 1 yes, 2 by the bytes after it.
_VISIBLE = np.zeros(256, np.uint8)
_VISIBLE[0x21:0x7F] = 1
_VISIBLE[0xC2:0xF5] = 1
_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
#: White space beyond ASCII, as the first three bytes of what follows (two for U+0085 and U+00A0).
_BLANKS = np.array([0xC28500, 0xC2A000, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[list(b"\t\n\r")] = ord(" ")

_id_of = attrgetter("id")
_loaded: dict[str, "WordCache"] = {}


def _narrow(text: str) -> bool:
    return text.isascii() or ord(max(text)) < 256


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; the last one of a letter from U+00C0 to U+00FF is a letter."""
    kind = _KIND[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = _LETTER
    return kind


def _before_visible(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte after each of these places begins a character that is no white space."""
    sort = _VISIBLE[data[at + 1]]
    look = np.flatnonzero(sort == 2)
    a, b, c = (data[at[look] + k].astype(np.int64) for k in (1, 2, 3))
    sort[look] = ~np.isin(a << 16 | b << 8 | np.where(a == 0xC2, 0, c), _BLANKS)
    return sort == 1


class WordCache:
    """Encodes texts to arrays of 32-bit ids.

    ``leading_space``: whether a word keeps the space before it, as byte-level tokenizers want it.
    Those cut a text before a space that is followed by another character than white space. The other
    kind drops white space, so every space is a cut, and case doesn't matter to it. Both cut after
    letters before anything else, after a number, and before white space.
    ``added``: whether the strings of added tokens are those tokens, as in the library when it is loaded;
    a text that holds one is encoded whole then. Without it they are ordinary text.

    The memory is bounded: when it is full, pieces met in a single group of texts are forgotten, or all
    of them if too many would remain.
    """

    def __init__(self, path: str, leading_space: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenizer.encode_special_tokens = True  # a part in lower case may hold a string that its text doesn't
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.leading_space = leading_space
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}  # of each piece, in the order met
        self.start = np.zeros(1, np.int64)  # of each piece's ids among all, and the end of the last
        self.known = np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int32)  # groups that hold the piece
        self.size = 0

    def _cuts(self, data: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """Places in ``n`` bytes where pieces begin, and ``n``; ``data`` has a few zeros behind them."""
        kind = _kinds(data)
        cut = np.zeros(n + 1, bool)
        cut[starts] = cut[n] = True
        spaces = np.flatnonzero(kind[:n] == _SPACE)
        if self.leading_space:
            spaces = spaces[~cut[spaces + 1] & _before_visible(data, spaces)]
            breaks = np.flatnonzero(kind[:n] == _BREAK)
            breaks = breaks[breaks > 0]
            before = kind[breaks - 1]
            breaks = breaks[(before >= _LETTER) & (before <= _SIGN) & _before_visible(data, breaks)]
            cut[breaks + 1] = True
        cut[spaces] = True
        cut[1:n] |= _ENDS[(kind[: n - 1] << 3) | kind[1:n]]
        return np.flatnonzero(cut)

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Encode new pieces; their numbers."""
        ids, counts, plain, others = array("I"), [], [], []
        for k, piece in enumerate(pieces):
            word = piece[1:] if piece[0] == " " else piece
            if not (word.isalpha() and _narrow(word)):
                others.append(k)
                continue
            plain.append(k)  # a single word to the library's model
            word = piece if self.leading_space else word.lower()
            found = self.model.tokenize(charmap_decode(word.encode(), "strict", BYTE_LETTERS)[0])
            counts.append(len(found))
            ids.extend(map(_id_of, found))
        for a in range(0, len(others), 1000):
            for e in self.tokenizer.encode_batch([pieces[k] for k in others[a : a + 1000]], add_special_tokens=False):
                counts.append(len(e.ids))
                ids.extend(e.ids)
        self.size += sum(map(len, pieces)) + len(ids)
        order = plain + others
        first = len(self.number)
        self.number.update(zip((pieces[k] for k in order), range(first, first + len(order))))
        self.known = np.concatenate([self.known, np.frombuffer(ids, np.uint32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts, dtype=np.int64)])
        self.met = np.concatenate([self.met, np.zeros(len(order), np.int32)])
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(first, first + len(order))
        return numbers

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        words = np.array(list(self.number), object)[kept]
        known, counts = self._gather(kept)
        self._clear()
        size = sum(map(len, words)) + len(known)
        if 2 * len(words) > MEMORY or 2 * size > MEMORY_SIZE:
            return
        self.number = dict(zip(words, range(len(words))))
        self.known, self.start = known, np.concatenate([[0], np.cumsum(counts)])
        self.met = np.ones(len(words), np.int32)
        self.size = size

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in turn, and their counts."""
        start = self.start[numbers]
        counts = self.start[numbers + 1] - start
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.known)) < 1 << 31 else np.int64
        at = np.repeat((start - ends + counts).astype(kind), counts)
        at += np.arange(total, dtype=kind)
        return self.known[at], counts

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between these offsets in ``data``, in turn, and each text's count."""
        if len(self.number) >= MEMORY or self.size >= MEMORY_SIZE:
            self._forget()
        n = int(offsets[-1])
        data = np.concatenate([data[:n], np.zeros(4, np.uint8)])
        if not self.leading_space:
            # a letter under an accent of its own stays: the library composes them before it lowers case
            data[:n] = np.where(data[1 : n + 1] < 0xC4, _LOWER[data[:n]], data[:n])
        cuts = self._cuts(data, n, offsets[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._add(words[new].tolist())
        self.met[numbers] += 1
        ids, counts = self._gather(numbers[pieces.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.searchsorted(cuts, offsets)])

    def _as_loaded(self, text: str) -> np.ndarray:
        """The ids of a whole text by the library as loaded, which finds added tokens first."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the count of each text. A null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        ordinary = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        out, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        if len(texts):
            offsets = np.frombuffer(ordinary.buffers()[1], np.int64)[ordinary.offset : ordinary.offset + len(ordinary) + 1]
            data = np.frombuffer(ordinary.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP, side="right")) - 1)
                b = min(b, len(texts))
                if offsets[b] > offsets[a]:
                    ids, counts[a:b] = self._group(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out.append(ids)
                a = b
        ids = np.concatenate(out)
        if not whole.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(whole):
            parts[k] = self._as_loaded(texts[int(k)].as_py())
            counts[k] = len(parts[k])
        return np.concatenate(parts), counts

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts = self.encode(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def word_cache(path: str, leading_space: bool) -> WordCache:
    """The encoder of this Python worker for a tokenizer file; it serves all tasks of the worker."""
    key = f"{path}|{leading_space}"
    if key not in _loaded:
        _loaded[key] = WordCache(path, leading_space, added=True)
    return _loaded[key]
