"""Encoding texts with a byte-level BPE tokenizer of the tokenizers library, part by part.

The tokenizer's split pattern never joins a space to what stands before it unless that is
white space too, and joins no other white space to a word. So a text falls apart before
every space that follows a non-space, around every line feed that stands alone between
non-spaces, and between Latin letters and ASCII marks, which are never in one piece of the
pattern; the parts encode independently. Many texts are cut at once in numpy, equal parts (by a
64-bit hash of their bytes and their length) are encoded once, and the ids are put together
again by index. What parts gave is kept in sorted arrays of at most ``KEEP`` bytes a worker
process; parts over ``LONG`` bytes are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyring.llm.text import GOLDEN, U64, _powers, mix

#: Bytes of kept ids and keys; bytes of a part that is kept; bytes of texts cut at once.
KEEP, LONG, SLICE = 24 << 20, 256, 512 << 10
_MARKS = np.isin(np.arange(256), list(b'.,;:!?%&*#$|()[]{}<>=+-_/\\@^~`"'))
_ASCII = np.isin(np.arange(256) | 0x20, np.arange(97, 123)) & (np.arange(256) < 0x80)
_RAW = mix(np.arange(1, 257, dtype=U64) * U64(GOLDEN))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space, control characters included."""
    white = data <= 0x20
    first = np.flatnonzero(data == 0xC2)
    first = first[first + 1 < len(data)]
    first = first[np.isin(data[first + 1], (0x85, 0xA0))]
    white[first] = white[first + 1] = True
    first = np.flatnonzero((data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(first := first[first + 2 < len(data)]):
        code = data[first].astype(np.int32) << 16 | data[first + 1].astype(np.int32) << 8 | data[first + 2]
        # fixed values: U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
        first = first[np.isin(code, (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))]
        for j in range(3):
            white[first + j] = True
    return white


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters up to U+00FF."""
    letter = _ASCII[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    return letter


def parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the parts of texts, one more than parts; the number of each text's first part,
    one more than texts; and which parts are one piece of the pattern: letters, after a space or
    not, or marks."""
    n = len(data)
    white, letter, mark = _white(data), _letters(data), _MARKS[data]
    opens = np.zeros(n + 1, dtype=bool)
    if n > 1:
        opens[1:n] = (data[1:] == 0x20) & ~white[:-1]
        opens[1:n] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        line = np.zeros(n, dtype=bool)
        line[1:-1] = (data[1:-1] == 0x0A) & ~white[:-2] & ~white[2:]
        opens[:n] |= line
        opens[1:] |= line
    opens[at] = True
    start = np.flatnonzero(opens)
    length = np.diff(start)
    of = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind)])[start])
    letters = of(letter)
    led = data[start[:-1]] == 0x20 if n else np.zeros(0, dtype=bool)
    return start, np.searchsorted(start, at), (letters > 0) & (letters + led == length) | (of(mark) == length)


class Encoder:
    """``encode(data, at)`` gives the ids of several texts in one array, and where each text's
    begin (one more than texts). Strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=U64)
        self.at = np.zeros(0, dtype=np.int32)
        self.many = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=self.dtype)

    def held(self) -> int:
        """Bytes that are kept."""
        return self.keys.nbytes + self.at.nbytes + self.many.nbytes + self.ids.nbytes

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, plain = parts(data, at)
        if len(start) < 2:
            return np.zeros(0, dtype=self.dtype), np.zeros(len(at), dtype=np.int64)
        length = np.diff(start)
        p, inverse = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_RAW[data] * p[:-1], out=sums[1:])
        hashes = mix((sums[start[1:]] - sums[start[:-1]]) * inverse[start[:-1]] + length.astype(U64) * U64(GOLDEN))
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        begin, many = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        begin[known], many[known] = self.at[place[known]], self.many[place[known]]
        new = np.flatnonzero(~known)
        found = self._new(data, start, one[new], plain)
        many[new] = list(map(len, found))
        ends = np.cumsum(many[new])
        begin[new] = len(self.ids) + ends - many[new]
        fresh = np.array([i for x in found for i in x], dtype=self.dtype)
        ids = np.concatenate([self.ids, fresh])
        count = many[which]
        to = np.cumsum(count)
        out = ids[np.arange(to[-1]) + np.repeat(begin[which] - (to - count), count)]
        self._remember(keys, begin, many, ids, new, length[one])
        return out, np.concatenate([[0], to])[first]

    def _new(self, data: np.ndarray, start: np.ndarray, which: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        """Ids of some parts: pieces go to the model itself, all else to the whole tokenizer."""
        raw, begin, end = data.tobytes(), start[which].tolist(), start[which + 1].tolist()
        words = [raw[a:b] for a, b in zip(begin, end, strict=True)]
        model, out, at = self.model.tokenize, [], 0
        stand_ins = b"".join(words).decode("latin-1").translate(self.letters)
        for word, is_plain in zip(words, plain[which].tolist(), strict=True):
            to = at + len(word)
            if is_plain:
                out.append([t.id for t in model(stand_ins[at:to])])
            else:
                out.append(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)
            at = to
        return out

    def _remember(self, keys: np.ndarray, begin: np.ndarray, many: np.ndarray, ids: np.ndarray, new: np.ndarray, length: np.ndarray) -> None:
        if self.held() + (len(ids) - len(self.ids)) * ids.itemsize + 16 * len(new) > self.keep:
            self.forget()  # what comes next fills it again
            return
        short = new[length[new] <= LONG]
        places = np.searchsorted(self.keys, keys[short])
        self.keys = np.insert(self.keys, places, keys[short])
        self.at = np.insert(self.at, places, begin[short].astype(np.int32))
        self.many = np.insert(self.many, places, many[short].astype(np.int32))
        self.ids = ids

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lo = size = 0
        for hi, x in enumerate([*raw, None]):
            if x is None or (size and size + len(x) > SLICE):
                at = np.cumsum([0, *map(len, raw[lo:hi])])
                ids, begin = self.encode(np.frombuffer(b"".join(raw[lo:hi]), dtype=np.uint8), at)
                yield from (ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True))
                lo, size = hi, 0
            size += len(x or b"")


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process; what it keeps is of bounded size."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file in this process; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
