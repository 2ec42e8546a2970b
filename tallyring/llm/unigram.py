"""A unigram vocabulary: pieces of a sentencepiece model with their scores.

``Counter`` counts the pieces of the best segmentation exactly as the tokenizers library's
Unigram model does. ``Lattice`` sums over all segmentations, for many words at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from tallyring.llm.text import GOLDEN, RADIX, U64, mix
from tallyring.llm.tokens import vocabulary

START = "▁"
UNKNOWN = "<unk>"
#: Bytes of kept counts; of an entry besides its characters; of an entry that is kept.
KEEP, ENTRY, LONG = 48 << 20, 160, 1024
PENALTY = 10.0  # fixed value: what an unknown character costs below the lowest score


def pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces with their scores, in order of ids; no control, byte or unused ones."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in plain]


#: White space as Unicode's property of that name has it.
SPACE = re.compile("[\t-\r \u0085   -     　]+")
_ODD = re.compile("[\x1c-\x1f▁]")
_MORE = re.compile(f"(?={START})")


class Counter:
    """Pieces of the best segmentation of a word that stands after START.

    Aho-Corasick gives the vocabulary matches by their ends, longest first. The best score of
    an end is that of the first match, by start, that none exceeds; a place without a match of
    one character may be crossed as unknown, and unknown characters in a row are one piece."""

    def __init__(self, named: list[tuple[str, float]], most: int = KEEP) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.unknown = min([0.0, *[s for _, s in named]]) - PENALTY
        self.automaton.add_word(UNKNOWN, (len(UNKNOWN), 0.0, True))
        for piece, score in named:
            self.automaton.add_word(piece, (len(piece), score, False))
        self.automaton.make_automaton()
        self.kept: dict[str, int] = {}
        self.most, self.bytes = most, 0

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        n = len(text)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, reached, single = 0, False, False
        unknown = self.unknown
        for end, (length, own, is_odd) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # close the ends before
                at += 1
                if not reached or not single:
                    self._cross(at, reached and not single, score, count, odd, reached)
                reached = single = False
            if at != end:
                at = end - 1
            start = end - length
            candidate = own + score[start]
            if not reached or candidate > score[end]:
                score[end] = candidate
                odd[end] = is_odd
                count[end] = count[start] + (not (is_odd and odd[start]))
            reached = True
            single = single or length == 1
        while at < n:
            at += 1
            if not single:
                self._cross(at, reached, score, count, odd, reached)
            reached = single = False
        del unknown
        return score[n], count[n]

    def _cross(self, end: int, held: bool, score: list, count: list, odd: list, reached: bool) -> None:
        candidate = self.unknown + score[end - 1]
        if not reached or candidate > score[end]:
            score[end] = candidate
            count[end] = count[end - 1] + (not odd[end - 1])
            odd[end] = True

    def word(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            text = word if word.startswith(START) else START + word
            parts = _MORE.split(text) if text.find(START, 1) > 0 else [text]
            found = sum(self.best(p)[1] for p in parts if p)
            size = ENTRY + 4 * len(word)
            if size <= LONG:
                if self.bytes + size > self.most:
                    self.forget()
                self.bytes += size
                self.kept[word] = found
        return found

    def forget(self) -> None:
        self.kept.clear()
        self.bytes = 0

    def words(self, text: str) -> list[str]:
        return [w for w in SPACE.split(text) if w] if _ODD.search(text) else text.split()


def weights(scores: np.ndarray, temperature: float, end: float = 0.0) -> np.ndarray:
    """Natural logs of the pieces' probabilities: the vocabulary's scores over a temperature, made to
    sum to 1 - ``end`` together with an unknown character's, which comes last."""
    x = np.append(scores, scores.min() - PENALTY) / temperature
    return x - x.max() - np.log(np.exp(x - x.max()).sum()) + np.log1p(-end)


def updated(use: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Logs of the pieces' probabilities after some use, from a prior worth ``strength`` pieces."""
    with np.errstate(divide="ignore"):
        x = np.logaddexp(np.log(use), np.log(strength) + prior)
    return x - np.logaddexp.reduce(x)


class Lattice:
    """Marginal probabilities of words, START before them, under weights of pieces: sums over all
    segmentations by forward recursion. A character that no piece of one character covers has the
    last weight, and its bytes are equally likely."""

    #: Words up to this length are summed in plain numbers; those that come out too small, and
    #: longer ones, in logs.
    PLAIN, TINY, PLACES = 40, 1e-280, 22
    #: Top bits of a hash by which most substrings are told to be no pieces, in a table that caches hold.
    FILTER = 19
    #: Words with which a table of one length is left alone; fewer are joined by longer ones.
    FEW = 2000

    def __init__(self, names: list[str]) -> None:
        self.names, self.longest = names, max(map(len, names))
        self.hashes = np.array([self._one(p) for p in names], dtype=U64)
        # a place for each piece by the top of its hash; where one is taken, pieces go to a list
        place = (self.hashes >> U64(64 - self.PLACES)).astype(np.int64)
        self.table = np.zeros(1 << self.PLACES, dtype=np.int32)
        self.table[place[::-1]] = np.arange(len(names), 0, -1)
        beside = np.flatnonzero(self.table[place] != np.arange(1, len(names) + 1))
        self.crowded = np.zeros(1 << self.PLACES, dtype=bool)
        self.crowded[place[beside]] = True
        self.beside = beside[np.argsort(self.hashes[beside])]
        self.likely = np.zeros(1 << self.FILTER, dtype=bool)
        self.likely[(self.hashes >> U64(64 - self.FILTER)).view(np.int64)] = True

    @staticmethod
    def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each place, a row a place, and what takes off a start."""
        n, length = codes.shape
        up = np.full(length, RADIX, dtype=U64)
        up[:1] = 1
        up = np.multiply.accumulate(up)
        down = np.full(length + 1, pow(RADIX, -1, 1 << 64), dtype=U64)
        down[:1] = 1
        sums = np.zeros((length + 1, n), dtype=U64)
        np.cumsum((mix((codes.astype(U64) + U64(1)) * U64(GOLDEN)) * up).T, axis=0, out=sums[1:])
        return sums, np.multiply.accumulate(down)

    def _one(self, piece: str) -> int:
        sums, down = self._sums(np.array([[ord(c) for c in piece]], dtype=np.uint32))
        return int(((sums[-1] - sums[0]) * down[0])[0])

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', and of which."""
        own = np.flatnonzero(self.likely.take((h >> U64(64 - self.FILTER)).view(np.int64)))
        h = h.take(own)
        place = (h >> U64(64 - self.PLACES)).view(np.int64)
        piece = self.table.take(place) - 1
        good = (self.hashes.take(piece) == h) & (piece >= 0)
        if len(self.beside):
            other = np.flatnonzero(~good & self.crowded.take(place))
            if len(other):
                sorted_ = self.hashes[self.beside]
                i = np.minimum(np.searchsorted(sorted_, h[other]), len(sorted_) - 1)
                hit = sorted_[i] == h[other]
                piece[other[hit]] = self.beside[i[hit]]
                good[other[hit]] = True
        return own[good], piece[good]

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """All edges into an end, by ends: the end, the first place that one comes from, where each comes from (place times
        rows, plus its row; none twice), rows, and pieces; an unknown character of so many bytes is the piece of that number after all others."""
        n, length = codes.shape
        sums, down = self._sums(codes)
        for end in range(1, length + 1):
            lo = max(0, end - self.longest)
            own, piece = self._find(((sums[end] - sums[lo:end]) * down[lo:end, None]).ravel())
            single = own[np.searchsorted(own, (end - 1 - lo) * n) :] - (end - 1 - lo) * n
            rows = own % n
            if len(single) < n:
                none = np.ones(n, dtype=bool)
                none[single] = False
                none = np.flatnonzero(none)
                code = codes[none, end - 1]
                own, rows = np.concatenate([own, none + (end - 1 - lo) * n]), np.concatenate([rows, none])
                piece = np.concatenate([piece, len(self.names) + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)])
            yield end, lo, own + lo * n, rows, piece

    def score(self, words: list[str], log_p: list[np.ndarray]) -> np.ndarray:
        """Log probability of every word under each of several weights, a row each."""
        length = np.array(list(map(len, words)), dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.score_codes(codes, np.cumsum(length) - length, length, log_p)

    def score_codes(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, log_p: list[np.ndarray]) -> np.ndarray:
        """The same of words that stand in an array of code points."""
        out = np.zeros((len(log_p), len(start)))
        spread = np.array([self._spread(p) for p in log_p])
        for part, table, last in self._tables(codes, start, length, 400_000 // len(log_p)):
            if table.shape[1] <= self.PLAIN:
                out[:, part] = self._plain(table, last, spread)
                small = np.flatnonzero((out[:, part] == -np.inf).any(axis=0))
                if len(small):
                    out[:, part[small]] = self._logs(table[small], last[small], spread)
            else:
                out[:, part] = self._logs(table, last, spread)
        return out

    @staticmethod
    def _spread(log_p: np.ndarray) -> np.ndarray:
        """Weights with the unknown character's replaced by those of one of 1, 2, 3 and 4 bytes."""
        return np.concatenate([log_p[:-1], log_p[-1] - np.arange(1, 5) * np.log(256)])

    def _tables(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of one length together, and of some lengths where they are few, about ``most`` places at a time: which,
        their code points, a row each, filled up with zeros, and how many are theirs."""
        order = np.argsort(length, kind="stable")
        sorted_, lo = length[order], 0
        while lo < len(order):
            hi = int(np.searchsorted(sorted_, sorted_[lo], side="right"))
            if hi - lo < self.FEW:  # to twice the length, but not from plain sums to those in logs
                longest = 2 * sorted_[lo] + 2
                longest = min(longest, self.PLAIN - 1) if sorted_[lo] < self.PLAIN else longest
                hi = max(hi, min(lo + self.FEW, int(np.searchsorted(sorted_, longest, side="right"))))
            while lo < hi:
                to = min(hi, lo + max(1, most // (int(sorted_[hi - 1]) + 2)))
                part, n = order[lo:to], int(sorted_[to - 1])
                table = np.empty((len(part), n + 1), dtype=np.uint32)
                table[:, 0] = ord(START)
                at = np.arange(n)
                if sorted_[lo] == n:
                    table[:, 1:] = codes[start[part][:, None] + at]
                else:
                    inside = at < length[part][:, None]
                    table[:, 1:] = np.where(inside, codes[np.where(inside, start[part][:, None] + at, 0)], 0)
                yield part, table, sorted_[lo:to] + 1
                lo = to

    def uses(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, update, log_p: np.ndarray, rounds: int) -> np.ndarray:
        """Expected use of every piece (unknown characters last) in some words, after rounds of expectation
        maximisation from given weights; ``update`` gives weights from uses. Edges are found once."""
        groups = []
        for _, table, last in self._tables(codes, start, length, 400_000):
            edges = [(e, lo, *(x.astype(np.int32) for x in found)) for e, lo, *found in self._edges(table)]
            groups.append((table.shape, last, edges))
        use = np.zeros(len(log_p))
        for r in range(rounds):
            log_p = update(use) if r else log_p
            use = np.zeros(len(log_p))
            for shape, last, edges in groups:
                use += self._uses(shape, last, edges, log_p)
        return use

    def _uses(self, shape: tuple[int, int], last: np.ndarray, edges: list, log_p: np.ndarray) -> np.ndarray:
        """Expected uses under one set of weights: forward and backward sums meet at each edge. Sums are plain
        numbers; of longer words, and where some come out too small, logs."""
        n, length = shape
        spread, ends, ways = self._spread(log_p), last * n + np.arange(n), []
        plain, used = length <= self.PLAIN, []
        if plain:
            p = np.exp(spread)
            ahead, behind = np.zeros((length + 1) * n), np.zeros((length + 1) * n)
            ahead[:n] = 1
            for e, lo, source, _, piece in edges:
                w = p.take(piece)
                way = ahead.take(source) * w
                dense = np.zeros((e - lo) * n)
                dense[source - lo * n] = way
                dense.reshape(e - lo, n).sum(axis=0, out=ahead[e * n : (e + 1) * n])
                ways.append((w, way))
            plain = ahead[ends].min() > self.TINY
        if plain:
            behind[ends] = 1 / ahead[ends]
            for (e, _, source, rows, _), (w, way) in zip(edges[::-1], ways[::-1], strict=True):
                x = behind[e * n : (e + 1) * n].take(rows)
                used.append(way * x)
                behind[source] += w * x
        else:
            ahead, behind = np.full((length + 1) * n, -np.inf), np.full((length + 1) * n, -np.inf)
            ahead[:n] = 0
            for e, lo, source, _, piece in edges:
                ahead[e * n : (e + 1) * n] = self._log_sums(n, e, lo, source, ahead[source] + spread[piece])
            behind[ends] = -ahead[ends]
            for e, _, source, rows, piece in edges[::-1]:
                x = spread[piece] + behind[e * n : (e + 1) * n][rows]
                used.append(np.exp(ahead[source] + x))
                behind[source] = np.logaddexp(behind[source], x)
        use = np.bincount(np.concatenate([piece for *_, piece in edges[::-1]]), weights=np.concatenate(used), minlength=len(spread))
        return np.append(use[:-4], use[-4:].sum())

    @staticmethod
    def _log_sums(n: int, end: int, lo: int, source: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each row, the log of the sum of what its edges into an end bring."""
        dense = np.full((end - lo) * n, -np.inf)
        dense[source - lo * n] = x
        return np.logaddexp.reduce(dense.reshape(end - lo, n), axis=0)

    def _plain(self, codes: np.ndarray, last: np.ndarray, spread: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        p = np.exp(spread)
        total = np.zeros((len(p), (length + 1) * n))
        total[:, :n] = 1
        for end, _, source, rows, piece in self._edges(codes):
            for sums, own in zip(total, p, strict=True):
                sums[end * n : (end + 1) * n] = np.bincount(rows, weights=own.take(piece) * sums.take(source), minlength=n)
        found = total[:, last * n + np.arange(n)]
        with np.errstate(divide="ignore"):
            return np.where(found > self.TINY, np.log(found), -np.inf)

    def _logs(self, codes: np.ndarray, last: np.ndarray, spread: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        total = np.full((len(spread), (length + 1) * n), -np.inf)
        total[:, :n] = 0
        for end, lo, source, _, piece in self._edges(codes):
            for sums, own in zip(total, spread, strict=True):
                sums[end * n : (end + 1) * n] = self._log_sums(n, end, lo, source, own[piece] + sums[source])
        return total[:, last * n + np.arange(n)]
