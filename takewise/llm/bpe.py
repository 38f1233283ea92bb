"""Byte-pair merges replayed over a corpus: each merge is applied to all words at once, in order of rank."""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

from takewise.llm.text import Numbering, ragged

_NONE = np.iinfo(np.int32).max
#: The characters of Unicode's White_Space property.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BLANK = re.compile("[\t-\r ]+")


class Merges:
    """Which neighbours merge, by rank, and into what."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        order = np.lexsort((rank, left.astype(np.int64) << 32 | right))
        keys = (left.astype(np.int64) << 32 | right)[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys, self.ranks = np.append(keys[first], np.int64(2**62)), np.append(rank[order][first].astype(np.int32), _NONE)
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def one_word(self, symbols: list[int]) -> list[int]:
        """The lowest rank first, the leftmost of equal ones first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = self.rank(np.array(symbols[:-1]), np.array(symbols[1:]))
            at = int(np.argmin(ranks))
            if ranks[at] == _NONE:
                break
            symbols[at : at + 2] = [int(self.made[ranks[at]])]
        return symbols

    def replay(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols after all merges, and where each word starts among them.

        An index holds, for each rank that some neighbours have, the positions of these neighbours. The lowest rank is
        taken, applied at all its positions, and only the pairs to the left and right of each change are looked up anew.
        A word in which a change brings up a rank no higher than the present one depends on the order inside the word;
        it is done again by itself.
        """
        n, words = len(symbols), len(starts)
        if not n:
            return symbols.astype(np.int32), starts
        sym, first = symbols.astype(np.int64), np.zeros(n, bool)
        first[starts] = True
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[first] = -1
        after[np.append(first[1:], True)] = -1
        have = np.flatnonzero(after >= 0)
        rank_at = np.full(n, _NONE, np.int32)
        rank_at[have] = self.rank(sym[have], sym[have + 1])
        gone, odd = np.zeros(n, bool), []
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(where: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks != _NONE
            where, ranks = where[known], ranks[known]
            if not len(where):
                return
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(where, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        note(have, rank_at[have])
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            where = parts[0] if len(parts) == 1 else np.concatenate(parts)
            where = np.unique(where[rank_at[where] == rank])
            if not len(where):
                continue
            right = after[where]
            touching = right[:-1] == where[1:]
            if touching.any():  # of neighbours that overlap, every other one, from the left
                number = np.arange(len(where))
                head = np.append(True, ~touching)
                keep = (number - np.maximum.accumulate(np.where(head, number, 0))) % 2 == 0
                rank_at[where[~keep]] = _NONE
                where, right = where[keep], right[keep]
            sym[where] = self.made[rank]
            gone[right] = True
            rank_at[right] = _NONE
            follow = after[right]
            after[where] = follow
            has = follow >= 0
            before[follow[has]] = where[has]
            rank_at[where] = _NONE
            one = where[has]
            two = before[where]
            two = two[two >= 0]
            place = np.concatenate([one, two])
            if len(place):
                ranks = self.rank(sym[place], sym[after[place]])
                rank_at[place] = ranks
                if ranks.min() <= rank:
                    odd.append(place[ranks <= rank])
                note(place, ranks)
        left = np.flatnonzero(~gone)
        word = np.cumsum(first)[left] - 1
        out, at = sym[left].astype(np.int32), np.searchsorted(word, np.arange(words))
        if odd:
            ends = np.append(starts[1:], n)
            pieces = np.split(out, at[1:])
            for w in np.unique(np.cumsum(first)[np.concatenate(odd)] - 1):
                pieces[w] = np.array(self.one_word(symbols[starts[w] : ends[w]].tolist()), np.int32)
            out, at = np.concatenate(pieces), np.append(0, np.cumsum([len(x) for x in pieces])[:-1])
        return out, at

    def by_turns(self, symbols: np.ndarray, starts: np.ndarray, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same result as replay: in each turn every word merges its own leftmost pair of lowest rank.

        There are as many turns as merges in a word, so the few long words that are left at the end are replayed.
        """
        words = len(starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        sym, word = symbols.astype(np.int64), np.repeat(np.arange(words), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks_of(sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(sym) - 1)
            return np.where((after > at) & (word[at] == word[after]), self.rank(sym[at], sym[after]), _NONE)

        ranks = ranks_of(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(ranks, first)
            ready = least == _NONE
            size = np.diff(np.append(first, len(sym)))
            if ready.any():
                still = np.repeat(ready, size)
                done.append((sym[still], word[still]))
                sym, word, ranks = sym[~still], word[~still], ranks[~still]
                least, size = least[~ready], size[~ready]
                first = np.cumsum(size) - size
            if len(first) <= few:
                if len(first):
                    ids, at = self.replay(sym, first)
                    done.append((ids, np.repeat(word[first], np.diff(np.append(at, len(ids))))))
                break
            hit = np.flatnonzero(ranks == np.repeat(least, size))
            owner = word[hit]
            hit = hit[np.append(True, owner[1:] != owner[:-1])]
            sym[hit] = self.made[ranks[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = hit - np.arange(len(hit))  # where the merged symbols stand once the others are gone
            sym, word, ranks = sym[keep], word[keep], ranks[keep]
            ranks[place] = ranks_of(sym, word, place)
            before = place[(place > 0)] - 1
            ranks[before] = ranks_of(sym, word, before)
        ids, word = (np.concatenate(x) for x in zip(*done)) if done else (sym, word)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(word[order], np.arange(words))


class Encoder:
    """Texts to ids, piece by piece, with a table of the pieces met so far.

    cut gives a text's pieces, which are encoded independently of what stands around them; symbols turns the bytes of
    many pieces, and where each ends, into what merge starts from. Pieces that known has an id for need no merges, and
    those that begin with a line break are words for whole. The table is emptied once it holds more than most new pieces;
    what is met again is encoded again, with the same result.
    """

    def __init__(self, merge: Callable, cut: Callable, symbols: Callable, known: Callable | None = None, whole: Callable | None = None, most: int = 500_000):
        self.merge, self.cut, self.symbols, self.known, self.whole, self.most = merge, cut, symbols, known, whole, most
        self.begin([], np.empty(0), np.empty(0))

    def empty(self) -> None:
        pieces, self.flat, self.length = self.base
        self.numbers, self.start = Numbering(zip(pieces, range(len(pieces)))), np.cumsum(self.length) - self.length

    def ids(self, texts: list) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, one text after the other, and how many each text has."""
        if len(self.numbers) - len(self.base[0]) > self.most:
            self.empty()
        known, coded, many = len(self.numbers), [np.empty(0, np.int32)], []
        for text in texts:
            pieces = self.cut(text)
            many.append(len(pieces))
            coded.append(np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces)))
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        codes = np.concatenate(coded)
        length = self.length[codes]
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(many, dtype=np.int64))]
        return ragged(self.flat, self.start[codes], length), np.diff(ends).tolist()

    def missing(self, texts: list, met: set) -> set[str]:
        """The distinct pieces of the texts that need merges; met collects those found to need none."""
        fresh: set[str] = set()
        for text in texts:
            fresh.update(self.cut(text))
        fresh -= met
        need = {piece for piece in fresh if self.known(piece.encode()) < 0}
        met |= fresh - need
        return need

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces after one replay over all of them, and where each piece's begin."""
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return self.merge(self.symbols(np.frombuffer(b"".join(pieces), np.uint8), stops), np.append(0, stops[:-1]))

    def begin(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Empties the table but for pieces whose ids are given, which stay in it from now on."""
        self.base = pieces, ids.astype(np.uint32), lengths.astype(np.int64)
        self.empty()

    def _learn(self, fresh: list[str]) -> None:
        raw = [piece.encode() for piece in fresh]
        length, flat, start = np.zeros(len(raw), np.int64), [self.flat], np.zeros(len(raw), np.int64)
        done, end = np.zeros(len(raw), bool), len(self.flat)
        if self.known:
            number = np.fromiter(map(self.known, raw), np.int64, len(raw))
            done = number >= 0
            length[done], start[done] = 1, end + np.arange(int(done.sum()))
            flat.append(number[done].astype(np.uint32))
            end += len(flat[-1])
        if self.whole:
            for i in [i for i, piece in enumerate(fresh) if piece[0] == "\n"]:
                got = np.asarray(self.whole(fresh[i][1:]), np.uint32)
                done[i], length[i], start[i] = True, len(got), end
                flat.append(got)
                end += len(got)
        rest = np.flatnonzero(~done)
        if len(rest):
            raw = raw if len(rest) == len(raw) else [raw[i] for i in rest.tolist()]
            ids, at = self.merged(raw)
            length[rest], start[rest] = np.diff(np.append(at, len(ids))), end + at
            flat.append(ids.astype(np.uint32))
        self.flat = np.concatenate(flat)
        self.start, self.length = np.append(self.start, start), np.append(self.length, length)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _within_latin1(pattern: str) -> re.Pattern | None:
    """A pattern of letters, numbers and white space by Unicode property for texts of the first 256 characters alone.

    There the properties are short lists, and the plain module does without the tables of the larger one. None if the
    pattern names another property.
    """
    classes = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "Z", r"\S": "Z"}
    first = [chr(i) for i in range(256)]
    lists = {k: re.escape("".join(c for c in first if (re.match(f"[{_SPACE}]", c) if kind == "Z" else unicodedata.category(c)[0] == kind))) for k, kind in classes.items()}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, at)), None)
        if name is None:
            if pattern[at : at + 2] in (r"\p", r"\P"):
                return None
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
        elif inside and name == r"\S":
            return None
        else:
            out.append(lists[name] if inside else f"[{'^' if name == r'\S' else ''}{lists[name]}]")
            at += len(name)
    return re.compile("".join(out))


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> tuple[Encoder, np.ndarray, np.ndarray]:
    """The encoder for a file of byte ranks, and the bytes of all ids in a row with where each id's begin."""
    ranks = read_ranks(path)
    rows = [(ranks[token[:k]], ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    left, right, rank = np.array(rows, np.int64).T
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    simple = _within_latin1(pattern)
    beyond = re.compile("[^\0-\xff]")

    def cut(text: str) -> list[str]:
        return split.findall(text) if simple is None or beyond.search(text) else simple.findall(text)

    encoder = Encoder(Merges(left, right, rank, rank).replay, cut, lambda values, stops: single[values], known=lambda piece: ranks.get(piece, -1), most=150_000)
    back = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        back[number] = token
    return encoder, np.frombuffer(b"".join(back), np.uint8), np.append(0, np.cumsum([len(x) for x in back]))


def visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Encoder:
    """The encoder for a file of the tokenizers library with word ends, lower case and white space dropped.

    A word of visible ASCII and the letters of Latin-1 is cut by the file's pattern here; any other word, and any that
    might hold a special token, is encoded by the library itself.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, end = model["vocab"], model["end_of_word_suffix"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    left, right, made = (np.array(x, np.int64) for x in zip(*[(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]))
    shown = visible_bytes()
    inner = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
    last = np.array([vocabulary[shown[b] + end] for b in range(256)], np.int32)
    letters = "\xdf-\xf6\xf8-\xff"
    cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9]|[^\t-\r a-z0-9{letters}]+")
    control = re.compile("[\0-\x08\x0e-\x1f\x7f]")
    strange = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\\|")

    def pieces(text: bytes) -> list[str]:
        text = text.decode()
        if text.isascii() and "<|" not in text and not control.search(text) or not strange.search(text):
            return cut.findall(text.lower())
        out: list[str] = []
        for word in _BLANK.split(text):
            if strange.search(word):
                out.append("\n" + word)
            elif word:
                out += cut.findall(word.lower())
        return out

    def symbols(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
        out = inner[values]
        out[stops - 1] = last[values[stops - 1]]
        return out

    return Encoder(Merges(left, right, np.arange(len(merges)), made).by_turns, pieces, symbols, whole=lambda word: library.encode(word, add_special_tokens=False).ids)
