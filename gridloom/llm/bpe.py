"""BPE encoding and decoding of a text column with a public vocabulary file, by speculation and verification.

A piece of text is split into words, and each distinct word is encoded once. Greedy longest matches propose its tokens.
The proposal is the BPE result exactly if no merge could have crossed a boundary between two neighbours, which is
tested for all distinct neighbour pairs at once; only the words that fail go through the merges themselves.
These steps are numpy operations over the distinct words of the piece.

Texts are split by a table of the code points that need no normalisation but lower case, and whose class the tokenizers
library confirms when the table is made. A text with any other code point is normalised and split by the library's
own normaliser and expression, whose Unicode tables are of other versions than Python's.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import chunks, mapped, strings
from .words import halves, hashes, owners, runs, utf8_offsets

_NEVER = np.int64(1 << 40)
#: Characters of the words that a process keeps encoded, about: some 200,000 words.
REMEMBERED = 1_500_000
#: Words of more bytes than this go through the merges at once, by a heap.
LONG_WORD = 1000
#: White space of Unicode, by code point.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL, _STRANGE = range(6)
#: Conjoining Hangul letters, which normalisation may join.
_JAMO = [*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD800)]
#: Code points from here on are all strange.
_TABLE_END = 0x20000


def _confirmed(found: list[int], holds) -> list[int]:
    """The code points of ``found`` for which ``holds`` is true, given that it holds for a string if for all its parts."""
    if not found or holds("".join(map(chr, found))):
        return found
    if len(found) == 1:
        return []
    half = len(found) // 2
    return _confirmed(found[:half], holds) + _confirmed(found[half:], holds)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each group of keys that agree in their leading bits, group of each key).

    The keys' last bits give way to their index, as sorting values is cheaper than finding their order."""
    bits = np.uint64(len(keys).bit_length())
    whole = np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64))
    order, top = (whole & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), whole >> bits
    new = np.ones(len(keys), bool)
    new[1:] = top[1:] != top[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class _Rows(dict):
    """word -> row; a word that is new gets the next row and is noted in ``fresh``."""

    def __init__(self, words):
        super().__init__((w, i) for i, w in enumerate(words))
        self.fresh: list[str] = []
        self.n = len(self)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = row = self.n
        self.n += 1
        return row


class Lookup:
    """A read-only map of non-negative 64-bit keys to integers, for many keys at once; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        self.keys[slot], self.values[slot] = keys, values
        lost = self.keys[slot] != keys
        order = np.argsort(keys[lost])
        self.more, self.more_values = keys[lost][order], values[lost][order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        if len(self.more):
            at = np.flatnonzero((held != keys) & (held >= 0))
            place = np.minimum(np.searchsorted(self.more, keys[at]), len(self.more) - 1)
            out[at] = np.where(self.more[place] == keys[at], self.more_values[place], -1)
        return out


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... for length[i] steps, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(total)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Bpe:
    """The vocabulary and merges of a tokenizers file whose words end in a suffix, and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"]}
        names = dict(zip(vocab.values(), vocab.keys(), strict=True)) | {i: s for s, i in self.specials.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merge = Lookup(left << 20 | right, np.arange(len(pairs)))
        self.made = made
        self.ranks = dict(zip(zip(left.tolist(), right.tolist(), strict=True), range(len(pairs)), strict=True))
        self._spines(left, right, made, len(names))
        self._trie(vocab)
        self._splitter(whole)
        # Lone surrogates, which no text holds, stand for the special tokens.
        self.rows = _Rows([chr(0xD800 + k) for k in range(len(self.specials))])
        self.pool = np.array(list(self.specials.values()), np.int64)
        self.begin, self.count, self.held = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64), 0
        # Of the short words: hash (in order), first and second half, length, row; and those of the present piece.
        self.known = [np.array([x], k) for x, k in ((2**64 - 1, np.uint64), (0, np.uint64), (0, np.uint64), (-1, np.int64), (0, np.int64))]
        self.met: list[list[np.ndarray]] = []

    def _splitter(self, whole: dict) -> None:
        """The library's normaliser and splitting expression, and the table of the code points that do without."""
        small = {**whole, "added_tokens": [], "model": {**whole["model"], "vocab": {}, "merges": []}}
        small["pre_tokenizer"] = next(x for x in whole["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        library = Tokenizer.from_str(json.dumps(small))
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        kinds = {"L": _LETTER, "N": _NUMBER, "P": _OTHER, "S": _OTHER, "C": _OTHER}
        some = [c for c in range(_TABLE_END) if c not in _SPACES and unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
        jamo = set(_JAMO)
        some = [c for c in some if c < 0x80 or c not in jamo and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFC", chr(c)) == chr(c) and len(chr(c).lower()) == 1]
        lower = self.normalise("|".join(chr(c) for c in some if c != 0x7C)).split("|")
        alike = {c for c, low in zip((c for c in some if c != 0x7C), lower, strict=True) if low == chr(c).lower()} | {0x7C}
        by_kind: dict[int, list[int]] = {_LETTER: [], _NUMBER: [], _OTHER: []}
        for c in some:
            kind = kinds.get(unicodedata.category(chr(c).lower())[0])
            if c in alike and kind:
                by_kind[kind].append(c)
        by_kind[_OTHER].remove(0x27)  # may begin a word of its own
        self.kind = np.full(0x110000, _STRANGE, np.uint8)
        tests = {
            _LETTER: lambda s: len(self.split(f"a{s.lower()}a")) == 1, _OTHER: lambda s: len(self.split(f"!{s.lower()}!")) == 1,
            _NUMBER: lambda s: len(self.split("!".join(s.lower()))) == 2 * len(s) - 1 and len(self.split(s.lower())) == len(s),
        }
        for kind, test in tests.items():
            self.kind[_confirmed(by_kind[kind], test)] = kind
        self.kind[[c for c in _SPACES if self.split(f"a{self.normalise(chr(c))}a") == [("a", (0, 1)), ("a", (2, 3))]]] = _SPACE
        self.kind[0x27] = _OTHER
        self.kind[0xD800:0xE000] = _SPECIAL

    def _spines(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, n: int) -> None:
        """What stands at a token's right (left) edge as it is built up, and the rank of the merge that absorbs it."""
        self.edges = []
        for part in (right, left):
            child, rank = np.full(n, -1, np.int64), np.full(n, _NEVER, np.int64)
            child[made], rank[made] = part, np.arange(len(made))
            level, chain, death = np.arange(n), [np.arange(n)], [np.full(n, _NEVER, np.int64)]
            while (child[level] >= 0).any():
                death.append(np.where(child[level] >= 0, rank[level], -1))
                level = np.where(child[level] >= 0, child[level], level)
                chain.append(level)
            # From the edge upwards: a token of depth d has d + 1 entries.
            death, chain = np.array(death[::-1]).T, np.array(chain[::-1]).T
            depth = (death == -1).sum(axis=1)
            step = np.minimum(np.arange(death.shape[1])[None, :] + depth[:, None], death.shape[1] - 1)
            self.edges.append((np.take_along_axis(chain, step, 1), np.take_along_axis(death, step, 1)))

    def _trie(self, vocab: dict[str, int]) -> None:
        """Nodes by the base symbols of the tokens that the merges do build from those symbols."""
        base = {c: int(i) for c, i in zip(byte_letters(), self.inner, strict=True)}
        words, ids = [], []
        for name, token in vocab.items():
            stem = name.removesuffix(self.suffix)
            if stem and all(c in base for c in stem):
                word = [base[c] for c in stem]
                if stem != name:
                    word[-1] = vocab[stem[-1] + self.suffix]
                words.append(word)
                ids.append(token)
        length = np.array([len(w) for w in words])
        flat = np.concatenate([np.array(w) for w in words])
        tokens, count = self._exact(flat, length)
        whole = (count == 1) & (tokens[np.cumsum(count) - 1] == np.array(ids))
        nodes: dict[tuple[int, int], int] = {}
        token = {}
        for word, i, ok in zip(words, ids, whole.tolist(), strict=True):
            if ok:
                at = 0
                for symbol in word:
                    at = nodes.setdefault((at, symbol), len(nodes) + 1)
                token[at] = i
        self.next = Lookup(np.array([a << 20 | s for a, s in nodes], np.int64), np.array(list(nodes.values()), np.int64))
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        self.token[list(token)] = list(token.values())

    def _exact(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges themselves, in all words at once: in each round a word's best pair, at all its places."""
        n = len(length)
        word = np.repeat(np.arange(n), length)
        done_word, done_symbol = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NEVER, np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            found = self.merge(symbols[same] << 20 | symbols[same + 1])
            rank[same] = np.where(found >= 0, found, _NEVER)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.concatenate((first, [len(word)])))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = best == _NEVER
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbols[over])
                symbols, word, rank, best = symbols[~over], word[~over], rank[~over], best[~over]
                if not len(symbols):
                    break
            take = rank == best
            start, end = runs(take)  # in a run of places that overlap, every other one from the left
            at = spread(start, end - start)
            at = at[(at - np.repeat(start, end - start)) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        word, symbols = np.concatenate(done_word or [word]), np.concatenate(done_symbol or [symbols])
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def _longest(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches from the left, in all words at once: (tokens in order, number of each word)."""
        end = np.cumsum(length)
        at, word = end - length, np.arange(len(length))
        owners, tokens = [], []
        while len(word):
            best, step = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
            going, node, depth = np.arange(len(word)), np.zeros(len(word), np.int64), 0
            while len(going):
                node = self.next(node << 20 | symbols[at[going] + depth])
                going, node = going[node >= 0], node[node >= 0]
                depth += 1
                here = self.token[node]
                hit = here >= 0
                best[going[hit]], step[going[hit]] = here[hit], depth
                more = at[going] + depth < end[word[going]]
                going, node = going[more], node[more]
            owners.append(word)
            tokens.append(best)
            at = at + step
            rest = at < end[word]
            at, word = at[rest], word[rest]
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(length))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges keep each pair of tokens apart: no symbol at the right edge of the one merges with one at
        the left edge of the other while both stand there. Of equal merges the leftmost comes first."""
        (chain_l, death_l), (chain_r, death_r) = self.edges
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        good, rest = np.ones(len(left), bool), np.arange(len(left))
        while len(rest):
            a, b, i_, j_ = left[rest], right[rest], i[rest], j[rest]
            dies_a, dies_b = death_l[a, i_], death_r[b, j_]
            rank = self.merge(chain_l[a, i_] << 20 | chain_r[b, j_])
            crossed = (rank >= 0) & (rank < dies_a) & (rank <= dies_b)
            good[rest[crossed]] = False
            first = dies_a <= dies_b
            i[rest], j[rest] = i_ + first, j_ + ~first
            rest = rest[~crossed & (np.minimum(dies_a, dies_b) < _NEVER)]
        return good

    def remember(self, words: list[str]) -> np.ndarray:
        """The row of each word in self.begin and self.count, which say where in self.pool its tokens are.

        Words that a process meets first stay encoded for its later texts, up to REMEMBERED; others are encoded again
        with each piece of text (``forget``). The result is the same either way.
        """
        known = len(self.rows.fresh)
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        fresh = self.rows.fresh[known:]
        if fresh:
            tokens, number = self.encode_words(*self._symbols(fresh))
            self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(number) - number))
            self.count = np.concatenate((self.count, number))
            self.pool = np.concatenate((self.pool, tokens))
        return rows

    def spans(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``remember`` for text[start:end], each distinct word once; points are the text's code points.

        Words of up to 16 bytes are grouped, and found among those met before, by their hash, and then compared whole;
        longer ones, and those that differ from another of the same hash, are looked up one by one.
        """
        raw, at = text.encode("utf-8", "surrogatepass"), utf8_offsets(points)
        low, high = at[starts], at[ends]
        short = high - low <= 16
        own = [*halves(raw, low, high), high - low]
        keys = np.where(short, hashes(raw, low, np.where(short, high, low), (own[0], own[1])), 0)
        where, back = _groups(keys)
        known, *parts, row = self.known
        place = np.minimum(np.searchsorted(known, keys[where]), len(known) - 1)
        met = known[place] == keys[where]
        new = np.flatnonzero(~met & short[where])
        rows = row[place]
        fresh = where[new]
        words = [text[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        rows[new] = self.remember(words)
        for word in words:  # are found by their hash from now on; special tokens stay, as texts with strange marks look words up
            if self.rows[word] >= len(self.specials):
                del self.rows[word]
        if len(fresh):
            self.met.append([keys[fresh], *(x[fresh] for x in own), rows[new]])
        like = [np.where(met, x[place], y[where])[back] for x, y in zip(parts, own, strict=True)]
        out = rows[back]
        apart = np.flatnonzero(~short | (own[0] != like[0]) | (own[1] != like[1]) | (own[2] != like[2]))
        if len(apart):
            out[apart] = self.remember([text[a:b] for a, b in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True)])
        return out

    def forget(self) -> None:
        """Ends a piece of text: its new words stay if there is room."""
        fresh = self.rows.fresh
        size = sum(map(len, fresh))
        if self.held + size <= REMEMBERED:
            self.held += size
            if self.met:
                self.known = [np.concatenate(x) for x in zip(self.known, *self.met, strict=True)]
                order = np.argsort(self.known[0], kind="stable")
                self.known = [x[order] for x in self.known]
        elif fresh:
            for word in fresh:
                self.rows.pop(word, None)
            n = self.rows.n = self.rows.n - len(fresh)
            self.pool = self.pool[: self.begin[n]].copy()
            self.begin, self.count = self.begin[:n].copy(), self.count[:n].copy()
        self.rows.fresh, self.met = [], []

    def _merged(self, symbols: list[int]) -> list[int]:
        """The merges of one long word: the pair of lowest rank first, of equal ones the leftmost."""
        ranks, after, before = self.ranks, list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        n = len(symbols)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                pair = (symbols[x], symbols[y]) if x >= 0 and y < n else None
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], x, pair))
        return [s for s in symbols if s >= 0]

    def encode_words(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words as base symbols -> (tokens, number of each word)."""
        long = np.flatnonzero(length > LONG_WORD)
        if len(long):
            first, short = np.cumsum(length) - length, np.flatnonzero(length <= LONG_WORD)
            tokens, count = self.encode_words(symbols[spread(first[short], length[short])], length[short]) if len(short) else (symbols[:0], length[:0])
            pool = [tokens, *(np.array(self._merged(symbols[first[i] : first[i] + length[i]].tolist()), np.int64) for i in long)]
            number = np.zeros(len(length), np.int64)
            number[short], number[long] = count, [len(x) for x in pool[1:]]
            start = np.zeros(len(length), np.int64)
            start[short], start[long] = np.cumsum(count) - count, len(tokens) + np.cumsum(number[long]) - number[long]
            return np.concatenate(pool)[spread(start, number)], number
        tokens, count = self._longest(symbols, length)
        word = np.repeat(np.arange(len(count)), count)
        at = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(tokens[at] << 20 | tokens[at + 1], return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))[back]
        bad = np.unique(word[at[~good]])
        if not len(bad):
            return tokens, count
        first = np.cumsum(length) - length
        mended, number = self._exact(symbols[spread(first[bad], length[bad])], length[bad])
        pool, start = np.concatenate((tokens, mended)), np.cumsum(count) - count
        start[bad], count[bad] = len(tokens) + np.cumsum(number) - number, number
        return pool[spread(start, count)], count

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The base symbols of the words: a symbol for each byte, the last one marked; and their number."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        raw = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[raw]
        last = np.cumsum(length) - 1
        symbols[last] = self.final[raw[last]]
        return symbols, length

    def _strange_words(self, text: str) -> list[str]:
        """The words of a text by the library's normaliser and expression."""
        words: list[str] = []
        for part in re.split("([\ud800-\udfff])", text):
            if part and 0xD800 <= ord(part[0]) < 0xE000:
                words.append(part)
            elif part:
                words += [word for word, _ in self.split(self.normalise(part))]
        return words

    def rows_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the words of all texts in order, the text of each); a special token is a word, a lone surrogate."""
        plain = []
        for text in texts:
            if "<|" in text:
                for k, special in enumerate(self.specials):
                    text = text.replace(special, chr(0xD800 + k))
            plain.append(text)
        first = np.concatenate(([0], np.cumsum(np.array([len(x) + 1 for x in plain], np.int64))))[:-1]
        whole = "\n".join(plain)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        strange = np.flatnonzero(self.kind[points] == _STRANGE)
        if len(strange):
            odd = np.unique(np.searchsorted(first, strange, "right") - 1).tolist()
            aside = set(odd)
            rows, doc = self.rows_of(["" if i in aside else x for i, x in enumerate(texts)])
            own = [self._strange_words(plain[i]) for i in odd]
            rows = np.concatenate((rows, self.remember([w for x in own for w in x])))
            doc = np.concatenate((doc, np.repeat(odd, [len(x) for x in own])))
            order = np.argsort(doc, kind="stable")
            return rows[order], doc[order]
        whole = whole.replace("Σ", "σ").lower()  # of these code points each becomes one
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        letter, letter_end = runs(kind == _LETTER)
        other, other_end = runs(kind == _OTHER)
        # 's, 't, 'm, 'd, 're, 've and 'll are words where the apostrophe begins a match.
        after = np.concatenate((points, np.zeros(3, np.uint32)))
        mark = np.flatnonzero((points[other] == 0x27) & (other_end - other == 1)) if len(other) else other
        one, two = after[other[mark] + 1], after[other[mark] + 2]
        tail = np.isin(one, [ord(c) for c in "stmd"]) + 2 * (
            ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        )
        other_end[mark] += tail
        hit = np.searchsorted(letter, other[mark[tail > 0]] + 1)
        letter[hit] += tail[tail > 0]
        left = letter < letter_end
        single = np.flatnonzero((kind == _NUMBER) | (kind == _SPECIAL))
        starts = np.concatenate((letter[left], other, single))
        ends = np.concatenate((letter_end[left], other_end, single + 1))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        return self.spans(whole, points, starts, ends), owners(starts, first)[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of each text)."""
        rows, doc = self.rows_of(texts)
        number = self.count[rows]
        ids = self.pool[spread(self.begin[rows], number)]
        self.forget()
        return ids, np.bincount(doc, weights=number, minlength=len(texts)).astype(np.int64)


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The encoder of a file, once for each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of each whole text, no special tokens added; a null or empty text has none.

    ``path`` names a tokenizers file on every machine: BPE with an end-of-word suffix, byte-level words, lower case.
    Special tokens that stand in a text are found as such. Long texts are encoded whole, long words by a heap of their
    pairs. Null ids and repeated rows are rows like any other; of equal merges the leftmost comes first. Other columns of
    docs are not read. An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        model = loaded(path)
        for part in chunks(batches, "text"):
            ids, count = model.encode(strings(part["text"]))
            at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(at, ids.astype(np.int32))], names=[id_col, "ids"])

    kind = own.schema["id"].dataType.simpleString()
    return mapped(own, work, f"`{id_col}` {kind}, ids array<int>")


#: Ids decoded at once.
_DECODE_IDS = 400_000


def _by_length(batches, ids_col: str):
    """The same rows in pieces of about _DECODE_IDS ids; a longer list is a piece of its own."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.list_value_length(batch[ids_col]), 0).to_pylist()):
            if held and held + n > _DECODE_IDS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows:
            yield batch.slice(start)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded and ``decoded``: the tokens' strings with a space between them, as the file names no decoder.

    A null list gives null, an empty one an empty text; ids outside the vocabulary give an empty string in their place. Lists
    of any length are decoded whole. Other columns stay, but one named decoded is replaced. Repeated rows are decoded
    alike, and an empty table gives an empty one.
    """

    def work(batches):
        names = loaded(path).names
        for batch in _by_length(batches, ids_col):
            column = batch[ids_col]
            flat = column.flatten().to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(names))
            words = names.take(pa.array(np.where(known, flat, 0).astype(np.int32)))
            words = words if known.all() else pc.if_else(known, words, "")
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(column.is_valid(), joined, None)], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return mapped(encoded.drop("decoded"), work, f"{fields}, decoded string")
