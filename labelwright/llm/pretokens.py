"""Vectorised pre-splitting of byte-level BPE: the matches of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

over many texts at once, and a table of the ids of the words met so far. A text that holds a
character outside the blocks whose classes all Unicode versions agree on goes to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from . import words

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
SAFE_BLOCKS = ((0, 0x250), (0x2000, 0x2070))
#: Characters of the property White_Space inside SAFE_BLOCKS (fixed values).
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)


def _classes() -> np.ndarray:
    out = np.full(0x10000, UNSURE, np.uint8)
    for lo, hi in SAFE_BLOCKS:
        for c in range(lo, hi):
            out[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    out[list(WHITE)] = SPACE
    return out


CLASSES = _classes()


def starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where matches begin in `chars` (code points); `first` marks the first character of each text."""
    n = len(chars)
    cls = CLASSES[np.minimum(chars, 0xFFFF)]
    begin = first.copy()
    begin[1:] |= cls[1:] != cls[:-1]
    # The last white character before a visible one stands alone, or leads the next match if it is a blank.
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~first[1:])
    begin[last] = True
    begin[last[chars[last] == 0x20] + 1] = False
    # Contractions count only where a match begins.
    quote = np.flatnonzero((chars == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = chars[quote + 1]
    two = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
    two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)], two, 0)
    code = lambda c: ord(c)
    short = np.isin(one, [code(c) for c in "stmd"])
    long = ((one == code("r")) & (two == code("e"))) | ((one == code("v")) & (two == code("e"))) | ((one == code("l")) & (two == code("l")))
    for hit, size in ((short, 2), (long & ~short, 3)):
        at = quote[hit]
        begin[at + 1] = False
        at = at[at + size < n] + size
        begin[at] = True
    return np.flatnonzero(begin)


class WordTable:
    """Ids of words, each encoded once by `encode` (one word to its ids); forgets all beyond `limit` words.

    Words are found by 64-bit hashes and then compared with the word of the table, character by character; one that
    differs is encoded for itself. Texts that hold one of the names `special` go to `whole`.
    """

    def __init__(self, encode: Callable[[str], list[int]], whole: Callable[[str], list[int]], special: Sequence[str] = (), limit: int = 300_000):
        self.encode, self.whole, self.special, self.limit = encode, whole, [s for s in special if s], limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.chars, self.first, self.width = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lanes = words.Lanes(np.zeros(0, np.uint8))

    def add(self, joined: str, chars: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes the words between some places; their numbers in the table."""
        coded = [self.encode(joined[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
        size, width = np.fromiter(map(len, coded), np.int64, len(coded)), ends - first
        number = len(self.size) + np.arange(len(coded))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))])
        self.first = np.concatenate([self.first, len(self.chars) + np.cumsum(width) - width])
        self.width = np.concatenate([self.width, width])
        self.chars = np.concatenate([self.chars, chars[np.arange(int(width.sum())) + np.repeat(first - (np.cumsum(width) - width), width)]])
        self.lanes = words.Lanes(self.chars.view(np.uint8))
        return number

    def lookup(self, joined: str, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.limit:
            self.clear()
        lanes, ends = words.Lanes(chars.view(np.uint8)), np.append(at[1:], len(chars))
        keys, first, back = np.unique(words.hashes(lanes, 4 * at, 4 * (ends - at)), return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = near < len(self.keys)
        known[inside] = self.keys[near[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            place = self.add(joined, chars, at[first[new]], ends[first[new]])
            self.place = np.insert(self.place, near[new], place)
            self.keys = np.insert(self.keys, near[new], keys[new])
            near = np.searchsorted(self.keys, keys)
        found = self.place[near][back]
        width = ends - at
        other = np.flatnonzero((self.width[found] != width) | words.differing(lanes, 4 * at, self.lanes, 4 * self.first[found], 4 * width))
        if len(other):
            found[other] = self.add(joined, chars, at[other], ends[other])
        return found

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), counts
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        unsure = CLASSES[np.minimum(chars, 0xFFFF)] == UNSURE
        odd = np.searchsorted(ends, np.flatnonzero(unsure), "right")
        if any(s in joined for s in self.special):
            odd = np.append(odd, [i for i, text in enumerate(texts) if any(s in text for s in self.special)])
        if len(odd):
            odd = np.unique(odd.astype(np.int64))
            parts, begin = [], 0
            for i in [*odd.tolist(), len(texts)]:
                if i > begin:
                    ids, counts[begin:i] = self.texts(texts[begin:i])
                    parts.append(ids)
                if i < len(texts):
                    ids = self.whole(texts[i])
                    parts.append(np.array(ids, np.uint32))
                    counts[i] = len(ids)
                begin = i + 1
            return np.concatenate(parts), counts
        first = np.zeros(len(chars), bool)
        first[(ends - lengths)[lengths > 0]] = True
        at = starts(chars, first)
        index = self.lookup(joined, chars, at)
        size = self.size[index]
        total = np.cumsum(size)
        flat = np.arange(total[-1]) + np.repeat(self.begin[index] - (total - size), size)
        upto = np.concatenate([[0], total])[np.searchsorted(at, ends, "left")]
        counts[:] = np.diff(upto, prepend=0)
        return self.ids[flat], counts


def byte_level_table(tokenizer_path: str) -> WordTable:
    """A table for a byte-level BPE file of the tokenizers library.

    Texts outside SAFE_BLOCKS and those that hold the name of a special token are encoded by that library. Single words are merged by tiktoken with the same
    vocabulary as ranks, which gives the same ids at a tenth of the time; that needs ids in order of the merges.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shown = dict(zip(map(chr, [*plain, *range(256, 512 - len(plain))]), [*plain, *(b for b in range(256) if b not in set(plain))]))
    vocabulary = {bytes(shown[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in shown for c in token)}
    special = {a.content for a in tokenizer.get_added_tokens_decoder().values()}
    ranks = {token: i for token, i in vocabulary.items() if token.decode("utf-8", "replace") not in special}
    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return WordTable(lambda word: merge(word.encode()), whole, sorted(special))
