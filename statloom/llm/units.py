"""Token ids of text units (words or parts of words), looked up once for each distinct unit a task meets."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .inputs import CACHES
from .textkernel import LOWER, SPACE, Words, byte_hashes, ragged

#: Bytes of text whose units are looked up together: each distinct one costs a look-up a chunk.
UNIT_BYTES = 1 << 20
#: Distinct units that a worker remembers (some 150 bytes each); beyond it starts afresh, so memory stays bounded.
REMEMBERED = 150_000


class UnitCache:
    """Ids of units in one growing array, found by the 64-bit hash of the unit."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.clear()
        CACHES.add(self)

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, name: str, n: int) -> None:
        if n > len(row := getattr(self, name)):
            grown = np.zeros(max(n, 2 * len(row)), row.dtype)
            grown[: len(row)] = row
            setattr(self, name, grown)

    def slots_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        met = pa.array(byte_hashes(data, start, end)).dictionary_encode()  # by a hash table, without a sort
        distinct, back = met.dictionary.to_numpy(), met.indices.to_numpy()
        where = np.zeros(len(distinct), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)  # the first of equals, written last
        if len(self.slots) + len(distinct) > self.most:
            self.clear()
        keys = distinct.tolist()
        get = self.slots.get
        slot = np.array([get(x, -1) for x in keys], np.int64)
        if len(new := np.flatnonzero(slot < 0)):
            at = where[new]
            raw = data.tobytes()
            coded = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            n, total = len(self.slots), int(sizes.sum())
            self._room("flat", self.used + total)
            self._room("first", n + len(new))
            self._room("size", n + len(new))
            self.flat[self.used : self.used + total] = list(chain.from_iterable(coded))
            self.size[n : n + len(new)] = sizes
            self.first[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.used += total
            slot[new] = np.arange(n, n + len(new))
            self.slots.update((keys[i], n + j) for j, i in enumerate(new.tolist()))
        return slot[back]

    def ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each unit has."""
        size = self.size[slot]
        return self.flat[ragged(self.first[slot], size)], size


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # anything else in ASCII
    kind[65:91] = kind[97:123] = 1
    kind[48:58] = 2
    kind[128:] = 3  # may be of any class, and may combine with what stands before it
    kind[SPACE] = 4
    return kind


_CLASS = _classes()


def word_bpe_units(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the ranges of units that the lower-casing word BPE codes one by one.

    Its pre-tokens never cross white space, and in ASCII they end wherever letters, digits and other signs meet,
    but for an apostrophe with what follows it. A text with a special token's sign is left in whole words.
    """
    marked = len(data) > 1 and bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())
    if marked or not len(words.start):
        return data, words.start, words.end
    lower = LOWER[data]
    kind = _CLASS[data]
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left < 3) & (right < 3) & (data[:-1] != 0x27)
    at = np.flatnonzero(cut) + 1  # signs on both sides are no space: a cut lies inside a word
    start = np.sort(np.concatenate([words.start, at]))
    end = np.sort(np.concatenate([words.end, at]))
    return lower, start, end


#: Units that the normaliser leaves as they are and that are one pre-token: small letters, or signs without an apostrophe.
_PLAIN = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[!-&(-/:-@\[-`{-~]+")


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte that isn't a visible Latin-1 sign itself: the next free one from U+0100."""
    unseen = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: 0x100 + i for i, b in enumerate(unseen)}


_BYTE_SIGNS = _byte_signs()


def _signs(unit: str) -> str:
    return unit if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTE_SIGNS)


#: Kinds of bytes for the byte-level BPE: control signs may count as white space there, so they are as open as what lies outside ASCII.
_BYTE_KIND = _classes()
_BYTE_KIND[[*range(9), *range(14, 32), 127]] = 3
_SPECIAL_SIGN = np.frombuffer(b"<|", np.uint8)
#: First bytes of two-byte letters (U+00C0 to U+017F but for the signs of times and division, U+0400 to U+047F).
_LETTER_LEAD = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])


def byte_bpe_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and the ranges of units that the byte-level BPE codes one by one; they cover all bytes.

    Its pre-tokens take one space before a word. They always end before white space that follows another sign, and wherever ASCII
    letters, digits and other signs meet, but for an apostrophe with what follows it; of several white-space signs before a word the last stands
    alone or with it. Where a neighbour is neither ASCII nor a common letter nothing is known, and nothing is cut. Texts with a special token's sign are only cut before white space.
    """
    n = len(data)
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < n)]
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _BYTE_KIND[data]
    lead = np.flatnonzero(_LETTER_LEAD[data])
    lead = lead[~((data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7)))]
    kind[lead] = kind[lead + 1] = 1
    left, right = kind[:-1], kind[1:]
    edge = np.zeros(n + 1, bool)  # a text begins, or the last one ends
    edge[0] = edge[n] = True
    edge[inner] = True
    cut = edge.copy()
    known = left < 3
    space = right == 4
    cut[1:n] |= known & space
    marked = bool(((data[:-1] == _SPECIAL_SIGN[0]) & (data[1:] == _SPECIAL_SIGN[1])).any())
    if not marked:
        cut[1:n] |= known & (right < 3) & (left != right) & (data[:-1] != 0x27)
        # the last sign of a run of white space that a known sign follows, the run itself after a known sign or at the beginning of a text
        ends = np.flatnonzero((left == 4) & (right < 3) & ~edge[1:n]) + 1
        white = kind == 4
        begins = white & ~np.concatenate([[False], white[:-1]]) | white & edge[:n]
        run = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        first = run[ends - 1]
        fine = edge[first] | (kind[np.maximum(first, 1) - 1] < 3)
        ends, first = ends[fine], first[fine]
        cut[(ends - 1)[ends - first > 1]] = True
        cut[ends[data[ends - 1] != 0x20]] = True
    at = np.flatnonzero(cut)
    return data, at[:-1], at[1:]


#: Units that are one pre-token of the byte-level BPE, contractions apart.
_ONE_TOKEN = re.compile(r" ?(?:[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u017F\u0400-\u047F]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|[ \t-\r]+")


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> UnitCache:
    """Ids of the tokeniser in the file. Units of one pre-token are merged by the ranks of the file's own vocabulary, which takes a fifth of
    the time and gives the same ids; all others go through the tokeniser itself."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    bytes_of = {chr(b): b for b in range(256) if b not in _BYTE_SIGNS} | {chr(sign): b for b, sign in _BYTE_SIGNS.items()}
    special = {x["content"] for x in content["added_tokens"]}
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    merged = Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer, plain = Tokenizer.from_file(path), _ONE_TOKEN.fullmatch

    def encode(units: list[str]) -> list[list[int]]:
        coded = [merged(unit) if plain(unit) and "<|" not in unit else None for unit in units]
        if rest := [i for i, ids in enumerate(coded) if ids is None]:
            for i, x in zip(rest, tokenizer.encode_batch([units[i] for i in rest], add_special_tokens=False), strict=True):
                coded[i] = x.ids
        return coded

    return UnitCache(encode, 400_000)


@lru_cache(maxsize=1)
def word_bpe(path: str) -> UnitCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge, plain = tokenizer.model.tokenize, _PLAIN.fullmatch

    def encode(units: list[str]) -> list[list[int]]:
        coded = [[x.id for x in merge(_signs(unit))] if plain(unit) else None for unit in units]
        if rest := [i for i, ids in enumerate(coded) if ids is None]:
            for i, x in zip(rest, tokenizer.encode_batch([units[i] for i in rest], add_special_tokens=False), strict=True):
                coded[i] = x.ids
        return coded

    return UnitCache(encode)


@lru_cache(maxsize=1)
def piece_bpe(path: str) -> tuple[UnitCache, np.ndarray]:
    """Ids by word, and which ids are single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return UnitCache(lambda units: model.encode(units, num_threads=1)), np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def tokenizer_file(name: str) -> str:
    """Where an executor's installation has the file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
