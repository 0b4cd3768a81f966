"""Tokenizing by words: each distinct piece of text goes through the tokenizers library once a worker.

The vocabulary drops white space, and nothing in its normaliser or merges reaches across a space. A word of ASCII signs and
Latin-1 letters only is cut further, where its pre-tokenizer cuts: contractions, runs of letters, single digits, and runs
of other signs. Such a piece is one pre-token that the normaliser only lower-cases, so the library's BPE model takes its
bytes, written as byte-level characters. Words with any other character go through the whole tokenizer, whole; words that
hold the beginning of a special token do so each time they occur, letters as written.

Pieces are found and hashed in the texts' byte buffers; the ids of a hash are held in an open-addressing table, which is
emptied when it is full. A hit counts if the length and the first eight bytes agree too, so pieces of up to eight bytes are
told apart exactly and longer ones by 128 bits and their length; pieces that share a hash and differ go through the
library one by one.

All this follows from what the file says of its normaliser, pre-tokenizer and model. Files that say anything else go
through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
from . import textops as tx

#: Pieces held at most; the table has twice as many places.
HELD = 1 << 20
# The normaliser and the pre-tokenizer of the files that ``pieces`` rebuilds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
KIND, LOW = _KIND.tobytes(), tx.LOWER.tobytes()
#: Byte-level characters: a byte that Latin-1 prints is itself, the others follow from U+0100.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _contract(low: np.ndarray, offsets: np.ndarray, edge: np.ndarray) -> None:
    """Keep 's 't 'm 'd 're 've 'll together, where the apostrophe begins a piece, and cut after them."""
    at = np.flatnonzero(low == 0x27)
    at = at[edge[at]]
    if not len(at):
        return
    room = offsets[np.searchsorted(offsets, at, "right")] - at  # bytes up to the text's end
    one, two = (low[np.minimum(at + k, len(low) - 1)] for k in (1, 2))
    short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (room > 2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
    edge[at[short | long] + 1] = False
    edge[at[short] + 2] = True
    edge[at[long] + 3] = True


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the pieces, the bytes with ASCII pieces in lower case, and for each piece whether it is a word
    that has to go whole and whether it holds ``<|``."""
    if not len(data):
        e, no = np.zeros(0, np.int64), np.zeros(0, bool)
        return e, e, data, no, no
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw.translate(KIND)), np.uint8)
    low = np.frombuffer(bytearray(raw.translate(LOW)), np.uint8)
    wide = np.flatnonzero(data == 0xC3)
    second = data[wide + 1]
    letter = (second != 0x97) & (second != 0xB7)
    wide, second = wide[letter], second[letter]
    kind[wide] = kind[wide + 1] = _LETTER
    low[wide + 1] = second + np.where(second < 0x9F, 0x20, 0).astype(np.uint8)
    odd = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    kind[odd] = _WHOLE
    inside = kind > 0
    edge = np.empty(len(data) + 1, bool)  # whether a piece or a gap begins at a byte
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[1:-1] |= kind[1:] == _DIGIT
    edge[offsets] = True
    _contract(low, offsets, edge)
    whole = np.flatnonzero(kind == _WHOLE)
    if len(whole):
        # the words around them: between white space and text ends
        bound = np.empty(len(data) + 1, bool)
        bound[0] = bound[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=bound[1:-1])
        bound[offsets] = True
        at = np.flatnonzero(bound)
        k = np.searchsorted(at, whole, "right")
        k = k[np.r_[True, k[1:] != k[:-1]]]
        a, b = at[k - 1], at[k]
        size = b - a
        first = np.cumsum(size) - size
        every = np.arange(size.sum()) + np.repeat(a - first, size)
        low[every] = data[every]
        edge[every] = False
        edge[a] = True
    begin = np.flatnonzero(edge[:-1] & inside)
    final = np.flatnonzero(edge[1:] & inside) + 1
    is_whole, is_odd = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
    if len(whole):
        is_whole[np.searchsorted(begin, a)] = True
        is_odd[np.searchsorted(begin, odd, "right") - 1] = True
    return begin, final, low, is_whole, is_odd


class WordTokenizer:
    """Ids of texts. path: a file of the tokenizers library."""

    def __init__(self, path: str, held: int = HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            self.by_words = _splits_words(json.load(f))
        self.held = held
        self._clear()

    def _clear(self) -> None:
        self.mask = np.uint64(2 * self.held - 1)
        self.keys, self.place = np.zeros(2 * self.held, np.uint64), np.zeros(2 * self.held, np.int32)
        self.head, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64)
        self.ids, self.first, self.n, self.n_ids = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = int(self.mask)
        at = (h & self.mask).view(np.int64)
        key = self.keys.take(at)
        out = np.where(key == h, self.place.take(at), -1)
        on = np.flatnonzero((key != h) & (key != 0))
        at = at[on]
        while len(on):
            at = at + 1 & mask
            key = self.keys.take(at)
            hit = key == h[on]
            out[on[hit]] = self.place.take(at[hit])
            more = ~hit & (key != 0)
            on, at = on[more], at[more]
        return out

    def _put(self, h: np.ndarray, head: np.ndarray, length: np.ndarray, found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while self.n + len(h) + 1 > len(self.first):
            self.first = np.r_[self.first, np.zeros_like(self.first)]
        while self.n + len(h) > len(self.head):
            self.head, self.size = np.r_[self.head, np.zeros_like(self.head)], np.r_[self.size, np.zeros_like(self.size)]
        self.head[self.n : self.n + len(h)], self.size[self.n : self.n + len(h)] = head, length
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[self.n + 1 : self.n + len(h) + 1] = self.n_ids + np.cumsum(size)
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        self.n_ids += len(ids)
        at = (h & self.mask).view(np.int64)
        while len(h):
            # of those that meet in a free place one gets it, the others go on
            free = self.keys.take(at) == 0
            self.keys[at[free]] = h[free]
            mine = self.keys.take(at) == h
            self.place[at[mine]] = number[mine]
            h, at, number = h[~mine], at[~mine] + 1 & int(self.mask), number[~mine]

    def _learn(self, h: np.ndarray, head: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, whole: np.ndarray) -> None:
        raw, found, rest = low.tobytes(), [], []
        one = self.tokenizer.model.tokenize
        for a, b, w in zip(starts.tolist(), ends.tolist(), whole.tolist()):
            if w:
                rest.append(len(found))
                found.append(raw[a:b].decode("utf-8", "replace"))
            else:
                found.append([t.id for t in one(raw[a:b].decode("latin-1").translate(LEVEL))])
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([found[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        self._put(h, head, ends - starts, found)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. data, offsets: the texts' bytes; end: an id put
        after each text."""
        if not self.by_words:
            return self._whole(data, offsets, end)
        starts, ends, low, whole, odd = pieces(data, offsets)
        h, head = tx.hash_words(low, starts, ends, lower=False, heads=True)
        h[h == 0] = 1
        number = self._find(h)
        new = np.flatnonzero((number < 0) & ~odd)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            if self.n + len(one) > self.held:
                if len(one) < len(h) and self.n:
                    self._clear()
                    return self.encode(data, offsets, end)
                self.held = 1 << int(len(one)).bit_length()  # one slice holds more pieces than the table
                self._clear()
            self._learn(h[one], head[one], starts[one], ends[one], low, whole[one])
            number[new] = self._find(h[new])
        safe = np.maximum(number, 0)
        odd |= (number >= 0) & ((self.head.take(safe) != head) | (self.size.take(safe) != ends - starts))
        size = self.first.take(number + 1) - self.first.take(number)  # of odd pieces, set below
        apart: dict = {}
        for i in np.flatnonzero(odd).tolist():
            text = low[starts[i] : ends[i]].tobytes()
            if whole[i]:
                apart[i] = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            else:
                apart[i] = [t.id for t in self.tokenizer.model.tokenize(text.decode("latin-1").translate(LEVEL))]
            size[i] = len(apart[i])
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        base = self.first.take(np.maximum(number, 0)) - (upto - size)
        at = np.arange(total) + np.repeat(base, size)
        if apart:
            at = np.clip(at, 0, len(self.ids) - 1)
        ids = self.ids.take(at)
        for i, x in apart.items():
            ids[upto[i] - size[i] : upto[i]] = x
        # texts end after the pieces that begin before their ends
        cut = np.r_[0, upto][np.searchsorted(starts, offsets[1:])]
        length = np.diff(np.r_[0, cut])
        if end is not None:
            ids, length = np.insert(ids, cut, np.uint32(end)), length + 1
        return ids, length


    def _whole(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Text by text through the library."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        found = [[*e.ids, *([] if end is None else [end])] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for f in found for x in f), np.uint32, int(length.sum())), length


def _splits_words(file: dict) -> bool:
    """Whether a tokenizer file has the normaliser, pre-tokenizer and model that ``pieces`` rebuilds."""
    norm, pre, model = (file.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    apart = all(t["special"] and t["content"].startswith("<|") for t in file.get("added_tokens") or [])
    return apart and (norm, pre) == (NORMALIZER, PRE_TOKENIZER) and model.get("type") == "BPE" and not model.get("ignore_merges") and model.get("dropout") is None


def stretches(data: np.ndarray, limit: int = tx.SLICE_BYTES):
    """A long text's bytes in parts that end beside white space and have about ``limit`` bytes; a longer word stays whole."""
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data):
            gap = np.flatnonzero(tx.SPACE[data[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + limit, len(data))
        yield data[start:end]
        start = end
