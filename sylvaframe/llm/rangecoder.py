"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks of at most ``BLOCK`` that share nothing: each starts from an empty model and carries a crc32 of its
ids. A block is dealt to up to ``LANES`` lanes of consecutive ids. All lanes take a step at once, so that a step is a few
array operations, and all teach the one model of the block; a lane has a range coder of its own.

Three predictions are mixed for each id. Order 2 names the id that last followed the last two, with a confidence that hits
raise and misses halve. Order 1 spreads ``SLOTS`` slots over the ids that have followed the last one, by their counts.
Order 0 spreads a power of two over all ids of the block, and escapes to an even spread over the vocabulary. How much
probability orders 2 and 1 get is learnt for each confidence and each wealth of the order-1 context, from their hits.
Confidences follow every step; counts, spreads and shares are renewed whenever the number of steps has doubled.

The coder is carry-less with 64-bit state and 32-bit words. All arithmetic is in integers.

Segment format, little-endian: magic ``SVT2``, u32 vocabulary, u32 blocks, u64 documents; i64 id of each document, u8
whether it is null, u64 ids of each document; then each block: u32 ids, u32 crc32, u32 lanes, u32 words of each lane, the
words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 22
LANES = 4096
#: Ids of a lane at least, where a block is too short for all lanes.
STRETCH = 1024
SLOTS = 256
MAGIC = b"SVT2"
_TOTAL = 28
_HASHED = 18
#: Contexts that get order-1 slots: those seen so often at least, and the most frequent of them.
_SEEN, _ROWS = 4, 4096
_FINDER = 19
_TOP = np.uint64(1 << 32)
_MASK = np.uint64((1 << 32) - 1)
_W = np.uint64(32)
_R = np.uint64(_TOTAL)
#: What a miss and a hit add to a confidence; an entry whose confidence gets 0 is replaced.
_CHANGE = np.array([*[(c >> 1) - c for c in range(16)], *[int(c < 15) for c in range(16)]], np.int32)
_WEALTH = 4
#: Steps that the encoder looks up at once.
_AHEAD = 4


class _Model:
    """What the steps up to now have taught."""

    def __init__(self, vocabulary: int):
        if not 0 < vocabulary < 1 << 21:
            raise ValueError("the vocabulary must have 1 to 2,097,151 ids")
        self.vocabulary = v = vocabulary
        self.bits = max(18, v.bit_length() + 1)
        self.named = np.full(1 << _HASHED, -16, np.int32)  # order 2: id << 4 | confidence
        self.count = np.zeros(v + 1, np.int64)  # the last one is the escape
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = 16 * _WEALTH
        conf = np.arange(kinds) // _WEALTH
        self.seen = np.full(kinds, 16, np.int64)
        self.hits2, self.hits1 = 16 * conf // (conf + 2), np.where(np.arange(kinds) % _WEALTH > 0, 8, 0)
        self.low0, self.wide0 = np.zeros(v + 1, np.uint32), np.zeros(v + 1, np.uint32)
        self.row = np.zeros(v, np.int32)  # number << 2 | wealth
        self.next = 1
        self._spread()
        self._slots()
        self._shares()

    def _spread(self) -> None:
        """Order 0: a stretch of 2**bits for each id seen and for the escape."""
        self.count[-1] += self.count[-1] == 0
        held = np.flatnonzero(self.count)
        upto = np.cumsum(self.count[held])
        ends = upto * ((1 << self.bits) - len(held)) // upto[-1] + np.arange(1, len(held) + 1)
        size = np.diff(np.r_[0, ends])
        self.low0[held], self.wide0[held] = ends - size, size
        self.owner = np.repeat(held.astype(np.uint32), size)

    def _slots(self) -> None:
        """Order 1: the slots of each context, and where to find those of a pair."""
        v = self.vocabulary
        context = self.pairs // v
        ids, first = np.unique(context, return_index=True)
        total = np.add.reduceat(self.times, first) if len(ids) else np.zeros(0, np.int64)
        rich = total >= _SEEN
        if rich.sum() > _ROWS:
            rich &= total >= np.partition(total, len(total) - _ROWS)[len(total) - _ROWS]
            rich &= np.cumsum(rich) <= _ROWS
        self.row[:] = 0
        self.row[ids[rich]] = np.arange(1, int(rich.sum()) + 1) << 2 | 1 + (total[rich] >= 64) + (total[rich] >= 1024)
        length = np.diff(np.r_[first, len(context)])
        before = np.cumsum(self.times) - self.times
        own = np.repeat(np.arange(len(ids)), length)
        keep = rich[own]
        own, pairs = own[keep], self.pairs[keep]
        upto = (before + self.times - np.repeat(before[first] if len(ids) else before, length))[keep]
        end = (upto * SLOTS + total[own] // 2) // total[own]
        start = np.r_[0, end[:-1]]
        if len(own):
            start[np.r_[True, own[1:] != own[:-1]]] = 0
        size = end - start
        some = size > 0
        self.held = np.r_[np.int64(-1), pairs[some]]
        self.place = np.r_[0, start[some] << 10 | size[some]].astype(np.uint32)
        self.slot = np.zeros((int(rich.sum()) + 1) * SLOTS, np.int64)
        entry = (pairs[some] % v) << 20 | self.place[1:]
        self.slot[SLOTS:] = np.repeat(entry, size[some])
        self.finder = np.zeros(1 << _FINDER, np.int32)
        self.finder[self.spot(self.held[1:])] = np.arange(1, len(self.held))

    @staticmethod
    def spot(pairs: np.ndarray) -> np.ndarray:
        """Where the finder looks for a pair; one that lost its place is coded by order 0."""
        return (pairs * 0x9E3779B97F4A7C1 >> 40) & ((1 << _FINDER) - 1)

    def _shares(self) -> None:
        """Shares of orders 2 and 1 by confidence and wealth: the first's end, a slot's width, the second's end, and the
        width of a unit of order 0."""
        most = (1 << _TOTAL) - (4 << self.bits)
        kind = np.arange(len(self.seen))
        share2 = np.clip((self.hits2 << _TOTAL) // self.seen, SLOTS, most - SLOTS)
        share2[kind < _WEALTH] = 0
        share1 = np.clip((self.hits1 << _TOTAL) // self.seen, SLOTS, most - share2)
        share1[kind % _WEALTH == 0] = 0
        self.end2 = share2.astype(np.uint32)
        self.width1 = (share1 // SLOTS).astype(np.uint32)
        self.end1 = self.end2 + self.width1 * np.uint32(SLOTS)
        self.width0 = (np.uint32(1 << _TOTAL) - self.end1) >> np.uint32(self.bits)

    @staticmethod
    def entry(prev: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        """The place of order 2's entry. prev, prev2: unsigned, 32 bits."""
        return (prev * np.uint32(0x9E3779B1) + prev2 * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASHED)

    def follow(self, at: np.ndarray, entry: np.ndarray, conf: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        """Order 2 after a step. Of lanes that meet in an entry, the last one counts."""
        entry = entry + _CHANGE.take(conf + hit * np.int32(16))
        self.named[at] = np.where(entry & np.int32(15), entry, ids << np.int32(4) | np.int32(1))

    def renew(self, t: int, prev: np.ndarray, ids: np.ndarray, notes: np.ndarray, escapes: int) -> None:
        """Take in what the steps since the last call gave. notes: kind * 4 + (2 for a hit of order 2, 1 of order 1)."""
        n = np.bincount(notes, minlength=4 * len(self.seen)).reshape(-1, 4)
        self.seen += n.sum(axis=1)
        self.hits2 += n[:, 2]
        self.hits1 += n[:, 1]
        self.count[:-1] += np.bincount(ids, minlength=self.vocabulary)
        self.count[-1] += escapes
        new = np.sort(prev.astype(np.int64) * self.vocabulary + ids)
        first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
        both = np.r_[self.pairs, new[first]]
        times = np.r_[self.times, np.diff(np.r_[first, len(new)])]
        order = np.argsort(both, kind="stable")  # two ascending runs
        both, times = both[order], times[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        self.pairs, self.times = both[first], np.add.reduceat(times, first)
        self._spread()
        self._slots()
        self._shares()
        self.next = 2 * t


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    steps = max(STRETCH, -(-n // LANES))
    return -(-n // steps), steps


class _Log:
    """The steps that the model hasn't taken in yet."""

    def __init__(self, model: _Model, ids: np.ndarray):
        self.model, self.ids = model, ids
        self.notes = np.zeros(ids.shape, np.uint8)
        self.since = self.escapes = 0

    def renew(self, t: int, active) -> None:
        a, b = self.since, t
        steps = range(a, b)
        prev = [self.ids[s - 1, : active[s]] if s else np.zeros(active[s], self.ids.dtype) for s in steps]
        ids, notes = ([x[s, : active[s]] for s in steps] for x in (self.ids, self.notes))
        self.model.renew(t, *[np.concatenate(x) for x in (prev, ids, notes)], self.escapes)
        self.since, self.escapes = t, 0


def _active(n: int, lanes: int, steps: int) -> list[int]:
    """Lanes with an id at each step: the last lane may end sooner."""
    last = n - (lanes - 1) * steps
    return [lanes if t < last else lanes - 1 for t in range(min(steps, n))]


def encode_block(flat: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    """The words of each lane."""
    n = len(flat)
    lanes, steps = _shape(n)
    if not n:
        return []
    if int(flat.max()) >= vocabulary:
        raise ValueError("an id is beyond the vocabulary")
    active = _active(n, lanes, steps)
    ids = np.zeros(lanes * steps, np.int32)
    ids[:n] = flat
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T[: len(active)])
    model = _Model(vocabulary)
    log = _Log(model, ids)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, upto = np.zeros((lanes, steps // 2 + 8), np.uint32), np.zeros(lanes, np.int64)

    def narrow(k, r, lo, wide):
        nonlocal words
        a = low[k] + r * lo
        r = r * wide
        low[k], rng[k] = a, r
        todo = np.flatnonzero(r < _TOP)
        if len(todo):
            lane = todo if isinstance(k, slice) else k[todo]
            a, r = a[todo], r[todo]
            r = np.where((a ^ (a + r)) < _TOP, r, (~a + np.uint64(1)) & _MASK)
            at = upto[lane]
            if at.max() + 1 >= words.shape[1]:
                words = np.pad(words, ((0, 0), (0, words.shape[1] // 2 + 8)))
            words[lane, at] = a >> _W
            upto[lane] = at + 1
            low[lane], rng[lane] = a << _W, r << _W

    before = np.zeros((2, lanes), np.int32)  # the last ids of each lane
    with np.errstate(over="ignore"):
        t = 0
        while t < len(active):
            if t == model.next:
                log.renew(t, active)
            end = min(t + _AHEAD, model.next, len(active))
            x = ids[t:end]
            past = np.concatenate([before, x])
            before, prev = past[-2:], past[1:-1]
            at = model.entry(prev.view(np.uint32), past[:-2].view(np.uint32))
            entry = np.empty_like(x)
            for k, m in enumerate(active[t:end]):
                e = entry[k, :m] = model.named.take(at[k, :m])
                model.follow(at[k, :m], e, e & np.int32(15), (e >> np.int32(4)) == x[k, :m], x[k, :m])
            kind = (entry & np.int32(15)) * np.int32(_WEALTH) + (model.row.take(prev) & np.int32(3))
            by2 = (entry >> np.int32(4)) == x
            pair = prev.astype(np.int64) * vocabulary + x
            found = model.finder.take(model.spot(pair))
            by1 = (model.held.take(found) == pair) & ~by2
            place, wide0, low0 = model.place.take(found), model.wide0.take(x), model.low0.take(x)
            raw = (wide0 == 0) & ~by1 & ~by2
            some = raw.any(axis=1)
            if some.any():
                low0[raw], wide0[raw] = model.low0[-1], model.wide0[-1]
            end2, width1, width0 = model.end2.take(kind), model.width1.take(kind), model.width0.take(kind)
            lo = np.where(by1, end2 + (place >> np.uint32(10)) * width1, model.end1.take(kind) + low0 * width0)
            wide = np.where(by1, (place & np.uint32(1023)) * width1, wide0 * width0)
            lo[by2] = 0
            wide = np.where(by2, end2, wide)
            log.notes[t:end] = kind * np.int32(4) + (by2 * np.uint8(2) + by1)
            for k, m in enumerate(active[t:end]):
                narrow(slice(0, m), rng[:m] >> _R, lo[k, :m], wide[k, :m])
                if some[k] and len(new := np.flatnonzero(raw[k, :m])):
                    narrow(new, rng[new] // np.uint64(vocabulary), x[k, new].astype(np.uint64), np.uint64(1))
                    log.escapes += len(new)
            t = end
    # a multiple of 2**32 inside each lane's range; the decoder reads zeros after it
    tail = ((low + (_TOP - np.uint64(1))) >> _W).astype(np.uint32)
    return [np.r_[words[k, : upto[k]], tail[k]] for k in range(lanes)]


def decode_block(words: np.ndarray, length: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The n ids of a block. words: those of all lanes, one lane after another; length: words of each lane."""
    lanes, steps = _shape(n)
    if len(length) != lanes or int(length.sum()) != len(words):
        raise ValueError("block is cut short")
    if not n:
        return np.zeros(0, np.uint32)
    active = _active(n, lanes, steps)
    ids = np.zeros((len(active), lanes), np.int32)
    model = _Model(vocabulary)
    log = _Log(model, ids)
    at_word = np.cumsum(length) - length
    end = at_word + length
    words = np.r_[words, np.uint32(0)].astype(np.uint64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def pull(lane):
        """The next word of each lane, or zero beyond its end."""
        at = at_word[lane]
        at_word[lane] = at + 1
        return words.take(np.where(at < end[lane], at, len(words) - 1))

    every = np.arange(lanes)
    code = pull(every) << _W
    code |= pull(every)

    def narrow(k, r, lo, wide):
        a = low[k] + r * lo
        r = r * wide
        low[k], rng[k] = a, r
        todo = np.flatnonzero(r < _TOP)
        if len(todo):
            lane = todo if isinstance(k, slice) else k[todo]
            a, r = a[todo], r[todo]
            r = np.where((a ^ (a + r)) < _TOP, r, (~a + np.uint64(1)) & _MASK)
            code[lane] = code[lane] << _W | pull(lane)
            low[lane], rng[lane] = a << _W, r << _W

    last, top = np.uint32((1 << model.bits) - 1), np.uint64((1 << _TOTAL) - 1)
    prev = prev2 = np.zeros(lanes, np.int32)
    with np.errstate(over="ignore"):
        for t, m in enumerate(active):
            if t == model.next:
                log.renew(t, active)
            prev, prev2 = prev[:m], prev2[:m]
            at = model.entry(prev.view(np.uint32), prev2.view(np.uint32))
            entry = model.named.take(at)
            row, conf = model.row.take(prev), entry & np.int32(15)
            kind = conf * np.int32(_WEALTH) + (row & np.int32(3))
            end2, width1, end1 = model.end2.take(kind), model.width1.take(kind), model.end1.take(kind)
            r = rng[:m] >> _R
            q = np.minimum((code[:m] - low[:m]) // r, top).astype(np.uint32)
            by2, by0 = q < end2, np.flatnonzero(q >= end1)
            # as if order 1 had named all; the others are put right below
            slot = np.minimum((q - end2) // np.maximum(width1, np.uint32(1)), np.uint32(SLOTS - 1))
            e = model.slot.take((row >> np.int32(2)) * np.int32(SLOTS) + slot.view(np.int32))
            place = e.astype(np.uint32)
            lo = end2 + (place >> np.uint32(10) & np.uint32(1023)) * width1
            wide = (place & np.uint32(1023)) * width1
            id2 = entry >> np.int32(4)
            lo[by2] = 0
            wide = np.where(by2, end2, wide)
            x = np.where(by2, id2, (e >> 20).astype(np.int32))
            note = kind * np.int32(4) + (by2 + np.int32(1))
            raw = by0
            if len(by0):
                width0, end1 = model.width0.take(kind[by0]), end1[by0]
                x0 = model.owner.take(np.minimum((q[by0] - end1) // width0, last))
                lo[by0] = end1 + model.low0.take(x0) * width0
                wide[by0] = model.wide0.take(x0) * width0
                x[by0] = x0
                note[by0] -= 1
                raw = by0[x0 == vocabulary]
            narrow(slice(0, m), r, lo, wide)
            if len(raw):
                r = rng[raw] // np.uint64(vocabulary)
                y = np.minimum((code[raw] - low[raw]) // r, np.uint64(vocabulary - 1))
                narrow(raw, r, y, np.uint64(1))
                x[raw] = y.astype(np.int32)
                log.escapes += len(raw)
            ids[t, :m] = x
            log.notes[t, :m] = note
            model.follow(at, entry, conf, id2 == x, x)
            prev, prev2 = x, prev
    out = np.zeros((lanes, steps), np.uint32)
    out[:, : len(active)] = ids.T
    return out.reshape(-1)[:n]


class Packer:
    """Builds a segment from documents that come one after another, each in one piece or several. Only coded blocks and
    less than one block of ids are held."""

    def __init__(self, vocabulary: int, block: int = BLOCK):
        self.vocabulary, self.block = vocabulary, block
        self.blocks: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.ids: list = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, ids: list, sizes: list[int], flat: np.ndarray) -> None:
        """Whole documents and their ids, one after another."""
        self.ids += ids
        self.sizes += sizes
        self._take(flat)

    def more(self, flat: np.ndarray) -> None:
        """Further ids of the last document."""
        self.sizes[-1] += len(flat)
        self._take(flat)

    def _take(self, flat: np.ndarray) -> None:
        while len(flat):
            part = flat[: self.block - self.n % self.block]
            self.held.append(part)
            self.n += len(part)
            flat = flat[len(part) :]
            if self.n % self.block == 0:
                self._code()

    def _code(self) -> None:
        flat = np.concatenate(self.held)
        lanes = encode_block(flat, self.vocabulary)
        head = np.array([len(flat), zlib.crc32(flat.astype("<u4").tobytes()), len(lanes), *[len(x) for x in lanes]], "<u4")
        self.blocks.append(b"".join([head.tobytes(), *[x.astype("<u4").tobytes() for x in lanes]]))
        self.held = []

    def segment(self) -> bytes:
        if self.held:
            self._code()
        head = MAGIC + np.array([self.vocabulary, len(self.blocks)], "<u4").tobytes() + np.array([len(self.ids)], "<u8").tobytes()
        return b"".join([head, np.array([d or 0 for d in self.ids], "<i8").tobytes(), np.array([d is None for d in self.ids], np.uint8).tobytes(), np.array(self.sizes, "<u8").tobytes(), *self.blocks])


def unpack(segment: bytes) -> tuple[list, np.ndarray, Iterator[np.ndarray]]:
    """The documents of a segment, the number of ids of each, and the ids, a block at a time. Raises ValueError where a
    checksum fails."""
    if segment[:4] != MAGIC:
        raise ValueError("not a token segment")
    vocabulary, blocks = (int(x) for x in np.frombuffer(segment, "<u4", 2, 4))
    docs = int(np.frombuffer(segment, "<u8", 1, 12)[0])
    at = 20
    doc_ids = np.frombuffer(segment, "<i8", docs, at)
    null = np.frombuffer(segment, np.uint8, docs, at + 8 * docs)
    size = np.frombuffer(segment, "<u8", docs, at + 9 * docs).astype(np.int64)

    def run(at: int):
        for k in range(blocks):
            n, crc, lanes = (int(x) for x in np.frombuffer(segment, "<u4", 3, at))
            length = np.frombuffer(segment, "<u4", lanes, at + 12).astype(np.int64)
            at += 12 + 4 * lanes
            words = np.frombuffer(segment, "<u4", int(length.sum()), at)
            at += 4 * len(words)
            flat = decode_block(words, length, n, vocabulary)
            if zlib.crc32(flat.astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of block {k} fails")
            yield flat

    return [None if z else int(d) for d, z in zip(doc_ids, null)], size, run(at + 17 * docs)
