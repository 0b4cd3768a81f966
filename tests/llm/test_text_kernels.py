"""Words, hashes, shingles, suffix arrays and wavelet trees against plain Python."""

import numpy as np
import pyarrow as pa
from helpers import ALNUM, WORD, low, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvaframe.llm import decontaminate as dc
from sylvaframe.llm import textops as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\n\t.9ß世", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = tx.buffers(pa.array(texts, pa.string()))
    for table, pattern in ((tx.SPACE, WORD), (tx.PUNCT, ALNUM)):
        starts, ends, doc = tx.words(data, offsets, table)
        got = [[] for _ in texts]
        for s, e, d in zip(starts, ends, doc):
            got[d].append(bytes(tx.LOWER[data[s:e]]).decode())
        assert got == [pattern.findall(low(t)) for t in texts]
        h = tx.hash_words(data, starts, ends)
        seen = {}
        for w, x in zip((w for g in got for w in g), h):
            assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(2, 5))
def test_shingles(texts, k):
    data, offsets = tx.buffers(pa.array(texts, pa.string()))
    starts, ends, doc = tx.words(data, offsets, tx.SPACE)
    full, owner = tx.shingles(tx.hash_words(data, starts, ends), doc, k)
    got = [len(set(full[owner == i].tolist())) for i in range(len(texts))]
    assert got == [len(shingles(t, k)) for t in texts]


def test_long_word_and_slices():
    col = pa.RecordBatch.from_pydict({"t": pa.array(["x" * (tx.LONG * 2 + 5), None, "y", "z" * 100])})
    data, offsets = tx.buffers(col.column("t"))
    s, e, d = tx.words(data, offsets, tx.SPACE)
    assert len(set(tx.hash_words(data, s, e).tolist())) == 3 and list(d) == [0, 2, 3]
    assert [p.num_rows for p in tx.slices(col, "t", 50)] == [1, 2, 1]


def thue_morse(n, a="a", b="b"):
    """Words for which polynomial hashes modulo powers of two fail: theirs equals that of the word with letters swapped."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_no_structure_meets():
    """Words that differ anywhere, and shift, swap or repeat each other's blocks, have hashes of their own."""
    own = [thue_morse(n, *x) for n in (8, 16, 256, 512, 1024, 2048, 65536) for x in ("ab", "ba")]
    own += ["ab" * 8, "ba" * 8, "a" * 9, "a" * 10, "a" * 16, "a" * 17, "12345678abcdefgh", "abcdefgh12345678", *(chr(97 + i) for i in range(26)), *("x" * 30 + chr(97 + i) for i in range(26))]
    data, offsets = tx.buffers(pa.array([" ".join(own)]))
    starts, ends, _ = tx.words(data, offsets, tx.SPACE)
    assert len(starts) == len(own) == len(set(tx.hash_words(data, starts, ends).tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(seq):
    sa = dc.suffix_array(np.array([*[x + 1 for x in seq], 0]))
    full = [*[x + 1 for x in seq], 0]
    assert sa.tolist() == sorted(range(len(full)), key=lambda i: full[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=3))
def test_fm_index(seq, pattern):
    index = dc.FMIndex(np.array([*seq, 0]), 5)
    lo, hi = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert got == [i for i in range(len(seq) - len(pattern) + 1) if seq[i : i + len(pattern)] == pattern]
