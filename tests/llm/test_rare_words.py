"""Language-model scores of words outside the vocabulary."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sylvaframe.llm import masked_lm
from sylvaframe.llm import textops as tx


def hashes(text):
    data, offsets = tx.buffers(pa.array([text]))
    starts, ends, _ = tx.words(data, offsets, tx.SPACE)
    return tx.hash_words(data, starts, ends).tolist()


@pytest.mark.parametrize("near", [0, 300, 1 << 18])
def test_bucketed_words_have_their_own_probability(spark, monkeypatch, near):
    """Scores equal bucket probability times the word's share, wherever the counts are held; shares of a bucket sum to 1."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) % 20_000) for _ in range(60)]
    texts += [" ".join(f"v{i} v{i}" for i in range(k, 4000, 8)) for k in range(8)]
    docs = spark.createDataFrame([*enumerate(texts), (99, "w1 gibberish-never-seen w2"), (None, "v1 once")], "doc_id long, text string")
    fitted = docs.filter("doc_id <> 99 OR doc_id IS NULL")
    monkeypatch.setattr(masked_lm, "NEAR", near)
    words, rank, flat = model = masked_lm.fit(fitted)
    assert (words.far is None) == (near > 300)
    n = Counter(h for r in fitted.collect() for h in hashes(r.text))
    top = set(words.top.tolist())
    full = Counter()
    for h, c in n.items():
        full[h % masked_lm.BUCKETS] += c * (h not in top)
    net = masked_lm.Network(flat)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, model).collect()}
    for r in docs.collect():
        part = pa.record_batch([pa.array([r.text])], names=["text"])
        ids, doc, _ = masked_lm._tokens(part, words.top, rank, masked_lm.BUCKETS)
        inside = sum(np.log(max(1, n[h]) / (full[h % masked_lm.BUCKETS] + 1)) for h in hashes(r.text) if h not in top)
        assert np.isclose(got[r.doc_id], net.log_probs(ids, doc).sum() + inside)
