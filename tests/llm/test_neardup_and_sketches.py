"""Near-dedup, components, fingerprints, language-model scores, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import WORD, awkward, components, empty, low, shingles
from pyspark.sql import functions as F

from sylvaframe.llm import fingerprint, language, masked_lm, neardup, oracles
from sylvaframe.llm.graph import components as connected
from sylvaframe.llm.queries import QUERIES


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_groups(rows, k):
    """Rows with equal ids are one document; each row keeps its own set's size."""
    sets = {(i, d): shingles(t, k) for i, (d, t) in enumerate(rows)}
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = [k for k in sets if k[1] is not None]
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a[1]), find(b[1])
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[i, d]), find(d)) for i, d in keys)


@pytest.mark.parametrize("k", [2, 5])
def test_random_near_copies(spark, k):
    rng = random.Random(k)
    rows = []
    for base in range(12):
        text = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(int(len(copy) * rng.choice([0, 0.02, 0.05, 0.1]))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows) * 3 % 101, " ".join(copy)))
    shared = " ".join(f"common{i}" for i in range(60))
    rows += [(200 + i, f"{shared} own{i} text{i}") for i in range(20)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query(spark, sf):
    sets = {r.doc_id: shingles(r.text, 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_bottom_k"](spark, sf).collect()}
    root = components(sets)
    assert got == {d: (len(s), root[d], root[d] == d) for d, s in sets.items()}


def test_neardup_awkward(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = neardup.groups(df, k=2).collect()
    assert len(got) == 15
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == plain_groups(rows, 2)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = neardup.deduplicated(df, k=2)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 8, 9, 10, 11, 12, -7, None]))
    assert neardup.groups(empty(spark)).count() == 0 and neardup.deduplicated(empty(spark)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in neardup.groups(clash, k=2).collect()} == {1}


M64 = (1 << 64) - 1
P = 0x9E3779B97F4A7C15 | 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


KEY = 0x8D1F2A64C93B57E1


def plain_word(raw):
    """A word's hash, eight bytes at a time."""
    if len(raw) > 512:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=KEY.to_bytes(8, "little")).digest(), "little")
    h = mixed(int.from_bytes(raw[:8], "little") ^ mixed(len(raw) * P + KEY & M64))
    for i in range(8, len(raw), 8):
        h = mixed((h ^ int.from_bytes(raw[i : i + 8], "little")) * P + KEY & M64)
    return h


def plain_hashes(text, k=5):
    """The 40-bit shingle hashes of a text, by Python integers."""
    words = [plain_word(w.encode()) for w in WORD.findall(low(text))]
    weight = [mixed(j * P & M64) | 1 for j in range(1, k + 1)]
    runs = [words] if 0 < len(words) < k else [words[i : i + k] for i in range(len(words) - k + 1)]
    return {mixed((sum(h * c for h, c in zip(run, weight)) & M64) ^ len(run)) >> 24 for run in runs}


def plain_likeness(x, y):
    if not x or not y:
        return float(len(x) == len(y))
    few = lambda s: s if len(s) <= fingerprint.WHOLE else {h for h in s if h < (1 << 40) // 4}
    x, y = sorted((x, y), key=len)
    own = few(x) if few(y) == y else {h for h in x if h < (1 << 40) // 4}
    if len(x) == len(y) and len(few(y)) > len(own):
        own = few(y)
        return len(own & few(x)) / len(own)
    return len(own & few(y)) / len(own) if own else float(len(x) == len(y) and few(x) == few(y))


def test_fingerprint_query(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op10_scaled_sketch"](spark, sf).collect()}
    assert len(got) == len(docs)
    sets = [plain_hashes(t) for _, t in docs]
    for i, (d, t) in enumerate(docs):
        x, c = docs[(i + 1) % len(docs)][1], len(t) // 3
        edited = t[: len(t) - c] + x[:c]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        new = plain_hashes(edited)
        for full, fp in ((sets[i], r.fingerprint), (new, r.edited_fingerprint)):
            sketch = fingerprint.read(fp)
            assert sketch.n == len(full) and set(sketch.kept.tolist()) == (full if len(full) <= fingerprint.WHOLE else {h for h in full if h < (1 << 40) // 4})
        assert r.near_next == pytest.approx(plain_likeness(sets[i], sets[(i + 1) % len(docs)]))
        assert r.near_edited == pytest.approx(plain_likeness(sets[i], new))
        # from the returned strings alone
        assert r.near_edited == fingerprint.alike(fingerprint.read(r.fingerprint), fingerprint.read(r.edited_fingerprint))
        assert r.near_next == fingerprint.alike(fingerprint.read(r.fingerprint), fingerprint.read(got[docs[(i + 1) % len(docs)][0]].fingerprint))


def test_sketches_estimate_containment():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10_000)}" for _ in range(6000)]
    texts = [" ".join(words), " ".join(words[1000:1800]), " ".join(words[:3000] + [f"z{i}" for i in range(500)])]
    a, b, c = fingerprint.sketches(pa.array(texts))
    assert fingerprint.likeness(a, b) == pytest.approx(1, abs=0.03)
    assert fingerprint.likeness(a, c) == pytest.approx(len(shingles(texts[0], 5) & shingles(texts[2], 5)) / len(shingles(texts[2], 5)), abs=0.06)
    assert fingerprint.likeness(b, c) == pytest.approx(1, abs=0.03)
    (few,) = fingerprint.sketches(pa.array([" ".join(words[:50])]))
    assert np.array_equal(fingerprint.read(fingerprint.written(few)).kept, few.kept)
    x, y, z = fingerprint.sketches(pa.array(["p q r s t u v w x y", "a b c d e f g h i j", ""]))
    assert fingerprint.likeness(x, y) == 0 and fingerprint.likeness(z, z) == 1 and fingerprint.likeness(x, z) == 0
    union = fingerprint.merge(a, c)
    assert set(union.kept.tolist()) == set(a.kept.tolist()) | set(c.kept.tolist())
    assert fingerprint.merge(x, y).n == 12 and fingerprint.likeness(fingerprint.merge(x, y), x) == 1


def test_small_texts_inside_large_ones():
    """A few words taken from inside a long text are contained in it, or the sketches say that they can't tell."""
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10_000)}" for _ in range(5000)]
    texts = [" ".join(words), *[" ".join(words[i : i + 7]) for i in range(0, 4900, 50)], *[" ".join(f"q{i + j}" for j in range(7)) for i in range(0, 700, 7)]]
    large, *small = fingerprint.sketches(pa.array(texts))
    full, *sets = fingerprint.shingle_sets(pa.array(texts))
    inside, outside = ([fingerprint.likeness(x, large) for x in part] for part in (small[:98], small[98:]))
    assert set(inside) <= {1.0, None} and set(outside) <= {0.0, None} and 0 < inside.count(None) < 60
    assert all(fingerprint.alike(x, large) == (fingerprint.likeness(x, large) or 0.0) for x in small)
    assert len(full) == large.n and all(len(x) == y.n for x, y in zip(sets, small))


def test_fingerprint_awkward(spark):
    rows = fingerprint.edited_fingerprints(awkward(spark)).collect()
    assert len(rows) == 15 and {r.doc_id: r.n_chars for r in rows}[5] == 0
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[1] == by[2] != by[3] and by[6] == by[7]
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0
    assert fingerprint.fingerprints(awkward(spark)).count() == 15
    one = fingerprint.edited_fingerprints(awkward(spark).filter("doc_id = 8")).first()
    assert one.near_next == 1.0


def test_gradient():
    """One step against finite differences of the pseudo-likelihood."""
    net = masked_lm.Network.fresh(dim=4, classes=3, members=4)
    net = masked_lm.Network(net.flat.astype(np.float64), 4, 3, 4)
    ids, doc = np.array([0, 5, 11, 3, 3, 7]), np.array([0, 0, 0, 1, 1, 1])
    total = lambda flat: -masked_lm.Network(flat, 4, 3, 4).log_probs(ids, doc).sum()
    grad = np.zeros_like(net.flat)
    for i in range(len(grad)):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        grad[i] = (total(up) - total(down)) / 2e-5
    past = masked_lm.Network(np.zeros_like(net.flat), 4, 3, 4)
    net.step(ids, doc, 0.0, past)
    assert np.allclose(np.sqrt(past.flat), np.abs(grad), atol=1e-3)


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = masked_lm.fit(docs)
    rows = masked_lm.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r.log_likelihood <= 0 for r in rows)
    text = docs.filter("lang = 'en' and n_chars between 1000 and 4000").orderBy("doc_id").first().text
    words = text.split()
    random.Random(3).shuffle(words)
    pair = spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string")
    a, b = (r.mean_log_likelihood for r in masked_lm.score(pair, model).orderBy("doc_id").collect())
    fresh = (*model[:2], masked_lm.Network.fresh().flat)
    untrained = masked_lm.score(pair, fresh).orderBy("doc_id").first().mean_log_likelihood
    assert a > untrained and a > b


def test_scores_equal_plain_loops(spark):
    """Every token's conditional probability and its share of its bucket, by loops over the network's numbers."""
    texts = {1: "a b c a b d e", 2: "d e f a", 3: "zz a", 4: "", 5: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = masked_lm.fit(docs)
    net = masked_lm.Network(model[2])
    count = Counter(w for t in texts.values() for w in t.split())
    code = lambda w: int(masked_lm.tx.hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])
    top = sorted(count, key=lambda w: (-count[w], np.uint64(code(w)).view(np.int64)))
    number = {w: i + masked_lm.BUCKETS for i, w in enumerate(top)}
    test = {**texts, 6: "a unseen b"}
    for d, text in test.items():
        ids = [number.get(w, code(w) % masked_lm.BUCKETS) for w in text.split()]
        total = 0.0
        for i, x in enumerate(ids):
            s = net.bias.astype(float).copy()
            for k, o in enumerate([o for o in range(-masked_lm.SIDE, masked_lm.SIDE + 1) if o]):
                if 0 <= i + o < len(ids):
                    s += net.emb[ids[i + o]].astype(float) * net.off[k]
            h = np.tanh(s)
            c, m = divmod(x, masked_lm.MEMBERS)
            for z, want in ((h @ net.wc + net.bc, c), (h @ net.wm[c] + net.bm[c], m)):
                total += z[want] - math.log(sum(math.exp(v) for v in z))
            if x < masked_lm.BUCKETS:  # a word the corpus doesn't have: one more token of its bucket
                total -= math.log(1)
        got = masked_lm.score(spark.createDataFrame([(d, text)], "doc_id long, text string"), model).first()
        assert got.n_tokens == len(ids) and got.log_likelihood == pytest.approx(total, abs=1e-3)


def test_language_model_learns_order(spark):
    """In texts where each kind of word follows another, the true order must score well above a shuffled one."""
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    texts = [" ".join(rng.choice(kinds[i % 4]) for i in range(rng.randint(40, 400))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = masked_lm.fit(docs.repartition(4, "doc_id"))
    fresh = [" ".join(rng.choice(kinds[i % 4]) for i in range(200)) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 200)) for t in fresh]
    got = {r.doc_id: r.mean_log_likelihood for r in masked_lm.score(spark.createDataFrame(list(enumerate(fresh + mixed)), "doc_id long, text string"), model).collect()}
    gaps = [got[i] - got[i + 20] for i in range(20)]
    assert min(gaps) > 0.5, gaps


def test_language_model_partitions(spark):
    """Scores don't depend on how the table is cut, in one round or in several, and beat word frequencies well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [w for r in docs.collect() for w in (r.text or "").split()]
    count = Counter(words)
    plain = sum(n * math.log(n / len(words)) for n in count.values()) / len(words)
    true = {}
    for parts in (1, 8, 64):
        model = masked_lm.fit(docs.repartition(parts))
        true[parts] = masked_lm.score(docs, model).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert max(true.values()) - min(true.values()) < 1e-3 and min(true.values()) > plain + 0.5, (true, plain)
    rng = random.Random(2)
    mixed = spark.createDataFrame([(r.doc_id, " ".join(rng.sample(r.text.split(), len(r.text.split())))) for r in docs.collect() if r.text], "doc_id long, text string")
    assert masked_lm.score(mixed, model).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0] < true[64] - 0.3
    small = [masked_lm.fit(docs.repartition(parts), unit=300_000)[2] for parts in (1, 8)]
    assert np.abs(small[0] - small[1]).max() < 1e-3
    several = masked_lm.score(docs, (*model[:2], small[0])).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert several > plain + 0.4, (several, plain)


def test_rounds():
    assert masked_lm._rounds(0) == [] and masked_lm._rounds(1) == [(0, 1)]
    assert masked_lm._rounds(52) == [(0, 1), (1, 4), (4, 16), (16, 52)]


def test_vocabulary_cut(spark):
    """Words of the count at which the vocabulary would overflow are all left out."""
    texts = ["x x x x y y y z z z u u v w", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {n: len(masked_lm.vocabulary(docs, n)[0].top) for n in (1, 2, 3, 4, 5, 6, 9)}
    assert sizes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 9: 6}


def test_language_model_awkward(spark):
    model = masked_lm.fit(awkward(spark))
    got = {r.doc_id: r for r in masked_lm.score(awkward(spark), model).collect()}
    assert got[4].log_likelihood == 0 and got[5].mean_log_likelihood is None and got[6].n_tokens == 1
    assert masked_lm.score(empty(spark), masked_lm.fit(empty(spark))).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = neardup.stored(out, "test")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    a, b, c, d, e = seen.values()
    from test_filters import plain_hits, plain_language
    from test_shards_and_mixing import plain_tree

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts, source = {r.doc_id: r.text for r in rows}, {r.doc_id: r.source for r in rows}
    train = [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None]
    found = dict(zip(texts, plain_language(train, texts.values(), sorted({k for k, _ in train}))))
    assert sorted(a) == sorted(i for i, (lang, score) in found.items() if lang != "und" and score >= language.LEAST)
    root = components({i: shingles(texts[i], 5) for i in a})
    assert sorted(b) == sorted(i for i in a if root[i] == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {i for i, x in plain_hits([(i, texts[i]) for i in b], items).items() if x[4]}
    assert sorted(c) == sorted(set(b) - dirty) and dirty
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": c, "text": [texts[i] for i in c], "source": [source[i] for i in c]}))
    copies = {i: taken // size if size else None for i, size, taken in con.sql(oracles.MIXING).select("doc_id, size, taken").fetchall()}
    assert all(d.count(i) == n for i, n in copies.items() if n is not None) and sorted(d) == sorted(e)
    sizes = [(len(texts[i].encode()) + 1, len(texts[i].encode()) - len(texts[i]), zlib.crc32(texts[i].encode()), i) for i in set(d)]
    extent = [max(1, max(x[k] for x in sizes) - min(x[k] for x in sizes)) for k in range(3)]
    shard: dict = {}
    plain_tree([(x[0], x[1], x[2], x[3], n) for x in sizes for n in range(d.count(x[3]))], 8, 0, extent, shard)
    assert {(r.doc_id, r.shard) for r in docs.collect()} == {(x[3], k) for x, k in shard.items()}
    assert low("ABC") == "abc"
    for table in (awkward(spark), empty(spark)):
        for _, stage in cp.STAGES:
            table = neardup.stored(stage(spark, table, sf), "edge")
