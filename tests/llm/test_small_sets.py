"""Near-dedup of small sets at the least similarity that links."""

import random

from helpers import shingles

from sylvaframe.llm import neardup


def pairs_at_the_bound():
    """Texts in pairs: every set size from 1 to 64, every union it can have, the least shared words that still link."""
    rows, n_pair = [], 0
    for n in range(1, 65):
        for union in range(n, n * 100 // 80 + 1):
            inner = -(-union * 80 // 100)
            for turn in range(3):
                own, other = n - inner, union - n
                if own < 0:
                    continue
                word = lambda i: f"p{n_pair}w{i}"  # noqa: B023, E731
                shared = [word(i) for i in range(inner)]
                rows += [(2 * n_pair, " ".join(shared + [word(f"a{i}") for i in range(own)])), (2 * n_pair + 1, " ".join([word(f"b{i}") for i in range(other)] + shared))]
                n_pair += 1
    return rows


def test_every_small_size_at_the_bound(spark):
    rows = pairs_at_the_bound()
    sets = {i: shingles(t, 1) for i, t in rows}
    assert all(100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2))
    assert any(100 * len(sets[i] & sets[i + 1]) == 80 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(df, k=1).collect()}
    missed = sorted({(len(sets[i]), len(sets[i + 1]), len(sets[i] & sets[i + 1])) for i in range(0, len(rows), 2) if got[i + 1] != i or got[i] != i})
    assert not missed


def test_last_word_changed_or_appended(spark):
    ten, four, few = "a b c d e f g h i j", "q r s t u", "k l m n o p q r s t u v w x y z x1 x2"
    rows = [(1, ten), (2, ten.replace("j", "other")), (3, four), (4, four + " more"), (5, few), (6, few + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(df, k=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def headers(n, own=100):
    """Documents that share a header of 100 words; the own text of each is quoted by another document."""
    rng = random.Random(n)
    head = " ".join(f"head{i}" for i in range(100))
    rows = []
    for d in range(n):
        text = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(own))
        rows += [(2 * d, f"{head} {text}"), (2 * d + 1, f"{text} " + " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(own)))]
    return rows


def test_shared_headers_make_few_pairs(spark, monkeypatch):
    """Candidate pairs grow with the documents, not with their square."""
    seen = []
    plain = neardup._crossed
    for n in (100, 200):
        held = []
        monkeypatch.setattr(neardup, "_crossed", lambda *a: held.append(plain(*a)) or held[-1])
        df = spark.createDataFrame(headers(n), "doc_id long, text string")
        assert neardup.groups(df, k=2).filter("not kept").count() == 0
        seen.append(held[0].count())
    assert seen[1] <= 3 * max(seen[0], 100), seen
