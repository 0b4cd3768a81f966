"""Families of texts that are alike to just below a link: no pair of them for each two members."""

import random

import pytest
from helpers import components, shingles

from sylvaframe.llm import neardup


def variant(rng, edits):
    """150 words, some of which are exchanged, each for the same other word in all texts."""
    at = set(rng.sample(range(150), edits))
    return " ".join(f"other{i}" if i in at else f"word{i}" for i in range(150))


def expected(rows):
    sets = {d: shingles(t, 2) for d, t in rows}
    root = components(sets)
    return sorted((d, len(s), root[d]) for d, s in sets.items())


@pytest.fixture
def crossed(monkeypatch):
    """The nodes that meet by rarest values, and their pairs."""
    plain, seen = neardup._crossed, {}

    def spy(nodes, sets, percent):
        out = plain(nodes, sets, percent)
        seen["nodes"], seen["pairs"] = nodes.collect(), (out[0] if isinstance(out, tuple) else out).collect()
        return out

    monkeypatch.setattr(neardup, "_crossed", spy)
    return seen


def test_outside_of_a_large_component(spark, crossed):
    """Who shares a list with one member of a large component and nobody else meets the component in blocks."""
    rng = random.Random(5)
    rows = [(0, variant(rng, 0)), *[(1 + i, variant(rng, 3)) for i in range(60)], *[(100 + i, variant(rng, 9)) for i in range(60)]]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    want = expected(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    linked = [d for d, _, root in want if root == 0]
    assert neardup.LARGE < len(linked) < len(rows)
    assert not {r.node for r in crossed["nodes"]} & set(range(61))


def test_family_without_a_component(spark, crossed, monkeypatch):
    """Nodes of a value that many hold are compared in blocks and leave links alone."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    rows = [(i, variant(rng, 7)) for i in range(120)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    want = expected(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 60 < len({root for _, _, root in want}) < 120
    assert len(crossed["nodes"]) == 120 and len(crossed["pairs"]) < 3000  # of 7140
