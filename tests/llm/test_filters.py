"""URL filter, language spans, decontamination."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, awkward, empty, low

from sylvaframe.llm import decontaminate, language, oracles, urls
from sylvaframe.llm.queries import QUERIES


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return low(rest[:end]), path


def letter_runs(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def best_split(cost, unknown, word):
    """Every split of a word tried, last word first."""
    memo = {"": (0.0, [])}

    def go(w):
        if w not in memo:
            options = []
            for i in range(len(w)):
                c = max(cost.get(w[i:], -math.inf), unknown - urls.LETTER * (len(w) - i))
                s, parts = go(w[:i])
                options.append((round(s + c, 9), -i, [*parts, w[i:]]))
            x = max(options, key=lambda o: o[:2])
            memo[w] = x[0], x[2]
        return memo[w]

    return go(word)[1]


def plain_model(pages):
    """Unigrams and naive Bayes by counting in plain Python. pages: (url, html)."""
    apart = collections.Counter()
    by_host = set()
    for url, html in pages:
        host, path = plain_parts(url)
        for label in host.split("."):
            runs = letter_runs(label)
            by_host |= {(host, w) for w in runs if "-" in label and len(runs) > 1}
        by_host |= {(host, w) for w in letter_runs(path)}
        apart.update(set(letter_runs(re.sub("<[^>]*>", " ", html or ""))))
    apart.update(w for _, w in by_host)
    seeds = {*urls.BLOCKED, *urls.ALLOWED}
    known = set(seeds)

    def joined(w):
        ends = {0: {False}}
        for j in range(1, len(w) + 1):
            ends[j] = {s or w[i:j] in seeds for i in range(j - 2) for s in ends[i] if w[i:j] in known}
        return True in ends[len(w)]

    for w in sorted(set(apart) - seeds, key=lambda w: (len(w), w)):
        if not joined(w):
            known.add(w)
    weight = sum(apart[w] for w in known)
    share = min(1, urls.UNIGRAM * len(seeds) / max(1, weight))
    count = {w: urls.UNIGRAM * (w in seeds) + share * apart[w] for w in known}
    total = sum(count.values())
    cost, unknown, memo = {w: math.log(c / total) for w, c in count.items()}, math.log(1 / total), {}

    def segments(word):
        if word not in memo:
            memo[word] = best_split(cost, unknown, word)
        return memo[word]

    own = {w for h, p, _ in urls.RULES for w in letter_runs(h) + letter_runs(p)}
    hosts = set()
    for url, _ in pages:
        host, path = plain_parts(url)
        verdict = plain_rule(host, path)[1]
        if verdict:
            hosts |= {(host, verdict, w) for x in letter_runs(host) + letter_runs(path) for w in segments(x) if w not in own}
    of = {k: collections.Counter({w: urls.SEED for w in s}) for k, s in (("block", urls.BLOCKED), ("allow", urls.ALLOWED))}
    for _, verdict, w in hosts:
        of[verdict][w] += 1
    both = set(of["block"]) | set(of["allow"])
    p = lambda k, w: (of[k][w] + urls.ALPHA) / (sum(of[k].values()) + urls.ALPHA * len(both))
    odds = {w: math.log(p("block", w)) - math.log(p("allow", w)) for w in both}
    return lambda host, path: math.log(urls.PRIOR / (1 - urls.PRIOR)) + sum(odds.get(w, 0) for x in letter_runs(host) + letter_runs(path) for w in segments(x))


def test_url_query(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    score = plain_model([(u, h) for _, u, h in pages])
    got = {r.page_id: r for r in QUERIES["op4_url_words"](spark, sf).collect()}
    assert len(got) == len(pages)
    for i, url, _ in pages:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict is None:
            assert r.log_odds == pytest.approx(score(host, path), abs=1e-6)
            assert r.verdict == ("block" if score(host, path) > 0 else "allow")
        else:
            assert (r.verdict, r.log_odds) == (verdict, None)


@pytest.mark.parametrize("word", ["cheappillsfarm", "freecasinobonus", "thththe", "newsblogdocs", "zzzz", "xcheap", "cheapx", "a"])
def test_segments_equal_all_splits(word):
    words = urls.Words({"example": 50, "the": 30, "eat": 4})
    assert words.segment(word) == best_split(words.cost, words.unknown, word)


def test_url_awkward(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Spam-Farm.EXAMPLE.net?x://y/z"), (5, "https://a.com/fr/x#y"), (5, "https://a.com/fr/x#y"), (6, "x://" + "a" * 50_000 + "/p"), (7, "http://org"), (8, "http://b.example.org/en/12")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'c' AS host", "'c' AS rule", "'c' AS path")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, url in rows:
        assert (got[i].host, got[i].path) == plain_parts(url)
    assert got[4].verdict == "block" and got[5].rule == "com/fr/" and got[1].verdict == "allow" and got[7].rule is None and got[8].rule == "example.org/en/1"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_language_spans"](spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def letter_words(text):
    """Runs of ASCII letters and of bytes beyond ASCII, as bytes in ASCII lower case."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[a-z\x80-\xff]+", raw)


def trigrams(word):
    padded = [0, *word, 0]
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(padded, padded[1:], padded[2:])]


def plain_language(train, texts, langs):
    """Language and share of each text, by counting trigrams and Viterbi in plain Python. All texts are in Latin script."""
    grams = {k: collections.Counter() for k in langs}
    for lang, text in train:
        for w in letter_words(text):
            grams[lang].update(trigrams(w))
    total = {k: sum(g.values()) + 0.1 * language.GRAMS for k, g in grams.items()}
    logp = lambda k, g: math.log((grams[k][g] + 0.1) / total[k])
    memo, out = {}, []
    for text in texts:
        words, scores = letter_words(text), []
        for w in words:
            if w not in memo:
                own = [sum(logp(k, g) for g in trigrams(w)) for k in langs]
                memo[w] = [max(x - max(own), 2 * language.FOREIGN) for x in own]
            scores.append(memo[w])
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        held = collections.Counter({k: 0 for k in range(len(langs))})
        for w, k in zip(words, viterbi(scores, language.SWITCH)):
            held[k] += len(w)
        best = max(held, key=lambda k: (held[k], -k))
        out.append((langs[best], held[best] / sum(held.values())))
    return out


def test_language_query_equals_plain_python(spark, sf):
    docs = sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    train = [(lang, t) for i, t, lang in docs if lang is not None and t is not None and not held[i]]
    want = plain_language(train, [t for _, t, _ in docs], sorted({lang for lang, _ in train}))
    got = {r.doc_id: r for r in QUERIES["op5_language_spans"](spark, sf).collect()}
    for (i, _, _), (lang, score) in zip(docs, want):
        # words between two spans may fall to either side where sums of single and double precision differ
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=0.02)


def test_accepted(spark):
    """Labels are filled in and put right by the text; texts in no one language go."""
    import itertools

    words = {"en": "the quick brown fox jumps over lazy dogs while thinking".split(), "fr": "une très belle journée pour être à la plage".split(), "de": "größe straße über für und nicht schön".split()}
    rows = [(i, " ".join(w * 8), lang) for i, (lang, w) in enumerate(list(words.items()) * 5)]
    mix = " ".join(itertools.chain(*[words[k] * 6 for k in ("en", "fr", "de")]))
    more = [(100, " ".join(words["en"] * 4), None), (101, " ".join(words["de"] * 4), "fr"), (102, "1234 !!", "en"), (103, mix, None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    model = language.train(docs.filter("doc_id < 100"))
    got = {r.doc_id: r.lang for r in language.accepted(docs, model).collect()}
    assert got[100] == "en" and got[101] == "de" and 102 not in got and all(got[i] == lang for i, _, lang in rows)
    assert 103 not in {r.doc_id for r in language.accepted(docs, model, least=0.7).collect()}


def viterbi(scores, switch):
    best, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(len(s)), key=lambda i: (best[i], -i))
        back.append([top if best[top] - switch > best[i] else i for i in range(len(s))])
        best = [max(best[i], best[top] - switch) + s[i] for i in range(len(s))]
    path = [max(range(len(best)), key=lambda i: (best[i], -i))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_spans_equal_plain_viterbi():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], np.zeros((language.GRAMS, 3), np.float32), np.ones((len(language.SCRIPTS), 3), bool))
    counts = np.array([5, 1, 30, 12])
    scores = rng.integers(-8, 1, (48, 3)).astype(np.float32) + rng.random((48, 3), np.float32) / 100
    got = model.spans(scores, counts, 6.0)
    want = [x for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts)) for x in viterbi(scores[a:b].tolist(), 6.0)]
    assert got.tolist() == want


def test_mixed_text_is_split_into_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang in ('en', 'de')")
    model = language.train(docs)
    a, b = (next(r.text for r in docs.filter(f"lang = '{x}' and n_chars between 800 and 3000").orderBy("doc_id").collect()) for x in ("en", "de"))
    names, score = model.predict(pa.array([a + " " + b + " " + b + " " + b, a]))
    assert names == ["de", "en"] and 0.4 < score[0] < 0.95


def test_language_awkward(spark):
    model = language.train(awkward(spark))
    rows = language.predict(awkward(spark), model, keep=("doc_id",)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert got[4] == got[5] == got[9] == ("und", 0.0) and got[10][0] == "de" and got[-7][0] == "ja" and len(rows) == 15
    kept = language.accepted(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == 12
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.predict(awkward(spark), nothing).collect()} == {"und"}
    assert language.predict(empty(spark), model, keep=("doc_id",)).count() == 0


def plain_hits(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for d, t in texts:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate_query(spark, sf):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark")]
    want = plain_hits([(r.doc_id, r.text) for r in tables[0]], [(r.item_id, r.text) for r in tables[1]])
    got = QUERIES["op8_fm_decontaminate"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and any(x[4] for x in want.values())


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontaminate_awkward(spark, block_bytes):
    items = [(1, "one"), (2, None), (3, ""), (4, "Two words"), (5, "word1 and text1 word2 and text2 word3 and text3 word4 and text4"), (6, "ONE"), (7, "aa aa aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = awkward(spark).unionByName(spark.createDataFrame([(20, "aa aa aa aa aa, aa bb aa")], "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.verdicts(docs, bench, block_bytes=block_bytes).collect()}
    assert got == plain_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if not got[r.doc_id][4])
    assert decontaminate.verdicts(empty(spark), bench).count() == 0
    none = decontaminate.verdicts(awkward(spark), bench.limit(0)).collect()
    assert len(none) == 15 and not any(r.contaminated for r in none)


@pytest.mark.parametrize("name, sql", [("op6_bottom_k", oracles.NEARDUP), ("op7_hash_mix", oracles.MIXING), ("op8_fm_decontaminate", oracles.DECONTAMINATE)])
def test_sql(spark, sf, name, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(sql).df(), QUERIES[name](spark, sf).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(got[names].itertuples(index=False, name=None)) == sorted(want[names].itertuples(index=False, name=None))


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [(1, f"ébefore. {item}, áfter"), (2, "one two three"), (3, item), (4, None), (5, f"x {item.upper()} y {item}!")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'c' AS items")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.removed(docs, bench).collect()}
    assert [got[i].text for i in range(1, 6)] == ["ébefore. , áfter", "one two three", "", None, "x  y !"] and got[1].items == "c"
    more = spark.createDataFrame([(i, f"a{i} b c d e f g h i j k{i}") for i in range(30)], "item_id long, text string").union(bench)
    few = decontaminate.verdicts(docs, more, block_bytes=40)
    assert {r.doc_id: r.n_hit for r in few.collect()} == {1: 11, 2: 0, 3: 11, 4: 0, 5: 22}


def test_clean(spark):
    import os

    from sylvaframe.llm import common

    common.stored(spark.range(3), "gone")
    root = common.shared_dir(spark).removeprefix("file://") + "/sylvaframe"
    assert os.path.exists(root)
    common.clean(spark)
    assert not os.path.exists(root) and common.stored(spark.range(3), "again").count() == 3
