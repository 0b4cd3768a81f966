"""Verdicts on run-together names don't follow how often they come, nor the size of the table."""

import pytest

from sylvaframe.llm import urls


@pytest.mark.parametrize("n_rows, seen", [(300, 1), (3000, 100), (3000, 1000), (300_000, 1), (300_000, 100_000)])
def test_run_together_host_at_any_count(spark, n_rows, seen):
    bad = "CASE id % 2 WHEN 0 THEN 'cheappills' ELSE 'freecasinobonus' END"
    host = f"CASE WHEN id < {2 * seen} AND id < {n_rows} THEN {bad} ELSE concat('page', translate(id % 1000, '0123456789', 'abcdefghij')) END"
    pages = spark.range(n_rows).selectExpr("id AS page_id", f"concat('http://', {host}, '.example.net/en/', id, '/essex') AS url")
    got = {(r.host, r.verdict) for r in urls.judge(pages).filter("host LIKE 'cheap%' OR host LIKE 'free%' OR page_id = 299").select("host", "verdict").distinct().collect()}
    assert ("cheappills.example.net", "block") in got and ("cheappills.example.net", "allow") not in got
    assert seen == 1 and n_rows == 300 or ("freecasinobonus.example.net", "allow") not in got


def test_words_apart_are_evidence(spark):
    rows = [(i, f"http://h{i}.example.net/essex/cheappills/x") for i in range(50)] + [(50 + i, f"http://my-essex{i}.example.net/") for i in range(5)]
    counts = {r.w: r.n for r in urls.words_apart(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert counts == {"essex": 55, "cheappills": 50, "x": 50, "my": 5}
    for times in (1, 1000, 10**6):
        words = urls.Words({w: c * times for w, c in counts.items()})
        assert words.segment("essex") == ["essex"] and words.segment("cheappills") == ["cheap", "pills"]


def test_words_of_page_texts(spark):
    """Words that pages hold apart split names that no seed would."""
    rows = [(i, f"http://h{i}.example.net/", "<p class=zz>buy now in our online room</p>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = {r.w: r.n for r in urls.words_apart(pages, text_col="html").collect()}
    assert counts == {w: 30 for w in "buy now in our online room".split()}
    words = urls.Words(counts)
    assert words.segment("buyviagranow") == ["buy", "viagra", "now"] and words.segment("onlinepokerroom") == ["online", "poker", "room"]
    more = spark.createDataFrame([(100, "http://buyviagranow.net/", None), (101, "http://garden.net/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages.union(more)).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[0] == "allow"


def test_rules_teach(spark):
    """Words of URLs that a rule blocks count against other URLs; words of the rules' own patterns don't."""
    bad = [(i, f"http://gleep{i}.com/de/snork") for i in range(40)] + [(100 + i, f"http://fine{i}.com/fr/plum") for i in range(40)]
    new = [(200, "http://x.net/en/snork"), (201, "http://x.net/en/plum"), (202, "http://x.net/de/"), (203, "http://snorkplum.net/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(bad + new, "page_id long, url string")).collect()}
    assert got[200].verdict == "block" and got[201].verdict == "allow" and got[201].log_odds < got[202].log_odds < got[200].log_odds
    assert got[0].rule == "com/de/" and got[0].log_odds is None and got[202].verdict == "allow"


def test_names_run_together():
    model = urls.Bayes(urls.Words({"example": 50, "the": 3}), {})
    assert model.words.segment("freecasinobonus") == ["free", "casino", "bonus"]
    assert model.score("cheappills.example.net", "/") > 0 > model.score("citynews.example.net", "/en/1")
    long = "cheappills" * 5000 + "q" * 50_000
    assert model.words.segment(long) == ["cheap", "pills"] * 5000 + ["q" * 50_000]
