"""URL filters: rules first, then naive Bayes over segmented host and path words.

Host and path are cut by built-in string functions, and the rules are one CASE expression, longest first. A URL that no
rule fits is judged by its words: names run together (``cheappills``) are split by a Viterbi search over unigram
probabilities, and a multinomial naive Bayes model scores the words of host and path.

The unigram table starts from stated seed words and adds words that stand apart somewhere in the table: in page texts
(``html``, if there is such a column, counted by pages), in hyphenated host labels and in paths (counted by hosts), together
of the seeds' weight at most. A host label without hyphens is what is judged and no evidence of itself, however often it
comes, and names that are whole known words run together (a seed among them) are none either; so verdicts don't follow the
size of the table. The words that reach the least count which at most ``vocabulary`` words have are kept, a bound on the
model and not on the rows. Unknown letters are words of any length, at a cost for the word and for each letter.

Naive Bayes learns from the URLs that the rules decide: the segmented words of each distinct host and its paths count for
the rule's class, one for each host, beside the seeds of the class, ``SEED`` each. Words that the rules' own patterns hold
are no evidence of anything but the rule and are left out. Words that neither class knows say nothing.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and no words, and is allowed; log odds
of 0 allow; a null page text has no words; equal URLs, and repeated rows, have equal verdicts; very long labels are
segmented in linear time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent, shipped

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Letters of the least part that shows a name to be words run together.
PART = 3
VOCABULARY = 50_000
#: Occurrences that a seed word counts for, in the unigram table and in its class.
UNIGRAM, SEED = 1000, 50
#: Cost of an unknown letter, in nats.
LETTER = 3.0
#: Share of URLs that are to be blocked, and what each class has of every word beforehand.
PRIOR, ALPHA = 0.2, 0.1
#: Seed words of the two classes.
BLOCKED = "spam farm cheap pills pill casino poker bet betting viagra cialis pharma loan loans payday crack warez torrent keygen serial porn xxx sex adult escort nude hack hacked malware phishing scam replica fake free click clicks bonus jackpot slots lottery winner prize discount deal coupon seo backlink links traffic bot".split()
ALLOWED = "news blog docs wiki mail shop store school university library museum science health city travel food book books music art history sport sports weather garden family community research data code help support about contact forum photo photos video world local times post press journal review guide home work info team learn open public".split()


def _rest(url: str | Column) -> Column:
    """What follows the first ``://``; else empty."""
    c = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", c)
    return F.coalesce(F.when(at > 0, F.substring(c, at + 3, F.length(c))), F.lit(""))


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


_WORD = re.compile(r"[^\W\d_]+")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Words:
    """Unigram segmentation. counts: how often a word stands apart, added to the seeds."""

    def __init__(self, counts: dict[str, int], seeds=(*BLOCKED, *ALLOWED)):
        known = {w: float(UNIGRAM) for w in seeds}
        apart = set(known)
        for w in sorted((w for w in counts if w not in known), key=lambda w: (len(w), w)):
            if not self._joined(w, apart, known):
                apart.add(w)
        # the corpus weighs as much as the seeds at most, so that the weight of a seed doesn't fade as tables grow
        share = min(1.0, sum(known.values()) / max(1, sum(counts.get(w, 0) for w in apart)))
        for w in apart:
            known[w] = known.get(w, 0.0) + counts.get(w, 0) * share
        total = sum(known.values())
        self.cost = {w: math.log(c / total) for w, c in known.items()}
        self.unknown = math.log(1 / total)
        self.longest = max(map(len, known), default=0)
        self.held: dict[str, list[str]] = {}

    @staticmethod
    def _joined(word: str, apart: set, seeds: dict) -> bool:
        """Whether a word consists of known words of PART letters at least, a seed among them."""
        plain, seeded = [True] + [False] * len(word), [False] * (len(word) + 1)
        for j in range(PART, len(word) + 1):
            for i in range(j - PART + 1):
                if (plain[i] or seeded[i]) and word[i:j] in apart:
                    plain[j] = True
                    seeded[j] = seeded[j] or seeded[i] or word[i:j] in seeds
        return seeded[-1]

    def segment(self, word: str) -> list[str]:
        """The most probable split into known words and unknown ones of any length. Of equals, the one whose last word is
        the longest."""
        found = self.held.get(word)
        if found is not None:
            return found
        n = len(word)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        strange, since = -math.inf, 0  # the best split that ends in an unknown word, and where that begins
        for j in range(1, n + 1):
            if best[j - 1] + self.unknown > strange:
                strange, since = best[j - 1] + self.unknown, j - 1
            strange -= LETTER
            best[j], back[j] = strange, since
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(word[i:j])
                if c is not None and (best[i] + c > best[j] or (best[i] + c == best[j] and i < back[j])):
                    best[j], back[j] = best[i] + c, i
        out = []
        while n:
            out.append(word[back[n] : n])
            n = back[n]
        if len(self.held) < 1 << 18:
            self.held[word] = out[::-1]
        return out[::-1]

    def words(self, host: str, path: str) -> list[str]:
        return [w for x in split_words(host) + split_words(path) for w in self.segment(x)]


class Bayes:
    """Multinomial naive Bayes over segmented words. seen: (word, verdict) to the number of hosts."""

    def __init__(self, words: Words, seen: dict[tuple[str, str], int], blocked=BLOCKED, allowed=ALLOWED, prior: float = PRIOR, alpha: float = ALPHA):
        self.words = words
        count = {"block": Counter({w: SEED for w in blocked}), "allow": Counter({w: SEED for w in allowed})}
        for (w, verdict), n in seen.items():
            count[verdict][w] += n
        vocabulary = set(count["block"]) | set(count["allow"])
        total = {k: sum(c.values()) for k, c in count.items()}
        share = lambda k, w: (count[k][w] + alpha) / (total[k] + alpha * len(vocabulary))
        self.log_odds = {w: math.log(share("block", w) / share("allow", w)) for w in vocabulary}
        self.prior = math.log(prior / (1 - prior))
        self.held: dict[str, float] = {}

    def word(self, word: str) -> float:
        """What a word says once it is segmented."""
        if word not in self.held:
            if len(self.held) >= 1 << 18:
                self.held.clear()
            self.held[word] = math.fsum(self.log_odds.get(w, 0.0) for w in self.words.segment(word))
        return self.held[word]

    def score(self, host: str, path: str) -> float:
        """Log odds that a URL is to be blocked."""
        return self.prior + math.fsum(self.word(w) for w in split_words(host) + split_words(path))


def _letters(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")


def words_apart(pages: DataFrame, url_col: str = "url", text_col: str | None = None) -> DataFrame:
    """(w, n): how many hosts have a word apart, in hyphenated labels or in paths (a hot host counts once), and how many
    pages have it in their text."""
    urls = pages.select(host_of(url_col).alias("__host"), path_of(url_col).alias("__path"))
    labels = F.transform(F.split("__host", r"\."), lambda x: _letters(F.when(x.contains("-"), x).otherwise("")))
    hosts = urls.select("__host").distinct().select("__host", F.explode(F.flatten(F.filter(labels, lambda x: F.size(x) > 1))).alias("w"))
    found = hosts.union(urls.select("__host", F.explode(_letters(F.col("__path"))).alias("w"))).distinct().select("w")
    if text_col is not None:
        plain = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "<[^>]*>", " ")
        found = found.unionAll(pages.select(F.explode(F.array_distinct(_letters(plain))).alias("w")))
    return found.groupBy("w").agg(F.count("*").alias("n"))


def rule_words(pages: DataFrame, words: Words, url_col: str = "url", rules=RULES) -> DataFrame:
    """(w, verdict, n): the segmented words of the URLs that a rule decides, and how many hosts have each under a verdict."""
    shared = shipped(pages.sparkSession, words)

    @F.pandas_udf("array<string>")
    def segments(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared()
        for x in parts:
            yield x.map(own.segment)

    own = {w for h, p, _ in rules for w in split_words(h) + split_words(p)}
    urls = pages.select(host_of(url_col).alias("h"), path_of(url_col).alias("p"))
    urls = urls.select("h", "p", rule_columns(F.col("h"), F.col("p"), rules)[1].alias("verdict")).filter("verdict is not null")
    apart = urls.select("h", "verdict", F.explode(F.concat(_letters(F.col("h")), _letters(F.col("p")))).alias("x")).distinct()
    cut = apart.select("h", "verdict", F.explode(segments("x")).alias("w")).filter(~F.col("w").isin(sorted(own))).distinct()
    return cut.groupBy("w", "verdict").agg(F.count("*").alias("n"))


def train(pages: DataFrame, *, url_col: str = "url", text_col: str | None = None, rules=RULES, vocabulary: int = VOCABULARY) -> Bayes:
    apart = frequent(words_apart(pages, url_col, text_col), "n", vocabulary)
    words = Words({r["w"]: r["n"] for r in apart.collect()})
    seen = frequent(rule_words(pages, words, url_col, rules), "n", vocabulary)
    return Bayes(words, {(r["w"], r["verdict"]): r["n"] for r in seen.collect()})


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html", rules=RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """id, host, path, rule, verdict and, where no rule fits, the model's log odds."""
    text_col = text_col if text_col in pages.columns else None
    model = shipped(pages.sparkSession, train(pages, url_col=url_col, text_col=text_col, rules=rules, vocabulary=vocabulary))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = model()
        for host, path in parts:
            yield pd.Series([None if h is None else m.score(h, p) for h, p in zip(host, path)], dtype=float)

    rows = pages.select(F.col(id_col).alias("__id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("__by_rule", verdict)
    rows = rows.withColumn("log_odds", score(F.when(F.col("rule").isNull(), F.col("host")), "path"))
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__by_rule", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
