"""Language identification of mixed text: script ranges, word scores and a Viterbi search over language spans.

Training counts byte trigrams inside words for each label, over a sample of labelled rows whose bound is the parameter
``train_rows``, and notes in which scripts each label's words are written. To predict, every word of a text gets a
log-probability under each language; languages that are not written in the word's script are ruled out; and a Viterbi
search with a penalty for each switch labels spans of words. The text's language is the one whose spans hold most
letters, and the score is their share.

Texts of a slice are searched side by side, one word position after another, so the arrays stay bounded and no text is
cut.

Defined cases: a null text, an empty one or one without a letter is ``und`` with score 0; without any labelled row all
texts are ``und``; rows with a null label train nothing; repeated rows each train and have equal results; a very long text
is one lane of its slice, whole; ties go to the label first in code-point order; an empty table
gives no rows; columns other than id, text and label are ignored (``predict``) or kept (``accepted``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

TRAIN_ROWS = 20_000
GRAMS = 1 << 16
SWITCH = 12.0
FOREIGN = -12.0
LEAST_SHARE = 0.005
SLICE = 8 << 20
STEP = 1 << 20
UND = "und"
#: Share of letters that a document's language must hold, and from which it outweighs a label.
LEAST, SURE = 0.3, 0.9

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ASCII_LETTER = LETTER.copy()
ASCII_LETTER[0x80:] = False
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "kana", "han", "hangul", "other")
#: Script by the lead byte of a character's UTF-8 form, as ranges (first, last, script).
LEADS = ((0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xCB, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD4, 0xD5, "armenian"), (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xDC, 0xDF, "other"), (0xE0, 0xE0, "indic"), (0xE1, 0xE1, "other"), (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xF0, 0xF4, "other"))
SCRIPT = np.zeros(256, np.int8)
for _a, _b, _s in LEADS:
    SCRIPT[_a : _b + 1] = SCRIPTS.index(_s)


def _letters(data: np.ndarray, offsets: np.ndarray):
    """Words of letters: starts, ends, text numbers."""
    return tx.words(data, offsets, ~LETTER)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hashed trigram at each byte of the given words, and where each word begins among them. Words lie in data."""
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(first - starts, length)
    low = tx.LOWER[data[at]].astype(np.uint32)
    prev, nxt = np.r_[np.uint32(0), low[:-1]], np.r_[low[1:], np.uint32(0)]
    prev[first] = 0
    nxt[first + length - 1] = 0
    with np.errstate(over="ignore"):
        return ((prev << np.uint32(16) | low << np.uint32(8) | nxt) * np.uint32(2654435761)) >> np.uint32(16), first, at


def _pieces(starts: np.ndarray, ends: np.ndarray):
    """Runs of words that together span about STEP bytes."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        yield i, j
        i = j


def _scripts(data, at, first):
    x = SCRIPT[data[at]].copy()
    # second byte tells Thai from the other scripts of its lead, and Han from kana
    nxt = data[np.minimum(at + 1, len(data) - 1)]
    lead = data[at]
    x[(lead == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xB9)] = SCRIPTS.index("thai")
    x[(lead == 0xE3) & (nxt >= 0x90)] = SCRIPTS.index("han")
    x[(lead == 0xE1) & (nxt >= 0xB8) & (nxt <= 0xBB)] = SCRIPTS.index("latin")
    return np.maximum.reduceat(x, first)


class Model:
    """Log-probabilities [gram, language] and which scripts each language is written in."""

    def __init__(self, langs: list[str], logp: np.ndarray, written: np.ndarray):
        self.langs, self.logp, self.written = langs, logp, written

    def word_scores(self, data, starts, ends) -> np.ndarray:
        out = np.empty((len(starts), len(self.langs)), np.float32)
        for i, j in _pieces(starts, ends):
            gram, first, at = _grams(data, starts[i:j], ends[i:j])
            s = np.add.reduceat(self.logp[gram], first, axis=0)
            s -= s.max(axis=1, keepdims=True)
            script = _scripts(data, at, first)
            fits = self.written[script]
            s += np.where(fits | ~fits.any(axis=1, keepdims=True), 0, FOREIGN)
            out[i:j] = s
        return np.maximum(out, 2 * FOREIGN)

    def spans(self, scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """Language of each word. counts: words of each text, in order. Texts advance side by side."""
        n_lang = scores.shape[1]
        if n_lang == 1 or not len(scores):
            return np.zeros(len(scores), np.int32)
        order = np.argsort(-counts, kind="stable")
        length = counts[order]
        steps = int(length[0])
        lanes = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # texts that have a word t
        off = np.r_[0, np.cumsum(lanes)]
        lane_of = np.empty(len(counts), np.int64)
        lane_of[order] = np.arange(len(counts))
        t = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = off[t] + np.repeat(lane_of, counts)
        by_step = np.empty((n_lang, len(scores)), np.float32)
        by_step[:, place] = scores.T
        moved = np.zeros((n_lang, len(scores)), bool)
        source = np.zeros(len(scores), np.int32)
        v = by_step[:, : lanes[0]].copy()
        last = np.empty((n_lang, len(counts)), np.float32)
        for k in range(1, steps):
            n = lanes[k]
            if n < v.shape[1]:
                last[:, n : v.shape[1]] = v[:, n:]
                v = v[:, :n].copy()
            a, b = off[k], off[k] + n
            source[a:b] = v.argmax(axis=0)
            jump = v.max(axis=0) - switch
            np.greater(jump, v, out=moved[:, a:b])
            np.maximum(v, jump, out=v)
            v += by_step[:, a:b]
            v -= v.max(axis=0)
        last[:, : v.shape[1]] = v
        label = np.zeros(len(scores), np.int32)
        now = last[:, : lanes[0]].argmax(axis=0)
        lane = np.arange(lanes[0])
        for k in range(steps - 1, -1, -1):
            a, b = off[k], off[k + 1]
            own = now[: b - a]
            label[a:b] = own
            if k:
                own[:] = np.where(moved[own, np.arange(a, b)], source[a:b], own)
        del lane
        return label[place]

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = tx.buffers(col)
        n = len(offsets) - 1
        starts, ends, doc = _letters(data, offsets)
        names, score = [UND] * n, np.zeros(n)
        if not len(starts) or not self.langs:
            return names, score
        label = self.spans(self.word_scores(data, starts, ends), np.bincount(doc, minlength=n)[np.unique(doc)])
        held = np.bincount(doc * len(self.langs) + label, weights=ends - starts, minlength=n * len(self.langs)).reshape(n, -1)
        total = held.sum(axis=1)
        best = held.argmax(axis=1)
        has = np.zeros(n, bool)
        has[doc[ASCII_LETTER[data[starts]]]] = True
        for i in np.flatnonzero((total > 0) & ~has):
            has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
        for i in np.flatnonzero(has):
            names[i] = self.langs[best[i]]
            score[i] = held[i, best[i]] / total[i]
        return names, score


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, order: Column | None = None) -> Model:
    """Fit on at most about train_rows labelled rows, chosen by a hash of the text; counts are summed by the executors."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = rows.select("lang").count()
    if n > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))

    def run(batches):
        for batch in batches:
            langs = sorted(set(batch.column("lang").to_pylist()))
            for part in tx.slices(batch, "text", STEP):
                data, offsets = tx.buffers(part.column("text"))
                starts, ends, doc = _letters(data, offsets)
                own = np.searchsorted(langs, part.column("lang").to_pylist())
                for i, j in _pieces(starts, ends):
                    gram, first, at = _grams(data, starts[i:j], ends[i:j])
                    who = own[doc[i:j]]
                    key, count = np.unique(np.repeat(who, ends[i:j] - starts[i:j]) * GRAMS + gram, return_counts=True)
                    script, m = np.unique(who * GRAMS + _scripts(data, at, first), return_counts=True)
                    for what, (k, c) in enumerate(((key, count), (script, m))):
                        yield pa.RecordBatch.from_arrays([pa.array([langs[x] for x in k // GRAMS], pa.string()), pa.array(np.full(len(k), what, np.int32)), pa.array((k % GRAMS).astype(np.int32)), pa.array(c.astype(np.int64))], names=["lang", "what", "key", "n"])

    sums = rows.mapInArrow(run, "lang string, what int, key int, n long").groupBy("lang", "what", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums.lang.unique(), key=lambda s: s.encode())
    count, script = np.zeros((GRAMS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for what, into in ((0, count), (1, script)):
        x = sums[sums.what == what]
        into[x.key, [langs.index(s) for s in x.lang]] = x.n
    logp = np.log((count + 0.1) / (count.sum(axis=0) + 0.1 * GRAMS))
    return Model(langs, logp.astype(np.float32), script >= LEAST_SHARE * np.maximum(script.sum(axis=0), 1))


def _predicted(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns as __k0, __k1, ... with __lang and __score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.written))
    kept = [f"__k{i}" for i in range(len(keep))]
    types = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in tx.slices(batch, "__text", SLICE):
                names, score = own.predict(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(names, pa.string()), pa.array(score)], names=[*kept, "__lang", "__score"])

    carried = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(k) for k, c in zip(kept, keep)])
    return carried.mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in zip(kept, types)], "__lang string", "__score double"]))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The kept columns with lang_pred and score; of clashing names, the new ones stay."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    out = _predicted(docs, model, text_col, keep)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder of crc32(id as text) by 4 is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang", least: float = LEAST, sure: float = SURE) -> DataFrame:
    """The documents in which one language holds at least the share ``least`` of the letters, with their own columns. Where a
    document names no language it gets the one found, and where the share is at least ``sure`` another one is put right."""
    keep = docs.columns
    found = _predicted(docs, model, text_col, keep).filter((F.col("__lang") != UND) & (F.col("__score") >= least))
    own = {c: F.col(f"__k{i}") for i, c in enumerate(keep)}
    if lang_col in own:
        own[lang_col] = F.when(own[lang_col].isNull() | (F.col("__score") >= sure), F.col("__lang")).otherwise(own[lang_col])
    return found.select(*[x.alias(c) for c, x in own.items()])
