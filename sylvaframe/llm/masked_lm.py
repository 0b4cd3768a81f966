"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token of a text from the tokens on both sides: the embeddings of the
``2 * SIDE`` neighbours, each scaled by a learned vector of its offset, are summed and passed through tanh, and a
two-level softmax (class, then member) gives the token's conditional probability. A text's score is the sum of its
tokens' conditional log-probabilities.

Nothing is sampled. The vocabulary holds the words that reach the least count which at most ``CLASSES * MEMBERS - BUCKETS``
words of the whole corpus have, so of words seen equally often all or none are in it; other words share
hash buckets, and such a token's probability is that of its bucket times the word's share of the bucket's tokens, from the
counts of all words. The counts of the more frequent of them (``NEAR`` at most) travel with the tasks, the others are
joined. A word that the corpus doesn't have counts as one more token of its bucket, whichever it is.

Training is plain numpy and doesn't depend on how the table is cut into partitions. The softmax starts from the words'
frequencies. Rows are dealt by a hash of id and text into units of about ``UNIT`` bytes of text, and units into rounds: the
first unit alone, the next 3, the next 12, and so on, fourfold, each token once. A round's shards (a unit each, or more
where a round has more than ``MOST`` units) start from the same weights and sums of squared gradients, take their rows in
the order of the hash by minibatch steps, and both are averaged, weighted by tokens, piece by piece on the executors. So the
first round finds the region, and later averages are of models that differ little. The sums' order may change the last
digits. The driver holds one model, whose size doesn't depend on the corpus. Rows of one id and one text fall into one
shard.

Defined cases: a null text, an empty one or one without words has no token and the score 0 (mean null); a text of one
word is predicted from no neighbour; very long texts are scored whole, a batch of tokens after another with the neighbours
beyond its ends; rows with equal ids, and repeated rows, are scored each by its own text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import least_count, shipped, stored, utf8_size

SIDE = 2
DIM = 16
CLASSES = 64
MEMBERS = 64
BUCKETS = 256
BATCH = 8192
#: Tokens of a training step.
STEP = 2048
RATE = 0.4
#: Bytes of text of a unit of training, and the most shards of a round.
UNIT, MOST = 16 << 20, 20_000
#: Logits up to this size are exponentiated as they are.
SAFE = 40.0
PIECE = 8192
MERGES = 32
#: Counted words outside the vocabulary up to this many (16 bytes each) travel with the tasks; the others are joined.
NEAR = 1 << 18


class Words(NamedTuple):
    """The vocabulary's hashes, ascending; of further words the hashes, ascending, and logarithms of counts; the logarithm
    of each bucket's tokens and one; and the stored counts (h, n) of all other words seen more than once, if there are
    any. What is seen once has the logarithm 0."""

    top: np.ndarray
    near: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    far: DataFrame | None = None


class Network:
    """Weights as one flat float32 array, seen in parts."""

    def __init__(self, flat: np.ndarray | None = None, dim: int = DIM, classes: int = CLASSES, members: int = MEMBERS):
        self.dim, self.classes, self.members = dim, classes, members
        v = classes * members
        shapes = {"emb": (v, dim), "off": (2 * SIDE, dim), "bias": (dim,), "wc": (dim, classes), "bc": (classes,), "wm": (classes, dim, members), "bm": (classes, members)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            flat = np.zeros(size, np.float32)
        self.flat, at = flat, 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, name, flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def fresh(cls, seed: int = 7, **shape) -> Network:
        net, rng = cls(**shape), np.random.default_rng(seed)
        net.emb[:] = rng.normal(0, 0.3, net.emb.shape)
        net.off[:] = 1
        net.wc[:] = rng.normal(0, 0.1, net.wc.shape)
        net.wm[:] = rng.normal(0, 0.1, net.wm.shape)
        return net

    def _hidden(self, ids: np.ndarray, doc: np.ndarray):
        e = self.emb[ids]
        s = np.broadcast_to(self.bias, e.shape).copy()
        near = []
        for k, o in enumerate([o for o in range(-SIDE, SIDE + 1) if o]):
            a, b = (slice(-o, None), slice(0, o)) if o < 0 else (slice(0, -o), slice(o, None))
            same = (doc[a] == doc[b])[:, None].astype(np.float32) if len(doc) > abs(o) else np.zeros((0, 1), np.float32)
            near.append((k, a, b, same))
            if len(same):
                s[a] += e[b] * self.off[k] * same
        return e, np.tanh(s), near

    @staticmethod
    def _log_soft(z: np.ndarray, want: np.ndarray):
        """The logarithm of each row's wanted probability; z becomes the exponentials, their sums come along."""
        if len(z) and (z.max() > SAFE or z.min() < -SAFE):  # else exponentials neither overflow nor vanish
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), want]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        return own - np.log(total), total

    @classmethod
    def _slope(cls, z: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The probabilities less one at the wanted place."""
        _, total = cls._log_soft(z, want)
        z *= (1 / total)[:, None]
        z[np.arange(len(z)), want] -= 1
        return z

    def _by_class(self, ids: np.ndarray):
        """Class and member of each id, the order of the ids (numbers of 16 bits sort by radix), and where classes begin."""
        order = np.argsort(ids.astype(np.uint16), kind="stable") if self.classes * self.members <= 1 << 16 else np.argsort(ids, kind="stable")
        cut = np.searchsorted(ids[order], np.arange(self.classes + 1) * self.members)
        return ids // self.members, ids % self.members, order, cut

    def _members(self, h: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Member logits of rows sorted by class."""
        z = np.empty((len(h), self.members), h.dtype)
        for k in np.flatnonzero(np.diff(cut)):
            a, b = cut[k], cut[k + 1]
            np.matmul(h[a:b], self.wm[k], out=z[a:b])
            z[a:b] += self.bm[k]
        return z

    def log_probs(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each token given its neighbours in the same text."""
        out = np.empty(len(ids))
        for i in range(0, len(ids), BATCH):
            # neighbours beyond the batch are read too
            a, b = max(0, i - SIDE), min(len(ids), i + BATCH + SIDE)
            _, h, _ = self._hidden(ids[a:b], doc[a:b])
            h, x = h[i - a : i - a + BATCH], ids[i : i + BATCH]
            c, m, order, cut = self._by_class(x)
            ll, _ = self._log_soft(h @ self.wc + self.bc, c)
            z = self._members(h[order], cut)
            ll[order] += self._log_soft(z, m[order])[0]
            out[i : i + BATCH] = ll
        return out

    def step(self, ids: np.ndarray, doc: np.ndarray, rate: float, past: Network) -> None:
        """One AdaGrad step on all tokens of a minibatch. past: sums of squared gradients, in the shape of the weights."""

        def move(name: str, g: np.ndarray, at=()) -> None:
            seen = getattr(past, name)
            seen[at] += g * g
            getattr(self, name)[at] -= rate * g / np.sqrt(seen[at] + np.float32(1e-6))

        e, h, near = self._hidden(ids, doc)
        c, m, order, cut = self._by_class(ids)
        p = self._slope(h @ self.wc + self.bc, c)
        gh = p @ self.wc.T
        wc, bc = h.T @ p, p.sum(axis=0)
        hs, one = h[order], np.ones(len(h), h.dtype)
        q = self._slope(self._members(hs, cut), m[order])
        gm, wm, bm = np.empty_like(hs), np.zeros_like(self.wm), np.zeros_like(self.bm)
        for k in np.flatnonzero(np.diff(cut)):
            a, b = cut[k], cut[k + 1]
            np.matmul(q[a:b], self.wm[k].T, out=gm[a:b])
            np.matmul(hs[a:b].T, q[a:b], out=wm[k])
            np.matmul(one[a:b], q[a:b], out=bm[k])
        gh[order] += gm
        move("wm", wm)
        move("bm", bm)
        move("wc", wc)
        move("bc", bc)
        gs = gh * (1 - h * h)
        ge, go = np.zeros_like(e), np.zeros_like(self.off)
        for k, a, b, same in near:
            if len(same):
                g = gs[a] * same
                ge[b] += g * self.off[k]
                go[k] = (g * e[b]).sum(axis=0)
        move("off", go)
        move("bias", gs.sum(axis=0))
        own = ids[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        move("emb", np.add.reduceat(ge[order], first, axis=0), own[first])


def _find(sorted_: np.ndarray, h: np.ndarray):
    """Where each hash stands, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(sorted_, h)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == h


def _tokens(part: pa.RecordBatch, vocabulary: np.ndarray, rank: np.ndarray, buckets: int):
    """Number, text and hash of each token."""
    data, offsets = tx.buffers(part.column("text"))
    starts, ends, doc = tx.words(data, offsets, tx.SPACE)
    h = tx.hash_words(data, starts, ends)
    ids = (h % np.uint64(buckets)).astype(np.int64)
    at, known = _find(vocabulary, h)
    ids[known] = rank[at[known]] + buckets
    return ids, doc, h


def vocabulary(docs: DataFrame, size: int, text_col: str = "text", near: int | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """The most frequent words of the corpus with the counts of all others, their ranks, and their own counts. Every word is
    counted."""
    near = NEAR if near is None else near

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                starts, ends, _ = tx.words(data, offsets, tx.SPACE)
                h, n = np.unique(tx.hash_words(data, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = stored(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    least = least_count(counts, "n", size)
    top = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["h"]))  # at most ``size`` words
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    often = np.array([r["n"] for r in top], float)

    total = np.ones(BUCKETS)
    for r in counts.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n").alias("n")).collect():  # a power of two
        total[r["b"]] += r["n"]
    np.subtract.at(total, (h % np.uint64(BUCKETS)).astype(np.int64), often)
    # counts in eighths of powers of two: the highest levels that together hold at most ``near`` words beside the vocabulary
    level = F.floor(F.log2("n") * 8)
    seen = {r["level"]: r["c"] for r in counts.filter("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}
    cut, held = max(seen, default=0) + 1, 0
    for x in sorted(seen, reverse=True):
        held += seen[x]
        if held > near + len(h):
            break
        cut = x
    more = counts.filter((F.col("n") > 1) & (level >= cut)).toArrow()
    mine, n = more.column("h").to_numpy().view(np.uint64), more.column("n").to_numpy()
    rest = ~_find(h[order], mine)[1]
    mine, n = mine[rest], n[rest]
    by = np.argsort(mine)
    far = counts.filter((F.col("n") > 1) & (level < cut)) if cut > min(seen, default=cut) else None
    return Words(h[order], mine[by], np.log(n[by]), np.log(total), far), order, often[order]


def _prior(vocab: Words, rank: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fresh weights whose softmax gives the frequencies of words and buckets where nothing else is known."""
    net = Network.fresh()
    n = np.ones(CLASSES * MEMBERS)
    n[:BUCKETS] = np.exp(vocab.total)
    n[BUCKETS + rank] += counts
    n = n.reshape(CLASSES, MEMBERS)
    net.bc[:] = np.log(n.sum(axis=1) / n.sum())
    net.bm[:] = np.log(n / n.sum(axis=1, keepdims=True))
    return net.flat


def _rounds(units: int) -> list[tuple[int, int]]:
    """The units [first, end) of each round."""
    out, first = [], 0
    while first < units:
        out.append((first, min(units, max(1, 4 * first))))
        first = out[-1][1]
    return out


def _trained(rows: DataFrame, shards: int, shared, rate: float) -> list:
    """(piece, tokens, sums) over the shards of a round. rows: (shard, h, text)."""

    def train(batches):
        v, r, state = shared.value
        half, seen = len(state) // 2, 0
        own, past = Network(state[:half].copy()), Network(state[half:].copy())
        for batch in batches:
            for part in tx.slices(batch, "text"):
                ids, doc, _ = _tokens(part, v, r, BUCKETS)
                for i in range(0, len(ids), STEP):
                    own.step(ids[i : i + STEP], doc[i : i + STEP], np.float32(rate), past)
                seen += len(ids)
        if seen:
            flat = np.concatenate([own.flat, past.flat]).astype(np.float64) * seen
            n = -(-len(flat) // PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n), pa.int64()), pa.array(np.full(n, TaskContext.get().partitionId() % MERGES), pa.int64()), pa.array(np.full(n, float(seen))), pa.array([flat[k * PIECE : (k + 1) * PIECE].tobytes() for k in range(n)], pa.binary())],
                names=["piece", "merge", "seen", "sum"],
            )

    def add(tables):
        """Sum the pieces of each key as they stream by."""
        sums: dict = {}
        for t in tables:
            for key, seen, raw in zip(zip(t.column("piece").to_pylist(), t.column("merge").to_pylist()), t.column("seen").to_pylist(), t.column("sum").to_pylist()):
                x = np.frombuffer(raw)
                n, total = sums.get(key, (0.0, 0.0))
                sums[key] = n + seen, total + x
        for (piece, merge), (seen, x) in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "merge": pa.array([merge], pa.int64()), "seen": pa.array([seen]), "sum": pa.array([x.tobytes()], pa.binary())})

    schema = "piece long, merge long, seen double, sum binary"
    pieces = rows.repartitionById(shards, "shard").sortWithinPartitions("h").select("text").mapInArrow(train, schema)
    # the pieces of each key meet in one partition; first within a merge group, then across groups
    merged = pieces.repartition("piece", "merge").mapInArrow(add, schema).withColumn("merge", F.lit(0).cast("long")).repartition("piece").mapInArrow(add, schema)
    return sorted(merged.collect())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, unit: int = UNIT):
    """(vocabulary, ranks, weights): one pass over all tokens. unit: bytes of text of a unit of training."""
    spark = docs.sparkSession
    vocab, rank, counts = vocabulary(docs, CLASSES * MEMBERS - BUCKETS, text_col)
    state = np.concatenate([_prior(vocab, rank, counts), Network().flat])
    units = -(-(docs.select(utf8_size(text_col).alias("n")).agg(F.sum("n")).first()[0] or 0) // unit)
    rounds = _rounds(units)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")).filter("text <> ''").withColumn("unit", F.pmod("h", F.lit(max(1, units))))
    # the last round reads the documents, those before it read their part of them, stored once
    early = stored(rows.filter(F.col("unit") < rounds[-1][0]), "early") if len(rounds) > 1 else None
    for first, end in rounds:
        shards = min(MOST, end - first)
        part = (rows if end == units else early).filter((F.col("unit") >= first) & (F.col("unit") < end))
        shard = F.floor((F.col("unit") - first) * shards / (end - first)).cast("int")
        shared = spark.sparkContext.broadcast((vocab.top, rank, state))
        found = _trained(part.select(shard.alias("shard"), "h", "text"), shards, shared, rate)
        if found:
            state = np.concatenate([np.frombuffer(r["sum"]) / r["seen"] for r in found]).astype(np.float32)
        shared.unpersist()
    return vocab, rank, state[: len(state) // 2]


def score(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (summed), mean_log_likelihood."""
    words, rank, flat = model
    shared = shipped(docs.sparkSession, (words._replace(far=None), rank, flat))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words, r, flat = shared()
        net, row = Network(flat), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in tx.slices(batch, "text"):
                ids, doc, h = _tokens(part, words.top, r, BUCKETS)
                ll = net.log_probs(ids, doc)
                own = np.flatnonzero(ids < BUCKETS)
                at, known = _find(words.near, h[own])
                ll[own] -= words.total[ids[own]]
                ll[own[known]] += words.weight[at[known]]
                own = own[~known]
                n = np.bincount(doc, minlength=part.num_rows)
                ll = np.bincount(doc, weights=ll, minlength=part.num_rows).astype(np.float64)  # whole numbers where nothing is counted
                rest = tx.list_array(h[own].view(np.int64), np.bincount(doc[own], minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column("id"), pa.array(n.astype(np.int64)), pa.array(ll), rest], names=["row", "id", "n_tokens", "log_likelihood", "rest"])
                row += part.num_rows

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, n_tokens long, log_likelihood double, rest array<long>")
    if words.far is not None:
        out = stored(out, "scored")
        far = words.far.select(F.col("h").alias("__h"), F.log("n").alias("w"))
        more = out.select("row", F.explode("rest").alias("h")).join(far, F.col("h") == F.col("__h")).groupBy(F.col("row").alias("__row")).agg(F.sum("w").alias("w"))
        out = out.drop("rest").join(more, F.col("row") == F.col("__row"), "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("w", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
