"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased words and one end per text.  The model predicts a token
through a tree of classes, each split in two by a softmax:

* the ``HEAD`` most frequent training tokens and ``SUFFIX_CLASSES`` classes of
  all other tokens, by their last two bytes, are the leaves of a binary tree
  that is built from their counts (frequent ones near the root);
* below the suffix classes, the bits of a token's hash split further, as many as
  the distinct tokens ask for; tokens of the same bits (a leaf) have their
  smoothed shares of the training counts.

The log odds of every split are its odds in the training counts plus one weight
for each feature of the history, hashed with the split: the last token, the last
two together, and skips to the second and third last.  So the probabilities of
all tokens, with one for everything unseen in a leaf, sum to 1.

A feature weighs in only once its context was seen often enough; how often
follows from how full the table of weights is, so that what a small corpus can
remember in full, a large one keeps for what recurs.

Training: learners, one per task, take gradient steps (AdaGrad) over all their
training texts; a weight is averaged over the learners that touched it.
Scoring runs in sparse numpy batches.

Scale: token counts are combined in tasks before the shuffle.  Tokens above a
frequency that at most ``HEAVY`` tokens can have are broadcast; the counts of
all others are looked up by hash shards of bounded size, so nothing depends on
the vocabulary fitting anywhere.  Models are of fixed size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import LOWER, hash_spans, id_remainder, mix64, read, slices, small_batches, stage, stream64, text_buffer, word_spans

HEAD, SUFFIX_CLASSES = 4096, 64
MOST_DIGITS = 1 << 12          # values of the hash bits below a suffix class, at most
WEIGHTS = 24                   # log2 of the weights
LEVELS = 3                     # of splits whose weights lie side by side
CONTEXTS = 22                  # log2 of the contexts told apart, by feature
FEATURES = 4
BLOCK = 1 << 14                # weights that travel together
BATCH, SCORE_BATCH = 512, 2048 # tokens of a gradient step, and of a scoring step
RATE, DAMP = 0.5, 1.0          # AdaGrad's rate, and its sum of squares at first
# how often a context must have been seen, by the touched share of the weights
ADMIT = [(0.3, 0), (0.4, 1), (0.5, 2), (0.6, 4), (1.0, 8)]
HEAVY = 1 << 20                # tokens whose counts are broadcast, at most
SHARD_TOKENS = 1 << 22         # looked-up tokens of a shard, about
LEARNER_TOKENS = 8_000_000     # training tokens that make another learner worth it
COUNTED = 1 << 20              # distinct tokens that a task combines at once
ADD = 0.1                      # of the smoothed counts

_U = np.uint64
END, START = stream64(201, 2)
_KEY = stream64(202, FEATURES + 2) | _U(1)
_LOG10 = np.log(10.0)
# class of every pair of last bytes
_SUFFIX = (mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) % _U(SUFFIX_CLASSES)).astype(np.int64)


# ------------------------------------------------------------------ tokens

def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts of a column, the class of each by its last
    two bytes, and each row's first token (with one entry more than rows)."""
    buf, at = text_buffer(col)
    starts, ends, first = word_spans(buf, at)
    n, rows = len(starts), len(at) - 1
    ahead = first + np.arange(rows + 1)          # an end after every row
    place = np.arange(n) + np.repeat(np.arange(rows), np.diff(first))
    out = np.full(n + rows, END, dtype=np.uint64)
    out[place] = hash_spans(buf, starts, ends)
    suffix = np.zeros(n + rows, dtype=np.int64)
    if n:
        before = np.where(ends - starts > 1, LOWER[buf[np.maximum(ends - 2, 0)]].astype(np.int64), 0)
        suffix[place] = _SUFFIX[LOWER[buf[ends - 1]].astype(np.int64) + 256 * before]
    return out, suffix, ahead


def history(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the history of every token the features (tokens x FEATURES): a hash
    that goes into the places of weights, and the place of its context."""
    at = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    before = []
    for k in (1, 2, 3):
        p = np.full(len(t), START, dtype=np.uint64)
        p[k:] = np.where(at[k:] >= k, t[:-k], START) if len(t) > k else p[k:]
        before.append(p)
    p1, p2, p3 = before
    h = mix64(np.stack([p1 * _KEY[0], p1 * _KEY[1] + p2 * _KEY[2], p2 * _KEY[3] + _U(2), p3 * _KEY[4] + _U(3)], axis=1))
    return (h >> _U(32)).astype(np.uint32), (h & _U((1 << CONTEXTS) - 1)).astype(np.int64)


# ------------------------------------------------------------------ counts

def _count(batches):
    held: list[tuple] = []

    def combine():
        t, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, back = np.unique(t, return_index=True, return_inverse=True)
        held[:] = [(u, s[at], np.bincount(back, n, len(u)).astype(np.int64))]

    def rows():
        t, s, n = held.pop()
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(s), pa.array(n)], names=["token", "suffix", "n"])
    for b in batches:
        for lo, hi in slices(b.column(0)):
            t, s, _ = tokens(b.column(0).slice(lo, hi - lo))
            u, at, n = np.unique(t, return_index=True, return_counts=True)
            held.append((u, s[at], n))
            if sum(len(x[0]) for x in held) > COUNTED:
                combine()
                if len(held[0][0]) > COUNTED // 2:
                    yield rows()
    if held:
        combine()
        yield rows()


@dataclass
class Counts:
    """What every task knows of the training counts."""
    total: int               # N
    distinct: int            # V
    heavy: np.ndarray        # hashes of the heavy tokens, in order
    heavy_n: np.ndarray      # their counts
    head: np.ndarray         # hashes of the head tokens, in order
    head_rank: np.ndarray    # their ranks by frequency
    rank_n: np.ndarray       # counts by rank
    leaf_n: np.ndarray | None = None  # by leaf, training tokens outside the head (none: no such tokens)
    leaf_v: np.ndarray | None = None  # and distinct ones
    _slots = None

    def __post_init__(self):
        if self.leaf_n is None:
            self.leaf_n, self.leaf_v = np.zeros((2, SUFFIX_CLASSES))

    @property
    def digits(self) -> int:
        """Values of the hash bits of a token outside the head."""
        return len(self.leaf_n) // SUFFIX_CLASSES

    def leaf_share(self) -> np.ndarray:
        """By leaf, the smoothed count that its tokens share."""
        return self.leaf_n + ADD * (self.leaf_v + 1)

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of heavy tokens, 0 for others, and ranks of head tokens, -1
        for others, by a hash table of the process."""
        if self._slots is None:
            known = np.append(self.heavy, self.head[~np.isin(self.head, self.heavy)])
            n = np.append(self.heavy_n, self.rank_n[self.head_rank[~np.isin(self.head, self.heavy)]])
            self._values = np.append(n, 0), np.append(_lookup(self.head, self.head_rank, known, -1), -1)
            self._slots = _hash_table(known)
        at = _find(self._slots, t)
        return self._values[0][at], self._values[1][at]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_slots", "_values")} | {"_slots": None}


def _lookup(keys: np.ndarray, values: np.ndarray, t: np.ndarray, other) -> np.ndarray:
    if not len(keys):
        return np.full(len(t), other)
    at = np.searchsorted(keys, t)
    at[at == len(keys)] = 0
    return np.where(keys[at] == t, values[at], other)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of distinct 64-bit hashes: the keys and their index by
    slot (-1: empty), about a quarter of the slots in use."""
    bits = max(4, (4 * len(keys)).bit_length())
    held, index = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
    at, left = (keys >> _U(64 - bits)).astype(np.int64), np.arange(len(keys))
    while len(left):
        free = left[index[at[left]] < 0]
        index[at[free]] = free                # of several the last one stays
        left = left[index[at[left]] != left]
        at[left] = (at[left] + 1) % len(index)
    some = index >= 0
    held[some] = keys[index[some]]
    return held, index


def _find(table: tuple[np.ndarray, np.ndarray], t: np.ndarray) -> np.ndarray:
    """Index of the keys, -1 for hashes that are none."""
    held, index = table
    at = (t >> _U(65 - len(index).bit_length())).astype(np.int64)
    out = index[at]
    left = np.flatnonzero((out >= 0) & (held[at] != t))
    while len(left):
        at[left] = (at[left] + 1) % len(index)
        out[left] = index[at[left]]
        left = left[(out[left] >= 0) & (held[at[left]] != t[left])]
    return out


def count_tokens(train: DataFrame) -> tuple[DataFrame, Counts]:
    """The table of training counts (token, suffix, n), and its digest."""
    counted = train.select("text").mapInArrow(_count, "token long, suffix long, n long")
    table = stage(counted.groupBy("token").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n")), "counts")
    sums = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums.n, sums.v
    digits = 1
    while digits < MOST_DIGITS and digits * SUFFIX_CLASSES < distinct:
        digits *= 2
    leaf = F.col("suffix") * digits + F.col("token").bitwiseAND(F.lit(digits - 1))
    leaves = table.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    # at most total / least tokens can have so high a count
    least = total // HEAVY + 1
    heavy = table.filter(F.col("n") >= least).toArrow()
    t = heavy.column("token").to_numpy().view(np.uint64)
    n, s = heavy.column("n").to_numpy(), heavy.column("suffix").to_numpy()
    order = np.argsort(t)
    t, n, s = t[order], n[order], s[order]
    top = np.lexsort((t, -n))[:HEAD]
    by_hash = np.argsort(t[top])
    leaf_n, leaf_v = np.zeros((2, SUFFIX_CLASSES * digits))
    at = leaves.column("leaf").to_numpy()
    leaf_n[at], leaf_v[at] = leaves.column("n").to_numpy(), leaves.column("v").to_numpy()
    at = s[top] * digits + (t[top] % _U(digits)).astype(np.int64)
    np.subtract.at(leaf_n, at, n[top])
    np.subtract.at(leaf_v, at, 1)
    return table, Counts(total, distinct, t, n, t[top][by_hash], by_hash, n[top], leaf_n, leaf_v)


# ------------------------------------------------------------------- model

class Tree:
    """The splits on the way to every token, with the log odds that they have
    in the training counts."""

    def __init__(self, counts: Counts):
        share = counts.leaf_share().reshape(SUFFIX_CLASSES, -1)
        weight = np.concatenate([counts.rank_n + ADD, share.sum(axis=1)])
        self.head, self.digits = len(counts.rank_n), share.shape[1]
        self.bits = self.digits.bit_length() - 1
        # join the two lightest until one is left
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        above: list[tuple[int, int]] = [(-1, 0)] * (2 * len(weight) - 1)
        odds = []
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            made = len(weight) + len(odds)
            above[left], above[right] = (made, 0), (made, 1)
            odds.append(np.log(b / a))
            heapq.heappush(heap, (a + b, made))
        ways = []
        for i in range(len(weight)):
            way = []
            while above[i][0] >= 0:
                i, bit = above[i]
                way.append((i - len(weight), bit))
            ways.append(way[::-1])
        # below a suffix class: the split by bit d of those with the same d bits before it
        self.joined = len(odds)
        below = np.zeros((SUFFIX_CLASSES, self.digits), np.float32)
        mass = share
        for d in reversed(range(self.bits)):
            mass = mass.reshape(SUFFIX_CLASSES, 2, 1 << d)
            below[:, 1 << d:2 << d] = np.log(mass[:, 1] / mass[:, 0])
            mass = mass.sum(axis=1)
        self.odds = np.concatenate([np.array(odds, np.float32), below.ravel()])
        # the splits of ``LEVELS`` levels from one on lie side by side: which
        # one is at the top, and the place within
        top, self.within = np.arange(len(self.odds)), np.ones(len(self.odds), np.int64)
        for way in ways:
            for d, (n, _) in enumerate(way):
                over = d - d % LEVELS
                top[n] = way[over][0]
                self.within[n] = int("1" + "".join(str(b) for _, b in way[over:d]), 2)
        for d in range(self.bits):
            over, low = d - d % LEVELS, np.arange(1 << d)
            rows = self.joined + np.arange(SUFFIX_CLASSES)[:, None] * self.digits
            top[rows + (1 << d) + low] = rows + (1 << over) + (low & (1 << over) - 1)
            self.within[rows + (1 << d) + low] = (1 << d - over) | low >> over
        key = mix64(top.astype(np.uint64) + _U(1)) >> _U(32)
        self.key = (key >> _U(LEVELS) << _U(LEVELS) | self.within.astype(np.uint64)).astype(np.uint32)
        # the way to every leaf: splits, with the side taken in the lowest bit
        leaves = [np.array([n << 1 | b for n, b in w], np.int32) for w in ways[:self.head]]
        low, d = np.arange(self.digits)[:, None], np.arange(self.bits)
        for c, way in enumerate(ways[self.head:]):
            node = self.joined + c * self.digits + (1 << d) + (low & (1 << d) - 1)
            own = np.broadcast_to(np.array([n << 1 | b for n, b in way], np.int32), (self.digits, len(way)))
            leaves += list(np.concatenate([own, (node << 1 | low >> d & 1).astype(np.int32)], axis=1))
        self.size = np.array([len(x) for x in leaves], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.steps = np.concatenate(leaves) if leaves else np.zeros(0, np.int32)

    def paths(self, symbol: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens one after the other: split and side of every step, and the
        number of each token's steps."""
        leaf = np.where(symbol < self.head, symbol, self.head + (symbol - self.head) * self.digits + digit)
        size = self.size.take(leaf)
        end = np.cumsum(size)
        at = np.repeat(self.first.take(leaf) - (end - size), size)
        at += np.arange(len(at))
        step = self.steps.take(at)
        return (step >> 1).astype(np.int64), (step & 1).astype(np.float32), size


_WITHIN = np.uint32((1 << LEVELS) - 1)


def _places(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of the weight of each feature and split: a hash of the feature
    (``h``, which is overwritten) and the split on top, and the split's place
    below that (low bits of its key)."""
    h += keys | _WITHIN
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h >>= np.uint32(32 - WEIGHTS + LEVELS)
    h <<= np.uint32(LEVELS)
    h |= keys & _WITHIN
    return h.astype(np.int64)


def _weighed(admitted: np.ndarray, h: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the steps of the tokens (feature by feature, one after the other)
    those whose context weighs in, and the places of their weights."""
    some, size = admitted.ravel(), np.tile(size, FEATURES)
    on = np.flatnonzero(np.repeat(some, size))
    keys = np.tile(keys, FEATURES).take(on)
    return on, _places(np.repeat(h.ravel()[some], size[some]), keys)


def _add_weights(z: np.ndarray, on: np.ndarray, weights: np.ndarray) -> None:
    """Adds to the log odds of every step the weights of all features."""
    all_weights = np.zeros(FEATURES * len(z), np.float32)
    all_weights[on] = weights
    for w in all_weights.reshape(FEATURES, -1):
        z += w


class Model:
    """Weights by place, and the contexts that weigh in."""

    def __init__(self, counts: Counts, weights: np.ndarray | None = None, admitted: np.ndarray | None = None):
        self.tree = Tree(counts)
        self.weights = np.zeros(1 << WEIGHTS, np.float32) if weights is None else weights.astype(np.float32)
        self.admitted = np.zeros((FEATURES, 1 << CONTEXTS), bool) if admitted is None else np.unpackbits(admitted).view(bool).reshape(FEATURES, -1)

    def log_probability(self, features: tuple[np.ndarray, np.ndarray], symbol: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's leaf."""
        out = np.empty(len(symbol))
        h, context = (np.ascontiguousarray(x.T) for x in features)
        for lo in range(0, len(symbol), SCORE_BATCH):
            part = slice(lo, lo + SCORE_BATCH)
            node, bit, size = self.tree.paths(symbol[part], digit[part])
            z, keys = self.tree.odds.take(node), self.tree.key.take(node)
            admitted = np.stack([self.admitted[k].take(context[k, part]) for k in range(FEATURES)])
            on, at = _weighed(admitted, h[:, part], size, keys)
            _add_weights(z, on, self.weights.take(at))
            z *= 1 - 2 * bit
            lost = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
            out[part] = -np.add.reduceat(lost.astype(float), np.cumsum(size) - size) if len(lost) else 0.0
        return out


class Learner:
    """A model that takes gradient steps.  A weight and AdaGrad's sum of
    squares lie side by side; ``seen`` counts contexts."""

    def __init__(self, counts: Counts):
        self.tree = Tree(counts)
        self.table = np.zeros(2 << WEIGHTS, np.float32)
        self.seen = np.zeros((FEATURES, 1 << CONTEXTS), np.uint8)
        self.steps = self.need = 0

    def learn(self, features: tuple[np.ndarray, np.ndarray], symbol: np.ndarray, digit: np.ndarray) -> None:
        table = self.table
        h, context = (np.ascontiguousarray(x.T) for x in features)
        for lo in range(0, len(symbol), BATCH):
            if self.steps % 64 == 0:
                touched = (table[1::2 * 97] > 0).mean()
                self.need = next(n for share, n in ADMIT if touched <= share)
            self.steps += 1
            part = slice(lo, lo + BATCH)
            node, bit, size = self.tree.paths(symbol[part], digit[part])
            z, keys = self.tree.odds.take(node), self.tree.key.take(node)
            counts = np.stack([self.seen[k].take(context[k, part]) for k in range(FEATURES)])
            admitted = counts >= self.need
            on, at = _weighed(admitted, h[:, part], size, keys)
            at *= 2
            _add_weights(z, on, table.take(at))
            for k, n in enumerate(np.minimum(counts, 250) + 1):
                self.seen[k][context[k, part]] = n
            # steps beyond this range are certain either way
            push = bit - 1 / (1 + np.exp(-np.minimum(np.maximum(z, -30), 30)))
            push = np.tile(push, FEATURES).take(on)
            squares = push * push
            push *= np.float32(RATE)
            beside, to = at + 1, np.cumsum(admitted @ size)
            for start, end in zip(np.append(0, to), to):
                own = slice(start, end)
                np.add.at(table, beside[own], squares[own])
                np.add.at(table, at[own], push[own] / np.sqrt(table.take(beside[own]) + np.float32(DAMP)))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights in half precision (0: not touched), and the contexts seen as
        often as is asked for now, in bits."""
        return self.table[::2].astype(np.float16), np.packbits(self.seen >= max(self.need, 1))


def _targets(counts: Counts, t: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of the joined tree, and hash bits, of tokens."""
    return _leaves(counts, counts.find(t)[1], t, suffix)


def _leaves(counts: Counts, rank: np.ndarray, t: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(rank >= 0, rank, len(counts.rank_n) + suffix), (t & _U(counts.digits - 1)).astype(np.int64)


# rows of weights have part 0, rows of admitted contexts part 1
_TABLE = "part int, block int, learner int, value binary, times binary"


def _learn(shared):
    def run(batches):
        from pyspark import TaskContext
        learner = Learner(shared.value)
        some = False
        for b in batches:
            for lo, hi in slices(b.column(0), 1 << 20):
                t, suffix, first = tokens(b.column(0).slice(lo, hi - lo))
                learner.learn(history(t, first), *_targets(shared.value, t, suffix))
                some = True
        if some:
            weights, admitted = learner.result()
            for part, values, size in ((0, weights, BLOCK), (1, admitted, 2 * BLOCK)):
                for at in range(0, len(values), size):
                    if values[at:at + size].any():
                        yield _blocks([(part, at, TaskContext.get().partitionId(), values[at:at + size].tobytes(), None)])
    return run


def _blocks(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["part", "block", "learner", "value", "times"])


def _add_blocks(last: bool):
    """Sums of the weights of a block and the learners that touched each, or
    their means in half precision at the last."""
    def run(key, table):
        part, block = key[0].as_py(), key[1].as_py()
        value, times = table.column("value").to_pylist(), table.column("times").to_pylist()
        if part == 1:
            bits = np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in value])
            return pa.Table.from_batches([_blocks([(part, block, 0, bits.tobytes(), None)])])
        total, n = np.zeros((2, BLOCK), np.float32)
        for v, t in zip(value, times, strict=True):
            x = np.frombuffer(v, np.float16 if t is None else np.float32)
            total += x
            n += x != 0 if t is None else np.frombuffer(t, np.float32)
        if last:
            return pa.Table.from_batches([_blocks([(part, block, 0, (total / np.maximum(n, 1)).astype(np.float16).tobytes(), None)])])
        return pa.Table.from_batches([_blocks([(part, block, 0, total.tobytes(), n.tobytes())])])
    return run


def train_model(train: DataFrame, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """One pass of all learners over all training texts, and their average:
    weights in half precision, and the bits of the contexts that weigh in.  The
    sums are formed in two levels, so that no task gets the blocks of more than
    about the square root of the learners.  A lost learner runs again."""
    spark = train.sparkSession
    learners = max(1, counts.total // LEARNER_TOKENS)
    shared = spark.sparkContext.broadcast(counts)
    learned = train.select("text").coalesce(int(learners)).mapInArrow(_learn(shared), _TABLE)
    fan = int(learners ** 0.5) + 1
    half = learned.withColumn("learner", F.col("learner") % fan).groupBy("part", "block", "learner").applyInArrow(_add_blocks(False), _TABLE)
    weights, admitted = np.zeros(1 << WEIGHTS, np.float16), np.zeros(FEATURES << CONTEXTS >> 3, np.uint8)
    for r in half.groupBy("part", "block").applyInArrow(_add_blocks(True), _TABLE).toLocalIterator():  # the model: of fixed size
        into, kind = (weights, np.float16) if r.part == 0 else (admitted, np.uint8)
        got = np.frombuffer(r.value, kind)
        into[r.block:r.block + len(got)] = got
    return weights, admitted


# ----------------------------------------------------------------- scoring

_SCORED = ("row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, "
           "shard int, rows binary, hashes binary")


def _score(shared, n_shards: int, kind: pa.DataType):
    """For every text its sums over the tokens whose counts are at hand, and
    by shard the hashes of the others (rows counted from column row)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
                        ("score", pa.float64()), ("shard", pa.int32()), ("rows", pa.binary()), ("hashes", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        counts, weights, admitted = shared.value
        model, row0 = Model(counts, weights, admitted), TaskContext.get().partitionId() << 32
        scale = np.log10(counts.total + ADD * (counts.distinct + 1))
        rest = np.log10(counts.leaf_share())
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                t, suffix, first = tokens(b.column(1).slice(lo, hi - lo))
                rows = hi - lo
                doc = np.repeat(np.arange(rows), np.diff(first))
                n, rank = counts.find(t)
                symbol, digit = _leaves(counts, rank, t, suffix)
                log_n = np.where(n > 0, np.log10(n + ADD), 0.0)  # of the others it comes from the shards
                p = model.log_probability(history(t, first), symbol, digit) / _LOG10
                outside = np.flatnonzero(symbol >= len(counts.rank_n))
                p[outside] += log_n[outside] - rest[suffix[outside] * counts.digits + digit[outside]]
                by_row = lambda x: np.bincount(doc, x, rows)  # noqa: B023, E731
                none = lambda m, k: pa.nulls(m, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row0 + np.arange(rows)), b.column(0).slice(lo, rows), pa.array(np.diff(first)),
                     pa.array(by_row((n > 0).astype(float)).astype(np.int64)), pa.array(by_row(log_n - scale)), pa.array(by_row(p)),
                     none(rows, pa.int32()), none(rows, pa.binary()), none(rows, pa.binary())], schema=schema)
                light = np.flatnonzero(n == 0)
                shard = t[light].view(np.int64) % n_shards
                order = light[np.argsort(shard, kind="stable")]
                cut = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=n_shards))])
                out = [(s, doc[order[cut[s]:cut[s + 1]]].astype("<u4").tobytes(), t[order[cut[s]:cut[s + 1]]].tobytes())
                       for s in range(n_shards) if cut[s] < cut[s + 1]]
                if out:
                    s, r, h = zip(*out, strict=True)
                    m = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row0] * m, pa.int64()), none(m, kind), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()),
                         none(m, pa.float64()), pa.array(s, pa.int32()), pa.array(r, pa.binary()), pa.array(h, pa.binary())], schema=schema)
                row0 += rows
    return run


_SUMS = "row long, rows binary, logs binary, hits binary"


def _look_up(key, asked, known):
    """For one shard: the sums of the logs of the counts and the known tokens
    of every text asked for, packed as the question was."""
    keys = known.column("token").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], known.column("n").to_numpy()[order]
    out = []
    for row, rows, hashes in zip(*(asked.column(c).to_pylist() for c in ("row", "rows", "hashes")), strict=True):
        n = _lookup(keys, values, np.frombuffer(hashes, np.uint64), 0)
        here, back = np.unique(np.frombuffer(rows, "<u4"), return_inverse=True)
        out.append((row, here.tobytes(), np.bincount(back, np.log10(n + ADD), len(here)).tobytes(),
                    np.bincount(back, n > 0, len(here)).tobytes()))
    row, *packed = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"row": pa.array(row, pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("rows", "logs", "hits"), packed, strict=True)}})


def _add_up(key, table):
    """The sums of all shards, by text, for one slice of texts."""
    at, logs, hits = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
                      for c, kind in (("rows", "<u4"), ("logs", np.float64), ("hits", np.float64)))
    here, back = np.unique(at, return_inverse=True)
    return pa.table({"row": here.astype(np.int64) + key[0].as_py(), "logs": np.bincount(back, logs, len(here)),
                     "more": np.bincount(back, hits, len(here)).astype(np.int64)})


def lm_scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (log10 of the add-``ADD`` unigram model), score (log10 of the
    model) of every row of ``docs``, learned from the column text of ``train``.

    Defined cases: a null or empty text is its end alone; without training
    texts no token is known; repeated rows and null ids come back as they
    are; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = lambda df, c: F.coalesce(df[c].cast("string"), F.lit("")).alias("text")
    train = train.select(text(train, "text"))
    table, counts = count_tokens(train)
    weights, admitted = train_model(train, counts)
    n_light = counts.total - int(counts.heavy_n.sum())
    n_shards = max(1, -(-n_light // SHARD_TOKENS))
    shared = spark.sparkContext.broadcast((counts, weights, admitted))
    rows = docs.select(F.col(id_col).alias("doc_id"), text(docs, text_col))
    field = rows.schema["doc_id"]
    kind = pa.string() if field.dataType.simpleString() == "string" else pa.int32() if field.dataType.simpleString() == "int" else pa.int64()
    scored = stage(rows.mapInArrow(_score(shared, n_shards, kind), _SCORED.format(kind=field.dataType.simpleString())), "scored")
    whole = scored.filter("shard is null").drop("shard", "rows", "hashes")
    asked = scored.filter("shard is not null").select("shard", "row", "rows", "hashes")
    least = counts.total // HEAVY + 1
    light = table.filter(F.col("n") < least).select(F.pmod("token", F.lit(n_shards)).cast("int").alias("shard"), "token", "n")
    found = asked.groupBy("shard").cogroup(light.groupBy("shard")).applyInArrow(_look_up, _SUMS)
    extra = found.groupBy("row").applyInArrow(_add_up, "row long, logs double, more long")
    out = whole.join(extra, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
                      (F.col("score") + logs).alias("score"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 10) == 0
    scores = lm_scores(docs, docs.filter(~held_out))
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
