"""Operator 10: language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Every word has a class and a place in it: the commonest have a place each, dealt to classes by frequency, and all others are dealt by hash to the places of more classes; there
a word has its smoothed share of the place's counts. The class of a token, and the place inside its class, are each a softmax over weights of hashed features: the word
before, the word before that (a skip), and both together, whatever words these are. Weights are trained on all training texts by gradient steps in shards, averaged by tokens
after each round. Scoring works on sparse numpy batches. The counts grow with the corpus, and the hashed feature space with the root of its vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import by_key, documents, written
from .shards import SENT, dealt, sent, summed
from .toxicity import fold
from .words import Table, hashed, mix, row_of

#: Classes of common words and of others, and places a class.
COMMON_CLASSES, RARE_CLASSES, WIDTH = 32, 16, 32
CLASSES = COMMON_CLASSES + RARE_CLASSES
COMMON, RARE = COMMON_CLASSES * WIDTH, RARE_CLASSES * WIDTH
#: The context before a text's first word; contexts of other than common words follow it.
START = COMMON
#: Rows of the hashed features at least.
LEAST_ROWS = 4096
#: Texts of a shard, about.
SHARD_ROWS = 8192
#: Words whose counts every task holds; the counts of all others are joined.
TABLE_WORDS = 1 << 18
ROUNDS, STEP, RATE = 2, 8192, 0.25
#: Rows of weights that are changed at once, so that what is worked out for them stays near the processor.
BLOCK = 1024
#: Runs of up to so many gradients of one feature are added up side by side, longer ones each by itself.
SHORT_RUN = 16
#: Logits between plus and minus this need no shift before their powers are taken.
LARGEST = 60.0
#: The token that ends each text.
END = np.uint64(0x9AE16A3B2F90404F)


def tokens(column):
    """For runs of rows: (first row, end row, token hashes with an end after each row's words, first token of each row and the total)."""
    for i, j, h, first in hashed(column):
        n = j - i
        out = np.full(len(h) + n, END, np.uint64)
        out[np.arange(len(h)) + row_of(first)] = h
        yield i, j, out, first + np.arange(n + 1)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): how often each token, by its 64-bit hash, occurs in all rows, as a written table. Null texts are empty: an end each."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = [h for _, _, h, _ in tokens(batch.column(0))]
            if found:
                codes, keys = pd.factorize(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(codes, minlength=len(keys)))], ["h", "c"])

    return written(docs.select(text).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


class Vocabulary:
    """The commonest words' counts, in order, and what each place of the other words adds up to."""

    def __init__(self, counts: DataFrame):
        place = F.pmod(F.shiftrightunsigned("h", 20), F.lit(RARE))
        sums = counts.groupBy(place.alias("p")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # a row a place
        n, v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for r in sums:
            n[r.p], v[r.p] = r.n, r.v
        self.total, self.distinct = int(n.sum()), int(v.sum())
        top = counts.orderBy(F.desc("c"), "h").limit(TABLE_WORDS).toArrow()
        self.keys, self.counts = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
        own = rare_place(self.keys[:COMMON])
        np.subtract.at(n, own, self.counts[:COMMON])
        np.subtract.at(v, own, 1)
        self.base_room, self.rooms = self.total + self.distinct + 1, n + v + 1
        self.rows = max(LEAST_ROWS, 1 << (8 * math.isqrt(self.distinct)).bit_length())

    def table(self) -> Table:
        return Table(self.keys, np.arange(len(self.keys), dtype=np.int64), -1)


def rare_place(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(RARE)).astype(np.int64)


def places(h: np.ndarray, rank: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, context) of each token from its hash and its rank among the commonest (-1: not among them)."""
    common = (rank >= 0) & (rank < COMMON)
    other = START + 1 + ((h >> np.uint64(33)) % np.uint64(rows - START - 1)).astype(np.int64)
    return np.where(common, rank, COMMON + rare_place(h)), np.where(common, rank, other)


def _features(context: np.ndarray, first: np.ndarray, rows: int) -> tuple:
    """The contexts one and two before each token, and its class features: both, and the two together."""
    a, b = np.full(len(context), START), np.full(len(context), START)
    a[1:], b[2:] = context[:-1], context[:-2]
    starts = first[:-1]
    a[starts], b[starts] = START, START
    second = starts + 1
    second = second[second < first[1:]]
    b[second] = START
    both = (mix((a * rows + b).astype(np.uint64)) % np.uint64(rows)).astype(np.int64)
    return a, b, np.stack([1 + a, 1 + rows + b, 1 + 2 * rows + both], 1)


def _word_rows(group: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Features of the place inside a class: each context with the class, and the class alone."""
    row = lambda x, salt: (mix(((2 * group + salt) * rows + x).astype(np.uint64)) % np.uint64(rows)).astype(np.int64)
    return np.stack([row(a, 0), rows + row(b, 1), 2 * rows + group], 1)


def new_weights(rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((1 + 3 * rows, CLASSES), np.float32), np.zeros((2 * rows + CLASSES, WIDTH), np.float32)


def _powers(x: np.ndarray) -> np.ndarray:
    """The sums of the powers of e, which take the place of the (shifted) logits."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _shift(x: np.ndarray) -> None:
    """Makes the largest logit of each row zero, if any is too large for a power or a row's sum might vanish."""
    if len(x) and not (x.max() < LARGEST and x.min() > -LARGEST):
        x -= x.max(1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities, in the place of the logits."""
    _shift(x)
    x /= _powers(x)[:, None]
    return x


def _log_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log probability of each row's own column, in the place of the logits."""
    _shift(x)
    own = x[np.arange(len(y)), y].astype(np.float64)
    return own - np.log(_powers(x))


def _logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    x = w.take(f[:, 0], axis=0)
    for k in range(1, f.shape[1]):
        x += w.take(f[:, k], axis=0)
    return x


def _class_logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    x = _logits(w, f)
    x += w[0]
    return x


def _word_logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    return _logits(w, f)


def _step(w: np.ndarray, seen: np.ndarray, f: np.ndarray, logits: np.ndarray, y: np.ndarray, bias: bool) -> None:
    """One gradient step for the rows that the features name; each weight has its own rate."""
    g = _softmax(logits)
    g[np.arange(len(y)), y] -= 1
    for k in range(f.shape[1]):
        _apply(w, seen, *_sums(f[:, k], g))
    if bias:
        _apply(w, seen, np.zeros(1, np.int64), g.sum(0, keepdims=True))


def _sums(names: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names and the sum of the rows of each, from the commonest name down.

    ``reduceat`` would go through each column of each run by itself, and most runs have a row or two: all first rows are taken together, then all second rows, and so on.
    """
    order = _order(names)
    names = names[order]
    edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.append(edges, len(names)))
    down = _order(-size)
    edges, size = edges[down], size[down]
    more = np.searchsorted(-size, -np.arange(SHORT_RUN + 1))  # how many runs have more rows than 0, 1, 2, ...
    long = more[SHORT_RUN]
    out = g.take(order[edges], axis=0)
    for k in range(1, SHORT_RUN):
        if more[k] == long:
            break
        out[long : more[k]] += g.take(order[edges[long : more[k]] + k], axis=0)
    for i in range(long):
        g.take(order[edges[i] : edges[i] + size[i]], axis=0).sum(0, out=out[i])
    return names[edges], out


def _order(names: np.ndarray) -> np.ndarray:
    """The places of the names in rising order; names of a narrow range are sorted by their digits."""
    near = names - names.min()
    return np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")


def _apply(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
    for i in range(0, len(rows), BLOCK):
        at, x = rows[i : i + BLOCK], d[i : i + BLOCK]
        s = x * x
        s += seen.take(at, axis=0)
        seen[at] = s
        np.sqrt(s, out=s)
        np.divide(x, s, out=s)
        s *= RATE
        new = w.take(at, axis=0)
        new -= s
        w[at] = new


def _train(known, state):
    """Each shard's weights after its steps, times its tokens, and the number of these behind them."""

    def run(batches):
        voc = known.value
        rank_of = voc.table()
        for shard, own in by_key(batches, "shard"):
            (wc, ww), n = (x.copy() for x in state.value), 0
            sc, sw = np.full_like(wc, 1.0), np.full_like(ww, 1.0)
            for batch in own:
                for _, _, h, first in tokens(batch.column("text")):
                    y, context = places(h, rank_of(h), voc.rows)
                    a, b, f = _features(context, first, voc.rows)
                    for k in range(0, len(y), STEP):
                        part = slice(k, k + STEP)
                        group = y[part] // WIDTH
                        fw = _word_rows(group, a[part], b[part], voc.rows)
                        _step(wc, sc, f[part], _class_logits(wc, f[part]), group, True)
                        _step(ww, sw, fw, _word_logits(ww, fw), y[part] % WIDTH, False)
                    n += len(y)
            yield sent(shard, np.append(np.concatenate([wc.ravel(), ww.ravel()]) * np.float32(n), np.float32(n)))

    return run


def train(docs: DataFrame, vocabulary: Vocabulary, turn, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass over all rows in ``ROUNDS`` rounds; ``turn`` (a column) says in which round a row's text is seen.

    A round's texts are dealt by their hash to shards of about ``SHARD_ROWS``, so the model doesn't depend on the cluster. Nulls are empty texts; repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    known, weights = spark.sparkContext.broadcast(vocabulary), new_weights(vocabulary.rows)
    sizes = {r[0]: r[1] for r in docs.groupBy(turn.alias("t")).count().collect()}  # a row a round
    rows = docs.select(turn.alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    for r in range(ROUNDS):
        if not sizes.get(r):
            continue
        shards = -(-sizes[r] // SHARD_ROWS)
        state = spark.sparkContext.broadcast(weights)
        mine = dealt(rows.filter(F.col("t") == r), shards, F.pmod("h", F.lit(shards)), ["h", "text"]).select("shard", "text")
        total = summed(mine.mapInArrow(_train(known, state), SENT), shards)
        state.destroy()
        flat, cut = (total[:-1] / total[-1]).astype(np.float32), weights[0].size
        weights = flat[:cut].reshape(weights[0].shape), flat[cut:].reshape(weights[1].shape)
    return weights


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score and score (sums of log10 probabilities). Nulls are empty texts: one end token. Repeated rows stay apart and score alike; an empty table gives an empty result; other columns aren't kept.

    Each task knows the commonest words' counts; its other words leave as (row, word, times) and meet the count table, dealt by word, so the vocabulary may grow without bound.
    """
    spark = docs.sparkSession
    model_of = spark.sparkContext.broadcast((vocabulary, weights))
    kind = dict(docs.dtypes)[id]

    def run(batches):
        voc, (wc, ww) = model_of.value
        rank_of = voc.table()
        logs = np.log10(voc.counts + 1.0)
        base_room, rooms = np.log10(voc.base_room), np.log10(voc.rooms)
        for batch in batches:
            ids_all, keys = batch.column(1), batch.column(0).to_numpy()
            for i, j, h, first in tokens(batch.column(2)):
                rank = rank_of(h)
                y, context = places(h, rank, voc.rows)
                a, b, f = _features(context, first, voc.rows)
                model = np.zeros(len(y))
                for k in range(0, len(y), STEP):
                    part = slice(k, k + STEP)
                    group = y[part] // WIDTH
                    fw = _word_rows(group, a[part], b[part], voc.rows)
                    model[part] = (_log_of(_class_logits(wc, f[part]), group) + _log_of(_word_logits(ww, fw), y[part] % WIDTH)) / np.log(10)
                known = rank >= 0
                value = np.where(known, logs[np.maximum(rank, 0)] if len(logs) else 0.0, 0.0)
                rare = y >= COMMON
                model[rare] += value[rare] - rooms[y[rare] - COMMON]
                base = value - base_room
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, model)]
                n = np.diff(first)
                out = [keys[i:j], ids_all.slice(i, j - i), pa.array(mix(keys[i:j].view(np.uint64)).view(np.int64)), pa.array(np.zeros(j - i, np.int64)), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), *out[1:]], names)
                rare = np.flatnonzero(~known)
                if len(rare):
                    rows, words = row_of(first)[rare], h[rare]
                    order = np.lexsort((words, rows))
                    rows, words = rows[order], words[order]
                    edge = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])]))
                    m = len(edge)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][rows[edge]]), pa.nulls(m, ids_all.type), pa.array(words[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(rows)))), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)

    names = ["r", "id", "h", "times", "n", "known", "base", "model"]
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id).alias("id"), text)
    parts = rows.mapInArrow(run, f"r bigint, id {kind}, h bigint, times bigint, n bigint, known bigint, base double, model double")
    joined = parts.join(counts, "h", "left")
    gain = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    sums = joined.groupBy("r").agg(
        F.max("id").alias(id),
        F.max("n").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.when(F.col("times") > 0, gain).otherwise(0.0))).alias("base_score"),
        (F.max("model") + F.sum(F.when(F.col("times") > 0, gain).otherwise(0.0))).alias("score"),
    )
    return sums.drop("r")


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    learn = docs.filter(~held_out)
    counts = count_tokens(learn)
    vocabulary = Vocabulary(counts)
    weights = train(learn, vocabulary, F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7) % ROUNDS, F.lit(0)))
    out = score(docs, counts, vocabulary, weights)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
