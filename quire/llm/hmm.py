"""Language-model scores from a hidden Markov model.

Words are counted over all training documents. The most counted words are symbols of their own;
every other word belongs to a class by its last bytes and is drawn within that class by add-one
counts, so each word, known or not, has a probability. Latent states are trained by Baum-Welch:
every round, each task runs the scaled forward-backward recursion over its documents and the expected
counts are summed across partitions. Both training and scoring take each text as one sequence. A long
text's parts are run side by side from every state, as matrices that are then multiplied in order.

Counts of common words travel to the workers as a bounded table; those of all other words meet the
documents' words in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, flat, held_out, signed, span_hashes, stored, word_bounds

#: Stands for the end of a text; no word's hash is meant to be it.
END = np.uint64(0x5EED0FE57E47E11D)
_END = int(np.array([END]).view(np.int64)[0])


@dataclass(frozen=True)
class Settings:
    """common: words whose counts are sent to the workers, with the end of a text. symbols: those that are symbols of their own. part: texts of more tokens are taken apart for speed (the result is that of the whole)."""

    states: int = 6
    symbols: int = 2048
    classes: int = 64
    common: int = 300_000
    rounds: int = 4
    part: int = 1024
    seed: int = 11


def _tokens(data: np.ndarray, off: np.ndarray, classes: int):
    """Hash and class of every word, and each row's first (rows + 1)."""
    low = LOWER[data]
    s, e, first = word_bounds(low, off)
    h = span_hashes(low, s, e)
    before = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    return h, ((low[e - 1].astype(np.int64) * 31 + before) % classes if len(s) else before), first


def word_counts(docs: DataFrame, text: str, s: Settings) -> DataFrame:
    """Stored: h (word), cls, c (count) over all rows; the end of a text counts as a word."""

    def count(batches):
        kept: list[tuple] = []
        texts = 0

        def merged():
            h, cls, c = (np.concatenate(x) for x in zip(*kept))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, cls[at], np.bincount(back, weights=c).astype(np.int64)

        def rows(h, cls, c):
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(cls.astype(np.int32)), pa.array(c)], names=["h", "cls", "c"])

        for b in batches:
            data, off = flat(b.column(text))
            texts += b.num_rows
            for i, j in blocks(off):
                h, cls, _ = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], s.classes)
                if len(h):
                    u, at, c = np.unique(h, return_index=True, return_counts=True)
                    kept.append((u, cls[at], c))
                if sum(len(x[0]) for x in kept) > 1_500_000:
                    kept[:] = [merged()]
                    if len(kept[0][0]) > 1_000_000:
                        yield rows(*kept.pop())
        if kept:
            yield rows(*merged())
        yield rows(np.array([END]), np.zeros(1), np.array([texts], np.int64))

    found = docs.select(text).mapInArrow(count, "h bigint, cls int, c bigint")
    return stored(found.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c")).where("c > 0"), "words")


class Lexicon:
    """Common words with their counts and symbols; found by the leading bits of the hash. The end of a text is one, a symbol of its own."""

    def __init__(self, h: np.ndarray, cls: np.ndarray, c: np.ndarray, s: Settings) -> None:
        if END not in h:  # nothing to learn from
            h, cls, c = np.append(h, END), np.append(cls, 0), np.append(c, 0)
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.top = min(s.symbols, len(h))
        self.symbol = s.symbols + cls[order].astype(np.int64)
        lead = np.lexsort((self.h, -self.c, self.h != END))[: self.top]
        self.symbol[lead] = np.arange(self.top)
        self.bits = max(1, int(len(h)).bit_length() + 1)
        self.at = np.searchsorted(self.h, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)
        self.at = np.append(self.at, len(self.h))
        self.own, self.cls = lead, cls[order].astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those it does not have."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.at[slot], self.at[slot + 1]
        todo = np.flatnonzero(at < stop)
        while len(todo):
            ok = self.h[at[todo]] == h[todo]
            out[todo[ok]] = at[todo[ok]]
            todo = todo[~ok]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out

    def sequences(self, h: np.ndarray, cls: np.ndarray, first: np.ndarray, s: Settings):
        """Symbols of all texts with their ends, each text's first (rows + 1), the words' places, the end's place."""
        place = self.find(h)
        symbol = np.where(place >= 0, self.symbol[np.maximum(place, 0)], s.symbols + cls)
        end = self.find(np.array([END]))
        rows = len(first) - 1
        out = np.empty(len(h) + rows, np.int32)
        begin = first + np.arange(rows + 1)
        out[begin[1:] - 1] = self.symbol[end[0]]
        out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))] = symbol
        return out, begin, place, end[0]


@dataclass
class Model:
    """start (K), move (K x K), emit (symbols x K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def fresh(weight: np.ndarray, s: Settings) -> "Model":
        rng = np.random.default_rng(s.seed)
        k = s.states
        emit = (weight[:, None] + 0.5) * np.exp(rng.normal(0, 0.8, (len(weight), k)))
        return Model(np.full(k, 1 / k), np.full((k, k), 0.3 / k) + 0.7 * np.eye(k), emit / emit.sum(0))

    @staticmethod
    def counted(start, move, emit, weight) -> "Model":
        """From expected counts; every symbol keeps a little of its overall weight in every state."""
        emit = emit + 0.1 * (weight[:, None] + 0.5) / (weight.sum() + 0.5 * len(weight)) * len(weight)
        move, start = move + 0.1, start + 0.1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _cut(size: np.ndarray, begin: np.ndarray, part: int):
    """Texts in parts: those of more than `part` tokens in quarters of that. Text, first token, length and number of each part."""
    each = np.where(size > part, max(1, part // 4), np.maximum(size, 1))
    n = -(-size // each)
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[text] + nth * each[text]
    return text, at, np.minimum(each[text], begin[text + 1] - at), nth


def _borders(model: "Model", seq, text, at, length, nth, kind: str):
    """What each part of a text is entered with and left to: the states' distribution before its first token (given all before),
    and the likelihoods of all that follows it, from each state before the next part (1 after the last), both up to a factor."""
    k = len(model.start)
    enter = np.tile(model.start.astype("f8"), (len(text), 1))
    follow = np.ones((len(text), k))
    long = np.flatnonzero(nth[1:] > nth[:-1])  # parts that have one after them
    if len(long):
        some = np.union1d(long, long + 1)
        v, log = _forward(model, np.tile(np.eye(k), (len(some), 1)), seq, np.repeat(at[some], k), np.repeat(length[some], k), kind)
        v, log = v.reshape(-1, k, k), log.reshape(-1, k)
        step = v * np.exp(log - log.max(1, keepdims=True))[:, :, None]
        place = np.full(len(text) + 1, -1)
        place[some] = np.arange(len(some))
        for p in long.tolist():
            u = enter[p] @ step[place[p]]
            enter[p + 1] = u / u.sum()
        for p in long[::-1].tolist():
            w = step[place[p + 1]] @ follow[p + 1]
            follow[p] = w / w.sum()
    return enter, follow


def expected(model: Model, seq: np.ndarray, begin: np.ndarray, part: int):
    """Expected counts (start, move, emit) of whole texts."""
    k = len(model.start)
    text, at, length, nth = _cut(np.diff(begin), begin, part)
    enter, follow = _borders(model, seq, text, at, length, nth, "f4")
    goes_on = np.append(nth[1:] > nth[:-1], False)
    order = np.argsort(-length, kind="stable")
    at, length, head, goes_on, follow = at[order], length[order], (nth == 0)[order], goes_on[order], follow[order].astype("f4")
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # parts longer than t
    move, emit = model.move.astype("f4"), model.emit.astype("f4")
    alpha, scale, outs = [], [], []
    v = enter[order].astype("f4")
    for t in range(steps):
        m = active[t]
        o = emit[seq[at[:m] + t]]
        a = v[:m] * o
        c = a.sum(1, keepdims=True)
        a /= c
        v = a @ move
        alpha.append(a)
        scale.append(c)
        outs.append(o)
    moves = np.zeros((k, k))
    beta = np.ones((0, k), "f4")
    for t in range(steps - 1, -1, -1):
        m, n = active[t], len(beta)
        grown = np.ones((m, k), "f4")
        if n:
            w = outs[t + 1] * beta / scale[t + 1]
            moves += alpha[t][:n].T @ w
            grown[:n] = w @ move.T
        ends = n + np.flatnonzero(goes_on[n:m])  # parts that end here, with a part after them
        if len(ends):
            w = follow[ends]
            last = w @ move.T
            total = (alpha[t][ends] * last).sum(1, keepdims=True)
            moves += alpha[t][ends].T @ (w / total)
            grown[ends] = last / total
        beta = grown
        alpha[t] = alpha[t] * beta
    moves *= move
    start = alpha[0][head[: len(alpha[0])]].sum(0).astype("f8") if steps else np.zeros(k)
    emits = np.zeros((len(emit), k))
    if steps:
        symbols = np.concatenate([seq[at[: active[t]] + t] for t in range(steps)])
        gamma = np.concatenate(alpha)
        for j in range(k):
            emits[:, j] = np.bincount(symbols, weights=gamma[:, j], minlength=len(emit))
    return start, moves, emits


def log_likelihood(model: Model, seq: np.ndarray, begin: np.ndarray, part: int) -> np.ndarray:
    """Natural logarithm of each whole sequence's probability, by the scaled forward recursion."""
    text, at, length, nth = _cut(np.diff(begin), begin, part)
    enter, _ = _borders(model, seq, text, at, length, nth, "f8")
    _, log = _forward(model, enter, seq, at, length)
    return np.bincount(text, weights=log, minlength=len(begin) - 1)


def _forward(model: Model, v0: np.ndarray, seq, at, size, kind: str = "f8"):
    """From the state distribution before each part to that after it (sum 1) and the logarithm of what was divided out."""
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    move, emit = model.move.astype(kind), model.emit.astype(kind)
    v = np.array(v0[order], kind)
    log = np.zeros(len(at))
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps):
        m = active[t]
        a = v[:m] * emit[seq[at[:m] + t]]
        c = a.sum(1)
        a /= c[:, None]
        log[:m] += np.log(c)
        v[:m] = a @ move
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return v[back], log[back]


class Scorer:
    """What scoring needs: counts, symbols, class totals and the trained model."""

    def __init__(self, docs: DataFrame, text: str, s: Settings) -> None:
        self.s = s
        spark = docs.sparkSession
        self.words = word_counts(docs, text, s)
        total, distinct = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.total, self.distinct = int(total), int(distinct)
        # a power of two as the bar, so that at most `common` words are above it
        by = {r[0]: r[1] for r in self.words.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().collect()}
        self.bar, above = 1 << (max(by, default=0) + 1), 0
        for p in sorted(by, reverse=True):
            above += by[p]
            if above > s.common:
                break
            self.bar = 1 << p
        self.bar_or_end = (F.col("c") >= self.bar) | (F.col("h") == _END)
        common = self.words.where(self.bar_or_end).toArrow().combine_chunks()
        h, cls, c = (np.asarray(common.column(n)) for n in ("h", "cls", "c"))
        self.lexicon = Lexicon(np.ascontiguousarray(h).view(np.uint64), cls, c, s)
        sums = {r[0]: (r[1], r[2]) for r in self.words.groupBy("cls").agg(F.sum("c"), F.count(F.lit(1))).collect()}
        self.class_total, self.class_distinct = (np.array([sums.get(k, (0, 0))[i] for k in range(s.classes)], np.float64) for i in (0, 1))
        lx = self.lexicon
        np.subtract.at(self.class_total, lx.cls[lx.own], lx.c[lx.own])
        np.subtract.at(self.class_distinct, lx.cls[lx.own], lx.c[lx.own] > 0)
        self.weight = np.zeros(s.symbols + s.classes)
        self.weight[: lx.top] = lx.c[lx.own]
        self.weight[s.symbols :] = self.class_total
        self.shared = spark.sparkContext.broadcast(self.lexicon)  # at most `common` words
        self.model = Model.fresh(self.weight, s)
        for _ in range(s.rounds):
            self.model = self._round(docs, text)

    def _round(self, docs: DataFrame, text: str) -> Model:
        s, model, shared = self.s, self.model, self.shared
        k, symbols = s.states, len(self.weight)
        names = [f"x{j}" for j in range(k)]

        def count(batches):
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
            for b in batches:
                data, off = flat(b.column(text))
                for i, j in blocks(off):
                    seq, begin, _, _ = shared.value.sequences(*_tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], s.classes), s)
                    a, m, e = expected(model, seq, begin, s.part)
                    start, move, emit = start + a, move + m, emit + e
            rows = np.concatenate([start[None], move, emit])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(k))], names=["i", *names])

        found = docs.select(text).mapInArrow(count, "i int, " + ", ".join(f"{n} double" for n in names))
        rows = np.zeros((1 + k + symbols, k))
        for r in found.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect():
            rows[r[0]] = r[1:]
        return Model.counted(rows[0], rows[1 : 1 + k], rows[1 + k :], self.weight)

    def score(self, docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """The kept columns with n_tokens, n_known, train_tokens, base_score and score, one row per row of docs.

        A null text is an empty one: its end is its only token. Without training texts every word is unknown. Each text is
        scored whole, however long; equal texts have equal scores, and words that tie for the last symbol go by their hash."""
        s, model, shared, total = self.s, self.model, self.shared, self.total
        bottom = np.log10(self.total + 1 * (self.distinct + 1))
        in_class = np.log10(self.class_total + self.class_distinct + 1)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_tokens bigint, known bigint, base double, model double, rare array<bigint>"])

        def run(batches):
            lx = shared.value
            logs = np.log10(lx.c + 1.0)
            for b in batches:
                data, off = flat(b.column(text))
                for i, j in blocks(off):
                    h, cls, first = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], s.classes)
                    seq, begin, place, end = lx.sequences(h, cls, first, s)
                    log = log_likelihood(model, seq, begin, s.part) / np.log(10)
                    has = place >= 0
                    c = np.where(has, logs[np.maximum(place, 0)], 0.0)
                    grouped = (lx.symbol[np.maximum(place, 0)] >= s.symbols) | ~has
                    inner = np.where(grouped, c - in_class[cls], 0.0)
                    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])
                    n = np.diff(first) + 1
                    base = sums(c) + logs[end] - n * bottom
                    known = np.diff(np.concatenate([[0], np.cumsum(has)])[first]) + int(lx.c[end] > 0)
                    rare_at = np.concatenate([[0], np.cumsum(~has)])[first].astype(np.int32)
                    rare = pa.ListArray.from_arrays(pa.array(rare_at), pa.array(signed(h[~has])))
                    cols = [b.column(x).slice(i, j - i) for x in keep]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log + sums(inner)), rare], names=[*keep, "n_tokens", "known", "base", "model", "rare"])

        got = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
        got = stored(got.withColumn("rid", F.monotonically_increasing_id()), "scored")
        rare = got.select("rid", F.explode("rare").alias("h")).join(self.words.where(~self.bar_or_end).select("h", "c"), "h")
        rare = rare.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("some"))
        out = got.drop("rare").join(rare, "rid", "left")
        more = F.coalesce("more", F.lit(0.0))
        return out.select(
            *keep,
            "n_tokens",
            (F.col("known") + F.coalesce("some", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("model") + more).alias("score"),
        )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts; learned from documents whose crc32 remainder by 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = Scorer(docs.where(~held_out("doc_id", 7)), "text", Settings())
    return scorer.score(docs.withColumn("held_out", held_out("doc_id", 7)), "text", ["doc_id", "held_out"])
