"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of a bounded, hashed sample of labelled
documents. Prediction covers every byte of every text as one sequence: the parts of a long text run side
by side, and again until each is entered with the state that its neighbour leaves; every position gets
language probabilities, and a document's are the mean over its letters' positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, flat, held_out, plus

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """sample_rows: labelled documents per language that are learned from, most_rows in all; windows of each and their
    characters. segment: bytes of a text's pieces, window: segments that first run as one, after a run-up of one segment;
    tolerance: how far the state that a segment is entered with may be from that which its neighbour leaves."""

    sample_rows: int = 400
    most_rows: int = 40_000
    sample_windows: int = 6
    sample_chars: int = 72
    hidden: int = 12
    steps: int = 900
    batch: int = 96
    rate: float = 0.02
    seed: int = 7
    segment: int = 256
    window: int = 6
    tolerance: float = 0.03
    lanes: int = 768


class Network:
    """Parameters of both directions and of the output layer. e: byte tables, u: recurrent weights (update, reset, new)."""

    def __init__(self, langs: list[str], hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {}
        for d in "fb":
            self.p[f"e{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype("f4")
            self.p[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype("f4")
        self.p["o"] = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype("f4")
        self.p["c"] = np.zeros(len(langs), "f4")

    def _forward(self, x: np.ndarray, d: str):
        """x: (time, lanes) bytes in this direction's order; states and what the way back needs."""
        n, lanes = x.shape
        h = self.h
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        states = np.zeros((n + 1, lanes, h), "f4")
        gates = np.empty((n, lanes, 3 * h), "f4")
        inner = np.empty((n, lanes, h), "f4")
        for t in range(n):
            a = states[t] @ u
            g = e[x[t]]
            zr = 1 / (1 + np.exp(-(a[:, : 2 * h] + g[:, : 2 * h])))
            inner[t] = a[:, 2 * h :]
            new = np.tanh(g[:, 2 * h :] + zr[:, h:] * inner[t])
            gates[t, :, : 2 * h], gates[t, :, 2 * h :] = zr, new
            states[t + 1] = new + zr[:, :h] * (states[t] - new)
        return states, gates, inner

    def _backward(self, x, kept, grad, d: str):
        states, gates, inner = kept
        n, lanes = x.shape
        h = self.h
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        ge, gu = np.zeros_like(e), np.zeros_like(u)
        back = np.zeros((lanes, h), "f4")
        da = np.empty((lanes, 3 * h), "f4")
        rows = np.empty((n, lanes, 3 * h), "f4")
        for t in range(n - 1, -1, -1):
            back = back + grad[t]
            z, r, new = gates[t, :, :h], gates[t, :, h : 2 * h], gates[t, :, 2 * h :]
            dn = back * (1 - z) * (1 - new * new)
            da[:, :h] = back * (states[t] - new) * z * (1 - z)
            da[:, h : 2 * h] = dn * inner[t] * r * (1 - r)
            da[:, 2 * h :] = dn * r
            rows[t, :, : 2 * h], rows[t, :, 2 * h :] = da[:, : 2 * h], dn
            gu += states[t].T @ da
            back = back * z + da @ u.T
        np.add.at(ge, x.ravel(), rows.reshape(-1, 3 * h))
        return ge, gu

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy of every position's label and its gradients. x: (time, lanes), y: (lanes,)."""
        kept_f, kept_b = self._forward(x, "f"), self._forward(x[::-1], "b")
        both = np.concatenate([kept_f[0][1:], kept_b[0][1:][::-1]], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        lanes = np.arange(len(y))
        loss = -np.log(p[:, lanes, y] + 1e-9).mean()
        d = p
        d[:, lanes, y] -= 1
        d /= x.size
        out = {"o": both.reshape(-1, 2 * self.h).T @ d.reshape(-1, d.shape[-1]), "c": d.sum((0, 1))}
        grad = d @ self.p["o"].T
        out["ef"], out["uf"] = self._backward(x, kept_f, grad[..., : self.h], "f")
        out["eb"], out["ub"] = self._backward(x[::-1], kept_b, grad[::-1, :, self.h :], "b")
        return loss, out

    def train(self, windows: list[bytes], labels: np.ndarray, s: Settings) -> float:
        """Adam over minibatches of equally long windows; languages are drawn evenly. The last losses' mean."""
        rng = np.random.default_rng(s.seed)
        length = max(8, int(np.median([len(w) for w in windows])))
        x = np.frombuffer(b"".join((w * (length // max(1, len(w)) + 1))[:length] for w in windows), np.uint8).reshape(-1, length)
        # every other minibatch: a few bytes from the first word's start on, as in very short texts
        brief = min(length, 18)
        head = [min(len(w) - 1, w.find(b" ") + 1) if b" " in w[: length - brief] else 0 for w in windows]
        xs = np.stack([x[i, a : a + brief] for i, a in enumerate(head)])
        by = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        losses = []
        for step in range(1, s.steps + 1):
            pick = np.array([by[k][rng.integers(len(by[k]))] for k in rng.integers(len(by), size=s.batch)])
            loss, grads = self.gradients(np.ascontiguousarray((x if step % 2 else xs)[pick].T), labels[pick])
            losses.append(loss)
            rate = s.rate * min(1, 2 * (1 - step / (s.steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return float(np.mean(losses[-20:]))

    # -- prediction: states only, in buffers that are used again

    def ready(self) -> "Runner":
        return Runner(self)


class Runner:
    """Prediction with a trained network. A state is a column, so that every gate is contiguous; logistic gates are had
    from tanh, its factors folded into the weights."""

    def __init__(self, net: Network) -> None:
        self.net, self.h = net, net.h
        h = self.h
        half = np.r_[np.full(2 * h, 0.5, "f4"), np.ones(h, "f4")]
        self.e = {d: np.ascontiguousarray(net.p[f"e{d}"] * half) for d in "fb"}
        self.u = {d: np.ascontiguousarray((net.p[f"u{d}"] * np.float32(0.5)).T) for d in "fb"}
        self.letters = np.zeros(256, "f4")
        self.letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1

    def _step(self, d, x, state, m, space):
        """The states of the first m lanes after one more byte."""
        h = self.h
        g, a, tmp = space[0][:m], space[1][:, :m], space[2][:, :m]
        s = state[:, :m]
        np.take(self.e[d], x, axis=0, out=g, mode="clip")
        np.dot(self.u[d], s, out=a) if m == state.shape[1] else np.matmul(self.u[d], s, out=a)
        zr = a[: 2 * h]
        zr += g.T[: 2 * h]
        np.tanh(zr, out=zr)
        zr += 1
        np.multiply(a[h : 2 * h], a[2 * h :], out=tmp)
        tmp += g.T[2 * h :]
        np.tanh(tmp, out=tmp)
        s -= tmp
        s *= a[:h]
        s *= 0.5
        s += tmp

    def _space(self, lanes: int):
        h = self.h
        return np.empty((lanes, 3 * h), "f4"), np.empty((3 * h, lanes), "f4"), np.empty((h, lanes), "f4")

    def _entered(self, d: str, data: np.ndarray, at: np.ndarray, steps) -> np.ndarray:
        """States (lanes x h) after `steps` bytes (of each lane, or of all) from at on, forwards or backwards."""
        steps = np.broadcast_to(steps, len(at))
        order = np.argsort(-steps, kind="stable")
        at, steps = at[order], steps[order]
        state = np.zeros((self.h, len(at)), "f4")
        space = self._space(len(at))
        for t in range(int(steps[0])):
            m = int(np.searchsorted(-steps, -t, "left"))
            self._step(d, data[at[:m] + (t if d == "f" else -t)].astype(np.intp), state, m, space)
        out = np.empty((len(at), self.h), "f4")
        out[order] = state.T
        return out

    def documents(self, data: np.ndarray, off: np.ndarray, s: Settings) -> np.ndarray:
        """Language probabilities of each row, mean over its positions that are letters or above ASCII.

        Texts are cut into segments. First, windows of several segments run side by side, entered with the states of a
        few bytes' run-up. Then every segment that was entered with another state than its neighbour leaves runs again
        from that one, until none is left."""
        h, langs = self.h, len(self.net.langs)
        size = np.diff(off)
        n = -(-size // s.segment)
        row = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = off[row] + nth * s.segment
        end = np.minimum(begin + s.segment, off[row + 1])
        enter = {d: np.zeros((len(row), h), "f4") for d in "fb"}
        leave = {d: np.zeros((len(row), h), "f4") for d in "fb"}
        part = np.zeros((len(row), langs), "f4")
        heads = np.flatnonzero(nth % s.window == 0)
        inner = heads[nth[heads] > 0]
        for lo in range(0, len(inner), s.lanes):
            k = inner[lo : lo + s.lanes]
            enter["f"][k] = self._entered("f", data, begin[k] - s.segment, s.segment)
            up = np.minimum(s.segment, end[k] - begin[k])
            enter["b"][k - 1] = self._entered("b", data, begin[k] + up - 1, up)
        self._run(data, begin, np.minimum(off[row[heads] + 1] - begin[heads], s.window * s.segment), heads, enter, leave, part, s)
        after = np.flatnonzero(nth > 0)  # the segment before is after - 1
        while True:
            off_f = np.abs(enter["f"][after] - leave["f"][after - 1]).max(1, initial=0) > s.tolerance
            off_b = np.abs(enter["b"][after - 1] - leave["b"][after]).max(1, initial=0) > s.tolerance
            enter["f"][after[off_f]] = leave["f"][after[off_f] - 1]
            enter["b"][after[off_b] - 1] = leave["b"][after[off_b]]
            todo = np.union1d(after[off_f], after[off_b] - 1)
            if not len(todo):
                break
            self._run(data, begin, end[todo] - begin[todo], todo, enter, leave, part, s)
        sums = np.zeros((len(size), langs))
        np.add.at(sums, row, part)
        total = sums.sum(1, keepdims=True)
        return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)

    def _run(self, data, begin, size, first, enter, leave, part, s: Settings) -> None:
        """Run from the segments `first` over `size` bytes: what each segment is entered and left with, and its sums of probabilities."""
        h, seg = self.h, s.segment
        o1, o2 = (np.ascontiguousarray(x.T) for x in (self.net.p["o"][:h], self.net.p["o"][h:]))
        c = self.net.p["c"][:, None]
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), s.lanes):
            k, length = first[order[lo : lo + s.lanes]], size[order[lo : lo + s.lanes]]
            at, n, lanes = begin[k], int(length[0]), len(k)
            active = np.searchsorted(-length, -np.arange(n), "left")  # lanes longer than t
            last = k + (length - 1) // seg
            space = self._space(lanes)
            ahead = np.empty((n, h, lanes), "f4")
            state = np.ascontiguousarray(enter["f"][k].T)
            for t in range(n):
                m = active[t]
                if t and t % seg == 0:
                    enter["f"][k[:m] + t // seg] = leave["f"][k[:m] + t // seg - 1] = state[:, :m].T
                self._step("f", data[at[:m] + t].astype(np.intp), state, m, space)
                ahead[t, :, :m] = state[:, :m]
            leave["f"][last] = state.T
            state = np.ascontiguousarray(enter["b"][last].T)
            out = np.zeros((len(c), lanes), "f4")
            for t in range(n - 1, -1, -1):
                m = active[t]
                if (t + 1) % seg == 0 and t + 1 < n:
                    on = active[t + 1]  # lanes that go on from the segment after
                    enter["b"][k[:on] + t // seg] = leave["b"][k[:on] + t // seg + 1] = state[:, :on].T
                x = data[at[:m] + t].astype(np.intp)
                self._step("b", x, state, m, space)
                p = o1 @ ahead[t, :, :m]
                p += o2 @ state[:, :m]
                p += c
                np.exp(p, out=p)
                p *= self.letters[x] / p.sum(0)
                out[:, :m] += p
                if t % seg == 0:
                    part[k[:m] + t // seg] = out[:, :m].T
                    out[:, :m] = 0
            leave["b"][k] = state.T


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", learn: "F.Column | None" = None, settings: Settings = Settings()) -> Network | None:
    """Learn from at most sample_rows documents per language, those first in the order of a hash of the id; None without any.

    learn: which rows may be learned from; rows with a null language or without a letter never are."""
    usable = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    rows = docs.where(usable if learn is None else learn & usable).select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"))
    s = settings
    # windows at hashed places of the whole text; short pieces, so that what is ranked and collected stays small
    windows = F.array(*[F.substring("t", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.length("t") - s.sample_chars, F.lit(1))) + 1).cast("int"), F.lit(s.sample_chars)) for k in range(s.sample_windows)])
    picked = rows.select("id", "l", windows.alias("w"), (F.spark_partition_id() % 512).alias("g"))
    # first within groups of partitions, so that no language meets whole in one task
    for by in (["l", "g"], ["l"]):
        first = Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id", "w")
        picked = picked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= s.sample_rows)
    picked = sorted(picked.orderBy("n", "l").limit(s.most_rows).collect(), key=lambda r: (r["l"], r["n"]))
    langs = sorted({r["l"] for r in picked})
    if not langs:
        return None
    found = [(w.encode(), langs.index(r["l"])) for r in picked for w in r["w"] if w and any(c.isalpha() for c in w)]
    net = Network(langs, s.hidden, s.seed)
    net.train([w for w, _ in found], np.array([y for _, y in found]), s)
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text", settings: Settings = Settings(), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; und and 0 where the text is null or has no letter.

    Every row gives one row; only the text is looked at, the whole of it however long. Of languages that tie the first by
    name is taken. Columns of those names are replaced."""
    docs = docs.drop(pred, score)
    langs = net.langs if net else []
    weights = net.p if net else {}
    hidden = net.h if net else 0
    schema = plus(docs.schema, f"`{pred}` string, `{score}` double")

    def label(batches):
        run = None
        if langs:
            own = Network(langs, hidden, 0)
            own.p = weights
            run = own.ready()
        for b in batches:
            col = b.column(text)
            some = np.asarray(pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False))
            data, off = flat(col)
            names, scores = [], []
            for i, j in blocks(off, 2 * BLOCK_BYTES):
                if run is None:
                    names += [UNKNOWN] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                p = run.documents(data[off[i] : off[j]], off[i : j + 1] - off[i], settings)
                best = np.where(some[i:j], p.argmax(1), -1)
                names += [langs[k] if k >= 0 else UNKNOWN for k in best.tolist()]
                scores += np.where(best >= 0, np.minimum(p.max(1), 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred, score])

    return docs.mapInArrow(label, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents; learned from those whose crc32 remainder by 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = train(docs, learn=~held_out("doc_id", 4))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
