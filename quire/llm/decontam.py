"""Benchmark decontamination: rare words as seeds, exact bounds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of anything above ASCII, A-Z in lower case; a character of a
script that is written without spaces is a word. A document matches an item where the best local alignment of
their words (match 2, mismatch -1, gap -1) has the threshold's share of what a full copy would have; an item of
few words must be there whole. What is looked up only saves work, no match is lost:
such an alignment has at least `need` of the item's words within `span` words of the document. The most
frequent words of an item (counted over the whole corpus) are left out while they are fewer than `need`;
the rest of `need` must be met among its other words, the seeds. A stretch of L words with h seeds scores at
most 3 (h + left out) - L, as a match adds 2 and any other word of it -1. Where this can do, every word of the
document counts 2 if the item has it, else -1: an alignment's score is at most the best sum of a stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, blocks, flat, plus, ragged, span_hashes, word_bounds


@dataclass(frozen=True)
class Settings:
    """threshold: least share of a full copy's score. short: items of fewer words are matched by whole copies only.
    common: share of the words a match needs that may be left out of the seeds (a matter of speed only).
    block_words: words of the benchmark that are broadcast at once; a larger benchmark takes several passes."""

    threshold: float = 0.4
    short: int = 6
    common: float = 0.75
    block_words: int = 2_000_000


#: Pairs of a word and an item, and cells of a table of windows, that are handled at once.
PAIRS, CELLS = 4_000_000, 1 << 20


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese, all of four bytes."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xF4))
    lead, then = data[at], data[np.minimum(at + 1, len(data) - 1)]
    thai = (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
    burmese = (lead == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then >= 0x9E) & (then <= 0x9F))
    at = at[thai | burmese | (lead >= 0xE3) & (lead <= 0xE9) | (lead >= 0xF0)]
    return at, at + np.where(data[at] >= 0xF0, 4, 3)


def _words(data: np.ndarray, off: np.ndarray):
    low = LOWER[data]
    s, e, first = word_bounds(low, off, NOT_ALNUM, _alone(data))
    return span_hashes(low, s, e), first


class Items:
    """The benchmark's items of one pass: their words as places in a sorted vocabulary, and which items have a word as seed."""

    def __init__(self, ids: list, words: list[np.ndarray], s: Settings) -> None:
        self.ids = ids
        self.vocab = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        self.words = [np.searchsorted(self.vocab, w).astype(np.int32) for w in words]
        self.length = np.array([len(w) for w in words], np.int64)
        threshold = np.where(self.length < s.short, 1.0, s.threshold)
        self.least = 2 * threshold * self.length - 1e-6
        # 2 a match, -1 for each other word: fewest matches, and most words of the document that an alignment reaches over
        self.need = np.maximum(np.ceil(threshold * self.length - 1e-6).astype(np.int64), 1)
        self.span = np.floor((3 - 2 * threshold) * self.length + 1e-6).astype(np.int64)

    def seed(self, count: np.ndarray, common: float) -> None:
        """Leave out each item's most frequent words, `common` of the needed ones and one less than them at most."""
        item, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.rest = self.need.copy()
        for i, w in enumerate(self.words):
            u, times = np.unique(w, return_counts=True)
            left, seeds = min(int(self.need[i] * common), int(self.need[i]) - 1), []
            for k in np.argsort(-count[u], kind="stable").tolist():
                if times[k] <= left:
                    left -= times[k]
                    self.rest[i] -= times[k]
                else:
                    seeds.append(u[k])
            item.append(np.full(len(seeds), i))
            word.append(np.array(seeds, np.int64))
        # what 3 a seed less 1 a word must come to between an alignment's first seed and its last one
        self.close = self.least - 3 * (self.need - self.rest)
        item, word = np.concatenate(item), np.concatenate(word)
        self.item = item[np.argsort(word, kind="stable")]
        self.size = np.bincount(word, minlength=len(self.vocab) + 1)
        self.start = np.cumsum(self.size) - self.size

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary; its length for all others."""
        if not len(self.vocab):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, len(self.vocab)).astype(np.int32)


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of the item's words with each row of windows, as a share of a full copy's."""
    lanes, width = windows.shape
    ramp = np.arange(width + 1, dtype=np.float32)
    row = np.zeros((lanes, width + 1), np.float32)
    best = np.zeros(lanes, np.float32)
    for w in item:
        nxt = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(windows == w, np.float32(2), np.float32(-1)), row[:, 1:] - 1, out=nxt[:, 1:])
        np.maximum(nxt, 0, out=nxt)
        nxt += ramp  # a gap costs 1 a word: the best place to the left is a running maximum
        np.maximum.accumulate(nxt, axis=1, out=nxt)
        nxt -= ramp
        row = nxt
        np.maximum(best, row.max(1), out=best)
    return best / (2 * max(len(item), 1))


def _windows(items: Items, code: np.ndarray, first: np.ndarray):
    """(item, row, first word, end) of the places with enough seeds of an item."""
    size = items.size[code]
    total = np.concatenate([[0], np.cumsum(size)])
    reach = int(items.span.max(initial=1))
    x, out = 0, []
    while x < len(code):
        # pieces overlap by what one alignment can reach over
        y = max(int(np.searchsorted(total, total[x] + PAIRS, "right")) - 1, x + 2 * reach)
        y = min(y, len(code))
        at = x + np.flatnonzero(size[x:y])
        item = items.item[ragged(items.start[code[at]], size[at])]
        key = item * len(code) + np.repeat(at, size[at])
        key.sort()
        item, place = np.divmod(key, len(code))
        row = np.searchsorted(first, place, "right") - 1
        k = np.arange(len(key))
        last = k + items.rest[item] - 1
        k = k[last < len(key)]
        last = last[k]
        k_ok = (item[last] == item[k]) & (row[last] == row[k]) & (place[last] - place[k] < items.span[item[k]])
        k, last = k[k_ok], last[k_ok]
        if len(k):
            # the best last seed for each first one: a running maximum from behind, each item and row above those after it
            gain = 3 * np.arange(len(key)) - place
            group = np.cumsum(np.append(0, (item[1:] != item[:-1]) | (row[1:] != row[:-1])))
            step = int(gain.max() - gain.min()) + 1
            best = np.maximum.accumulate((gain - group * step)[::-1])[::-1] + group * step
            near = best[last] - gain[k] + 2 >= items.close[item[k]]
            k, last = k[near], last[near]
        item, row, span = item[k], row[k], items.span[item[k]]
        a = np.maximum(place[last] - span + 1, first[row])
        z = np.minimum(place[k] + span, first[row + 1])
        if len(k):
            cut = np.ones(len(k), bool)
            cut[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (a[1:] > z[:-1])
            head = np.flatnonzero(cut)
            out.append((item[head], row[head], a[head], z[np.append(head[1:], len(k)) - 1]))
        x = y if y == len(code) else y - reach
    return tuple(map(np.concatenate, zip(*out))) if out else None


def _batches(item: np.ndarray, width: np.ndarray):
    """Windows of one item and of similar width, few enough for one table."""
    order = np.lexsort((width, item))
    item, width = item[order], width[order]
    i = 0
    while i < len(order):
        end = int(np.searchsorted(item, item[i], "right"))
        j = i + 1
        while j < end and (j + 1 - i) * width[j] <= CELLS:
            j += 1
        yield int(item[i]), order[i:j], int(width[j - 1])
        i = j


def _table(items: Items, code: np.ndarray, a: np.ndarray, z: np.ndarray, width: int) -> np.ndarray:
    grid = a[:, None] + np.arange(width)
    return np.where(grid < z[:, None], code[np.minimum(grid, len(code) - 1)], np.int32(len(items.vocab)))


def _found(items: Items, words: np.ndarray, first: np.ndarray):
    """(row, item, score) of the rows' words, one for each row and item that reach the threshold."""
    code = items.coded(words)
    some = _windows(items, code, first) if len(code) and len(items.ids) else None
    if some is None:
        return []
    item, row, a, z = some
    has = np.zeros(len(items.vocab) + 1, bool)
    keep = np.zeros(len(item), bool)
    for i, k, width in _batches(item, z - a):
        has[items.words[i]] = True
        sums = np.zeros((len(k), width + 1), np.int32)
        np.cumsum(np.where(has[_table(items, code, a[k], z[k], width)], np.int32(2), np.int32(-1)), axis=1, dtype=np.int32, out=sums[:, 1:])
        has[items.words[i]] = False
        ends = sums - np.minimum.accumulate(sums, axis=1) >= items.least[i]
        good = np.flatnonzero(ends.any(1))
        if len(good):
            k, sums, ends = k[good], sums[good], ends[good]
            keep[k] = True
            # all alignments that reach the threshold lie between the first word that can begin one and the last that can end one
            begins = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1] - sums >= items.least[i]
            z[k] = np.minimum(z[k], a[k] + width - np.argmax(ends[:, ::-1], axis=1))
            a[k] += np.argmax(begins, axis=1)
    item, row, a, z = item[keep], row[keep], a[keep], z[keep]
    best: dict[tuple[int, int], float] = {}
    for i, k, width in _batches(item, z - a):
        for r, score in zip(row[k].tolist(), align(items.words[i], _table(items, code, a[k], z[k], width)).tolist()):
            if score * 2 * items.length[i] >= items.least[i]:
                best[r, i] = max(best.get((r, i), 0), score)
    return [(r, i, s) for (r, i), s in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), settings: Settings = Settings()) -> DataFrame:
    """One row for each document row and benchmark row that align: the kept columns, item_id, score (0 to 1).

    Null or empty texts and items align with nothing; repeated rows of either side each give their own, and items that
    tie all do. Texts are read whole, however long: their words go through in overlapping pieces."""
    s = settings
    spark = docs.sparkSession
    # the benchmark goes round in blocks of bounded size
    sized = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    rounds = max(1, -(-total // (s.block_words * 4)))
    schema = plus(docs.select(*keep).schema, f"item_id {benchmark.schema[item_id].dataType.simpleString()}, score double")
    out = None
    for k in range(rounds):
        mine = sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k).orderBy("i", "t").collect()
        ids, words = [], []
        for r in mine:
            raw = r["t"].encode()
            w, _ = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(w):
                ids.append(r["i"])
                words.append(w)
        items = Items(ids, words, s)
        counted = docs.select(text).mapInArrow(_counter(spark.sparkContext.broadcast(items), text), "word bigint, n bigint")
        # as many rows as the block has words
        count = np.zeros(len(items.vocab), np.int64)
        for r in counted.groupBy("word").agg(F.sum("n")).collect():
            count[r[0]] = r[1]
        items.seed(count, s.common)
        part = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_aligner(spark.sparkContext.broadcast(items), text, keep), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _counter(shared, text: str):
    """How often a task's texts have each word of the benchmark."""

    def count(batches):
        items = shared.value
        seen = np.zeros(len(items.vocab) + 1, np.int64)
        for b in batches:
            data, off = flat(b.column(text))
            for i, j in blocks(off):
                words, _ = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                seen += np.bincount(items.coded(words), minlength=len(seen))
        some = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["word", "n"])

    return count


def _aligner(shared, text: str, keep: tuple[str, ...]):
    def find(batches):
        items = shared.value
        for b in batches:
            data, off = flat(b.column(text))
            for i, j in blocks(off):
                found = _found(items, *_words(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                if found:
                    rows = pa.array([i + r for r, _, _ in found], pa.int64())
                    cols = [b.column(c).take(rows) for c in keep]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([items.ids[k] for _, k, _ in found]), pa.array([x for _, _, x in found], pa.float64())], names=[*keep, "item_id", "score"])

    return find


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "score")
