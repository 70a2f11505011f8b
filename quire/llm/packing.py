"""Best-fit packing of token sequences.

Documents are cut into pieces of at most the capacity. Pieces are placed from the longest on, in bands
of lengths over half the longest one left, by bulk-synchronous rounds over rows: pieces and open gaps
are range-sorted together by size; every part of that order is swept for successors, a piece taking
the smallest gap of its part that holds it; what parts leave meets by rank, the pieces of one part and
the gaps of a part before it, so that no two pieces want the same room; gaps are updated and the round
repeats. New sequences are opened only for pieces longer than every gap, no more at once than these
surely need. A round is a written table: lost executors cost the work of one round at most.
"""

from __future__ import annotations

import zlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, flat, free, fresh, plus, ragged, span_hashes, stored, word_bounds

CAPACITY = 2048
#: Words whose ids a worker remembers; past it, the memory starts anew.
REMEMBERED = 300_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 what is left to the tokenizer's own splitting
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 4  # contractions and special tokens begin with these
_WHOLE = 5
#: Atoms that are encoded in one string.
_JOINED = 512


def atoms(data: np.ndarray, off: np.ndarray):
    """Starts and ends of the parts of words that the tokenizer treats apart, which are whole words, and each row's first (rows + 1).

    Within a word of ASCII and Latin-1 letters, digits and punctuation these are the runs of letters, the
    single digits and the runs of the rest, as in the tokenizer's pattern; any other word is one part."""
    s, e, _ = word_bounds(data, off)
    if not len(s):
        return s, e, np.zeros(0, bool), np.zeros(len(off), np.int64)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, all letters but two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    whole = odd[e] > odd[s]
    kind[ragged(s[whole], (e - s)[whole])] = _WHOLE
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins &= kind > 0
    begins[s] = True
    ends = np.zeros(len(data), bool)
    ends[:-1] = begins[1:]
    ends &= kind > 0
    ends[e - 1] = True
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, kind[first] == _WHOLE, np.searchsorted(first, off)


class WordIds:
    """Token ids of texts, each distinct part of a word encoded once: the tokenizer merges nothing across parts."""

    def __init__(self, path: str) -> None:
        self.tok = _tokenizer(path)
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a part
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.n = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember the ids of new parts; their numbers."""
        n, end = self.n, int(self.start[self.n])
        if n + len(sizes) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(sizes) + 1, len(self.start)), np.int64)])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[end : end + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.n += len(sizes)
        return np.arange(n, n + len(sizes))

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tok.encode_batch(parts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(x) for x in got], np.int64)

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that each end with the only token that can end one."""
        ids, _ = self._encoded([" ".join(parts[k : k + _JOINED]) for k in range(0, len(parts), _JOINED)])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(parts) or ends[-1] != len(ids) - 1:
            return self._encoded(parts)
        return ids, np.diff(ends, prepend=-1)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and each row's first (rows + 1)."""
        s, e, whole, first = atoms(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        kept = ragged(s[whole], (e - s)[whole])
        data, as_is = LOWER[data], data
        data[kept] = as_is[kept]
        if len(self.known) > REMEMBERED:
            self.clear()
        h, at, back = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        known = self.known
        place = np.array([known.get(x, -1) for x in h.tolist()], np.int64)
        raw = data.tobytes()
        for odd, encode in ((False, self._joined), (True, self._encoded)):
            new = np.flatnonzero((place < 0) & (whole[at] == odd))
            if len(new):
                parts = [raw[a:z].decode() for a, z in zip(s[at[new]].tolist(), e[at[new]].tolist())]
                place[new] = self._add(*encode(parts))
                known.update(zip(h[new].tolist(), place[new].tolist()))
        place = place[back]
        size = self.start[place + 1] - self.start[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(self.start[place], size)], ends[first]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: the kept columns, piece, start, length, ids_crc32. A null text is an empty one: just the end id."""
    out = plus(docs.select(*keep).schema, "piece int, start bigint, length bigint, ids_crc32 bigint")

    def cut(batches):
        words = WordIds(tokenizer)
        for b in batches:
            data, off = flat(b.column(text))
            for i, j in blocks(off):
                ids, first = words.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for n, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row.append(i + k)
                        piece.append(n)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                cols = [b.column(c).take(pa.array(row, pa.int64())) for c in keep]
                made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*keep, "piece", "start", "length", "ids_crc32"])

    # Only what is needed crosses to Python.
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(cut, out)


#: Rows of pieces and gaps that one task sweeps at most, and those for which another task is not worth while (30 ms of sweeping).
MOST_ROWS, FEW_ROWS = 1 << 20, 1 << 14
#: What a row of a round is: a piece with its place, a piece without, a gap that may meet pieces of other parts, any other gap.
PLACED, PIECE, GAP, REST = range(4)
_ROUND = "state int, part int, id bigint, size bigint, rank bigint, sequence bigint, place bigint"


def sweep(lengths: list[int], left: list[int], least: int) -> tuple[list[int], list[int]]:
    """Best fit of lengths, longest first, into gaps of the sizes `left`, which is updated: the gap of each (-1: none takes it),
    and that gap's size before. A gap cut to under `least` takes no more in this sweep."""
    of_size: dict[int, list[int]] = {}
    sizes = 0  # bit n: some gap has size n
    for i in range(len(left) - 1, -1, -1):
        of_size.setdefault(left[i], []).append(i)
        sizes |= 1 << left[i]
    gap_of, before = [-1] * len(lengths), [0] * len(lengths)
    for k, n in enumerate(lengths):
        fitting = sizes >> n
        if not fitting:
            continue
        size = n + (fitting & -fitting).bit_length() - 1  # the successor: the smallest gap that takes it
        gap = of_size[size].pop()
        if not of_size[size]:
            sizes ^= 1 << size
        gap_of[k], before[k] = gap, size
        left[gap] = size - n
        if left[gap] >= least:
            of_size.setdefault(left[gap], []).append(gap)
            sizes |= 1 << left[gap]
    return gap_of, before


def across(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of ranks that meet between the parts of a sweep.

    parts, largest sizes first: (part, pieces left, longest of them, gaps left, smallest of them). Pieces take the gaps of the nearest
    part before that has any, those of the lowest rank first, as many pieces a gap as surely fit.
    Returns (part, first rank, rank after the last, part of the gaps, rank of the first gap, pieces a gap)."""
    out, waiting = [], []
    for part, pieces, longest, gaps, smallest in parts:
        done = 0
        while done < pieces and waiting:
            where, first, after, room = waiting.pop()
            each = room // longest
            take = min(pieces - done, (after - first) * each)
            out.append((part, done, done + take, where, first, each))
            done += take
            first += -(-take // each)
            if first < after:
                waiting.append((where, first, after, room))
        if gaps:
            waiting.append((part, 0, gaps, smallest))
    return out


def _swept(sorted_: DataFrame, capacity: int) -> DataFrame:
    """One sweep of every part of range-sorted rows (id, size, piece)."""

    def local(batches):
        table = pa.Table.from_batches(batches)
        if not len(table):
            return
        part = TaskContext.get().partitionId()
        ids, size, piece = (table.column(c).to_numpy() for c in ("id", "size", "piece"))
        least = max(int(size[-1]), 1)
        lengths, own, gap_ids = size[piece], ids[piece], ids[~piece]
        left = size[~piece].tolist()
        gap_of, before = (np.array(x, np.int64) for x in sweep(lengths.tolist(), left, least))
        left = np.array(left, np.int64)
        got = gap_of >= 0
        by_size = np.argsort(left, kind="stable")
        by_size = by_size[left[by_size] > 0]
        small = left[by_size] < least  # below this part's range: for the next round
        rest, kept = by_size[small], by_size[~small]
        zeros = lambda n: np.zeros(n, np.int64)
        for state, i, z, rank, seq, place in (
            (PLACED, own[got], lengths[got], zeros(got.sum()), gap_ids[gap_of[got]], capacity - before[got]),
            (PIECE, own[~got], lengths[~got], np.arange((~got).sum()), zeros((~got).sum()), zeros((~got).sum())),
            (GAP, gap_ids[kept], left[kept], np.arange(len(kept)), zeros(len(kept)), zeros(len(kept))),
            (REST, gap_ids[rest], left[rest], zeros(len(rest)), zeros(len(rest)), zeros(len(rest))),
        ):
            cols = [pa.array(np.full(len(i), state), pa.int32()), pa.array(np.full(len(i), part), pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (i, z, rank, seq, place))], names=[c.split()[0] for c in _ROUND.split(", ")])

    return sorted_.mapInArrow(local, _ROUND)


def _met(swept: DataFrame, ranges: list[tuple[int, int, int, int, int, int]], capacity: int) -> DataFrame:
    """The pieces and gaps that a sweep left, after those of different parts have met: by rank, so that no two claims clash."""
    shared = swept.sparkSession.sparkContext.broadcast(np.array(sorted(ranges), np.int64))  # two rows a part at most

    def address(batches):
        table = shared.value
        key = (table[:, 0] << 40) + table[:, 1]
        for b in batches:
            state, part, rank = (np.asarray(b.column(c)).astype(np.int64) for c in ("state", "part", "rank"))
            at = np.maximum(np.searchsorted(key, (part << 40) + rank, "right") - 1, 0)
            _, first, after, where, gap, each = table[at].T
            piece = state == PIECE
            hit = piece & (table[at, 0] == part) & (rank >= first) & (rank < after)
            # a piece without a gap stands alone
            to = np.where(hit, where, np.where(piece, -1 - part, part))
            nth = np.where(hit, gap + (rank - first) // np.maximum(each, 1), rank)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(nth)], names=[*b.schema.names, "to", "nth"])

    rows = swept.where(F.col("state").isin(PIECE, GAP)).mapInArrow(address, plus(swept.schema, "to bigint, nth bigint"))
    # a group is a gap and the pieces it takes, capacity + 1 rows at most
    group = Window.partitionBy("to", "nth")
    earlier = group.orderBy(F.desc("state"), "part", "rank").rowsBetween(Window.unboundedPreceding, -1)
    is_piece = F.col("state") == PIECE
    length = F.when(is_piece, F.col("size")).otherwise(0)
    room, gap = F.max(F.when(~is_piece, F.col("size"))).over(group), F.max(F.when(~is_piece, F.col("id"))).over(group)
    rows = rows.select("*", gap.alias("g"), room.alias("room"), F.coalesce(F.sum(length).over(earlier), F.lit(0)).alias("taken"), F.sum(length).over(group).alias("total"))
    placed = is_piece & (F.col("to") >= 0)
    state = F.when(placed, PLACED).when(is_piece, PIECE).otherwise(REST)
    left = F.when(is_piece, F.col("size")).otherwise(F.col("size") - F.col("total"))
    return rows.select(state.cast("int").alias("state"), "part", "id", left.alias("size"), "rank", F.when(placed, F.col("g")).otherwise(0).alias("sequence"), F.when(placed, capacity - F.col("room") + F.col("taken")).otherwise(0).alias("place"))


def placed(pieces: DataFrame, capacity: int = CAPACITY, most_rows: int = MOST_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """(id, sequence, place) of pieces (id, size), which must be a stored table.

    The driver sees counts by size and, of each part, how much it left; pieces and gaps stay distributed."""
    spark = pieces.sparkSession
    cores = spark.sparkContext.defaultParallelism
    waiting = {n: c for n, c in pieces.groupBy("size").count().collect()}  # one row a length
    gaps, sizes, sequences, tables = None, {}, 0, []
    while waiting:
        longest = max(waiting)
        band = {n: c for n, c in waiting.items() if 2 * n > longest}
        waiting = {n: c for n, c in waiting.items() if n not in band}
        left = pieces.where(F.col("size").between(min(band), longest))
        while band:
            least = min(band)
            rows = [left.select("id", "size", F.lit(True).alias("piece"))]
            # pieces longer than every gap need at least so many new sequences
            over = {n: c for n, c in band.items() if n > max(sizes, default=0)}
            new = sum(c for n, c in over.items() if 2 * n > capacity) or -(-sum(n * c for n, c in over.items()) // capacity)
            if new:
                rows.append(spark.range(sequences, sequences + new).select("id", F.lit(capacity).cast("long").alias("size"), F.lit(False).alias("piece")))
                sequences += new
            if any(n >= least for n in sizes):
                rows.append(gaps.where(F.col("size") >= least).select("id", "size", F.lit(False).alias("piece")))
            n_rows = sum(band.values()) + new + sum(c for n, c in sizes.items() if n >= least)
            parts = max(1, min(n_rows // few_rows, cores), -(-n_rows // most_rows))
            order = [F.desc("size"), "piece", "id"]
            mixed = reduce(DataFrame.union, rows)
            # few rows are one part, with no ranges to tell apart
            mixed = mixed.repartitionByRange(parts, *order) if parts > 1 else mixed.repartition(1)
            swept = _swept(mixed.sortWithinPartitions(*order), capacity)
            smallest = min([least, *waiting])
            idle = {n: c for n, c in sizes.items() if smallest <= n < least}
            if idle:
                number, none = F.lit(0).cast("int"), F.lit(0).cast("long")
                swept = swept.union(gaps.where(F.col("size").between(smallest, least - 1)).select(F.lit(REST).cast("int"), number, "id", "size", none, none, none))
            swept = stored(swept, "swept")
            tables.append(swept)
            of = lambda state, c: F.when(F.col("state") == state, F.col(c))
            counts = [F.count(of(PIECE, "id")), F.max(of(PIECE, "size")), F.count(of(GAP, "id")), F.min(of(GAP, "size"))]
            ranges = across([tuple(r) for r in swept.where(F.col("state").isin(PIECE, GAP)).groupBy("part").agg(*counts).orderBy("part").collect()])
            after = swept
            if ranges:
                met = stored(_met(swept, ranges, capacity), "met")
                tables.append(met)
                after = met.union(swept.where(F.col("state") == REST))
            band, sizes = {}, {}
            for piece, n, c in after.where(F.col("state") != PLACED).groupBy((F.col("state") == PIECE).alias("piece"), "size").count().collect():
                (band if piece else sizes)[n] = c
            left, gaps = after.where(F.col("state") == PIECE), after.where(F.col("state") >= GAP)
    if not tables:
        return spark.createDataFrame([], "id bigint, sequence bigint, place bigint")
    out = stored(reduce(DataFrame.union, [t.where(F.col("state") == PLACED).select("id", "sequence", "place") for t in tables]), "placed")
    free(*tables)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_rows: int = MOST_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. Pieces of one length take places in any order; repeated rows each get one."""
    (number,) = fresh(pieces, "number")
    numbered = stored(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    places = placed(numbered.select(F.col(number).alias("id"), F.col("length").cast("long").alias("size")), capacity, most_rows, few_rows)
    return numbered.join(places.select(F.col("id").alias(number), F.col("sequence").alias("sequence_id"), F.col("place").alias("offset")), number).drop(number)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text") -> DataFrame:
    """Every document's pieces with their places. Rows without doc_id are packed too; repeated rows each get a place."""
    return pack(pieces_of(docs, tokenizer, capacity, end_id, text), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
