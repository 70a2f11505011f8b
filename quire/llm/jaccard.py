"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its n-word shingles. Equal sets are one class from the start. Shingles
have one global order: rare ones first, then frequent ones, each by hash. Two sets that are similar
enough share l shingles among their first size - least overlap + l. Rare shingles are indexed
alone; frequent ones fall into a few classes (by hash) that are indexed by pairs of shingles, and
prefixes are extended by one shingle per such class: if two prefixes shared no rare shingle and at
most one of each frequent class, they would share fewer than they must.

Sets whose smallest shingles meet too few other sets' to be similar to any leave first. Classes
under one index key are a group. Groups with the same members are one, and groups that hang together
meet as one where that moves less data. A group is cut into
blocks of bounded size; each two blocks meet in a task of their own and return the components of
what they find. Heads (a prefix and more) meet first and rule out most pairs by an upper bound of the
overlap; what is left hanging together then meets with whole sets, whose intersections are counted exactly. No table of pairs
is made, no group meets in one task, and no link between two classes that the forest does not
imply is lost. What counts as frequent changes the work done, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, flat, free, fresh, gram_hashes, mix, ragged, signed, span_hashes, stored, word_bounds
from .graph import components

_NONE = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    """n: words of a shingle. percent: least similarity. frequent: sets that must have a shingle early for it to
    be frequent, counted by their smallest hash so that copies count about once. block: shingles of a block."""

    n: int = 4
    percent: int = 85
    frequent: int = 512
    most_frequent: int = 1_000_000
    block: int = 600_000
    broadcast_ids: int = 200_000

    def least_overlap(self, size):
        """Shingles that a set of this size shares with any set it links to."""
        return -(-self.percent * size // 100)

    @property
    def classes(self) -> int:
        """Classes of frequent shingles: fewer than any two linked but different sets share."""
        smallest = -(-self.percent // (100 - self.percent))
        return max(1, min(4, self.least_overlap(smallest) - 1))


def _sets(data: np.ndarray, off: np.ndarray, n: int):
    """Sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    s, e, first = word_bounds(low, off)
    h, start = gram_hashes(span_hashes(low, s, e), first, n, short=True)
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        if b - a > 1:
            own = np.sort(h[a:b])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        else:
            yield h[a:b]


def _key(own: np.ndarray) -> bytes | None:
    """128 bits of a set, whatever the order; None for the empty one."""
    if not len(own):
        return None
    return b"".join(int(mix(own ^ np.uint64(c)).sum(dtype=np.uint64)).to_bytes(8, "little") for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _list(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(signed(np.concatenate([*rows, np.zeros(0, np.uint64)]))))


def _unsigned(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.asarray(col.offsets, np.int64)
    return np.asarray(col.values).view(np.uint64)[off[0] : off[-1]], off - off[0]


def _prefix(size, s: Settings):
    return size - s.least_overlap(size) + 1


def _head(size, s: Settings):
    """Shingles that are kept of a set of this size: a prefix and more."""
    return 8 * _prefix(size, s) // 5 + 8


def _must_share(size, s: Settings):
    """So many shingles of its head at least are in the head of any set that a set of this size links to.

    Heads hold the first size - least overlap + l shingles of both sets, for the l of the smaller head, and so
    share l of them. Partners have at least the least overlap's size; less 2 for rounding."""

    def l_of(n):
        return np.minimum(_head(n, s), n) - _prefix(n, s) + 1

    return np.maximum(1, np.minimum(l_of(size), l_of(s.least_overlap(size))) - 2)


def shingled(docs: DataFrame, doc_id: str, text: str, s: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stored: doc_id, n (set size), key, must (see _must_share), the smallest shingles (head), a number for the row, and columns that it carries."""

    def cut(batches):
        for b in batches:
            data, off = flat(b.column(text))
            for i, j in blocks(off):
                size, key, head, must = [], [], [], []
                for own in _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], s.n):
                    size.append(len(own))
                    key.append(_key(own))
                    head.append(own[: _head(len(own), s)])
                    must.append(int(_must_share(len(own), s)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (doc_id, *carry)), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(must, pa.int32()), _list(head)], names=["doc_id", *carry, "n", "key", "must", "head"])

    kind = docs.schema[doc_id].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = docs.select(doc_id, text, *carry).mapInArrow(cut, f"doc_id {kind}{more}, n int, key binary, must int, head array<bigint>")
    return stored(rows.withColumn("rid", F.monotonically_increasing_id()), "shingled")


def _possible(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """Stored: the rows whose heads share enough with other sets' heads to be linked with any. Exact: the others have no link.

    Equal sets do not count as others; every round counts among the rows that the one before kept."""
    before, rows = None, rows.where("n > 0")
    for _ in range(rounds):
        each = rows.select("rid", "must", F.xxhash64("key").alias("k"), F.explode("head").alias("t"))
        shared = each.groupBy("t").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("t")
        kept = each.select("rid", "must", "t").join(shared, "t").groupBy("rid", "must").agg(F.count(F.lit(1)).alias("c")).where("c >= must")
        kept = stored(kept.select("rid"), "kept")
        rows = stored(rows.join(kept, "rid", "left_semi"), "possible")
        free(kept, *([before] if before is not None else []))
        before = rows
    return rows


def _frequent(classes: DataFrame, s: Settings) -> np.ndarray:
    """Shingles that many different sets have early; at most most_frequent of them, by the bound on their number of rows."""
    heads = classes.select(F.element_at("head", 1).alias("least"), F.explode("head").alias("t"))
    rows = classes.agg(F.sum(F.size("head"))).first()[0] or 0
    bar = max(s.frequent, -(-rows // s.most_frequent))
    often = stored(heads.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= bar).select("t"), "often")
    found = heads.join(F.broadcast(often), "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= bar)
    return np.sort(np.array([r[0] for r in found.select("t").collect()], np.int64).view(np.uint64))


def _is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _signatures(own: np.ndarray, often: np.ndarray, length: int, classes: int) -> list[np.ndarray]:
    """Index keys of a whole set: rare shingles of its prefix, pairs of frequent ones within a class."""
    hot = _is_in(own, often)
    rare = own[~hot][:length]
    more = own[hot][: length - len(rare)]
    out = [rare]
    for c in range(classes):
        mine = more[more % np.uint64(classes) == c]
        if len(mine) > 1:
            i, j = np.triu_indices(len(mine), 1)
            out.append(mix(mine[i] * np.uint64(0x9E3779B97F4A7C15) + mix(mine[j])))
    return out


def _index(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, often: np.ndarray, s: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (sig, cid, n) and the stored tables that have them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(often)
    extra = s.classes if len(often) else 0

    def from_heads(batches):
        table = shared.value
        for b in batches:
            values, off = _unsigned(b.column("head"))
            cid, size = np.asarray(b.column("cid")), np.asarray(b.column("n"), np.int64)
            length = np.minimum(_prefix(size, s) + extra, size)
            rare = ~_is_in(values, table)
            seen = np.concatenate([[0], np.cumsum(rare)])
            row = np.repeat(np.arange(len(cid)), np.diff(off))
            nth = seen[1:] - seen[off[row]]
            enough = seen[off[1:]] - seen[off[:-1]] >= length
            take = rare & (nth <= length[row]) & enough[row]
            few = np.flatnonzero(~enough)
            # a set without enough rare shingles in its head gets a row without a key: its whole text is needed
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(signed(values[take])), pa.nulls(len(few), pa.int64())]), pa.array(np.concatenate([cid[row[take]], cid[few]])), pa.array(np.concatenate([size[row[take]], size[few]]).astype(np.int32))],
                names=["sig", "cid", "n"],
            )

    index = stored(classes.select("cid", "n", "head").mapInArrow(from_heads, "sig bigint, cid bigint, n int"), "index")
    if not len(often):
        return index, [index]
    whole, made = _whole_sets(classes.join(index.where("sig IS NULL").select("cid"), "cid", "left_semi"), docs, doc_id, text, s)

    def from_sets(batches):
        table = shared.value
        for b in batches:
            values, off = _unsigned(b.column("items"))
            cid = np.asarray(b.column("cid"))
            for k in range(len(cid)):
                own = values[off[k] : off[k + 1]]
                keys = np.concatenate(_signatures(own, table, min(len(own), _prefix(len(own), s) + extra), s.classes))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.full(len(keys), cid[k])), pa.array(np.full(len(keys), len(own), np.int32))], names=["sig", "cid", "n"])

    more = stored(whole.mapInArrow(from_sets, "sig bigint, cid bigint, n int"), "index")
    free(*made)
    return index.where("sig IS NOT NULL").unionByName(more), [index, more]


def _whole_sets(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, s: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """(cid, items): the whole sorted sets of some classes, made from one document of each; and the stored tables that have them."""
    ids = stored(classes.select(F.coalesce(F.col("id").cast("long"), F.lit(_NONE)).alias("at"), "key", "cid"), "wanted")
    small = ids.count() <= s.broadcast_ids
    wanted = F.broadcast(ids.select("at")) if small else ids.select("at")
    some = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("at"), F.col(text).alias("t")).join(wanted, "at", "left_semi")

    def cut(batches):
        for b in batches:
            data, off = flat(b.column("t"))
            for i, j in blocks(off):
                own = list(_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], s.n))
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in own], pa.binary()), _list(own)], names=["key", "items"])

    sets = some.select("t").mapInArrow(cut, "key binary, items array<bigint>").join(F.broadcast(ids.select("key", "cid")) if small else ids.select("key", "cid"), "key")
    # rows that repeat a document would give its set again
    found = stored(sets.select("cid", "items"), "sets")
    return found.dropDuplicates(["cid"]), [ids, found]


def _stars(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The links' components: each member with the smallest one."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(x, top(x)) for x in list(parent) if top(x) != x]


#: Counts of pairs of rows, and matches of single shingles, that are held at once.
_PAIRS, _MATCHES = 1 << 19, 1 << 20


def _ordered(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in order, and the row of each."""
    order = np.argsort(values, kind="stable")
    return values[order], np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))[order]


def _shared(va: np.ndarray, ra: np.ndarray, na: int, vb: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """How many shingles each of na rows has in common with each of nb rows; both sides as _ordered gives them."""
    common = va[np.diff(va, prepend=~va[:1]) != 0]
    lb, hb = np.searchsorted(vb, common, "left"), np.searchsorted(vb, common, "right")
    common, lb, hb = (x[hb > lb] for x in (common, lb, hb))
    la, ha = np.searchsorted(va, common, "left"), np.searchsorted(va, common, "right")
    counts = np.zeros((na, nb), np.int32)
    size = (ha - la) * (hb - lb)
    few = np.flatnonzero(size <= 64)
    ends = np.cumsum(size[few])
    at = 0
    while at < len(few):  # many short lists at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MATCHES, "right")))
        k = few[at:to]
        wa, wb = (ha - la)[k], (hb - lb)[k]
        pa_ = np.repeat(ragged(la[k], wa), np.repeat(wb, wa))
        pb_ = ragged(np.repeat(lb[k], wa), np.repeat(wb, wa))
        np.add.at(counts.ravel(), ra[pa_].astype(np.int64) * nb + rb[pb_], 1)
        at = to
    for k in np.flatnonzero(size > 64).tolist():
        counts[np.ix_(ra[la[k] : ha[k]], rb[lb[k] : hb[k]])] += 1
    return counts


def _below(values_a, off_a, size_a, values_b, off_b, size_b) -> np.ndarray:
    """How many of each a's head are not above the last one of each b's head; a head that is its whole set ends nowhere."""
    last = np.where(np.diff(off_b) < size_b, values_b[np.maximum(off_b[1:] - 1, 0)] if len(values_b) else np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF))
    return np.stack([np.searchsorted(values_a[off_a[i] : off_a[i + 1]], last, "right") for i in range(len(off_a) - 1)])


def _compare(percent: int, heads: bool):
    """For one meeting of two blocks: the components of its links as stars; of heads, of what may be links.

    done: the meeting is all of a unit that shares no set with another one, so its stars are final."""
    types = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("done", pa.bool_())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        done = table.column("sure")[0].as_py() and table.column("nb")[0].as_py() == 1
        sides = []
        for mine in (b1, b2) if b1 != b2 else (b1,):
            part = table.filter(pa.compute.equal(table.column("own"), mine)).combine_chunks()
            sides.append((np.asarray(part.column("cid")), np.asarray(part.column("n"), np.int64), *_unsigned(part.column("items").combine_chunks())))
        if len(sides) == 2 and not (len(sides[0][0]) and len(sides[1][0])):
            return types.empty_table()
        (ca, na, va, oa), (cb, nb, vb, ob) = sides[0], sides[-1]
        found: list[tuple[int, int]] = []
        step = max(1, _PAIRS // max(1, len(cb)))
        vs, rs = _ordered(vb, ob)
        for i in range(0, len(ca), step):  # a count matrix of bounded size
            j = min(len(ca), i + step)
            values, off, size = va[oa[i] : oa[j]], oa[i : j + 1] - oa[i], na[i:j]
            common = _shared(*_ordered(values, off), j - i, vs, rs, len(cb)).astype(np.int64)
            if heads:  # what is beyond the shorter head may all be common
                common += np.minimum(size[:, None] - _below(values, off, size, vb, ob, nb), nb[None, :] - _below(vb, ob, nb, values, off, size).T)
            x, y = np.nonzero(100 * common >= percent * (size[:, None] + nb[None, :] - common))
            keep = ca[i + x] != cb[y]
            found += _stars(ca[i + x][keep].tolist(), cb[y][keep].tolist())
            if len(found) > _PAIRS:
                found = _stars([p for p, _ in found], [q for _, q in found])
        found = _stars([p for p, _ in found], [q for _, q in found])
        return pa.table({"a": [p for p, _ in found], "b": [q for _, q in found], "done": [done] * len(found)}, schema=types)

    return compare


def _meet(units: DataFrame, sets: DataFrame, percent: int, heads: bool) -> DataFrame:
    """units: (unit, nb, sure, cid), nb the blocks that the unit is cut into, sure: no other unit has its sets.
    sets: (cid, n, items). (node, label) of every set with a link."""
    own = F.pmod(F.xxhash64("cid", "unit"), F.col("nb")).cast("int")
    meet = units.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    meet = meet.select("unit", "nb", "sure", "cid", "own", F.least("own", "o").alias("b1"), F.greatest("own", "o").alias("b2")).join(sets.select("cid", "n", "items"), "cid")
    found = stored(meet.groupBy("unit", "b1", "b2").applyInArrow(_compare(percent, heads), "a bigint, b bigint, done boolean"), "found")
    final = found.where("done")
    final = final.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(final.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    return final.unionByName(components(found.where("NOT done")))


def links(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(node, label) of every class with a link: label is the smallest class of its component."""
    index, made = _index(classes, docs, doc_id, text, _frequent(classes, s), s)
    groups = (
        index.where("sig IS NOT NULL")
        .groupBy("sig")
        .agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 31))).alias("y"), F.sum(F.col("n").cast("long")).alias("w"))
        .where("m > 1")
    )
    # groups with the same members are one
    groups = groups.groupBy("m", "x", "y", "w").agg(F.min("sig").alias("sig")).select("sig", "w")
    members = stored(index.join(groups, "sig").select("sig", "w", "cid", "n"), "members")
    free(*made)
    # heads are about a quarter of their sets
    blocks_of = lambda w: F.ceil(F.col(w) / (4 * s.block))
    # Groups overlap. Where it moves less, all that a chain of groups connects meets as one group instead.
    star = members.groupBy("sig").agg(F.min("cid").alias("b"))
    chains = components(members.join(star, "sig").select(F.col("cid").alias("a"), "b")).withColumnRenamed("node", "cid")
    placed = stored(members.join(chains, "cid"), "placed")
    free(members)
    by_group = placed.groupBy("label", "sig", "w").agg(F.lit(1)).groupBy("label").agg(F.sum(F.col("w") * blocks_of("w")).alias("apart"))
    by_chain = placed.groupBy("label", "cid", "n").agg(F.lit(1)).groupBy("label").agg(F.sum("n").alias("whole"))
    # a table, so that its size is known: a large chain's rows need no shuffle by chain while there are few chains
    plan = stored(by_chain.join(by_group, "label").withColumn("one", F.col("whole") * blocks_of("whole") <= F.col("apart")), "plan")
    chosen = placed.join(plan, "label")
    unit = F.when(F.col("one"), F.concat(F.lit("c"), F.col("label").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("sig").cast("string")))
    size = F.when(F.col("one"), blocks_of("whole")).otherwise(blocks_of("w")).cast("int")
    units = stored(chosen.select(unit.alias("unit"), size.alias("nb"), F.col("one").alias("sure"), "cid").distinct(), "meetings")
    free(placed, plan)
    # first by heads: what they rule out needs no whole sets
    maybe = _meet(units, classes.select("cid", "n", F.col("head").alias("items")), s.percent, True).withColumnRenamed("node", "cid")
    maybe = stored(maybe.join(classes.select("cid", "n"), "cid"), "maybe")
    weight = maybe.groupBy("label").agg(F.ceil(F.sum("n") / s.block).cast("int").alias("nb"))
    units = maybe.join(weight, "label").select(F.col("label").alias("unit"), "nb", F.lit(True).alias("sure"), "cid")
    sets, made = _whole_sets(classes.join(maybe.select("cid"), "cid", "left_semi"), docs, doc_id, text, s)
    out = _meet(units, sets.withColumn("n", F.size("items")), s.percent, False)
    free(*made)
    return out


def components_of(docs: DataFrame, doc_id: str, text: str, s: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the carried columns, n (set size), and first: the least (no_id, id, carried columns)
    of its component's rows, null for rows without shingles."""
    rows = shingled(docs, doc_id, text, s, carry)
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *carry)
    possible = _possible(rows)
    classes = possible.groupBy("key").agg(F.min(me).alias("first"), F.first("n").alias("n"), F.first("head").alias("head"))
    classes = stored(classes.select("key", "first", F.col("first.id").alias("id"), "n", "head").withColumn("cid", F.monotonically_increasing_id()), "classes")
    free(possible)
    labels = links(classes, docs, doc_id, text, s)
    linked = classes.select("key", "first", "cid").join(labels.withColumnRenamed("node", "cid"), "cid")
    least = linked.groupBy("label").agg(F.min("first").alias("component"))
    linked = linked.join(least, "label").select("key", "component")
    # sets without a link are a component of their own rows
    named = rows.where("n > 0").groupBy("key").agg(F.min(me).alias("first")).join(linked, "key", "left")
    named = stored(named.select("key", F.coalesce("component", "first").alias("first")), "named")
    free(classes)
    return rows.select("doc_id", *carry, "n", "key").join(named, "key", "left").drop("key")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (the smallest doc_id of those it is linked with, itself included), one row per row of docs.

    Null and empty texts, and those without words, have 0 shingles and their own id. Repeated rows and
    equal texts are in one component. A null doc_id is never the smallest unless there is no other."""
    out = components_of(docs, doc_id, text, settings)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id"))


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (no id comes last), of rows that share it that
    with the smallest hash of id and text. All rows without shingles stay; every row is judged by its own text."""
    a, b = fresh(docs, "a", "b")
    # what a row is: 128 bits of its id and text
    keyed = docs.withColumn(a, F.xxhash64(doc_id, text)).withColumn(b, F.xxhash64(text, F.lit(1), doc_id))
    found = components_of(keyed, doc_id, text, settings, (a, b))
    mine = found.where((F.col("n") > 0) & (F.col(f"first.`{a}`") == F.col(a)) & (F.col(f"first.`{b}`") == F.col(b)))
    keep = stored(mine.select(a, b).unionByName(found.where("n = 0").select(a, b)).distinct(), "keep")
    kept = keyed.join(keep, [a, b], "left_semi")
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    one = kept.where(~blank).dropDuplicates([a, b])
    return one.unionByName(kept.where(blank)).select(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles at 85 %."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS gs FROM w),
s AS MATERIALIZED (SELECT doc_id, len(gs) AS n, unnest(gs) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM g UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT g.doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, m.c AS component_id
FROM g JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = g.doc_id
"""
