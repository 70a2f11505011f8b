"""Document fingerprints by SimHash. DataFrame functions only.

A text's words, lower-cased, vote on 64 bits with the bits of their hash; longer words, which are
rarer, weigh more. Votes are summed as two 32-bit lanes in each of 32 long integers. Permuted block
tables find fingerprints within a Hamming radius of 3: the 64 bits are six blocks, a pair within the
radius agrees on three of them at least, and each of the twenty choices of three is a table keyed by
those blocks' bits.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

RADIUS = 3
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Characters of text that a range of ids should have, and the most ranges.
RANGE_CHARS, MOST_RANGES = 8_000_000, 100_000
_LAST = (1 << 63) - 1


def _weight(word):
    """1 to twice the length, so that a lane never overflows: the weights of a text of under 2^31 characters sum up to under 2^32."""
    n = F.length(word).cast("long")
    return F.when(n <= 4, F.least(n, F.lit(1))).otherwise(F.least(2 * n, (n - 3) * (n - 3)))


def fingerprints(texts: DataFrame, text: str, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """by columns and fp (64 bits), one row per value of the by columns, which must tell texts apart, with numeric
    columns that each text carries along.

    A null text counts as empty; without words the fingerprint is 0."""
    words = texts.select(*by, *carry, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")).alias("__w"))
    words = words.select(*by, *carry, F.xxhash64("__w").alias("__h"), _weight(F.col("__w")).alias("__k"))
    lanes = F.lit((1 << 32) | 1)
    votes = [F.sum(F.shiftrightunsigned("__h", i).bitwiseAND(lanes) * F.col("__k")).alias(f"__v{i}") for i in range(32)]
    sums = words.groupBy(*by).agg(F.sum("__k").alias("__all"), *votes, *[F.max(c).alias(c) for c in carry])
    bit = lambda lane, i: F.when(2 * lane > F.col("__all"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)).cast("long")
    fp = F.lit(0).cast("long")
    for i in range(32):
        v = F.col(f"__v{i}")
        fp = fp.bitwiseOR(bit(v.bitwiseAND(F.lit((1 << 32) - 1)), i)).bitwiseOR(bit(F.shiftrightunsigned(v, 32), i + 32))
    return sums.select(*by, *carry, fp.alias("fp"))


def _tables(fp) -> "F.Column":
    """The table numbers and keys of a fingerprint."""
    piece = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = []
    for a, b, c in combinations(range(len(BLOCKS)), 3):
        key = F.shiftleft(F.shiftleft(piece[a], BLOCKS[b][1]).bitwiseOR(piece[b]), BLOCKS[c][1]).bitwiseOR(piece[c])
        keys.append(key)
    # the table's number goes above the at most 33 bits of the key
    return F.array(*[k.bitwiseOR(F.lit(t << 40)) for t, k in enumerate(keys)])


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (query, fp) with at most `radius` differing bits; both sides are tables of distinct fingerprints (column fp)."""
    if radius > RADIUS:
        raise ValueError(f"the block tables are whole up to a radius of {RADIUS}")
    q = queries.select(F.col("fp").alias("query"), F.explode(_tables(F.col("fp"))).alias("key"))
    i = index.select("fp", F.explode(_tables(F.col("fp"))).alias("key"))
    return q.join(i, "key").where(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius).select("query", "fp").distinct()


def _place(key, bounds: list[int]) -> "F.Column":
    """How many of the ascending bounds are at most key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    array = F.array(*[F.lit(b) for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def narrow(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(array, F.least(mid, F.lit(len(bounds) - 1))) <= key
        done = acc["lo"] >= acc["hi"]
        lo = F.when(done, acc["lo"]).when(below, mid + 1).otherwise(acc["lo"])
        hi = F.when(done, acc["hi"]).when(below, acc["hi"]).otherwise(mid)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, narrow, lambda acc: acc["lo"])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty), next (the text after it by ascending doc_id; after the last, the first), the hashes of both and a number for the row.

    One shuffle of the texts, by ranges of ids of about equal numbers of rows; each range also gets the first
    row of the one after it. Null ids come last; rows with the same id go by their text's hash."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars, = rows.agg(F.sum(F.length("text"))).first()
    n = max(1, min(MOST_RANGES, (chars or 0) // RANGE_CHARS))
    bounds: list[int] = []
    if n > 1:
        found = rows.agg(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))).first()[0]
        bounds = sorted(set(found or []))
    place = _place(F.col("k"), bounds).cast("int")
    # at most MOST_RANGES rows
    firsts = sorted(tuple(r) for r in rows.groupBy(place.alias("p")).agg(F.min("k")).collect())
    filled = [p for p, _ in firsts]
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    spark = docs.sparkSession
    rows = rows.withColumn("p", place).withColumn("x1", F.xxhash64("text")).withColumn("x2", F.xxhash64("text", F.lit(1)))
    if not firsts:
        none = F.lit(0).cast("long")
        return rows.select("doc_id", "text", F.lit("").alias("next"), "x1", "x2", none.alias("y1"), none.alias("y2"), none.alias("rid"))
    heads = spark.createDataFrame([(p, k, before[p]) for p, k in firsts], "p int, k long, back int")
    again = rows.join(F.broadcast(heads), ["p", "k"]).select("doc_id", "k", "text", F.col("back").alias("p"), "x1", "x2", F.lit(1).alias("extra"))
    rows = rows.withColumn("extra", F.lit(0)).unionByName(again)
    order = Window.partitionBy("p").orderBy("extra", "k", "x1", "x2")
    lead = [F.lead(c).over(order).alias(a) for c, a in (("text", "next"), ("x1", "y1"), ("x2", "y2"))]
    rid = F.shiftleft(F.col("p").cast("long"), 40) + F.row_number().over(order)
    return rows.select("doc_id", "text", "x1", "x2", "extra", *lead, rid.alias("rid")).where("extra = 0").drop("extra")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 50) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, their likenesses, and n_near.

    Edited: the last half of the characters (rounded down) is replaced by as many first ones of the next
    document. Null texts are empty; equal texts have equal fingerprints, texts without words 0; repeated rows each give
    a row and follow one another. n_near: for ids divisible by `every`, rows whose fingerprint is within the radius (itself included); else null."""
    pairs = with_next(docs, doc_id, text)
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {half})"), F.expr(f"substring(next, 1, {half})"))
    pairs = pairs.withColumn("edited", edited)
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    # what a row returns goes along with its texts as numbers: the texts are shuffled and read once
    parts = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    form = lambda which, t: F.struct(F.lit(which).alias("form"), F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"), F.col(t).alias("t"))
    forms = pairs.select("rid", F.col("doc_id"), F.length("text").cast("long").alias("n"), *parts, "y1", "y2", F.explode(F.array(form(0, "text"), form(1, "edited"))).alias("f"))
    forms = forms.select("rid", "doc_id", "n", "s0", "s1", "s2", "s3", "y1", "y2", "f.*")
    each = stored(fingerprints(forms, "t", ["rid", "form"], ("doc_id", "n", "s0", "s1", "s2", "s3", "y1", "y2", "a", "b")), "fingerprints")
    own, other = each.where("form = 0"), each.where("form = 1").select("rid", F.col("fp").alias("efp"))
    by_text = own.groupBy(F.col("a").alias("y1"), F.col("b").alias("y2")).agg(F.min("fp").alias("nfp"))
    digest = F.lower(F.concat(*[F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4)]))
    out = own.join(other, "rid").join(by_text, ["y1", "y2"], "left")
    out = stored(out.select("doc_id", F.col("n").alias("n_chars"), digest.alias("edited_sha256"), "fp", "efp", "nfp"), "likeness")
    fps = out.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asked = out.where(F.pmod(F.col("doc_id"), F.lit(every)) == 0).select("fp").distinct()
    near = within(asked, fps).join(fps, "fp").groupBy("query").agg(F.sum("n").alias("n_near")).withColumnRenamed("query", "fp")
    like = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)
    text_of = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.join(near, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("fp").alias("fingerprint"),
        text_of("efp").alias("edited_fingerprint"),
        like("fp", "efp").alias("near_edited"),
        like("fp", "nfp").alias("near_next"),
        F.when(F.pmod(F.col("doc_id"), F.lit(every)) == 0, F.col("n_near")).alias("n_near"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited form."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
