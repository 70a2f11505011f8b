"""Stored translation runs: comparison, anomaly flags, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from ..text import let, once, shorten, strip, words


@F.pandas_udf(StringType())
def block_key(page: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """p<page>:<x0>,<y0>,<x1>,<y1>, coordinates to one decimal as Python rounds them."""
    return pd.Series([f"p{p}:" + ",".join(str(round(float(v), 1)) for v in box) for p, *box in zip(page, x0, y0, x1, y1)])


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(c, K.LEADERS, " "))


def flags(s: Column, o: Column, w: Column) -> Column:
    """array of glyph-unk, dup-word, loop-trigram, largo or corto, in this order; from plain texts and the output's words."""
    rest = 1 << 30
    two = F.zip_with(w, F.slice(w, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.filter(F.zip_with(two, F.slice(w, 3, rest), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    loop = (F.size(w) >= 6) & let(three, lambda x: F.size(x) > F.size(F.array_distinct(x)))
    ls, lo = F.length(s), F.length(o)
    return F.array_compact(
        F.array(
            F.when(F.contains(o, F.lit(K.UNK)), "glyph-unk"),
            F.when(o.rlike(K.DUPLICATE), "dup-word"),
            F.when(loop, "loop-trigram"),
            # products instead of a quotient: the same in every engine
            F.when((ls > 20) & (10 * lo > 18 * ls), "largo").when((ls > 20) & (100 * lo < 45 * ls), "corto"),
        )
    )


def ratio(s: Column, o: Column) -> Column:
    """Length of the plain output by that of the plain source; null for an empty one."""
    return F.length(o) / F.nullif(F.length(s), F.lit(0))


def scan(run: DataFrame) -> DataFrame:
    """run (label, pos, key, page, src, out) with flags, ratio and passthrough."""
    plain = once(run, __s=_plain(F.col("src")), __o=_plain(F.col("out")), passthrough=strip(F.col("src")) == strip(F.col("out")))
    plain = once(plain, __w=words(F.col("__o")))
    return once(plain, flags=flags(F.col("__s"), F.col("__o"), F.col("__w")), ratio=ratio(F.col("__s"), F.col("__o"))).drop("__s", "__o", "__w")


@F.pandas_udf(StringType())
def _times(r: pd.Series) -> pd.Series:
    return r.map(lambda x: None if pd.isna(x) else f"×{x:.1f}")


def labels(flags: Column, ratio: Column) -> Column:
    """Flags as a report shows them: largo and corto with the ratio to one decimal (as Python writes it)."""
    odd = F.exists(flags, lambda f: f.isin("largo", "corto"))
    return let(_times(F.when(odd, ratio)), lambda r: F.transform(flags, lambda f: F.when(f.isin("largo", "corto"), F.concat(f, r)).otherwise(f)))


def summary(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("label").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("passthrough").alias("passthrough"), F.count_if(F.size("flags") > 0).alias("suspects"))


def first_suspects(scanned: DataFrame, show: int = 40) -> DataFrame:
    """The first suspects of all runs in the order of pos: a top-k report."""
    return scanned.where(F.size("flags") > 0).orderBy("pos", "label").limit(show)


def _last(run: DataFrame, side: str) -> DataFrame:
    """One entry per key: the last one's values at the first one's place."""
    latest = F.max_by(F.struct("page", "src", "out"), "pos")
    return run.groupBy("key").agg(F.min("pos").alias(f"pos_{side}"), latest.alias(side))


def orphans(diffed: DataFrame, show: int = 5) -> DataFrame:
    """The first blocks, by their place, that only one run has, and the first that only the other has: a report of that length."""
    one = lambda side: diffed.where(F.col("status") == f"only_{side}").orderBy(f"pos_{side}", "key").limit(show).select("status", F.col(f"pos_{side}").alias("pos"), "page", shorten(F.col(f"src_{side}"), 70).alias("src"))
    return one("a").unionByName(one("b"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, status (same, changed, only_a, only_b), page, both places, sources and outputs."""
    both = _last(a, "a").join(_last(b, "b"), "key", "full_outer")
    changed = strip(F.col("a.out")) != strip(F.col("b.out"))
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(changed, "changed").otherwise("same")
    return both.select("key", status.alias("status"), F.coalesce("a.page", "b.page").alias("page"), "pos_a", "pos_b", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("src", "out")])
