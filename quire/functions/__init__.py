"""Small functions that stand for themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_range(spec: Column, n_pages: Column) -> Column:
    """0-based pages of a list such as 1-10,15 within n_pages; all of them for a null or empty list.

    A range that runs backwards is empty; anything that is no number raises an error."""
    one = lambda p, k: F.split(p, "-").getItem(k).cast("int")
    many = lambda p: F.sequence(one(p, 0) - 1, one(p, 1) - 1)
    none = F.expr("cast(array() as array<int>)")
    part = lambda p: F.when(~F.contains(p, F.lit("-")), F.array(p.cast("int") - 1)).when(one(p, 0) > one(p, 1), none).otherwise(many(p))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, r"\s*,\s*"), lambda p: part(F.trim(p))))))
    everything = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages - 1)).otherwise(none)
    return F.when(F.coalesce(spec, F.lit("")) == "", everything).otherwise(F.filter(listed, lambda p: (p >= 0) & (p < n_pages)))


def output_name(path: str, suffix: str = "translated") -> str:
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return f"{stem}_{suffix}.pdf"


def percent(current: int, total: int) -> int:
    """Progress in whole percent; nothing to do is done."""
    return 100 if total <= 0 else int(current / total * 100)
