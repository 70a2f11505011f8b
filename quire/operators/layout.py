"""Where translated text goes: room around each block, alignment, fonts, sizes.

Rectangles are columns x0, y0, x1, y1. Text metrics are pluggable: without a PDF library widths come from a documented
linear model (a character is half its size wide, a space a quarter, lines are 1.2 sizes apart)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..text import let, n_words, strip
from .structure import PAGE

LEFT, CENTER, RIGHT, JUSTIFY = 0, 1, 2, 3
_BOX = ("x0", "y0", "x1", "y1")


def unpack_color(c: Column) -> Column:
    part = lambda n: F.shiftright(c, n).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def font_code(flags: Column, name: Column) -> Column:
    """The standard font nearest to a span's; helv without a span (null flags and name)."""
    n, f = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(flags, F.lit(0))
    has = lambda bit, names: (f.bitwiseAND(F.lit(bit)) != 0) | n.rlike("|".join(names))
    bold, italic, mono, serif = has(16, K.BOLD_NAMES), has(2, K.ITALIC_NAMES), has(8, K.MONO_NAMES), has(4, K.SERIF_NAMES)
    face = lambda bi, b, i, r: F.when(bold & italic, bi).when(bold, b).when(italic, i).otherwise(r)
    return F.when(mono, face("cobi", "cobo", "coit", "cour")).when(serif, face("tibi", "tibo", "tiit", "tiro")).otherwise(face("hebi", "hebo", "heit", "helv"))


def alignment(x0: Column, x1: Column, page_width: Column, text: Column, col_right: Column) -> Column:
    width = x1 - x0
    centre = (F.abs((x0 + x1) / 2 - page_width / 2) < 15) & (width < page_width * 0.65)
    right = (F.abs(x1 - col_right) < 6) & (x0 > page_width * 0.5)
    return F.when(centre, CENTER).when(right, RIGHT).when((width > page_width * 0.5) & (n_words(text) >= 6), JUSTIFY).otherwise(LEFT)


def obstacles(images: DataFrame, drawings: DataFrame) -> DataFrame:
    """Images (one row per placement; an image counts once per page and number) and drawings larger than 8 by 8."""
    once = images.join(images.groupBy(*PAGE, "xref").agg(F.min("nth").alias("nth")), [*PAGE, "xref", "nth"], "left_semi")
    both = once.select(*PAGE, F.lit("image").alias("source"), *_BOX).unionByName(drawings.select(*PAGE, F.lit("drawing").alias("source"), *_BOX))
    return both.where("x1 - x0 > 8 AND y1 - y0 > 8")


def _others(blocks: DataFrame, obstacle: DataFrame) -> DataFrame:
    mine = blocks.select(*PAGE, F.col("block_no").alias("o_no"), *[F.col(c).alias(f"o_{c}") for c in _BOX])
    return mine.unionByName(obstacle.select(*PAGE, F.lit(-1).alias("o_no"), *[F.col(c).alias(f"o_{c}") for c in _BOX]))


def limits(blocks: DataFrame, obstacle: DataFrame, page_bottom: Column | float) -> DataFrame:
    """blocks with min_x, max_x and max_y: how far each may grow. One range join per page serves all three;
    pages are the equality key, so a task holds a page's rectangles, not a table's."""
    page = Window.partitionBy(*PAGE)
    b = blocks.withColumn("col_left", F.min("x0").over(page)).withColumn("col_right", F.max("x1").over(page))
    o = _others(blocks, obstacle)
    other = (F.col("o_no") != F.col("block_no")) | (F.col("o_no") == -1)
    pairs = b.join(o, PAGE).where(other)
    beside = F.least("y1", "o_y1") - F.greatest("y0", "o_y0") > 1.0
    on_left = beside & (F.col("o_x1") <= F.col("x0") + 0.5)
    on_right = beside & ~(F.col("o_x1") <= F.col("x0") + 0.5) & (F.col("o_x0") >= F.col("x1") - 0.5)
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("o_x1") - F.col("o_x0"))
    overlap = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    below = (F.col("o_y0") > F.col("y1") + 0.5) & (narrow > 0) & (overlap >= narrow * 0.30)
    near = pairs.groupBy(*PAGE, "block_no").agg(
        F.max(F.when(on_left, F.col("o_x1") + 2.0)).alias("l"), F.min(F.when(on_right, F.col("o_x0") - 2.0)).alias("r"), F.min(F.when(below, F.col("o_y0") - 2.0)).alias("y")
    )
    out = b.join(near, [*PAGE, "block_no"], "left")
    return out.select(
        *blocks.columns,
        "col_right",
        F.least(F.greatest("col_left", "l"), "x0").alias("min_x"),
        F.greatest(F.least("col_right", "r"), "x1").alias("max_x"),
        F.greatest(F.least((page_bottom if isinstance(page_bottom, Column) else F.lit(page_bottom)) - 5.0, F.col("y")), "y1").alias("max_y"),
    )


def candidates(align: Column) -> Column:
    """array<struct<x0,y0,x1,y1>> of the boxes to try, from columns x0..y1, min_x, max_x, max_y: as it is, wider, taller, both."""
    x0, y0, x1, y1, lo, hi, most = (F.col(c) for c in (*_BOX, "min_x", "max_x", "max_y"))
    capped = F.least(most, y0 + (y1 - y0) * 2.0, y1 + 40.0)
    room = F.greatest(F.lit(0.0), F.least(x0 - lo, hi - x1))
    w0 = F.when(align == RIGHT, lo).when(align == CENTER, x0 - room).otherwise(x0)
    w1 = F.when(align == RIGHT, x1).when(align == CENTER, x1 + room).otherwise(hi)
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    wider = w1 - w0 > x1 - x0 + 2
    return F.array_compact(
        F.array(box(x0, y0, x1, y1), F.when(wider, box(w0, y0, w1, y1)), F.when(capped - y0 > y1 - y0 + 1, box(x0, y0, x1, capped)), F.when(wider & (capped > y1 + 1), box(w0, y0, w1, capped)))
    )


def text_width(text: Column, size: Column) -> Column:
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    return (F.length(text) - spaces) * size * 0.5 + spaces * size * 0.25


def fits(box: Column, text: Column, size: Column, leading: Column) -> Column:
    """Whether the text's lines at this size and leading go into the box."""
    lines = F.ceil(text_width(text, size) / F.greatest(box["x1"] - box["x0"], F.lit(1.0)))
    return lines * size * leading <= box["y1"] - box["y0"]


#: Line distance of the model, as a share of the size.
LEADING = 1.2


def fit(boxes: Column, text: Column, size: Column, leading: Column | float = LEADING) -> Column:
    """struct<fontsize, lineheight, box>; leading: the font's line distance as a share of the size.

    the boxes at this size, then the last box tighter, then up to 16 times smaller, 5 at least."""
    last = F.element_at(boxes, -1)
    plan = lambda s, lh, b: F.struct(s.cast("double").alias("fontsize"), lh.cast("double").alias("lineheight"), b.alias("box"))
    leading = leading if isinstance(leading, Column) else F.lit(leading)
    first = F.get(F.filter(boxes, lambda b: fits(b, text, size, leading)), F.lit(0))
    out = F.when(first.isNotNull(), plan(size, F.lit(None), first))
    for tight in (0.95, 0.90):
        out = out.when(fits(last, text, size, leading * tight), plan(size, leading * tight, last))
    # each try is 8 % smaller than the one before; the first one at 5 points ends them
    tries = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.greatest(F.lit(5.0), size * F.pow(F.lit(0.92), k)))
    good = F.get(F.filter(tries, lambda s: fits(last, text, s, leading * 0.90)), F.lit(0))
    return out.otherwise(plan(F.coalesce(good, F.lit(5.0)), leading * 0.90, last))


def unify(plans: DataFrame, again) -> DataFrame:
    """plans (with size and plan) with uniform: per page and rounded size of three blocks or more, the planned size that a
    quarter of them stay below, 80 % of the original at least. again(df, size) plans anew the blocks above it."""
    klass = plans.withColumn("class", F.bround("size", 1))
    sizes = klass.groupBy(*PAGE, "class").agg(F.array_sort(F.collect_list("plan.fontsize")).alias("s"))
    quarter = F.get(F.col("s"), F.floor(F.size("s") * 0.25).cast("int"))
    uniform = F.greatest(quarter, F.col("class") * 0.80)
    sizes = sizes.where(F.size("s") >= 3).withColumn("uniform", uniform).where(F.col("uniform") < F.col("class") - 0.05).drop("s")
    out = klass.join(sizes, [*PAGE, "class"], "left").drop("class")
    redo = F.col("uniform").isNotNull() & (F.col("plan.fontsize") > F.col("uniform") + 0.05)
    return out.withColumn("plan", F.when(redo, again(F.col("uniform"))).otherwise(F.col("plan")))


def toc_line(text: Column, width: Column, size: Column) -> Column:
    """A contents line with as many dots as reach the right edge; other text as it is."""
    dot = text_width(F.lit(". "), size)

    def filled(e):
        room = width - text_width(F.concat(e["title"], F.lit(" ")), size) - text_width(e["number"], size) - size * 1.5
        dots = F.least(F.lit(80), F.floor(room / dot).cast("int"))
        return F.when(room < dot * 2, F.concat(e["title"], F.lit(" "), e["number"])).otherwise(F.concat(e["title"], F.lit(" "), F.repeat(F.lit(". "), F.greatest(dots, F.lit(0))), e["number"]))

    def line(s):
        title = F.regexp_replace(F.regexp_extract(s, K.TOC_LEADER, 1), r"[ .]+\z", "")
        entry = F.struct(title.alias("title"), F.regexp_extract(s, K.TOC_LEADER, 2).alias("number"))
        return F.when(s.rlike(K.TOC_LEADER), let(entry, filled)).otherwise(text)

    return let(strip(text), line)


def indented(text: Column, indent: Column, align: Column, size: Column) -> Column:
    """Leading spaces for a first line's indent, in flush-left and justified text."""
    n = F.greatest(F.lit(1), F.bround(indent / text_width(F.lit(" "), size), 0).cast("int"))
    return F.when((indent > 2) & align.isin(LEFT, JUSTIFY), F.concat(F.repeat(F.lit(" "), n), text)).otherwise(text)


def or_source(out: Column, src: Column) -> Column:
    """The source where the output is blank; null where both are: nothing is inserted."""
    some = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(some(out), some(src))


#: Rows of a table of font metrics that are sent to the workers: there are a dozen standard fonts.
MOST_FONTS = 10_000
