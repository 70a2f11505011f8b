"""Whole dataflows: extract, translate, lay out, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engines import Identity
from ..operators import batching as B
from ..operators import layout as L
from ..operators import structure as X
from ..operators.evaluate import block_key, scan
from ..operators.routing import route
from ..sources import read_rows, select_pages, write_run
from ..text import font_safe, once, strip
from ..work import in_place, stored, together


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extract(raw: DataFrame, tables: DataFrame, n: int | None = None) -> DataFrame:
    """Blocks of raw text blocks in reading order (doc_id, page_index, block_no, line_no): kind, text, spans, box and indent.

    Blocks in tables, formulas, links and texts of one character are left out. A contents block gives one block a line. On
    pages of mostly single lines these become paragraphs. Words that hyphens cut are put together again by the words of the document.
    n: the number of parts by document that raw has (work.together); without it rows are moved once."""
    if n is None:
        n = _parts(raw.sparkSession)
        raw = together(raw.repartition(n, "doc_id"), "raw", n)
    raw_line = lambda x: X.line_text(x["spans"], False)
    texts = F.filter(F.transform("lines", lambda x: X.line_text(x["spans"])), lambda t: t != "")
    flat = raw.where("type = 0").select("doc_id", "page_index", "block_no", "bbox.*", "lines", F.transform("lines", raw_line).alias("raw_lines"), texts.alias("texts"))
    words = X.spoken(flat, "doc_id", F.explode("raw_lines"))
    free = X.outside_tables(X.join_blocks(flat, "texts", [*X.PAGE, "block_no"], words), tables)
    kinds = X.merge_mode(once(free, kind=X.block_kind(F.col("raw_lines"), F.col("text"), F.lit(False))).where(~F.col("kind").isin(*X.SKIPPED)))
    toc = F.col("kind") == "toc"
    text = F.when(F.col("kind") == "tocln", strip(F.get("raw_lines", F.lit(0)))).when(F.col("kind") != "single", F.col("text")).alias("text")
    # the three ways that blocks take from here start from one table; a single line's text is that of its spans
    kept = kinds.select(*X.PAGE, "block_no", "x0", "y0", "x1", "y1", "kind", "merge", text, F.when(toc, F.col("lines")).alias("lines"), F.when(~toc, F.flatten("lines.spans")).alias("spans"))
    with in_place(raw.sparkSession):
        kinds = together(kept, "blocks", n).withColumn("text", F.coalesce("text", X.line_text(F.col("spans"))))
        paragraphs = stored(X.paragraph_blocks(kinds, words), "paragraphs")
    out = ["doc_id", "page_index", "block_no", "line_no", "kind", "text", "spans", "x0", "y0", "x1", "y1", "indent"]
    merged = F.col("merge") & (F.col("kind") == "single")
    whole = kinds.where(~merged & (F.col("kind") != "toc")).withColumn("line_no", F.lit(0)).withColumn("indent", F.lit(0.0))
    contents = X.contents_lines(kinds.where("kind = 'toc'"))
    return whole.select(*out).unionByName(contents.select(*out)).unionByName(paragraphs.select(*out))


def translate(blocks: DataFrame, glossary: DataFrame, key: list[str], text: str = "text", engine: Callable[[], object] = Identity) -> DataFrame:
    """blocks with route and out. key[0] is the document."""
    # routes are worked out once: sentences, authors and the way back all start from them
    routed = stored(route(blocks, glossary, text, key), "routed")
    pool = B.fan_out(routed, key)
    return B.fan_in(routed, pool, B.translate(pool, key, engine), key, text)


def lay_out(blocks: DataFrame, obstacle: DataFrame, width: float = 612.0, height: float = 792.0, pages: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """blocks (text, out, size, flags, font, color, indent, box columns) with their plans, sizes made even per page.

    pages: (doc_id, page_index, width, height), for pages that are not all of one size. metrics: (fontname, leading), the
    line distance of fonts as a share of the size."""
    b = blocks
    if pages is not None:
        b = b.join(pages.select(*X.PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), X.PAGE, "left")
    have = lambda c, other: F.coalesce(c, F.lit(other)) if c in b.columns else F.lit(other)
    b = b.withColumn("page_width", have("page_width", width)).withColumn("page_height", have("page_height", height))
    b = L.limits(b, obstacle, F.col("page_height"))
    b = once(b, shown=font_safe(L.or_source(F.col("out"), F.col("text"))), fontname=L.font_code(F.col("flags"), F.col("font")), rgb=L.unpack_color(F.col("color"))).where(F.col("shown").isNotNull())
    if metrics is not None:
        b = b.join(F.broadcast(metrics.limit(L.MOST_FONTS).select("fontname", F.col("leading").cast("double").alias("leading"))), "fontname", "left")
    b = b.withColumn("leading", F.coalesce("leading", F.lit(L.LEADING)) if metrics is not None else F.lit(L.LEADING))
    b = once(b, align=L.alignment(F.col("x0"), F.col("x1"), F.col("page_width"), F.col("shown"), F.col("col_right")))
    b = once(b, shown=L.indented(L.toc_line(F.col("shown"), F.col("x1") - F.col("x0"), F.col("size")), F.col("indent"), F.col("align"), F.col("size")), boxes=L.candidates(F.col("align")))
    fit = lambda size: L.fit(F.col("boxes"), F.col("shown"), size, F.col("leading"))
    return L.unify(once(b, plan=fit(F.col("size"))), fit)


def evaluate(translated: DataFrame, label: str, text: str = "text") -> DataFrame:
    """A scanned run of translated blocks with columns key, pos and page."""
    return scan(translated.select(F.lit(label).alias("label"), "pos", "key", "page", F.col(text).alias("src"), "out"))


def check_job(src: str, tgt: str, blocks: DataFrame) -> None:
    """Raise where a job cannot run: the same language twice, or a document without text blocks."""
    if src == tgt:
        raise ValueError("source and target language are the same")
    if not blocks.limit(1).count():
        raise ValueError("no text blocks: the document needs character recognition first")


def first_span(blocks: DataFrame) -> DataFrame:
    """blocks with size, flags, font and color of their first span."""
    return blocks.withColumns({c: F.get("spans", F.lit(0))[c] for c in ("size", "flags", "font", "color")})


def run_job(
    spark: SparkSession,
    path: str,
    glossary: DataFrame,
    parsers: dict[str, Callable[[bytes], list[dict]]],
    src: str = "en",
    tgt: str = "es",
    engine: Callable[[], object] = Identity,
    pages: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files to plans: (translated blocks, plans, files that could not be read).

    parsers: functions from a file's bytes to rows of "blocks" and, where there are any, of "tables", "images", "drawings" and "pages"."""
    read = {kind: read_rows(spark, path, kind, parse) for kind, parse in parsers.items()}
    empty = lambda kind: read.get(kind) if kind in read else spark.createDataFrame([], read_rows.schemas[kind])
    n = _parts(spark)
    found = together(read["blocks"].repartition(n, "doc_id"), "raw", n)
    failed = found.where("error IS NOT NULL").select("doc_id", "error")
    raw = found.where("error IS NULL").drop("error")
    blocks = extract(raw, empty("tables"), n)
    if pages:
        blocks = select_pages(blocks, raw.select("doc_id", "page_index").distinct(), pages)
    check_job(src, tgt, blocks)
    # one number for each block of a page: contents lines and paragraphs have none of their own
    blocks = blocks.withColumn("block_no", F.col("block_no") * 10_000 + F.col("line_no")).drop("line_no")
    done = stored(translate(blocks, glossary, ["doc_id", "page_index", "block_no"], engine=engine), "translated")
    plans = lay_out(first_span(done), L.obstacles(empty("images"), empty("drawings")), pages=empty("pages"))
    return done, plans, failed


def run_and_store(done: DataFrame, path: str, meta: dict) -> DataFrame:
    """Write translated blocks as a stored run, in reading order, and return it with its flags."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "block_no")) - 1
    rows = done.select("doc_id", place.cast("long").alias("pos"), block_key("page_index", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("key"), (F.col("page_index") + 1).alias("page"), F.col("text").alias("src"), "out")
    rows = stored(rows, "run")
    write_run(rows, path, {**meta, "n_blocks": rows.count()})
    return scan(rows.withColumn("label", F.lit(str(meta.get("label", "")))))
