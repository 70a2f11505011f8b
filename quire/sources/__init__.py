"""Where documents and runs come from, and where results go."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import page_range


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(label, pos, key, page, src, out, date) of stored runs, one JSON document each."""
    runs = spark.read.schema(S.RUN).option("multiLine", True).json(path)
    return runs.select(F.col("meta.label").alias("label"), F.col("meta.date").alias("date"), F.posexplode("blocks").alias("pos", "b")).select("label", "date", "pos", "b.*")


def write_run(blocks: DataFrame, path: str, meta: dict) -> None:
    """One run as JSON lines of its blocks below path, by label; the run's description beside it. Characters stay as they are."""
    blocks.write.mode("overwrite").json(f"{path}/blocks")
    blocks.sparkSession.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def select_pages(blocks: DataFrame, pages: DataFrame, spec: str | None) -> DataFrame:
    """Blocks on the listed pages; pages: (doc_id, page_index)."""
    n = pages.groupBy("doc_id").agg((F.max("page_index") + 1).cast("int").alias("n"))
    wanted = n.select("doc_id", F.explode(page_range(F.lit(spec).cast("string"), F.col("n"))).alias("page_index"))
    return blocks.join(wanted, ["doc_id", "page_index"], "left_semi")


def read_rows(spark: SparkSession, path: str, kind: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """Rows of one kind (blocks, tables, images, drawings, pages) of binary documents. parse: bytes to rows without doc_id; it runs on the executors.

    A document that cannot be parsed gives, of blocks, one row with only its name and the error; the job goes on."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    told = kind == "blocks"
    schema = StructType.fromDDL(read_rows.schemas[kind] + (", error string" if told else ""))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = [{"doc_id": doc, **r} for r in parse(content)]
                except Exception as e:  # noqa: BLE001  (any parser's error belongs to the document)
                    rows = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}] if told else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


read_rows.schemas = {"blocks": S.RAW_BLOCKS, "tables": S.TABLES, "images": S.OBSTACLES, "drawings": S.OBSTACLES, "pages": S.PAGES}


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """Raw blocks of binary documents, with the error of those that cannot be parsed (see failed_documents)."""
    return read_rows(spark, path, "blocks", parse)


def failed_documents(raw: DataFrame) -> DataFrame:
    """(doc_id, error) of documents that could not be parsed; text_blocks leaves them out."""
    return raw.where("error IS NOT NULL").select("doc_id", "error")


def _box(b) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))


def _pdf(content: bytes):
    """A PDF, with a library that may not be installed."""
    import pymupdf

    return pymupdf.open(stream=content, filetype="pdf")


def pdf_blocks(content: bytes) -> list[dict]:
    import pymupdf

    span = lambda s: {"text": s["text"], "size": float(s["size"]), "flags": s["flags"], "font": s["font"], "color": s["color"], "bbox": _box(s["bbox"])}
    line = lambda x: {"bbox": _box(x["bbox"]), "spans": [span(s) for s in x["spans"]]}
    rows = []
    with _pdf(content) as doc:
        for i, page in enumerate(doc):
            # text only: images are not decoded
            for k, block in enumerate(page.get_text("dict", flags=pymupdf.TEXTFLAGS_TEXT)["blocks"]):
                rows.append({"page_index": i, "block_no": k, "type": block["type"], "bbox": _box(block["bbox"]), "lines": [line(x) for x in block.get("lines", [])]})
    return rows


def pdf_pages(content: bytes) -> list[dict]:
    with _pdf(content) as doc:
        return [{"page_index": i, "width": float(p.rect.width), "height": float(p.rect.height)} for i, p in enumerate(doc)]


def pdf_tables(content: bytes) -> list[dict]:
    """Tables that the library detects; a page on which it fails has none."""
    rows = []
    with _pdf(content) as doc:
        for i, page in enumerate(doc):
            with contextlib.suppress(Exception):
                rows += [{"page_index": i, **_box(t.bbox), "col_count": t.col_count, "row_count": t.row_count} for t in page.find_tables().tables]
    return rows


def pdf_images(content: bytes) -> list[dict]:
    """One row for each place of each image."""
    rows = []
    with _pdf(content) as doc:
        for i, page in enumerate(doc):
            for nth, image in enumerate(page.get_images(full=True)):
                with contextlib.suppress(Exception):
                    rows += [{"page_index": i, "source": "image", "xref": image[0], "nth": nth, **_box(r)} for r in page.get_image_rects(image[0])]
    return rows


def pdf_drawings(content: bytes) -> list[dict]:
    rows = []
    with _pdf(content) as doc:
        for i, page in enumerate(doc):
            with contextlib.suppress(Exception):
                rows += [{"page_index": i, "source": "drawing", "xref": None, "nth": k, **_box(d["rect"])} for k, d in enumerate(page.get_drawings())]
    return rows


#: The parsers of PDF files for plans.run_job.
PDF = {"blocks": pdf_blocks, "pages": pdf_pages, "tables": pdf_tables, "images": pdf_images, "drawings": pdf_drawings}


def pdf_writer(name: Callable[[str], str]) -> Callable[[str, list[dict]], None]:
    """A writer for write_documents: blanks each block's box and puts its text there; name gives the new file's path."""

    def write(doc_id: str, rows: list[dict]) -> None:
        import pymupdf

        with pymupdf.open(doc_id.removeprefix("file:")) as doc:
            for i, page in enumerate(doc):
                mine = [r for r in rows if r["page_index"] == i]
                for r in mine:
                    page.add_redact_annot(pymupdf.Rect(r["x0"], r["y0"], r["x1"], r["y1"]), fill=(1, 1, 1))
                if mine:
                    page.apply_redactions(images=pymupdf.PDF_REDACT_IMAGE_NONE)
                for r in mine:
                    plan, rgb = r["plan"], tuple(r["rgb"])
                    look = {"fontname": r["fontname"], "color": rgb, "align": r["align"]}
                    box = pymupdf.Rect(*plan["box"])
                    if page.insert_textbox(box, r["shown"], fontsize=plan["fontsize"], lineheight=plan["lineheight"], **look) < 0:
                        page.insert_textbox(box, r["shown"], fontsize=5.0, **look)
            doc.save(name(doc_id))

    return write


def text_blocks(raw: DataFrame) -> DataFrame:
    return raw.where("type = 0")


def write_documents(plans: DataFrame, write: Callable[[str, list[dict]], None]) -> None:
    """Hand each document's placed blocks to a writer on the executors, page by page in order."""
    cols = plans.columns

    def one(rows):
        doc, kept = None, []
        for r in rows:
            if doc is not None and r["doc_id"] != doc:
                write(doc, kept)
                kept = []
            doc = r["doc_id"]
            kept.append(dict(zip(cols, r)))
        if doc is not None:
            write(doc, kept)

    plans.repartition("doc_id").sortWithinPartitions("doc_id", "page_index", "block_no").foreachPartition(one)
