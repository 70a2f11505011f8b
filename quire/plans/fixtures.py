"""Inputs for the queries, derived from documents: lines dressed as blocks of every kind, geometry, stored runs, engine output.

The expressions are plain SQL that both engines read alike; lines() differs in how a text is taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line, whole, as a block of one of eight kinds.
DRESSED = """CASE (doc_id * 31 + line_no) % 8
 WHEN 0 THEN t || ' . . . . . . ' || (doc_id % 400 + 1)
 WHEN 1 THEN '2.3. ' || t || '          xvii'
 WHEN 2 THEN t || ' | ' || (doc_id % 400 + 1)
 WHEN 3 THEN 'xviii | ' || t
 WHEN 4 THEN '[ ' || (doc_id % 400 + 1) || ' ] Ana B. Ruiz and Tom Vale. ' || t
 WHEN 5 THEN t || ' (see "' || CASE doc_id % 3 WHEN 0 THEN 'Harbour Lights' ELSE 'Notes on Tides' END || '" on page ' || (doc_id % 400 + 1) || ').'
 WHEN 6 THEN '“' || t || '” — Half-Timbered ' || (doc_id % 400 + 1)
 ELSE t END"""

#: Beside each line, a short block that no line would be.
SHORT = """CASE (doc_id * 7 + line_no) % 16
 WHEN 0 THEN 'Harbour  Lights:' WHEN 1 THEN 'FOREWORD' WHEN 2 THEN 'What’s Kept in the Old Boathouse?' WHEN 3 THEN ' tide tables. '
 WHEN 4 THEN '' || (doc_id % 400 + 1) WHEN 5 THEN 'xvii' WHEN 6 THEN '12 - 3' WHEN 7 THEN 'Marta Quinlan' WHEN 8 THEN 'Owen Bright' WHEN 9 THEN 'Tide Models'
 WHEN 10 THEN '- Jan Lindqvist' WHEN 11 THEN 'Ann Lee, Bob Ray, Cyd Young, Dan Poe, Eve Orr, Flo Kay, Gus Hall ' || (doc_id % 7)
 WHEN 12 THEN 'Knots . . . . . . ' || (doc_id % 400 + 1) WHEN 13 THEN 'Harbour Lights . . . . . ' || (doc_id % 400 + 1) WHEN 14 THEN 'f ( x , y ) = a + b' ELSE 'www.example.org' END"""

#: A line's place on its page.
GEOMETRY = [
    "cast(floor(line_no / 40.0) as int) AS page_index",
    "cast(line_no as int) AS block_no",
    "cast(72.0 + CASE WHEN line_no % 4 = 0 THEN 12.0 ELSE 0.0 END + CASE WHEN line_no % 7 = 3 THEN 250.0 ELSE 0.0 END as double) AS x0",
    "cast(72.0 + 14.0 * (line_no % 40) - CASE WHEN line_no % 7 = 3 THEN 14.0 ELSE 0.0 END as double) AS y0",
    "cast(72.0 + CASE WHEN line_no % 4 = 0 THEN 12.0 ELSE 0.0 END + CASE WHEN line_no % 7 = 3 THEN 250.0 ELSE 0.0 END + 40.0 + (length(t) % 300) as double) AS x1",
    "cast(72.0 + 14.0 * (line_no % 40) - CASE WHEN line_no % 7 = 3 THEN 14.0 ELSE 0.0 END + 10.0 + 0.5 * (doc_id % 2) as double) AS y1",
    "cast(9 + (doc_id + line_no) % 4 as double) AS size",
    "cast((doc_id * 7 + line_no) % 32 as int) AS flags",
    "cast(doc_id * 65793 % 16777216 as int) AS color",
    "CASE (doc_id + line_no) % 5 WHEN 0 THEN 'Courier-BoldOblique' WHEN 1 THEN 'Times-Roman' WHEN 2 THEN 'MinionPro-Bold' WHEN 3 THEN 'Helvetica' ELSE 'Arial-ItalicMT' END AS font",
    "cast((doc_id + line_no) % 3 * 8 as double) AS indent",
]

#: Engine output: a line, whole, with the faults that engines make.
MUTATED = """CASE (doc_id * 31 + line_no) % 9
 WHEN 0 THEN t || ' ' || t || ' fin'
 WHEN 1 THEN t || '. ' || t
 WHEN 2 THEN '⁇ndices y ⁇ltimo ' || t
 WHEN 3 THEN 'Uno ' || t || ' : uno .'
 WHEN 4 THEN 'barco 2o barco de ' || t
 WHEN 5 THEN ''
 WHEN 6 THEN 'casa casa ' || t || ' a b c a b c'
 WHEN 7 THEN t || ' Faro Costero Piedra de la piedra'
 ELSE t || ' , marea 3.5 estable' END"""

#: Beside each, a heading as engines give them.
HEADING = """CASE (doc_id + line_no) % 6
 WHEN 0 THEN 'Faro Costero Piedra de la piedra' WHEN 1 THEN 'Muelles del Norte. Los muelles del sur' WHEN 2 THEN 'Barcos frente a otros barcos 3'
 WHEN 3 THEN '⁇ndice de mareas' WHEN 4 THEN '¿Barco barco viejo? , sí' ELSE 'Puerto 2o puerto de la costa' END"""

#: Stored runs: which lines a run has, and what became of them.
IN_A, IN_B = "(doc_id + line_no) % 11 <> 0", "(doc_id + line_no) % 13 <> 0"
RUN_OUT = """CASE WHEN (doc_id + line_no) % 17 = 0 THEN '⁇ ' || t WHEN (doc_id + line_no) % 23 = 0 THEN t || ' ' || t
 WHEN (doc_id + line_no) % 29 = 0 THEN substring(t, 1, cast(floor(length(t) / 3.0) as int)) WHEN (doc_id + line_no) % 7 = {0} THEN t || ' x' ELSE t END"""
KEY = "'p' || doc_id || ':' || (line_no - line_no % 50 + CASE WHEN line_no % 50 = 49 THEN 48 ELSE line_no % 50 END)"


#: Bytes of documents for each core below which they are dealt anew.
SMALL = 64 << 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, t."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # a small file is one row group and would be one task
    cores = spark.sparkContext.defaultParallelism
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL:
        docs = docs.repartition(cores, "doc_id")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t")).withColumn("line_no", F.col("line_no").cast("long"))


def _two(rows: DataFrame, columns: list[str], first: str, second: str, out: str) -> DataFrame:
    """Two rows for each line; line_no tells line and which of the two."""
    each = rows.selectExpr("doc_id", "line_no", "t", f"posexplode(array({first}, {second})) AS (k, {out})")
    return each.selectExpr("doc_id", "line_no * 2 + k AS line_no", *columns, out)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole line as a block, and a short block beside it."""
    return _two(lines(spark, sf_dir), ["t"], DRESSED, SHORT, "text")


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("doc_id", "line_no", "t", *GEOMETRY)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole line as an engine's output, and a heading beside it."""
    return _two(lines(spark, sf_dir), ["t AS src"], MUTATED, HEADING, "out")


def run(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    has, odd = (IN_A, 0) if label == "A" else (IN_B, 1)
    rows = lines(spark, sf_dir).where(has)
    return rows.selectExpr(f"'{label}' AS label", "doc_id * 100000 + line_no AS pos", f"{KEY} AS key", "cast(doc_id as int) AS page", "t AS src", f"{RUN_OUT.format(odd)} AS out")


def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut every 40 characters; a cut within a word ends in one of three hyphens."""
    return _cut(lines(spark, sf_dir)).select("doc_id", "block_no", "line_no", "line")


def _cut(rows: DataFrame) -> DataFrame:
    rows = rows.where("t <> ''").withColumn("block_no", F.col("line_no").cast("int"))
    rows = rows.withColumn("line_no", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 40).cast("int"))))
    part = F.expr("substring(t, line_no * 40 + 1, 40)")
    inside = F.expr("substring(t, line_no * 40 + 40, 1) rlike '[A-Za-z]' AND substring(t, line_no * 40 + 41, 1) rlike '[A-Za-z]'")
    hyphen = F.expr("CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '‐' ELSE '‑' END")
    return rows.withColumn("line", F.concat(part, F.when(inside, hyphen).otherwise("")))


def raw_blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Raw blocks as a parser gives them, doc_id a string: a document's cut lines, one to four a block, each of two spans; every
    ninth block is one of contents, and every other page has single lines only. They lie in n parts by document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string) AS id", "doc_id", "text")
    # only texts are moved: all that is made of them, and is many times as large, stays where its document is
    docs = docs.repartition(n, "id").select("id", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    rows = _cut(docs).selectExpr("id", "doc_id", "row_number() OVER (PARTITION BY id ORDER BY block_no, line_no) - 1 AS at", "line")
    rows = rows.selectExpr("id", "doc_id", "line", "cast(floor(at / 36.0) as int) AS page_index", "cast(at % 36 as int) AS place")
    rows = rows.selectExpr("*", "CASE WHEN page_index % 2 = 0 THEN place ELSE cast(floor(place / (1 + (doc_id % 4))) as int) END AS block_no")
    rows = rows.withColumn("line", F.expr("CASE WHEN page_index % 2 = 1 AND block_no % 9 = 4 THEN line || ' ..... ' || (place + 1) ELSE line END"))
    rows = rows.withColumns({"x0": F.expr("72.0D + CASE WHEN place % 5 = 0 THEN 12.0D ELSE 0.0D END"), "y0": F.expr("72.0D + 14.0D * place + CASE WHEN place % 7 = 6 THEN 9.0D ELSE 0.0D END"), "x1": F.expr("300.0D + place")}).withColumn("y1", F.expr("y0 + 10.0D"))
    box = "named_struct('x0', {0}x0, 'y0', {0}y0, 'x1', {0}x1, 'y1', {0}y1)"
    grouped = rows.groupBy("id", "page_index", "block_no").agg(F.array_sort(F.collect_list(F.struct("place", "line", "x0", "y0", "x1", "y1"))).alias("l"), *[F.expr(f"{f}({c}) AS {c}") for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1"))])
    part = lambda text: f"named_struct('text', {text}, 'size', 10.0D, 'flags', 0, 'font', 'Times-Roman', 'color', 0, 'bbox', {box.format('x.')})"
    spans = f"array({part('substring(x.line, 1, 9)')}, {part('substring(x.line, 10)')})"
    return grouped.selectExpr("id AS doc_id", "page_index", "block_no", "0 AS type", f"{box.format('')} AS bbox", f"transform(l, x -> named_struct('bbox', {box.format('x.')}, 'spans', {spans})) AS lines")


# -- the same inputs for the SQL that queries are held against

LINES_SQL = """fx AS (SELECT doc_id, CAST(u.i - 1 AS BIGINT) AS line_no, ls[u.i] AS t
 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))"""
BLOCKS_SQL = f"{LINES_SQL}, f1 AS (SELECT doc_id, line_no * 2 AS line_no, t, {DRESSED} AS text FROM fx UNION ALL SELECT doc_id, line_no * 2 + 1, t, {SHORT} FROM fx)"
GEOMETRY_SQL = f"{LINES_SQL}, f3 AS (SELECT doc_id, line_no, t, {', '.join(GEOMETRY)} FROM fx)"
OUTPUTS_SQL = f"{LINES_SQL}, f5 AS (SELECT doc_id, line_no * 2 AS line_no, t AS src, {MUTATED} AS out FROM fx UNION ALL SELECT doc_id, line_no * 2 + 1, t, {HEADING} FROM fx)"


def run_sql(name: str, label: str) -> str:
    has, odd = (IN_A, 0) if label == "A" else (IN_B, 1)
    return f"{name} AS (SELECT '{label}' AS label, doc_id * 100000 + line_no AS pos, {KEY} AS key, CAST(doc_id AS INT) AS page, t AS src, {RUN_OUT.format(odd)} AS out FROM fx WHERE {has})"
