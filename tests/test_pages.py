import pytest
from pyspark.sql import functions as F

from quire import engines, glossary, plans, sources
from quire.operators import batching, hardware, layout, structure

PAGE = "doc_id string, page_index int, block_no int, x0 double, y0 double, x1 double, y1 double"


def test_paragraphs(spark):
    lines = [(72, 100, 300, 110), (72, 112, 300, 122), (84, 124, 300, 134), (72, 136, 300, 146), (72, 170, 300, 180)]
    df = spark.createDataFrame([("d", 0, i, *map(float, b)) for i, b in enumerate(lines)], PAGE).withColumn("run", F.lit(0))
    got = sorted({(r["para"], r["p_x0"], r["p_y0"], r["p_x1"], r["p_y1"], r["indent"]) for r in structure.paragraphs(df).collect()})
    assert got == [(0, 72, 100, 300, 122, 0), (1, 72, 124, 300, 146, 12), (2, 72, 170, 300, 180, 0)]


def test_limits_and_candidates(spark):
    boxes = [(72, 100, 200, 110), (72, 130, 400, 140), (250, 102, 400, 108)]
    df = spark.createDataFrame([("d", 0, i, *map(float, b)) for i, b in enumerate(boxes)], PAGE)
    none = spark.createDataFrame([], "doc_id string, page_index int, source string, x0 double, y0 double, x1 double, y1 double")
    lim = layout.limits(df, none, 792.0)
    got = {r["block_no"]: (r["min_x"], r["max_x"], r["max_y"]) for r in lim.collect()}
    assert got == {0: (72, 248, 128), 1: (72, 400, 787), 2: (202, 400, 128)}
    first = lim.where("block_no = 0").select(layout.candidates(F.lit(layout.LEFT)).alias("c")).first()["c"]
    assert [tuple(b) for b in first] == [(72, 100, 200, 110), (72, 100, 248, 110), (72, 100, 200, 120), (72, 100, 248, 120)]


@pytest.mark.parametrize("x0, x1, words, want", [(256, 356, 3, 1), (400, 540, 3, 2), (72, 540, 6, 3), (72, 540, 5, 0)])
def test_alignment(spark, x0, x1, words, want):
    df = spark.createDataFrame([(float(x0), float(x1), " ".join("w" * words))], "x0 double, x1 double, t string")
    assert df.select(layout.alignment(F.col("x0"), F.col("x1"), F.lit(612.0), F.col("t"), F.lit(540.0))).first()[0] == want


def test_fonts(spark):
    df = spark.createDataFrame([(20, "X"), (0, "Courier-BoldOblique"), (None, None)], "f int, n string")
    assert [r[0] for r in df.select(layout.font_code(F.col("f"), F.col("n"))).collect()] == ["tibo", "cobi", "helv"]
    assert tuple(spark.range(1).select(layout.unpack_color(F.lit(0xFF8000))).first()[0]) == (1.0, 128 / 255, 0.0)


def test_even_sizes(spark):
    df = spark.createDataFrame([("d", 0, i, 10.8, (s,)) for i, s in enumerate([10.8, 9.9, 9.9, 8.4])], "doc_id string, page_index int, block_no int, size double, plan struct<fontsize:double>")
    again = lambda size: F.struct(size.alias("fontsize"))
    got = {r["block_no"]: r["plan"]["fontsize"] for r in layout.unify(df, again).collect()}
    assert got == {0: 9.9, 1: 9.9, 2: 9.9, 3: 8.4}


def test_fit_shrinks_to_the_floor(spark):
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(20.0).alias("x1"), F.lit(6.0).alias("y1")))
    plan = spark.range(1).select(layout.fit(box, F.lit("x" * 100), F.lit(30.0)).alias("p")).first()["p"]
    assert plan["fontsize"] == pytest.approx(30 * 0.92**16) or plan["fontsize"] == 5.0


@pytest.mark.parametrize("lengths, want", [([1, 1, 2, 2, 3, 4, 5], [2, 2, 1, 2]), ([4] * 70, [32, 32, 6])])
def test_buckets(spark, lengths, want):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(lengths)], "pool string, pos int, n int")
    got = batching.buckets(df, ["pool"], "n", ["pos"]).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == want


def test_buckets_against_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(f"p{rng.randrange(5)}", i, rng.randrange(1, 60)) for i in range(600)]
    got = {r["pos"]: r["bucket"] for r in batching.buckets(spark.createDataFrame(rows, "pool string, pos int, n int"), ["pool"], "n", ["pos"]).collect()}
    for pool in {r[0] for r in rows}:
        bucket, size, first = -1, 0, 0
        for n, pos in sorted((n, pos) for p, pos, n in rows if p == pool):
            if bucket >= 0 and size < 32 and n <= 1.25 * first:
                size += 1
            else:
                bucket, size, first = bucket + 1, 1, n
            assert got[pos] == bucket


@pytest.mark.parametrize("toc, n, cap", [(False, 3, 6), (False, 5, 9), (False, 20, 28), (False, 21, 36), (False, 190, 200), (False, 250, 200), (True, 3, 8), (True, 250, 255)])
def test_caps(spark, toc, n, cap):
    assert spark.range(1).select(batching.decode_cap(F.lit(n), F.lit(toc))).first()[0] == cap


def test_translation_flow(spark):
    texts = ["Harbour Lights", "Marta Quinlan", "12", "Knots | 7", "2. Storage things here . . . . 9", "[ 3 ] Ana B. Ruiz and Tom Vale. The big idea works.", 'Look (see "Foreword" on page 4).', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = {r["k"]: (r["route"], r["out"]) for r in plans.translate(df, glossary.load(spark), ["k"]).collect()}
    assert out[0] == ("glossary", "Luces del puerto") and out[1] == ("name", "Marta Quinlan") and out[2] == ("trivial", "12")
    assert out[3] == ("footer", "Nudos | 7")
    assert out[4] == ("toc", "2. Storage things here . . . . . . . . . . 9")
    assert out[5] == ("body", "[ 3 ] Ana B. Ruiz y Tom Vale. The big idea works.")
    assert out[6][1] == 'Look (ver "Prólogo" en la página 4).'
    assert out[8] == ("trivial", "")


def test_engine_batches_do_not_change_the_result(spark):
    df = spark.createDataFrame([(i, f"the plain text number {'x ' * (i % 40)} here") for i in range(200)], "k int, text string")
    engine = lambda: engines.Words({"the": "el", "text": "texto"})
    a = {r["k"]: r["out"] for r in plans.translate(df, glossary.load(spark), ["k"], engine=engine).collect()}
    b = {r["k"]: r["out"] for r in plans.translate(df.repartition(7), glossary.load(spark), ["k"], engine=engine).collect()}
    assert a == b


def test_batches_are_those_of_the_document(spark):
    """Caps follow a document's own sentences, whatever partitions and Arrow batches they come in."""
    rows = [(d, i, False, False, " ".join("w" * (1 + (7 * i + d) % 45))) for d in range(4) for i in range(90)]
    df = spark.createDataFrame(rows, "d int, pos int, toc boolean, author boolean, sentence string")
    want = {}
    for d in range(4):
        own = sorted((len(s.split()), i) for dd, i, _, _, s in rows if dd == d)
        while own:
            some = [x for x in own[:32] if x[0] <= 1.25 * own[0][0]]
            most = some[-1][0]
            cap = most + 3 if most <= 3 else most + 4 if most <= 5 else most + 8 if most <= 20 else min(most + 15, 200)
            want |= {(d, i): str(cap) for _, i in some}
            own = own[len(some) :]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    for n in (1, 5):
        got = {(r["d"], r["pos"]): r["raw"] for r in batching.translate(df.repartition(n), ["d"], engines.Caps).collect()}
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def plain_join(lines, known):
    import re

    text = ""
    for x in lines:
        tail = re.search("[A-Za-zÀ-ÿ]+$", text[:-1]) if text[-1:] in ("-", "‐", "‑") else None
        word = re.match("[A-Za-zÀ-ÿ]+", x)
        if not text:
            text = x
        elif text[-1] not in "-‐‑" or not x[0].isalpha():
            text += " " + x
        elif x[0].islower() and (text[-1] != "-" or (tail and word and (tail[0] + word[0]).lower() in known)):
            text = text[:-1] + x
        else:
            text += x
    return text


def test_hyphens(spark):
    import random
    import re

    rng = random.Random(4)
    halves = ["in", "ter", "na", "tion", "al", "Inter", "l", "é", "3", "x.", "TCP", "ß", "ñu"]
    blocks, words = [], {}
    for d in "pqr":
        for b in range(60):
            line = lambda: " ".join("".join(rng.choice(halves) for _ in range(rng.randrange(1, 3))) for _ in range(rng.choice([1, 1, 2]))) + rng.choice(["-", "-", "‐", "‑", "", "."])
            blocks.append((d, b, [line() for _ in range(rng.randrange(1, 6))]))
        for _, _, ls in blocks:
            words.setdefault(d, set()).update(w.lower() for x in ls for w in re.findall("[A-Za-zÀ-ÿ]+", x))
        blocks.append((d, 100, ["Internal international", "inter‐", "na-", "tional"]))
        words[d] |= {"internal", "international", "inter", "na", "tional"}
    rows = [(d, b, i, x) for d, b, ls in blocks for i, x in enumerate(ls)]
    words = {d: {w.lower() for dd, _, _, x in rows if dd == d for w in re.findall("[A-Za-zÀ-ÿ]+", x)} for d in "pqr"}
    got = {(r["doc_id"], r["block_no"]): r["text"] for r in structure.dehyphenate(spark.createDataFrame(rows, "doc_id string, block_no int, line_no int, line string")).collect()}
    assert got == {(d, b): plain_join(ls, words[d]) for d, b, ls in blocks}
    assert got["p", 100] == "Internal international international"


def test_extraction(spark):
    """Hyphens, short and skipped blocks, tables, contents lines and paragraphs of whole pages."""
    from quire import schemas as S

    def block(page, no, lines, x0=72.0, y0=None, kind=0):
        y0 = 100.0 + 12 * no if y0 is None else y0
        box = lambda i: {"x0": x0, "y0": y0 + 12 * i, "x1": 300.0, "y1": y0 + 12 * i + 10}
        spans = lambda x: [{"text": t, "size": 10.0, "flags": 0, "font": "f", "color": 0, "bbox": box(0)} for t in (x[: x.find(" ") + 1], x[x.find(" ") + 1 :])]
        return ("file:/a.pdf", page, no, kind, {**box(0), "y1": box(len(lines) - 1)["y1"]}, [{"bbox": box(i), "spans": spans(x)} for i, x in enumerate(lines)])

    raw = [
        block(0, 0, ["The inter‐", "national market grew"]), block(0, 1, ["A"]), block(0, 2, ["x = f ( y ) + 1"]), block(0, 3, ["www.example.org"]),
        block(0, 4, ["One ....... 1", "Heading", "Two ....... 2", "", "Three ..... 3"]), block(0, 5, ["Alone ....... 12"]), block(0, 6, ["in a table"], y0=700.0), block(0, 7, ["not text"], kind=1), block(0, 8, ["cell in a well-", "formed one"]),
        block(1, 0, ["First line of a para-"], x0=84.0), block(1, 1, ["graph that goes on"]), block(1, 2, ["z"]), block(1, 3, ["and ends."]), block(1, 4, ["The paragraph after"], x0=84.0), block(1, 5, ["far away"], y0=400.0),
    ]
    tables = spark.createDataFrame([("file:/a.pdf", 0, 0.0, 690.0, 600.0, 720.0, 2, 2), ("file:/a.pdf", 1, 0.0, 0.0, 600.0, 800.0, 1, 9)], S.TABLES)
    got = plans.extract(spark.createDataFrame(raw, S.RAW_BLOCKS), tables).orderBy("page_index", "block_no", "line_no").collect()
    assert [(r["page_index"], r["block_no"], r["line_no"], r["kind"], r["text"]) for r in got] == [
        (0, 0, 0, "multi", "The international market grew"),
        (0, 4, 0, "toc", "One ....... 1"), (0, 4, 1, "toc", "Heading"), (0, 4, 2, "toc", "Two ....... 2"), (0, 4, 4, "toc", "Three ..... 3"),
        (0, 5, 0, "tocln", "Alone ....... 12"),
        (0, 8, 0, "multi", "cell in a well-formed one"),
        (1, 0, 0, "single", "First line of a paragraph that goes on and ends."), (1, 4, 0, "single", "The paragraph after"), (1, 5, 0, "single", "far away"),
    ]
    para = got[7]
    assert (para["x0"], para["y0"], para["x1"], para["y1"], para["indent"]) == (72, 100, 300, 146, 12) and para["spans"][0]["text"] == "First "
    assert (got[8]["x0"], got[8]["indent"]) == (84, 0) and got[3]["y0"] == 100 + 12 * 4 + 24


def test_whole_job(spark, tmp_path):
    """Files to plans and to a stored run, with page sizes of their own and a file that cannot be read."""
    (tmp_path / "good.bin").write_bytes("Harbour Lights\nThe tide comes in\nMarta Quinlan".encode())
    (tmp_path / "bad.bin").write_bytes(b"!")
    box = lambda i: {"x0": 72.0, "y0": 100.0 + 30 * i, "x1": 300.0, "y1": 112.0 + 30 * i}

    def blocks(content):
        if content == b"!":
            raise ValueError("broken")
        return [{"page_index": 0, "block_no": i, "type": 0, "bbox": box(i), "lines": [{"bbox": box(i), "spans": [{"text": t, "size": 10.0, "flags": 0, "font": "Times", "color": 0, "bbox": box(i)}]}]} for i, t in enumerate(content.decode().split("\n"))]

    def pages(content):
        return [{"page_index": 0, "width": 400.0, "height": 150.0}]

    done, placed, failed = plans.run_job(spark, f"file://{tmp_path}/*.bin", glossary.load(spark), {"blocks": blocks, "pages": pages}, pages="1")
    assert [r["error"] for r in failed.collect()] == ["ValueError: broken"]
    assert sorted((r["route"], r["out"]) for r in done.collect()) == [("body", "The tide comes in"), ("glossary", "Luces del puerto"), ("name", "Marta Quinlan")]
    rows = {r["text"]: r for r in placed.collect()}
    assert rows["Harbour Lights"]["shown"] == "Luces del puerto" and rows["Marta Quinlan"]["page_height"] == 150 and rows["Marta Quinlan"]["max_y"] == 172
    scanned = plans.run_and_store(done, f"file://{tmp_path}/run", {"label": "a"})
    assert [r["key"] for r in scanned.orderBy("pos").collect()] == [f"p0:72.0,{100.0 + 30 * i},300.0,{112.0 + 30 * i}" for i in range(3)]
    assert spark.read.json(f"file://{tmp_path}/run/meta").first()["n_blocks"] == "3"
    with pytest.raises(ValueError):
        plans.run_job(spark, f"file://{tmp_path}/good.bin", glossary.load(spark), {"blocks": blocks}, "en", "en")


def test_hardware(spark):
    df = spark.createDataFrame([(2.0, False), (8.0, False), (8.0, True), (16.0, False), (16.0, True), (32.0, False)], "ram_gb double, gpu boolean")
    got = [r["model"] for r in hardware.recommend(df, hardware.catalogue(spark)).orderBy("ram_gb", "gpu").collect()]
    assert got == ["opus", "nllb-600M", "nllb-1.3B", "nllb-1.3B", "nllb-3.3B", "nllb-3.3B"]
    assert hardware.detect(spark).first()["cores"] >= 1 and hardware.supported("en", "es") and not hardware.supported("en", "fr")


def test_sources(spark, tmp_path):
    import json

    run = {"meta": {"label": "a", "date": "2024-01-01T00:00:00"}, "blocks": [{"key": "k", "page": 1, "src": "é", "out": "ü"}, {"key": "k", "page": 1, "src": "s", "out": "o"}]}
    (tmp_path / "a.json").write_text(json.dumps(run, indent=1, ensure_ascii=False))
    got = sources.read_runs(spark, f"file://{tmp_path}/a.json").orderBy("pos").collect()
    assert [(r["pos"], r["src"], r["out"]) for r in got] == [(0, "é", "ü"), (1, "s", "o")]
    (tmp_path / "good.bin").write_bytes(b"one\ntwo")
    (tmp_path / "bad.bin").write_bytes(b"!")

    def parse(content: bytes) -> list[dict]:
        if content == b"!":
            raise ValueError("broken")
        return [{"page_index": 0, "block_no": i, "type": 0, "bbox": {"x0": 0.0, "y0": float(i), "x1": 9.0, "y1": i + 1.0}, "lines": [{"spans": [{"text": t}]}]} for i, t in enumerate(content.decode().split())]

    raw = sources.read_documents(spark, f"file://{tmp_path}/*.bin", parse)
    assert sources.failed_documents(raw).first()["error"] == "ValueError: broken"
    tables = spark.createDataFrame([], "doc_id string, page_index int, x0 double, y0 double, x1 double, y1 double, col_count int, row_count int")
    assert sorted(r["text"] for r in plans.extract(raw, tables).collect()) == ["one", "two"]
    pages = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "doc_id string, page_index int")
    assert sorted(r["page_index"] for r in sources.select_pages(pages, pages, "2-9").collect()) == [1, 2]


def test_without_blocks(spark):
    with pytest.raises(ValueError):
        plans.check_job("en", "es", spark.createDataFrame([], "x int"))
    with pytest.raises(ValueError):
        plans.check_job("en", "en", spark.range(1))


def test_progress_and_streams(spark, tmp_path):
    from quire import streaming

    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "a.json").write_text('{"job":"j","kind":"progress","current":1,"total":3}\n{"job":"j","kind":"progress","current":0,"total":0}\n')
    out = streaming.run_to_end(streaming.progress(spark, f"file://{tmp_path}/events"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert sorted(r["percent"] for r in out.collect()) == [33, 100]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 0, 1, "x"), ("a", 0, 0, "y"), ("b", 0, 0, "z")], "doc_id string, page_index int, block_no int, text string")
    target = str(tmp_path)

    def write(doc, rows):
        with open(f"{target}/{doc}.txt", "w") as f:
            f.write("".join(r["text"] for r in rows))

    sources.write_documents(df, write)
    assert (tmp_path / "a.txt").read_text() == "y" and (tmp_path / "b.txt").read_text() == "zx"
    sources.write_run(df, f"file://{tmp_path}/run", {"label": "r", "n_blocks": 3})
    assert spark.read.json(f"file://{tmp_path}/run/blocks").count() == 3


def test_extraction_keeps_documents_together(spark, sf_dir):
    """What is written for extract_blocks holds the rows of a document in one part, so that nothing made of it is moved: moved blocks
    with their spans were many times the input."""
    from quire import queries as Q

    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    plan = Q.QUERIES["extract_blocks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get(key) == before
