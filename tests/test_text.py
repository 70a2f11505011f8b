"""Cases worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from quire import glossary
from quire import text as T
from quire.functions import output_name, percent
from quire.operators import evaluate, routing, structure
from quire.operators import postprocess as P


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "make, good, bad",
    [
        (T.needs_translation, ["Mix", "hello", "ab"], ["", "A", "12 - 3", "ix", "mix", "civil"]),
        (T.is_page_number, ["xviii", "12"], ["3x", "xXi"]),
        (T.is_proper_name, ["Marta Quinlan", "Data Streams"], ["Fault Tolerance", "Chris Ware", "Data Stream", "The Bigger"]),
        (T.is_formula, ["P ( x 1 , x 2 )", "The value of x = 5"], ["A plain line of words", "Preface . . . . xvii"]),
        (T.is_url, ["see example.com"], ["see example.com " + "x" * 100, "no link"]),
        (T.is_author_sentence, ["Ana B. Ruiz and Tom Vale.", "F. Codd"], ["A relational model of data", "Codd"]),
        (T.has_repeated_prefix, ["Shared-Memory, Shared-Disk"], ["Memory and Disk"]),
    ],
)
def test_predicates(spark, make, good, bad):
    rows = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
    assert rows.where(make(F.col("t")) != F.col("want")).collect() == []


def test_parts(spark):
    assert tuple(one(spark, T.toc_entry, "Preface . . . . . xvii")) == ("Preface", " . . . . . . . . . . xvii", False)
    assert one(spark, T.toc_entry, "Storage and Retrieval . . . . 43")["several"]
    assert tuple(one(spark, T.footer, "Chapter One | c")) == ("", "Chapter One", " | c")
    assert tuple(one(spark, T.footer, "12 | Title")) == ("12 | ", "Title", "")
    assert one(spark, T.footer, "no bar") is None
    assert one(spark, T.normalize, "Data-Intensive — “x”") == 'Data Intensive  -  "x"'
    assert one(spark, T.sentences, "See 1. Title here.") == ["See 1.", "Title here."]
    assert one(spark, T.sentences, "F. Codd wrote it.") == ["F.", "Codd wrote it."]
    assert one(spark, T.sentences, "It is e.g. Fine. Edgar F. Codd did. Yes") == ["It is e.g. Fine.", "Edgar F. Codd did.", "Yes"]
    assert one(spark, T.sentences, None) is None and one(spark, T.sentences, "") == []
    assert one(spark, T.polish, "parte : la") == "Parte: la"
    assert one(spark, T.glossary_key, "  Fault   Tolerance: ") == "fault tolerance"
    assert tuple(one(spark, routing.with_sentinel, "Designing Data Intensive Applications")) == ("Designing Data Intensive Applications.", True, True)


def test_degenerate(spark):
    for src, out, want in [("Writing", "Ww w", True), ("Coding", "", True), ("Tutoring", "Tutotutoring", True), ("IA", "IA", True), ("API", "API", False), ("a b c d", "", False)]:
        assert one(spark, T.is_degenerate, src, out) is want, (src, out)


def test_glossary(spark):
    df = glossary.lookup(spark.createDataFrame([("  The   OLD boathouse: ",), ("none",)], "t string"), F.col("t"), glossary.load(spark), "g")
    assert {r["t"]: r["g"] for r in df.collect()} == {"  The   OLD boathouse: ": "El viejo cobertizo", "none": None}


def test_mask(spark):
    df = spark.createDataFrame([(1, 'see "Alpha One" on page 2 and (see "Beta Two" on page 3)'), (2, "nothing"), (3, None)], "k int, t string")
    got = {r["k"]: r for r in routing.mask_references(df, "t", glossary.load(spark), ["k"]).collect()}
    assert got[1]["masked"] == "(902) and (901)"
    assert [tuple(x) for x in got[1]["restores"]] == [("(901)", '(ver "Beta Two" en la página 3)'), ("(902)", 'ver "Alpha One" en la página 2')]
    assert got[2]["masked"] == "nothing" and got[2]["restores"] == [] and got[3]["masked"] is None


def clean(spark, f, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r["x"] for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_strings(spark):
    assert clean(spark, P.recover_heads, "⁇ndices y ⁇ltimo ⁇zzz ⁇ndicesx", None) == ["Índices y Último ⁇zzz ⁇ndicesx", None]
    assert P.collapse("a b a b a") == "a b a" and P.collapse("x x x x") == "x x"
    assert P.collapse("el mar sube hoy El mar sube hoy") == "el mar sube hoy"
    cut = {
        "version 3.5 es estable": "version 3.", "sube... y mira": "sube.", "Faro 2o faro": "Faro 2o", "la la": "la la", "casa casa casa": "casa casa", "": "", None: None,
        "Ana B. Ruiz y T. E. Vale lo cuentan así": "Ana B. Ruiz y T. E. Vale lo cuentan así", "Marea. 2a marea de la costa": "Marea.", "¿Barco 2o barco, viejo": "¿Barco 2o", "¿Barco, barco viejo": "¿Barco, barco viejo", "⁇ndice ⁇ de mareas": "Índice   de mareas".replace("   ", " "),
        "uno dos tres uno dos tres cuatro": "uno dos tres cuatro", " muy lejos muy lejos muy lejos de aquí ": "muy lejos de aquí", "sube .": "sube .", "baja. . y": "baja.",
    }
    assert clean(spark, P.truncate, *cut) == list(cut.values())
    short = {
        "Faro Costero Piedra de la piedra": "Faro Costero Piedra", "Barcos nuevos versus barcos antiguos 3": "Barcos nuevos versus barcos antiguos 3", "Barcos nuevos versus barcos antiguos": "Barcos nuevos",
        "¿Cuándo zarpan los barcos?, cuando zarpan.": "¿Cuándo zarpan los barcos?", "Ana B. [ 5 ] Ana Anabel Ruiz. Sobre los barcos y Anabel": "Ana B. [ 5 ] Ana Anabel Ruiz. Sobre los barcos y Anabel",
        "Un título limpio;: ": "Un título limpio", "": "", None: None, "de de de": "de de de", "Muelle uno de la Muelles": "Muelle uno", "solo dos": "solo dos",
    }
    assert clean(spark, lambda c: P.compact(c, F.lit(True)), *short) == list(short.values())
    assert clean(spark, lambda c: P.compact(c, F.lit(False)), "Faro Costero Piedra de la piedra") == ["Faro Costero Piedra de la piedra"]
    assert output_name("/a/b.pdf") == "/a/b_translated.pdf" and percent(0, 0) == 100 and percent(1, 3) == 33


def test_ratios_in_flags(spark):
    rows = [(["largo"], 2.25), (["dup-word", "corto"], 0.35), (["dup-word"], 9.0), ([], None)]
    got = [r[0] for r in spark.createDataFrame(rows, "f array<string>, r double").select(evaluate.labels(F.col("f"), F.col("r"))).collect()]
    assert got == [["largo×2.2"], ["dup-word", "corto×0.3"], ["dup-word"], []]


def test_collapse_is_stable():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from("abc"), max_size=20))
    def check(words):
        once = P.collapse(" ".join(words))
        assert P.collapse(once) == once
        w = once.split()
        assert not any(w[i : i + n] == w[i + n : i + 2 * n] for n in range(2, 7) for i in range(len(w) - 2 * n + 1))

    check()


def test_flags(spark):
    run = spark.createDataFrame([("r", 0, "k", 1, "abcdefghij klmnopqrst uvwxyzab", "a" * 60), ("r", 1, "k", 1, "x" * 20, "y" * 60), ("r", 2, "k", 1, "s", "⁇ casa casa a b c a b c")], "label string, pos int, key string, page int, src string, out string")
    got = {r["pos"]: r for r in evaluate.scan(run).collect()}
    assert got[0]["flags"] == ["largo"] and got[0]["ratio"] == 2.0 and got[1]["flags"] == [] and got[2]["flags"] == ["glyph-unk", "dup-word", "loop-trigram"]
    key = run.select(evaluate.block_key(F.lit(3), F.lit(0.25), F.lit(2.675), F.lit(1.0), F.lit(0.35))).first()[0]
    assert key == "p3:0.2,2.7,1.0,0.3"


def test_last_entry_wins(spark):
    schema = "label string, pos int, key string, page int, src string, out string"
    a = spark.createDataFrame([("a", 0, "k1", 1, "s", "x"), ("a", 1, "k2", 1, "s", "y"), ("a", 2, "k1", 1, "s", "z")], schema)
    b = spark.createDataFrame([("b", 0, "k1", 1, "s", "z "), ("b", 1, "k3", 1, "s", "y")], schema)
    got = {r["key"]: r for r in evaluate.diff(a, b).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"k1": "same", "k2": "only_a", "k3": "only_b"}
    assert got["k1"]["pos_a"] == 0 and got["k1"]["out_a"] == "z"
