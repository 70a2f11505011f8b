"""Column expressions over text. White space, case and word classes are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{K.WS}+|{K.WS}+\z", "")


def rstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, rf"(?U){K.WS if chars is None else '[' + chars + ']'}+\z", "")


def strip_chars(c: Column, klass: str) -> Column:
    """klass: what goes in the brackets of a character class."""
    return F.regexp_replace(c, rf"^[{klass}]+|[{klass}]+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){K.WS}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+\z")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def in_set(c: Column, values) -> Column:
    return c.isin(list(values))


def let(c: Column, f) -> Column:
    """f of c's value: c is worked out once, however often f looks at it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are worked out once: no later filter or projection takes their expressions apart."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(row)))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Characters replaced by what the table has for them."""
    one = [a for a in table if len(table[a]) == 1]
    c = F.translate(c, "".join([*one, *(a for a in table if not table[a])]), "".join(table[a] for a in one))
    for a in table:
        if len(table[a]) > 1:
            c = F.replace(c, F.lit(a), F.lit(table[a]))
    return c


def normalize(c: Column) -> Column:
    """Typographic characters to ASCII, then Title-Case hyphens to spaces."""
    return F.regexp_replace(mapped(c, K.UNICODE), K.TITLE_HYPHEN, "$1 $2")


def font_safe(c: Column) -> Column:
    return mapped(c, K.FONT_SAFE)


def glossary_key(c: Column) -> Column:
    c = F.translate(c, "“”‘’", "\"\"''")
    c = F.lower(strip(F.regexp_replace(c, rf"(?U){K.WS}+", " ")))
    return rstrip(c, " .:,;")


def norm_word(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), K.ACCENTS, K.PLAIN), "[^a-z]", "")


def shorten(c: Column, n: int = 90) -> Column:
    c = strip(F.regexp_replace(c, rf"(?U){K.WS}+", " "))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def taken_numbers(c: Column) -> Column:
    """The numbers that stand alone in parentheses, as strings: no marker may be one of them. Soft hyphens count for nothing."""
    return F.regexp_extract_all(F.replace(c, F.lit("\u00ad")), F.lit(r"(?U)\(\s*(\d+)\s*\)"), F.lit(1))


def free_marker(c: Column) -> Column:
    """The first marker, from (901) on, that the text does not have yet."""
    numbers = lambda t: F.transform(F.sequence(F.lit(K.FIRST_MARKER), K.FIRST_MARKER + F.size(t)), lambda i: i.cast("string"))
    return let(taken_numbers(c), lambda t: F.concat(F.lit("("), F.get(F.array_except(numbers(t), t), F.lit(0)), F.lit(")")))


def needs_translation(c: Column) -> Column:
    return let(strip(c), lambda s: ~((F.length(s) <= 1) | s.rlike(K.TRIVIAL) | ((F.length(s) <= 6) & s.rlike(K.ROMAN))))


def is_page_number(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+\z") | ((F.length(c) <= 6) & c.rlike(K.ROMAN))


def is_proper_name(c: Column) -> Column:
    suffix = "(?i)(?:" + "|".join(K.ENGLISH_SUFFIXES) + r")\z"

    def name(w):
        first, last = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        ok = is_alpha(first) & is_alpha(last) & starts_upper(first) & starts_upper(last)
        ok &= ~in_set(first, K.TITLE_COMMON) & ~in_set(last, K.TITLE_COMMON) & (F.length(last) >= 5)
        return (F.size(w) == 2) & F.coalesce(ok & ~last.rlike(suffix) & ~in_set(last, K.COMMON_SECOND_WORDS), F.lit(False))

    return let(words(c), name)


def is_name_list(c: Column) -> Column:
    commas = F.length(c) - F.length(F.replace(c, F.lit(",")))

    def many(alpha):
        lower = F.filter(alpha, lambda x: (F.length(x) >= 4) & starts_lower(x))
        # a share of more than 0.70, without a division
        return (F.size(alpha) >= 8) & (F.size(lower) <= 3) & (10 * F.size(F.filter(alpha, starts_upper)) > 7 * F.size(alpha))

    w = F.transform(words(c), lambda x: strip_chars(x, r".,;:()\[\]"))
    return F.when(commas < 5, F.lit(False)).otherwise(let(F.filter(w, lambda x: is_alpha(x) & (F.length(x) >= 2)), many))


def is_author_sentence(c: Column) -> Column:
    w = words(F.regexp_replace(c, r"\.+\z", ""))
    cores = F.filter(F.transform(w, lambda x: strip_chars(x, r""".,;:()\[\]"'""")), lambda x: x != "")
    name = lambda x: x.rlike(r"^[A-Z]\.?\z") | in_set(F.lower(x), K.NAME_PARTICLES) | (starts_upper(x) & is_alpha(F.replace(x, F.lit("-"))))
    return F.size(w).between(2, 30) & (F.size(cores) >= 2) & F.forall(cores, name)


def toc_entry(c: Column) -> Column:
    """struct<title, suffix, several (two words or more)>, null for other text."""
    def entry(s):
        title = F.regexp_replace(F.regexp_extract(s, K.TOC_ENTRY, 1), r"[. ]+\z", "")
        page = F.regexp_extract(s, K.TOC_ENTRY, 3)
        return F.when(s.rlike(K.TOC_ENTRY), F.struct(title.alias("title"), F.concat(F.lit(" ." * 10 + " "), page).alias("suffix"), (n_words(title) >= 2).alias("several")))

    return let(strip(c), entry)


def footer(c: Column) -> Column:
    """struct<prefix, title, suffix>, null for other text; the form with the number on the right comes first."""
    right, left = F.regexp_extract(c, K.FOOTER_RIGHT, 2), F.regexp_extract(c, K.FOOTER_LEFT, 1)
    make = lambda a, b, d: F.struct(a.alias("prefix"), b.alias("title"), d.alias("suffix"))
    none = F.lit("")
    return F.when(c.rlike(K.FOOTER_RIGHT) & is_page_number(right), make(none, strip(F.regexp_extract(c, K.FOOTER_RIGHT, 1)), F.concat(F.lit(" | "), right))).when(
        c.rlike(K.FOOTER_LEFT) & is_page_number(left), make(F.concat(left, F.lit(" | ")), strip(F.regexp_extract(c, K.FOOTER_LEFT, 2)), none)
    )


def chapter_prefix(c: Column) -> Column:
    return F.regexp_extract(c, K.CHAPTER, 1)


def reference_prefix(c: Column) -> Column:
    """The bracketed number that begins a bibliography entry, with one space after it; empty without one."""
    found = F.regexp_extract(c, K.REFERENCE, 1)
    return F.when(found != "", F.concat(strip(found), F.lit(" "))).otherwise("")


def sentences(c: Column) -> Column:
    hide = "\u0000"
    s = strip(c)
    for abbreviation in ("e.g", "i.e"):
        s = F.regexp_replace(s, rf"(?U)\b{abbreviation[0]}\.{abbreviation[2]}\.", abbreviation.replace(".", hide) + hide)
    s = F.regexp_replace(s, r"(?U)\b(cf|vs|et al|Fig|fig|Eq|No)\.", "$1" + hide)
    parts = F.transform(F.split(s, K.SENTENCE), lambda p: strip(F.replace(p, F.lit(hide), F.lit("."))))
    return F.filter(parts, lambda p: p != "")


def has_repeated_prefix(c: Column, least: int = 4) -> Column:
    w = F.transform(F.regexp_extract_all(c, F.lit(K.LATIN_WORD), F.lit(0)), norm_word)
    p = F.transform(F.filter(w, lambda x: (F.length(x) >= least) & ~in_set(x, K.FUNC_WORDS)), lambda x: F.substring(x, 1, 5))
    return let(p, lambda p: F.size(p) > F.size(F.array_distinct(p)))


def is_url(c: Column) -> Column:
    return (F.length(c) < 90) & c.rlike(K.URL)


def is_formula(c: Column) -> Column:
    def signs(w):
        n = F.size(w)
        real = F.size(F.filter(w, lambda x: is_alpha(x) & (F.length(x) >= 3)))
        single = F.size(F.filter(w, lambda x: F.length(strip_chars(x, r".,;:()\[\]{}")) <= 1))
        return (n >= 3) & (100 * real < 35 * n) & ((10 * single > 4 * n) | c.rlike(K.MATH))

    return F.when(F.length(c) > 160, F.lit(False)).otherwise(~c.rlike(K.DOT_LEADER) & let(words(c), signs))


def capital(c: Column) -> Column:
    """A letter's capital as one letter, as ẞ is that of ß. A letter that only several letters can write (a ligature) stays."""
    one = lambda x: F.length(x) == 1
    return F.when(c == "ß", "ẞ").when(one(F.upper(c)), F.upper(c)).when(one(F.initcap(c)), F.initcap(c)).otherwise(c)


def polish(c: Column) -> Column:
    upper = lambda c: F.when(starts_lower(c), F.concat(capital(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))).otherwise(c)
    return let(F.regexp_replace(c, r"(?U)\s+([:;,.!?%])", "$1"), upper)


def is_degenerate(src: Column, out: Column) -> Column:
    o, n = strip(out), n_words(src)
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-záéíóúüñ]", "")
    real = F.exists(words(o), lambda t: F.length(F.regexp_replace(t, r"\P{L}", "")) >= 3)
    head = F.substring(letters(src), 1, 4)
    twice = (F.length(letters(o)) - F.length(F.replace(letters(o), head))) >= 8
    glued = (n == 1) & (n_words(o) == 1) & (F.length(letters(src)) >= 4) & twice
    return (n <= 3) & ((o == "") | ~real | glued)
