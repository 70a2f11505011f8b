"""Shared pieces of the corpus operators: work tables, byte views of Arrow text, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..work import folder

#: Bytes of text handled at once inside a Python worker; longer single texts are handled alone.
BLOCK_BYTES = 2 << 20

_U64 = np.uint64


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_quire_path"] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them must be stored itself."""
    for t in tables:
        if path := t.__dict__.pop("_quire_path", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, built from names (for operators that add helper columns)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in have:
            c += "_"
        have.add(c.lower())
        out.append(c)
    return out


def plus(schema: StructType, ddl: str) -> StructType:
    """schema with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def held_out(doc_id: str, of: int) -> "F.Column":
    """True for documents whose crc32(doc_id as text) leaves 2 when divided by `of`; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(of) == 2, F.lit(True))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges [i, j) of at most `limit` bytes each (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INV = pow(_BASE, -1, 1 << 64)
_MULS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U64(1)
_powers: dict[str, np.ndarray] = {}

#: space, tab, newline, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: everything in ASCII but letters and digits
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * _U64(pow(base, len(out), 1 << 64))])
    return out


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"], _powers["down"] = _geometric(_BASE, n), _geometric(_INV, n)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input (the splitmix finaliser)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x = x * _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separator bytes, none across two rows, and each row's first word (rows + 1).

    apart: starts and ends of spans that are words of their own wherever they stand."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    is_word = ~space[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = is_word[cut]
    last[cut - 1] = is_word[cut - 1]
    if apart is not None and len(apart[0]):
        starts, ends = apart
        first[starts] = last[ends - 1] = True
        before, after = starts[starts > 0] - 1, ends[ends < len(data)]
        last[before] |= is_word[before]
        first[after] |= is_word[after]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e) (ascending, apart): polynomial over a random byte table, then mixed."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + piece, "right")))
        lo, hi = s[i], e[j - 1]
        up, down = _power(hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[e[i:j] - lo] - sums[s[i:j] - lo]) * down[s[i:j] - lo]
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a row, and each row's first one (rows + 1).

    short: a row with fewer words, but one at least, gets a single hash of all of them."""
    count = np.diff(first)
    grams = np.maximum(count - n + 1, 0)
    if short:
        few = (count > 0) & (count < n)
        grams = grams + few
    start = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], grams)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        j = at + k
        if short:
            inside = j < np.repeat(first[1:], grams)
            h += np.where(inside, words[np.minimum(j, max(len(words) - 1, 0))], _U64(0x9E3779B97F4A7C15)) * _MULS[k] if len(words) else _U64(0)
        else:
            h += words[j] * _MULS[k]
    return mix(h), start


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1 for all i, one after the other."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
