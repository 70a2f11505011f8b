"""Token counts: greedy longest-match word pieces counted by an automaton, without building pieces.

The vocabulary's trie has two roots, one for pieces that begin a word and one for those that go on
in it. A node's failure link leads to where reading stands once the longest pieces of what was read
so far are taken off; how many those are is stored with the node. Reading a byte follows failure
links, adding their counts, until a child exists, so that a word takes time linear in its length.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, flat, plus, span_hashes, word_bounds

#: A vocabulary beyond this many pieces is refused: the automaton is sent to every worker.
MAX_PIECES = 2_000_000


class Automaton:
    """begin: pieces that begin a word, inside: pieces within one (bytes)."""

    def __init__(self, begin: list[bytes], inside: list[bytes]) -> None:
        if len(begin) + len(inside) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        child: dict[int, int] = {}  # node << 8 | byte -> node
        ends = [False, False]
        parents: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                at = root
                for b in piece:
                    to = child.get(at << 8 | b)
                    if to is None:
                        to = child[at << 8 | b] = len(ends)
                        ends.append(False)
                        parents.append((at, b))
                    at = to
                if piece:
                    ends[at] = True
        n = len(ends)
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parents[v][0]] + 1
        fail, pops = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if ends[v]:
                fail[v], pops[v] = 1, 1
                continue
            u, b = parents[v]
            z, taken = fail[u], pops[u]
            while z >= 0 and (z << 8 | b) not in child:
                taken += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = child[z << 8 | b], taken
        keys = np.array(sorted(child), np.int64)
        self.keys = keys
        self.to = np.array([child[k] for k in keys.tolist()], np.int32)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int64)

    def lengths(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Pieces of each byte span; a span that no pieces make up counts as one (unknown)."""
        n = len(s)
        order = np.argsort(s - e, kind="stable")
        at, left = s[order], (e - s)[order]
        state, count, lost = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        active = n
        for t in range(int(left[0]) if n else 0):
            while active and left[active - 1] <= t:
                active -= 1
            todo = np.flatnonzero(~lost[:active])
            byte = data[at[todo] + t].astype(np.int64)
            while len(todo):
                key = state[todo] << 8 | byte
                i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                ok = self.keys[i] == key if len(self.keys) else np.zeros(len(todo), bool)
                state[todo[ok]] = self.to[i[ok]]
                todo, byte = todo[~ok], byte[~ok]
                todo, byte = self._pop(todo, byte, state, count, lost)
        todo = np.flatnonzero(~lost & (left > 0) & (state != 1))
        while len(todo):
            todo, _ = self._pop(todo, todo, state, count, lost)
            todo = todo[state[todo] != 1]
        count[lost] = 1
        out = np.empty(n, np.int64)
        out[order] = count
        return out

    def _pop(self, todo, with_it, state, count, lost):
        """Follow one failure link each; those without one are lost."""
        v = state[todo]
        f = self.fail[v]
        good = f >= 0
        lost[todo[~good]] = True
        todo, with_it = todo[good], with_it[good]
        count[todo] += self.pops[v[good]]
        state[todo] = f[good]
        return todo, with_it


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """A .tiktoken file as word pieces: those with a leading space begin a word, those without any go on in it."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if b" " not in t]


@cache
def _loaded(path: str) -> Automaton:
    return Automaton(*byte_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", n_words: str = "n_words", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the number of words (runs without ASCII white space) and of their greedy longest-match pieces.

    A null or empty text has none of either. A word that the pieces cannot make up counts as one.
    vocabulary: a path that every worker can open. Every row gives one row. Columns of those names are replaced."""
    docs = docs.drop(n_words, n_tokens)
    schema = plus(docs.schema, f"`{n_words}` bigint, `{n_tokens}` bigint")

    def count(batches):
        automaton = _loaded(vocabulary)
        for b in batches:
            data, off = flat(b.column(text))
            words, tokens = [], []
            for i, j in blocks(off):
                part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, first = word_bounds(part, own)
                _, at, back = np.unique(span_hashes(part, s, e), return_index=True, return_inverse=True)
                per = np.concatenate([[0], np.cumsum(automaton.lengths(part, s[at], e[at])[back])]) if len(s) else np.zeros(1, np.int64)
                words.append(np.diff(first))
                tokens.append(np.diff(per[first]))
            z = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(words or z)), pa.array(np.concatenate(tokens or z))], names=[*b.schema.names, n_words, n_tokens])

    return docs.mapInArrow(count, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_words", "n_tokens")
