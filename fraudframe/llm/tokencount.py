"""Number of greedy word pieces of a text, by a linear longest-match automaton.

Words (runs of bytes other than white space, A-Z lower-cased) are cut greedily into
the longest pieces of a vocabulary.  The pieces are never built: the vocabulary is a
trie, and every node carries a failure link and a count.  When the next byte has no
branch, the greedy pieces at the front of the node's string are popped; the count says
how many those are and the link is the node of what remains.  So a word costs time
linear in its length.  A word's last byte is a symbol of its own (256 + the byte), and so is
that of a vocabulary string with an end-of-word mark: a piece that ends words matches at
the end of a word only, the others match anywhere else.  All single bytes, last or not, are
pieces, so every word can be cut.

Each distinct word of a slice of texts is counted once, all of them side by side, byte
by byte.  Null and empty texts count 0; a null doc_id and repeated rows are returned
as they are.  Only the named columns are read.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .packing import _ALPHABET

SCHEMA = "doc_id long, n_words long, n_tokens long"


#: Symbols: the bytes, and the bytes as a word's last.
SYMBOLS = 512


def pieces_of(tokenizer_path: str, end_mark: str = "</w>") -> set[str]:
    """The vocabulary of a byte-level tokenizer file as strings of symbols."""
    byte_of = {chr(c): b for b, c in _ALPHABET.items()}
    with open(tokenizer_path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    out = {chr(c) for c in range(SYMBOLS)}
    for name in names:
        bare = name.removesuffix(end_mark)
        if bare and all(c in byte_of for c in bare):
            codes = [byte_of[c] for c in bare]
            codes[-1] += 256 * (bare != name)
            out.add("".join(map(chr, codes)))
    return out


class Automaton:
    """Trie edges as one sorted array, failure links and popped-piece counts."""

    def __init__(self, pieces: set[str]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        parent: list[tuple[int, int]] = [(0, 0)]
        for piece in sorted(pieces):
            node = 0
            for c in map(ord, piece):
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    final.append(False)
                    parent.append((node, c))
                node = child[node][c]
            final[node] = True
        depth_first = sorted(range(1, len(child)), key=_depths(parent).__getitem__)
        fail, popped = [0] * len(child), [0] * len(child)
        for v in depth_first:
            if final[v]:
                popped[v] = 1
                continue
            u, c = parent[v]
            n, z = popped[u], fail[u]
            while c not in child[z]:  # all single symbols are pieces, so the root has every branch
                n, z = n + popped[z], fail[z]
            fail[v], popped[v] = child[z][c], n
        keys = [v * SYMBOLS + c for v, row in enumerate(child) for c in row]
        goto = [to for row in child for to in row.values()]
        order = np.argsort(keys)
        self.key, self.to = np.array(keys, np.int64)[order], np.array(goto, np.int32)[order]
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)

    @classmethod
    def of(cls, arrays: dict) -> Automaton:
        """An automaton from another one's arrays (what is sent to the workers)."""
        out = cls.__new__(cls)
        vars(out).update(arrays)
        return out

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The branch of each node by its symbol, or -1."""
        key = node.astype(np.int64) * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], -1)

    def count(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Greedy pieces of each word, a run of bytes."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        node, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        for p in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -p, side="left"))  # words longer than p
            symbol = buf[start[:n] + p] + 256 * (length[:n] == p + 1)
            to = self.step(node[:n], symbol)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                total[stuck] += self.popped[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                to[stuck] = self.step(node[stuck], symbol[stuck])
                stuck = stuck[to[stuck] < 0]
            node[:n] = to
        left = np.flatnonzero(node)
        while len(left):
            total[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] > 0]
        out = np.empty_like(total)
        out[order] = total
        return out


def _depths(parent: list[tuple[int, int]]) -> list[int]:
    depth = [0] * len(parent)
    for v in range(1, len(parent)):  # a node is made after its parent
        depth[v] = depth[parent[v][0]] + 1
    return depth


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens.  The automaton (a vocabulary's size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(Automaton(pieces_of(tokenizer_path))))

    def run(batches):
        machine = Automaton.of(shared.value)
        for batch in batches:
            for lo, hi, raw, offsets in bw.text_slices(batch.column(1)):
                words = bw.split_words(raw, offsets)
                _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                pieces = machine.count(words.buf, words.start[at], (words.end - words.start)[at])[inverse]
                tokens = np.bincount(words.doc, pieces, minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first).astype(np.int64)), pa.array(tokens)],
                    ["doc_id", "n_words", "n_tokens"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)
