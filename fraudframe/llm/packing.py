"""Cost-balanced packing of documents into fixed-length token sequences.

Every document is its tokenizer ids plus an end id.  Documents are packed in groups
of about ``group_tokens`` tokens that follow each other in one input partition, so
nothing is shuffled.  A group of T tokens gets T // length sequences of full length
and, for the rest, sequences whose lengths are the powers of two that sum to it, so
every sequence is exactly full.  A document's cost is ``linear * n + quadratic *
n * n`` (n its tokens in the sequence): whole stretches of ``length`` tokens take a
sequence each; the remainders, longest first, go to the cheapest sequence with room
for them; what has no room anywhere is cut over the sequences with most room.

Null and empty texts are documents of the end id alone; repeated rows are packed as
often as they occur; a null doc_id stays null; ties go to the earlier row; an empty
table gives no rows.  Only the two named columns are read, so further columns of any
name do no harm.
"""
from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

LENGTH, END_ID, GROUP_TOKENS = 4096, 2, 1 << 20
#: Distinct pre-tokens whose ids a Python worker remembers.
CACHE = 300_000
#: Slots of the table that finds them (it grows if one part of the texts needs more), and a part's bytes.
TABLE, PART_BYTES = 1 << 20, 1 << 20
COLUMNS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"
SCHEMA = COLUMNS + ", ids binary"

# byte classes: 0 space, 1 letter, 2 digit, 3 other ASCII, 4 other non-ASCII
_CLASS = np.full(256, 3, np.uint8)
_CLASS[128:] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[bw.SPACE] = 0


def _byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, extra = {}, 256
    for b in range(256):
        if b in same:
            table[b] = b
        else:
            table[b], extra = extra, extra + 1
    return table


_ALPHABET = _byte_alphabet()


class IdCoder:
    """Ids of whole texts by the given tokenizer, each distinct pre-token encoded once.

    Words of ASCII and Latin-1 letters, digits and ASCII marks are cut into the
    tokenizer's pre-tokens here; a word with anything else in it (apostrophes, other
    scripts, a special token's opening) is encoded whole by the tokenizer.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self._table(TABLE)
        self.start, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _table(self, size: int) -> None:
        """An open-addressed table of ``size`` (a power of two): hash, place of its ids (-1: free)."""
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.shift = np.uint64(65 - size.bit_length())

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes, -1 for those not in the table."""
        found = np.full(len(hashes), -1, np.int32)
        todo, at = np.arange(len(hashes)), self._home(hashes)
        while len(todo):
            place = self.places[at]
            hit = (self.keys[at] == hashes[todo]) & (place >= 0)
            found[todo[hit]] = place[hit]
            on = ~hit & (place >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return found

    def _insert(self, hashes: np.ndarray, places) -> None:
        for h, at, place in zip(hashes, self._home(hashes).tolist(), places):
            while self.places[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.places[at] = h, place

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        n = self.known
        need, total = n + len(ids), self.used + sum(map(len, ids))
        if need > len(self.start):
            grow = max(need, 2 * len(self.start)) - len(self.start)
            self.start, self.len = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.start, self.len))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, 2 * len(self.pool)) - len(self.pool), np.uint32)])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.len[n:need] = lens
        self.start[n:need] = self.used + np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.pool[self.used:total] = np.fromiter((i for x in ids for i in x), np.uint32, total - self.used)
        self.used, self.known = total, need
        if 2 * need > len(self.keys):       # more pre-tokens than a part usually has
            old, places = self.keys[self.places >= 0], self.places[self.places >= 0].tolist()
            self._table(1 << (4 * need - 1).bit_length())
            self._insert(old, places)
        self._insert(hashes, range(n, need))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a slice of texts."""
        kind = _CLASS[raw]
        # U+00C0..U+00FF are letters (but for the two signs among them): lead byte C3
        lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.empty(0, np.int64)
        tail = raw[lead + 1]
        good = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[good], tail[good]
        kind[lead] = kind[lead + 1] = 1
        low = bw.LOWER[raw]
        upper = tail <= 0x9E
        low[lead[upper] + 1] = tail[upper] + 0x20
        ws, we = bw.runs(kind > 0, offsets)
        if not len(ws):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        odd = (kind == 4) | (raw == 39)
        odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        whole = np.logical_or.reduceat(odd, ws)
        # a pre-token starts at a word's start, at a change of class and at every digit
        begins = np.zeros(len(raw), bool)
        begins[ws] = True
        word_of = np.cumsum(begins, dtype=np.int32) - 1
        inner = np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
        inner = inner[~whole[word_of[inner]]]
        begins[inner] = True
        start = np.flatnonzero(begins)
        word = word_of[start]
        last = np.append(word[1:] != word[:-1], True)
        end = np.where(last, we[word], np.append(start[1:], 0))
        special = whole[word]
        hashes = bw.run_hashes(low, start, end)
        if special.any():
            hashes[special] = bw.mix(bw.run_hashes(raw, start[special], end[special]) + np.uint64(1))
        slots = self._find(hashes)
        if (slots < 0).any():
            if self.known > CACHE:
                self.clear()
            unknown = np.flatnonzero(self._find(hashes) < 0)
            new, first = np.unique(hashes[unknown], return_index=True)
            model, data, rawdata = self.tokenizer.model, low.tobytes(), raw.tobytes()
            ids = []
            for k in unknown[first].tolist():
                s, e = start[k], end[k]
                if special[k]:
                    text = rawdata[s:e].decode("utf-8", "replace")
                    ids.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    text = data[s:e].decode("latin-1").translate(_ALPHABET)
                    ids.append([t.id for t in model.tokenize(text)])
            self._add(new, ids)
            slots = self._find(hashes)
        lens, begin = self.len[slots], self.start[slots]
        out = self.pool[np.repeat(begin - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))]
        per_text = np.add.reduceat(np.append(lens, 0), np.minimum(np.searchsorted(start, offsets[:-1]), len(lens)))
        none = np.searchsorted(start, offsets[:-1]) == np.searchsorted(start, offsets[1:])
        return out, np.where(none, 0, per_text)


_coders: dict[int, IdCoder] = {}


def coder(json_text: str) -> IdCoder:
    """One coder a Python worker, kept from task to task."""
    key = hash(json_text)
    if key not in _coders:
        _coders.clear()
        _coders[key] = IdCoder(json_text)
    return _coders[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)), counts + 1


def assign(lengths: np.ndarray, length: int, linear: float, quadratic: float):
    """Pieces (document, start, size, sequence, offset) and the sequences' (size, cost)."""
    total = int(lengths.sum())
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    used = np.zeros(len(sizes), np.int64)
    pieces = []

    def put(doc: int, start: int, size: int, seq: int) -> None:
        pieces.append((doc, start, size, seq, int(used[seq])))
        used[seq] += size
        room[seq] -= size
        cost[seq] += linear * size + quadratic * size * size

    rest, free = [], 0
    for d, n in enumerate(lengths.tolist()):
        whole = n // length
        for k in range(whole):
            put(d, k * length, length, free)
            free += 1
        if n % length:
            rest.append((n % length, d, whole * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    late = []
    for n, d, start in rest:
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(d, start, n, int(fits[np.argmin(cost[fits])]))
        else:
            late.append((n, d, start))
    for n, d, start in late:
        while n:
            seq = int(np.argmax(room))
            size = min(n, int(room[seq]))
            put(d, start, size, seq)
            start, n = start + size, n - size
    return pieces, sizes, cost


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
         end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, linear: float = 1.0,
         quadratic: float = 1 / 1024, digest: bool = False) -> DataFrame:
    """One row per piece of a document, with its ids (little-endian unsigned 32-bit), or with
    their checksum, ids_crc32, if only a ``digest`` is asked for: the ids then stay in the task.

    ``tokenizer_path`` is read on the driver and broadcast: a vocabulary file, a few
    megabytes whatever the data.  Sequence ids are unique, by partition.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches):
        ids_of = coder(vocabulary.value)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        names, parts, counts, held = [], [], [], 0

        def flush():
            nonlocal names, parts, counts, held, base
            lengths, ids = np.concatenate(counts), np.concatenate(parts)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            pieces, sizes, cost = assign(lengths, length, linear, quadratic)
            ids = ids.astype("<u4")
            d, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
            rows = pa.array(names, pa.int64())
            for lo in range(0, len(d), 4096):
                s = slice(lo, lo + 4096)
                own = (ids[a:a + n].tobytes() for a, n in zip((first[d[s]] + start[s]).tolist(), size[s].tolist()))
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(list(own), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    rows.take(pa.array(d[s])), pa.array(start[s]), pa.array(size[s]), pa.array(lengths[d[s]]),
                    pa.array(base + seq[s]), pa.array(offset[s]), pa.array(np.array(sizes, np.int64)[seq[s]]),
                    pa.array(cost[seq[s]]), last],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "cost", "ids_crc32" if digest else "ids"])
            base += len(sizes)
            names, parts, counts, held = [], [], [], 0

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in bw.text_slices(batch.column(1), PART_BYTES):
                ids, n = with_end(*ids_of.encode(raw, offsets), end_id)
                names += keys[lo:hi]
                parts.append(ids)
                counts.append(n)
                held += len(ids)
                if held >= group_tokens:
                    yield from flush()
            pa.default_memory_pool().release_unused()  # the worker stays for later tasks
        if held:
            yield from flush()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, COLUMNS + ", ids_crc32 long" if digest else SCHEMA)


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer_path, digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
