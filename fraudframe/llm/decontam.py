"""Benchmark passages in documents, found by their template.

Texts become templates: runs of letters (lower-cased; single characters in scripts
without spaces) and numbers are tokens, other marks drop out; numbers, names
(capitalised inside a sentence) and units after a number become typed placeholders,
whose values are kept aside.  Windows of ``window`` template tokens, at least half of
them plain words, are hashed and the documents' windows are hash-joined with the
benchmark's, once with names as placeholders and once with names as words, so a copy in
another case is found too.  An item's first word stands as a word and as a name.  Along
each diagonal (a document's stretch laid on an item), equal values in the item stand
against equal values in the document and different ones against different ones, so a
question with other numbers is caught and a chance likeness of templates is not; windows
that break the mapping most windows agree on don't count.  A document holds an item when
windows cover ``coverage`` of the item's, or more than that where some broke the mapping.

Items shorter than ``window`` tokens are one window.  Items under ``MIN_TOKENS`` tokens or
without a window of enough plain words are found by their exact sequence of tokens; items
without a token take no part.  Null texts hold nothing; documents with a null id are not
reported; repeated rows give one row a document and item.  The benchmark is taken in
blocks of bounded size, each broadcast to one pass over the documents, so its size is
free; documents are never shuffled.  Only the named columns are read.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

WINDOW, COVERAGE, MIN_TOKENS, BLOCK_BYTES = 8, 0.5, 5, 32 << 20
#: Bytes of documents worked on at once: a byte takes some tens of bytes of arrays.
PART_BYTES = 1 << 20
KINDS = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
SCHEMA = "doc_id long, item_id long, coverage double, n_windows long, n_slots long, verbatim boolean"
#: Units that become a placeholder after a number.
UNITS = ("kg g mg lb oz t km m cm mm mi ft in yd l ml gal s sec ms min h hr hour hours day days week weeks month months year "
         "years percent dollar dollars euro euros usd eur c f k w kw v a hz mph kmh").split()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACE = bw.mix(np.arange(10, 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_unit = np.frombuffer("".join(UNITS).encode(), np.uint8)
_unit_end = np.cumsum([len(u) for u in UNITS])
_UNIT_HASHES = np.sort(bw.run_hashes(_unit, _unit_end - [len(u) for u in UNITS], _unit_end))


def _unspaced(raw: np.ndarray) -> np.ndarray:
    """Edges (first bytes and ends) of the characters of scripts written without spaces."""
    lead = np.flatnonzero(raw >= 0xE0)
    if not len(lead):
        return lead
    x, y = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)]
    three = ((x == 0xE0) & (y >= 0xB8) & (y <= 0xBB)) | ((x == 0xE1) & (((y >= 0x80) & (y <= 0x82)) | (y == 0x9E) | (y == 0x9F)))  # Thai, Lao; Myanmar, Khmer
    three |= ((x == 0xE3) & (y != 0x84) & (y != 0x85)) | ((x >= 0xE4) & (x <= 0xE9)) | ((x == 0xEF) & (y >= 0xA4) & (y <= 0xAB))  # kana, Han
    four = (x == 0xF0) & (y >= 0xA0) & (y <= 0xB3)
    return np.concatenate([lead[three], lead[three] + 3, lead[four], lead[four] + 4])


class Template:
    """Token arrays of a slice: kind, template hash, value hash, and the first token of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        digit = _DIGIT[raw]
        if len(raw) > 2:  # marks inside a number
            inner = digit[:-2] & digit[2:] & ((raw[1:-1] == 44) | (raw[1:-1] == 46))
            digit[1:-1] |= inner
        ls, le = bw.runs(_LETTER[raw], np.concatenate([offsets, _unspaced(raw)]))
        ds, de = bw.runs(digit, offsets)
        start, end = np.concatenate([ls, ds]), np.concatenate([le, de])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        number = np.concatenate([np.zeros(len(ls), bool), np.ones(len(ds), bool)])[order]
        self.first = np.searchsorted(start, offsets)
        self.value = bw.run_hashes(bw.LOWER[raw], start, end)
        self.kind = np.where(number, NUMBER, WORD).astype(np.int8)
        self.capital = np.zeros(len(start), bool)
        if len(start):
            stops = np.concatenate([[0], np.cumsum(_STOP[raw] & ~digit)])
            opening = np.ones(len(start), bool)
            opening[1:] = stops[start[1:]] > stops[end[:-1]]
            opening[self.first[:-1][self.first[:-1] < len(start)]] = True
            upper = (raw[start] >= 65) & (raw[start] <= 90)
            second = raw[np.minimum(start + 1, len(raw) - 1)]
            upper &= (end - start > 1) & ~((second >= 65) & (second <= 90))
            self.capital = upper & ~number
            self.kind[self.capital & ~opening] = NAME
            after = np.zeros(len(start), bool)
            after[1:] = number[:-1] & ~opening[1:] & (start[1:] - end[:-1] <= 1)
            self.kind[after & np.isin(self.value, _UNIT_HASHES)] = UNIT

    def quoted(self) -> Template:
        """The same with each text's first word as a name if it is capitalised."""
        out = Template.__new__(Template)
        vars(out).update(vars(self), kind=self.kind.copy())
        first = self.first[:-1][np.diff(self.first) > 0]
        out.kind[first[self.capital[first]]] = NAME
        return out

    def _texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first token, hash) of each window that is half plain words or more; names: as placeholders, or else as words."""
        n = len(self.kind) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        word = (self.kind == WORD) | ((self.kind == NAME) & (not names))
        token = np.where(word, self.value, _PLACE[self.kind])
        h = token[:n].copy()
        for j in range(1, size):
            h = bw.mix(h * np.uint64(0xBF58476D1CE4E5B9) + token[j:n + j])
        text = self._texts()
        plain = np.concatenate([[0], np.cumsum(word)])
        at = np.flatnonzero((text[:n] == text[size - 1:]) & (2 * (plain[size:] - plain[:n]) >= size))
        return text[at], at, h[at]

    def sequences(self, sizes):
        """(size, text, first token, hash of the values) for each run of so many tokens."""
        text, h = self._texts(), self.value.copy()
        for size in range(1, max(sizes, default=0) + 1):
            n = len(self.value) - size + 1
            if n <= 0:
                return
            if size > 1:
                h = bw.mix(h[:n] * np.uint64(0xBF58476D1CE4E5B9) + self.value[size - 1:])
            if size in sizes:
                at = np.flatnonzero(text[:n] == text[size - 1:])
                yield size, text[at], at, h[at]


def _table(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, where each one's rows begin, and the rows without the hash."""
    rows.sort()
    h = np.array([r[0] for r in rows], np.uint64)
    unique, begin = np.unique(h, return_index=True)
    return unique, np.append(begin, len(h)), np.array([r[1:] for r in rows], np.int64)


def _held(table, h: np.ndarray):
    """(place in h, row) of each hash that the table has."""
    unique, begin, rows = table
    pos = np.searchsorted(unique, h)
    pos[pos == len(unique)] = 0
    for k in np.flatnonzero(unique[pos] == h).tolist():
        for row in rows[begin[pos[k]]:begin[pos[k] + 1]].tolist():
            yield k, row


def _mapping(windows: list[set]) -> set:
    """One-to-one (item value, document value) pairs, those of most windows first."""
    uses = defaultdict(int)
    for pairs in windows:
        for pair in pairs:
            uses[pair] += 1
    out, left, right = set(), set(), set()
    for x, y in sorted(uses, key=lambda pair: (-uses[pair], pair)):
        if x not in left and y not in right:
            out.add((x, y))
            left.add(x)
            right.add(y)
    return out


class Benchmark:
    """A block of items: for each window size and reading of names, sorted hashes with their (item, place) lists; exact: the items
    without windows, by the hash of their first tokens."""

    def __init__(self, ids: list[int], texts: list[str], window: int, min_tokens: int):
        self.items: dict[int, dict] = {}
        found, exact = defaultdict(set), defaultdict(list)
        for lo, hi, raw, offsets in bw.text_slices(pa.array(texts, pa.string())):
            t = Template(raw, offsets)
            counts = np.diff(t.first)
            for size in sorted({min(window, int(c)) for c in counts if c >= min_tokens}):
                for source, names in ((t, True), (t.quoted(), True), (t, False)):
                    text, at, h = source.windows(size, names)
                    fit = (np.minimum(counts[text], window) == size) & (counts[text] >= min_tokens)
                    fit &= (source is t) | (at == t.first[text])
                    for d, a, x in zip(text[fit].tolist(), at[fit].tolist(), h[fit].tolist()):
                        base = int(t.first[d])
                        item = self.items.setdefault(lo + d, {"id": ids[lo + d], "value": t.value[base:int(t.first[d + 1])], "windows": (set(), set())})
                        item["windows"][names].add(a - base)
                        found[size, names].add((x, lo + d, a - base))
            bare = {d for d in range(hi - lo) if counts[d] and lo + d not in self.items}
            for size, text, at, h in t.sequences({min(window, int(counts[d])) for d in bare}):
                for d, a, x in zip(text.tolist(), at.tolist(), h.tolist()):
                    if d in bare and a == t.first[d] and min(window, counts[d]) == size:
                        whole = slice(a, a + int(counts[d]))
                        self.items[lo + d] = {"id": ids[lo + d], "value": t.value[whole], "slots": len(set(t.value[whole][t.kind[whole] != WORD].tolist()))}
                        exact[size].append((x, lo + d))
        self.sizes = {k: _table(list(rows)) for k, rows in found.items()}
        self.exact = {size: _table(rows) for size, rows in exact.items()}
        for item in self.items.values():
            item["windows"] = [len(x) for x in item.get("windows", ())]

    @classmethod
    def of(cls, parts: dict) -> Benchmark:
        """A benchmark from another one's parts (what is sent to the workers)."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def search(self, raw: np.ndarray, offsets: np.ndarray, coverage: float):
        """(text, item id, coverage, windows, slots, verbatim) of each item held by a text."""
        t = Template(raw, offsets)
        yield from self._verbatim(t)
        hits = defaultdict(list)
        for (size, names), table in self.sizes.items():
            text, at, h = t.windows(size, names)
            for k, (key, place) in _held(table, h):
                hits[int(text[k]), key, names].append((int(at[k]), place, size))
        for (d, key, names), found in hits.items():
            item = self.items[key]
            total = item["windows"][names]
            if len({place for _, place, _ in found}) < coverage * total:
                continue
            lines = defaultdict(list)
            for a, place, size in found:
                lines[a - place].append((a, place, size))
            covered, slots, verbatim, broken = set(), 0, True, False
            for line in lines.values():
                pairs = []
                for a, place, size in line:
                    kind = t.kind[a:a + size]
                    slot = np.flatnonzero((kind != WORD) & (names | (kind != NAME)))
                    pairs.append(set(zip(item["value"][place + slot].tolist(), t.value[a + slot].tolist())))
                agreed = _mapping(pairs)
                fits = [p <= agreed for p in pairs]
                covered.update(place for (_, place, _), ok in zip(line, fits) if ok)
                slots += len(agreed)
                verbatim &= all(x == y for p in pairs for x, y in p)
                broken |= not all(fits)
            if len(covered) > coverage * total or (len(covered) == coverage * total and not broken):
                yield d, item["id"], len(covered) / total, len(covered), slots, verbatim

    def _verbatim(self, t: Template):
        """The same of items without windows, by their whole sequence of tokens."""
        seen = set()
        for size, text, at, h in t.sequences(self.exact):
            for k, (key,) in _held(self.exact[size], h):
                item, d, a = self.items[key], int(text[k]), int(at[k])
                end = a + len(item["value"])
                if (d, key) not in seen and end <= t.first[d + 1] and np.array_equal(t.value[a:end], item["value"]):
                    seen.add((d, key))
                    yield d, item["id"], 1.0, 1, item["slots"], True


def _blocks(benchmark: DataFrame, item_text: str, item_id: str, window: int, min_tokens: int, block_bytes: int):
    """Yields the benchmark in blocks of about block_bytes, broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter(
        "text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        yield spark.sparkContext.broadcast(vars(Benchmark([r["id"] for r in part], [r["text"] for r in part], window, min_tokens)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
                 item_id: str = "item_id", window: int = WINDOW, coverage: float = COVERAGE, min_tokens: int = MIN_TOKENS,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it holds."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")

    def search(shared):
        def run(batches):
            block = Benchmark.of(shared.value)
            for batch in batches:
                keys = batch.column(0).to_numpy()
                for lo, hi, raw, offsets in bw.text_slices(batch.column(1), PART_BYTES):
                    rows = list(block.search(raw, offsets, coverage))
                    if rows:
                        d, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[lo + np.array(d)]), *[pa.array(list(x), k) for x, k in zip(rest, KINDS)]],
                            ["doc_id", "item_id", "coverage", "n_windows", "n_slots", "verbatim"])

        return run

    out = None
    for shared in _blocks(benchmark, item_text, item_id, window, min_tokens, block_bytes):
        found = source.mapInArrow(search(shared), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"),
        F.max("verbatim").alias("verbatim"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
          window: int = WINDOW, coverage: float = COVERAGE, min_tokens: int = MIN_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; one pass a block, no shuffle."""
    schema, place = docs.schema, docs.columns.index(text)

    def search(shared):
        def run(batches):
            block = Benchmark.of(shared.value)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for lo, _, raw, offsets in bw.text_slices(batch.column(place).cast(pa.string()), PART_BYTES):
                    for row in block.search(raw, offsets, coverage):
                        keep[lo + row[0]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _blocks(benchmark, item_text, item_id, window, min_tokens, block_bytes):
        docs = docs.mapInArrow(search(shared), schema)
    return docs
