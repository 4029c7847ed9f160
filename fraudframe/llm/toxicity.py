"""Toxic documents by a support vector machine on a subsequence string kernel.

A text's sentences (up to . ! ? or a line's end) are cut into units: words with marks
taken out, digits read as the letters they imitate, and runs of three or more single
letters joined.  A unit's features are its subsequences of four symbols inside six
(both word ends are symbols too), each skipped symbol costing a factor DECAY, so an
insult keeps much of its kernel value when characters are inserted, split by marks or
inflected.  The kernel is the normalised inner product of these features.

Training takes a bounded sample of labelled documents (``samples``, by the hash of the
id, one of each distinct text).  Their sentences carry the document's label; a sentence
that copies repeat counts once.  Units that keep to toxic sentences (by a binomial
score) are the positive examples, units of clean sentences the negative
ones.  Nyström landmarks are drawn from both, the positive ones greedily and unlike each
other, the negative ones as those nearest to them; a squared-hinge machine is fitted on the landmarks' feature space, which folds
into one weight for each four symbols.  A sentence's value is the highest of its units, a
document's the highest of its sentences; a logistic curve fitted on the sample's
documents turns it into a score from 0 to 1.

Null and empty texts have the value -1 (score near 0).  Without labels of both kinds the
score is the share of toxic labels, 0 if there are none.  Labels of several rows for
one id count as toxic if any is.  Null ids are scored and not learnt from; repeated rows
are scored each.  Only the named columns are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

SAMPLES, POSITIVES, NEGATIVES, LANDMARKS, LEAST_USES, LEAST_SCORE = 12_000, 400, 6000, 160, 4, 4.0
DECAY, COST, ALIKE = 0.6, 1.0, 0.9
_EDGE = 27
# symbols: 1-26 letters, 27 a word's end, 28-31 bytes of other letters; 0 is left out
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:192] = 28 + np.arange(64) % 4
#: Marks that stand for letters.
for _mark, _letter in zip("0134578@$", "oieastbas"):
    _SYMBOL[ord(_mark)] = ord(_letter) - 96
_SPANS = [(a, b, c) for a in range(1, 4) for b in range(1, 4) for c in range(1, 4) if a + b + c <= 5]
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
TABLE = 1 << 20
#: Bytes of text and units worked on at once: a symbol takes some hundred bytes of arrays.
PART_BYTES, PART_UNITS = 1 << 20, 8_000


class Units:
    """Units of a slice of texts: symbols one after another, and each unit's text and sentence."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = bw.split_words(raw, offsets)
        size = words.end - words.start
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.empty(0, np.int64)
        at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(words.start, size)
        symbol = _SYMBOL[words.buf[at]]
        word = np.repeat(np.arange(len(size)), size)
        keep = symbol > 0
        count = np.bincount(word[keep], minlength=len(size))
        last = words.buf[words.end - 1] if len(size) else np.empty(0, np.uint8)
        # runs of single letters in one text, not across a sentence's end, become one unit
        lone = count == 1
        opens = np.ones(len(size), bool)  # a sentence
        follows = np.zeros(len(size), bool)
        if len(size):
            line = np.concatenate([[0], np.cumsum(words.buf == 10)])
            opens[1:] = (words.doc[1:] != words.doc[:-1]) | _END[last[:-1]] | (line[words.start[1:]] != line[words.end[:-1] - 1])
            follows[1:] = lone[1:] & lone[:-1] & ~opens[1:]
        group = np.cumsum(~follows) - 1
        length = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 0)
        joined = (length >= 3)[group] if len(group) else np.empty(0, bool)
        unit = np.where(joined, group + len(size), np.arange(len(size)))
        names, index, unit = np.unique(unit, return_index=True, return_inverse=True)
        self.doc = words.doc[index]
        self.sentence = (np.cumsum(opens) - 1)[index]
        body = symbol[keep]
        owner = unit[word[keep]]
        n = np.bincount(owner, minlength=len(names))
        begin = np.concatenate([[0], np.cumsum(n + 2)])
        self.symbols = np.full(int(begin[-1]), _EDGE, np.int32)
        order = np.argsort(owner, kind="stable")
        owner, body = owner[order], body[order]
        place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else owner
        self.symbols[begin[owner] + 1 + place] = body
        self.begin, self.size = begin[:-1], n
        self.hash = bw.run_hashes(self.symbols.astype(np.uint8), self.begin, begin[1:]) if len(names) else np.empty(0, np.uint64)

    def pick(self, which: np.ndarray) -> list[bytes]:
        flat = self.symbols.astype(np.uint8)
        return [flat[self.begin[i]:self.begin[i] + self.size[i] + 2].tobytes() for i in which]


def subsequences(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray):
    """(unit, subsequence, weight), repeats of a subsequence summed."""
    unit = np.repeat(np.arange(len(begin)), length)
    left = np.repeat(begin + length, length) - np.arange(len(symbols))  # symbols from here to the unit's end
    keys, weight = [], []
    for a, b, c in _SPANS:
        i = np.flatnonzero(left > a + b + c)
        ids = (symbols[i] << 15) | (symbols[i + a] << 10) | (symbols[i + a + b] << 5) | symbols[i + a + b + c]
        keys.append(unit[i] * TABLE + ids)
        weight.append(np.full(len(i), DECAY ** (a + b + c - 3), np.float32))
    key, weight = np.concatenate(keys), np.concatenate(weight)
    if not len(key):
        return key, key, weight
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // TABLE, key[first] % TABLE, np.add.reduceat(weight, first)


def decide(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kernel machine's value of each unit, without the bias."""
    who, ids, weight = subsequences(symbols, begin, length)
    dot = np.bincount(who, weight * table[ids], minlength=len(begin))
    norm = np.bincount(who, weight * weight, minlength=len(begin))
    return dot / np.sqrt(np.maximum(norm, 1e-12))


def _features(units: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Normalised features of units in the given columns, a dense row each."""
    flat = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
    length = np.array([len(u) for u in units], np.int64)
    who, ids, weight = subsequences(flat, np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    norm = np.sqrt(np.maximum(np.bincount(who, weight * weight, minlength=len(units)), 1e-12))
    at = np.minimum(np.searchsorted(columns, ids), len(columns) - 1)
    has = columns[at] == ids
    out = np.zeros((len(units), len(columns)), np.float32)
    out[who[has], at[has]] = weight[has]
    return out / norm[:, None].astype(np.float32)


def _columns(units: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
    length = np.array([len(u) for u in units], np.int64)
    return np.unique(subsequences(flat, np.concatenate([[0], np.cumsum(length)[:-1]]), length)[1])


def fit(positive: list[bytes], negative: list[bytes], weight: np.ndarray, landmarks: int = LANDMARKS, cost: float = COST):
    """(table of a weight for each subsequence, bias) of the machine; weight: of each
    example, positive ones first."""
    columns = _columns(positive)
    near = _features(positive, columns)
    chosen: list[int] = []
    for i in range(len(positive)):  # strongest first, unlike those before
        if len(chosen) < landmarks and (not chosen or float((near[chosen] @ near[i]).max()) < ALIKE):
            chosen.append(i)

    def against(units: np.ndarray) -> np.ndarray:  # a part at a time: the features are wide
        return np.concatenate([_features(negative[lo:lo + 250], columns) @ units.T for lo in range(0, len(negative), 250)])

    close = np.argsort(-against(near[chosen]).max(axis=1), kind="stable")[:landmarks]  # clean units most like them
    base = np.concatenate([near[chosen], _features([negative[i] for i in close], columns)])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = np.concatenate([near @ base.T, against(base)]).astype(np.float64) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = cost * weight
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on the squared hinge
        active = y * (x @ w) < 1
        xa = x[active] * c[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    table = np.zeros(TABLE, np.float32)
    table[columns] = base.T @ (root @ w[:-1]).astype(np.float32)
    return table, float(w[-1])


def platt(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (value, label)."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (label - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _values(batch_text, table: np.ndarray, bias: float) -> np.ndarray:
    """The highest unit value of each text; -1 for texts without units."""
    out = np.full(len(batch_text), -1.0)
    for lo, _, raw, offsets in bw.text_slices(batch_text, PART_BYTES):
        units = Units(raw, offsets)
        _, index, inverse = np.unique(units.hash, return_index=True, return_inverse=True)
        length = units.size[index] + 2
        flat_at = np.arange(int(length.sum())) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(index) else index
        symbols = units.symbols[flat_at + np.repeat(units.begin[index], length)]
        value = np.empty(len(index))
        ends = np.cumsum(length)
        for a in range(0, len(index), PART_UNITS):
            b = min(len(index), a + PART_UNITS)
            s = ends[a] - length[a]
            value[a:b] = decide(symbols[s:ends[b - 1]], ends[a:b] - length[a:b] - s, length[a:b], table)
        value = np.where(units.size[index] > 0, value + bias, -1.0)[inverse]
        np.maximum.at(out, lo + units.doc, value)
    return out


def _unit_rows(batches):
    """(unit, sentence, label) of each distinct unit of each sentence of each labelled text."""
    for batch in batches:
        label = batch.column(2).to_numpy()
        for lo, _, raw, offsets in bw.text_slices(batch.column(1), PART_BYTES):
            units = Units(raw, offsets)
            if not len(units.doc):
                continue
            whole = np.zeros(int(units.sentence.max()) + 1, np.uint64)
            np.add.at(whole, units.sentence, bw.mix(units.hash))
            sentence = whole[units.sentence]
            which = np.flatnonzero((units.size >= 3) & (units.size <= 40))
            _, first = np.unique(bw.mix(units.hash[which]) + sentence[which], return_index=True)
            which = which[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(units.pick(which), pa.binary()), pa.array(sentence[which].view(np.int64)),
                 pa.array(label[lo + units.doc[which]].astype(np.int64))], ["unit", "sentence", "label"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
          samples: int = SAMPLES) -> dict:
    """The model, of fixed size.  At most POSITIVES + NEGATIVES units and about
    ``samples`` (value, label) pairs reach the driver."""
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        may & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("label"))
    n, toxic = known.agg(F.count("*"), F.sum("label")).first()
    if not n or not toxic or toxic == n:
        return {"share": (toxic or 0) / n if n else 0.0}
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, samples / n) * (1 << 30)))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    # the sample has about `samples` ids, so it is broadcast and the documents are not shuffled
    rows = source.join(F.broadcast(chosen), "doc_id")
    seen = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    one = rows.join(F.broadcast(seen.distinct()), "doc_id", "left_semi").select("doc_id", "text", F.col("label").cast("long").alias("label"))
    # a sentence that copies share counts once, and as clean if any clean document has it
    uses = one.mapInArrow(_unit_rows, "unit binary, sentence long, label long").groupBy("unit", "sentence").agg(F.min("label").alias("label"))
    counts = uses.groupBy("unit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    rate = toxic / n
    spread = (F.col("t") - (F.col("t") + F.col("c")) * rate) / F.sqrt((F.col("t") + F.col("c")) * rate * (1 - rate))
    counts = counts.select("unit", "t", "c", spread.alias("score")).persist()
    positive = counts.filter((F.col("t") >= LEAST_USES) & (F.col("score") >= LEAST_SCORE) & (F.col("t") >= 10 * F.col("c"))).orderBy(
        F.desc("score"), "unit").limit(POSITIVES).collect()
    clean = counts.filter((F.col("c") > 0) & (F.col("c") * rate >= F.col("t") * (1 - rate)))
    usual = clean.orderBy(F.desc("c"), "unit").limit(NEGATIVES // 2).collect()
    rare = clean.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES // 2).collect()
    counts.unpersist()
    if not positive or not usual:
        return {"share": rate}
    negative = {bytes(r["unit"]): r["c"] for r in rare} | {bytes(r["unit"]): r["c"] for r in usual}
    weight = np.sqrt(np.array([r["t"] for r in positive] + list(negative.values()), np.float64))
    table, bias = fit([bytes(r["unit"]) for r in positive], list(negative), weight)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_values(batch.column(1), shared.value, bias)), batch.column(2)], ["value", "label"])

    pairs = np.array([(r["value"], r["label"]) for r in one.mapInArrow(measure, "value double, label long").collect()])
    slope, offset = platt(pairs[:, 0], pairs[:, 1])
    return {"table": table, "bias": bias, "slope": slope, "offset": offset, "share": rate}


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and value (the machine's highest over the text's sentences)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if "table" not in model:
        return source.select("doc_id", F.lit(float(model["share"])).alias("score"), F.lit(None).cast("double").alias("value"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            value = _values(batch.column(1), m["table"], m["bias"])
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * value + m["offset"], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(value)], ["doc_id", "score", "value"])

    return source.mapInArrow(run, "doc_id long, score double, value double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, train(docs, labels)).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
