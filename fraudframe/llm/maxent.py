"""Log-probabilities of texts under a hashed maximum-entropy model.

Tokens are words (runs of bytes other than white space, A-Z lower-cased) and one end a
text.  A word hashes to one of ``CLASSES * MEMBERS`` buckets.  The model factors

    P(word | history) = P(class | history) * P(member | class, history) * P(word | bucket)

The first two are softmaxes over hashed features of the history: a bias, the previous
word, the word before it (a skip) and the pair.  The last is (c + 1) / (N_b + V_b + 1)
with c the word's training count, N_b the bucket's tokens and V_b its distinct words.

Every text is read once.  Runs of texts of about ``BLOCK_TOKENS`` tokens become a block:
the distinct words' hashes and counts and the sequence of their places, compressed.
Counts meet by a shuffle of (word, block) rows, so a frequent word has one row a
block.  Biases start at the counts' logarithms; weights are then trained in rounds of
distributed gradient updates: in every round each trainer runs over all its blocks with
its own copy, and the copies' changes are averaged by tokens on the executors in slices.  One
training text in PROBES lends its words' counts but no gradients: its loss tells how well the
model fits.  There are ROUNDS at least, and more as long as a round lowers that loss
by the share STILL.  The rows of a kind of feature grow with the square root of the number of
distinct words (``feature_rows``), so the weights that are broadcast take at most 3.3 kB times that
root, and 3.3 MB at least: 27 MB for a hundred million words.  Blocks are scored in numpy batches.

Texts whose id's crc32 modulo 7 is 2 are held out; so are, without the mark, texts with
a null id.  Null and empty texts are one end.  Repeated rows count and are scored as
often as they occur.  Without training tokens every count is 0.  Words are told apart by
64-bit hashes.  Only the named columns are read.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .storage import Scratch

#: Classes, members of each (both powers of two) and least rows of a kind of feature.
CLASSES, MEMBERS, MIN_ROWS = 16, 16, 1024
BUCKETS = CLASSES * MEMBERS
BLOCK_TOKENS, BATCH, ROUNDS, RATE, SMOOTH = 4_000_000, 1 << 15, 2, 0.2, 30.0
#: Share of the loss a round has to win for another one to follow; least updates a block, of the classes and of each class's members.
STILL, STEPS, MEMBER_STEPS = 0.002, 64, 8
#: One training text in so many is set aside to measure the fit.
PROBES = 16
#: Widest range of a batch's logits under which one shift serves all its tokens.
FLAT = 60.0
#: Trainers of a round: about one for each TRAINER_TOKENS tokens, but so many at least.
TRAINER_TOKENS, MIN_TRAINERS, SLICES = 4_000_000, 6, 256
#: Bytes of text, and tokens of a block to score, worked on at once.
PART_BYTES, PART_TOKENS = 1 << 20, 1 << 19
#: Most (word, block) rows of a counting task, on average.
TASK_ROWS = 4_000_000
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
BLOCKS = ("kind int, block long, hash long, place int, n int, tokens long, doc_ids array<long>, held array<boolean>, "
          "lengths array<int>, hashes binary, sequence binary")


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _probe(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) // 7 % PROBES == 0


def _blocks(batches):
    """Texts to blocks: a row for each distinct word (kind 0) and one for the block (kind 1)."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 24
    ids, hashes, places, lengths, held = [], [], [], [], 0

    def flush():
        nonlocal ids, hashes, places, lengths, held, block
        n = np.concatenate(lengths)
        # each slice's distinct words, named by their place among the block's
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        cut = np.cumsum([0, *map(len, hashes)])
        inverse = np.concatenate([at[a:b].astype(np.uint32)[p] for a, b, p in zip(cut, cut[1:], places)])
        hashes, places = [], []
        out = np.array([_held(i) for i in ids])
        learnt = np.repeat(~out & np.array([i is not None for i in ids]), n)
        count = np.bincount(inverse[learnt], minlength=len(words))
        order = np.argsort(-np.bincount(inverse, minlength=len(words)), kind="stable")  # frequent words: small places
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        words, count = words[order], count[order]
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        rows = len(words)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()),
                 pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for lo in range(0, rows, 50_000):
            hi = min(rows, lo + 50_000)
            cols = [pa.array(np.zeros(hi - lo, np.int32)), pa.array(np.full(hi - lo, block)), pa.array(words[lo:hi].view(np.int64)),
                    pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(count[lo:hi].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols + [pa.nulls(hi - lo, k) for k in kinds[5:]], names)
        whole = [[1], [block], [None], [None], [None], [len(inverse)], [ids], [out.tolist()], [n.tolist()], [words.tobytes()],
                 [_packed(rank[inverse])]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(whole, kinds)], names)
        pa.default_memory_pool().release_unused()  # the worker stays for later stages
        ids, lengths, held = [], [], 0
        block += 1

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for lo, hi, raw, offsets in bw.text_slices(batch.column(1), PART_BYTES):
            words = bw.split_words(raw, offsets)
            distinct, place = np.unique(np.insert(words.hash, words.first[1:], END), return_inverse=True)
            hashes.append(distinct)
            places.append(place.astype(np.uint32))
            lengths.append(np.diff(words.first) + 1)
            ids += keys[lo:hi]
            held += len(place)
            if held >= BLOCK_TOKENS:
                yield from flush()
    if held:
        yield from flush()


TOTALS = "kind int, block long, places binary, totals binary, bucket int, tokens long, words long"


def _totals(batches):
    """(hash, block, place, n) of all rows of some words, to each block's totals and each bucket's sums."""
    parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
    if not parts:
        return
    h, block, place, n = (np.concatenate(x) for x in zip(*parts))
    words, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, n, minlength=len(words)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, place, each = block[order], place[order], total[inverse[order]]
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ends = np.append(cut[1:], len(block))
    k = len(cut)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(k, np.int32)), pa.array(block[cut]),
         pa.array([place[a:b].astype("<u4").tobytes() for a, b in zip(cut, ends)], pa.binary()),
         pa.array([each[a:b].astype("<i8").tobytes() for a, b in zip(cut, ends)], pa.binary()),
         pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
        ["kind", "block", "places", "totals", "bucket", "tokens", "words"])
    bucket = words % BUCKETS
    sums = np.bincount(bucket, total, minlength=BUCKETS).astype(np.int64)
    seen = np.bincount(bucket[total > 0], minlength=BUCKETS).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(BUCKETS, 2, np.int32)), pa.nulls(BUCKETS, pa.int64()), pa.nulls(BUCKETS, pa.binary()), pa.nulls(BUCKETS, pa.binary()),
         pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(sums), pa.array(seen)],
        ["kind", "block", "places", "totals", "bucket", "tokens", "words"])


def feature_rows(words: int) -> int:
    """Rows of each kind of feature for a corpus of so many distinct words: the power of two next
    above half their square root."""
    return max(MIN_ROWS, 1 << math.ceil(math.log2(math.sqrt(max(4, words)) / 2)))


class Softmax:
    """Weights of three kinds of hashed features and, last, a bias, for WIDTH outcomes."""

    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.rows = len(weights) // 3
        self.kinds = [weights[k * self.rows:(k + 1) * self.rows] for k in range(3)]
        self.past = None

    def forward(self, f: np.ndarray):
        """Logits less a shift, their exponentials and the exponentials' sums."""
        x = self.kinds[0].take(f[0], axis=0)
        x += self.kinds[1].take(f[1], axis=0)
        x += self.kinds[2].take(f[2], axis=0)
        x += self.w[-1]
        top = x.max()
        x -= top if top - x.min() < FLAT else x.max(axis=1, keepdims=True)
        p = np.exp(x)
        return x, p, p @ np.ones(p.shape[1], np.float32)

    def logs(self, f: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Natural log-probability of each outcome."""
        x, _, total = self.forward(f)
        return x.ravel().take(np.arange(0, x.size, x.shape[1]) + outcome).astype(np.float64) - np.log(total)

    def update(self, f: np.ndarray, outcome: np.ndarray) -> float:
        """One gradient step (Adagrad) on the rows that a batch touches; returns its loss before the step."""
        if self.past is None:
            self.past = np.zeros_like(self.w)
        x, p, total = self.forward(f)
        is_it = np.arange(0, x.size, x.shape[1]) + outcome
        loss = float(np.log(total).sum(dtype=np.float64) - x.ravel().take(is_it).sum(dtype=np.float64))
        p *= (1 / total)[:, None]
        p.ravel()[is_it] -= 1
        pairs = p.view(np.complex64)  # sums two columns at a time
        for k in range(3):
            order = np.argsort(f[k], kind="stable")
            row = f[k][order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            g = np.add.reduceat(pairs.take(order, axis=0), first, axis=0).view(np.float32)
            at = row[first].astype(np.intp) + k * self.rows
            past = self.past[at] + g * g
            self.past[at] = past
            self.w[at] -= RATE * g / np.sqrt(past + SMOOTH)
        return loss


class Model:
    """A softmax over the classes and, for each class, one over its members.

    Their weights are apart from one another, so each is trained on batches of its own."""

    def __init__(self, weights: np.ndarray):
        self.w = weights.astype(np.float32).reshape(1 + CLASSES, -1, MEMBERS)
        self.parts = [Softmax(w) for w in self.w]
        self.rows = self.parts[0].rows

    def by_class(self, f: np.ndarray, bucket: np.ndarray):
        """Places, features and members of the tokens of each class."""
        cls = (bucket // MEMBERS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        cut = np.cumsum([0, *np.bincount(cls, minlength=CLASSES)])
        for c in range(CLASSES):
            at = order[cut[c]:cut[c + 1]]
            yield self.parts[1 + c], at, f[:, at], bucket[at] % MEMBERS

    def score(self, f: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Natural log-probability of each bucket."""
        out = np.empty(len(bucket))
        for lo in range(0, len(bucket), BATCH):
            out[lo:lo + BATCH] = self.parts[0].logs(f[:, lo:lo + BATCH], bucket[lo:lo + BATCH] // MEMBERS)
        for part, at, g, member in self.by_class(f, bucket):
            for lo in range(0, len(at), BATCH):
                out[at[lo:lo + BATCH]] += part.logs(g[:, lo:lo + BATCH], member[lo:lo + BATCH])
        return out

    def train(self, f: np.ndarray, bucket: np.ndarray) -> float:
        """One pass over a block's tokens; returns their loss."""
        n, loss = len(bucket), 0.0
        size = min(BATCH, max(1, -(-n // STEPS)))
        for lo in range(0, n, size):
            loss += self.parts[0].update(f[:, lo:lo + size], bucket[lo:lo + size] // MEMBERS)
        for part, at, g, member in self.by_class(f, bucket):
            size = min(BATCH, max(1, -(-len(at) // MEMBER_STEPS)))
            for lo in range(0, len(at), size):
                loss += part.update(g[:, lo:lo + size], member[lo:lo + size])
        return loss


def _features(hashes: np.ndarray, seq: np.ndarray, lengths: np.ndarray, rows: int):
    """Feature rows (3 x tokens) and bucket of each token of a block."""
    mask, kind = np.uint64(rows - 1), np.uint16 if rows <= 1 << 16 else np.uint32
    one = (bw.mix(hashes + np.uint64(1)) & mask).astype(kind)
    two = (bw.mix(hashes + np.uint64(2)) & mask).astype(kind)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = np.zeros(len(seq), bool)
    first[begin] = True
    second = np.zeros(len(seq), bool)
    second[begin[lengths > 1] + 1] = True
    s = int(START)
    edge = [bw.mix(np.array([(s + k) % 2 ** 64], np.uint64))[0] & mask for k in (1, 2)]
    before = np.concatenate([np.zeros(2, seq.dtype), seq])
    f = np.empty((3, len(seq)), kind)
    f[0, 1:] = one[seq[:-1]]
    f[0, first] = edge[0]
    f[1, 2:] = two[seq[:-2]]
    f[1, first | second] = edge[1]
    for lo in range(0, len(seq), BATCH):
        hi = min(len(seq), lo + BATCH)
        h1, h2 = hashes[before[lo + 1:hi + 1]], hashes[before[lo:hi]]
        h1[first[lo:hi]] = START
        h2[first[lo:hi] | second[lo:hi]] = START
        f[2, lo:hi] = bw.mix(h1 * np.uint64(0xBF58476D1CE4E5B9) + h2) & mask
    return f, (hashes & np.uint64(BUCKETS - 1)).astype(np.uint8)[seq]


def _open(row: dict):
    hashes = np.frombuffer(row["hashes"], np.uint64)
    return hashes, _unpacked(row["sequence"]), np.array(row["lengths"], np.int64)


def _learnt(batches, rows: int, probes: bool):
    """Features and buckets of each block's training texts: those that lend gradients, or those that only measure the fit."""
    for batch in batches:
        for i in range(len(batch)):
            row = {n: batch.column(n)[i].as_py() for n in ("hashes", "sequence", "lengths", "held", "doc_ids")}
            hashes, seq, lengths = _open(row)
            texts = np.array([d is not None and not h and _probe(d) == probes for d, h in zip(row["doc_ids"], row["held"])])
            if texts.any():
                yield _features(hashes, seq[np.repeat(texts, lengths)], lengths[texts], rows)


CHANGES = "slice int, change binary, tokens long"
CHANGE_NAMES = [f.split()[0] for f in CHANGES.split(", ")]


def _train(shared):
    def run(batches):
        model, start, tokens = Model(shared.value), shared.value, 0
        for f, bucket in _learnt(batches, model.rows, False):
            model.train(f, bucket)
            tokens += len(bucket)
        if tokens:
            change = np.array_split((model.w.ravel() - start) * np.float32(tokens), SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([c.tobytes() for c in change], pa.binary()),
                 pa.array(np.full(SLICES, tokens))], CHANGE_NAMES)

    return run


def _average(batches):
    """The trainers' changes, averaged by tokens slice by slice."""
    sums: dict[int, list] = {}
    for batch in batches:
        for s, change, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
            have = sums.setdefault(s, [0.0, 0])
            have[0] = have[0] + np.frombuffer(change, np.float32).astype(np.float64)
            have[1] += tokens
    if sums:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([(sums[k][0] / sums[k][1]).astype(np.float32).tobytes() for k in keys], pa.binary()),
             pa.array([sums[k][1] for k in keys], pa.int64())], CHANGE_NAMES)


def _measure(shared):
    """Tokens of the texts set aside and their loss."""
    def run(batches):
        model, tokens, loss = Model(shared.value), 0, 0.0
        for f, bucket in _learnt(batches, model.rows, True):
            tokens += len(bucket)
            loss -= float(model.score(f, bucket).sum())
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([loss], pa.float64())], ["tokens", "loss"])

    return run


def _fit(blocks: DataFrame, weights: np.ndarray, trainers: int, rounds: int) -> np.ndarray:
    """Weights after so many rounds as lower the loss of the texts set aside."""
    context = blocks.sparkSession.sparkContext
    done, best = 0, np.inf
    while True:
        shared = context.broadcast(weights)
        changes = blocks.coalesce(trainers).mapInArrow(_train(shared), CHANGES)
        slices = sorted(changes.repartition("slice").mapInArrow(_average, CHANGES).collect(), key=lambda r: r["slice"])
        shared.unpersist()
        if not slices:
            return weights
        after = weights + np.concatenate([np.frombuffer(r["change"], np.float32) for r in slices])
        shared = context.broadcast(after)
        fit = blocks.mapInArrow(_measure(shared), "tokens long, loss double").agg(F.sum("tokens").alias("n"), F.sum("loss").alias("loss")).first()
        shared.unpersist()
        done += 1
        loss = fit["loss"] / fit["n"] if fit["n"] else 0.0
        if done > rounds and loss >= best:
            return weights
        weights, enough = after, loss > (1 - STILL) * best
        if done >= rounds and enough:
            return weights
        best = loss


def _runs(lengths: np.ndarray):
    """Runs of whole texts of about PART_TOKENS tokens: the first and last text, the first and last token."""
    ends = np.cumsum(lengths)
    cut = np.unique([0, *np.flatnonzero(np.diff(ends // PART_TOKENS, prepend=0)) + 1, len(lengths)])
    at = np.append(0, ends)[cut]
    return zip(cut, cut[1:], at, at[1:])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shared, tokens: int, words: int, bucket_tokens: np.ndarray, bucket_words: np.ndarray):
    def run(batches):
        model = Model(shared.value)
        places, totals, current = [], [], None
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column("block")[i].as_py()
                if block != current:
                    places, totals, current = [], [], block
                if batch.column("kind")[i].as_py() == 0:
                    places.append(np.frombuffer(batch.column("places")[i].as_py(), "<u4"))
                    totals.append(np.frombuffer(batch.column("totals")[i].as_py(), "<i8"))
                    continue
                row = {n: batch.column(n)[i].as_py() for n in ("hashes", "sequence", "lengths", "held", "doc_ids")}
                hashes, seq, lengths = _open(row)
                count = np.zeros(len(hashes), np.int64)
                count[np.concatenate(places)] = np.concatenate(totals)
                home = (hashes.view(np.int64) % BUCKETS)
                base = np.log10((count + 1) / (tokens + words + 1))
                inside = np.log10((count + 1) / (bucket_tokens[home] + bucket_words[home] + 1))
                per = [[], [], []]
                for first, last, lo, hi in _runs(lengths):
                    part, n = seq[lo:hi], lengths[first:last]
                    logs = model.score(*_features(hashes, part, n, model.rows)) / np.log(10) + inside[part]
                    begin = np.cumsum(n) - n
                    for sums, values in zip(per, ((count > 0)[part].astype(np.int64), base[part], logs)):
                        sums.append(np.add.reduceat(values, begin))
                per = [np.concatenate(x) for x in per]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), *map(pa.array, per)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def log_probabilities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    staged = scratch.keep(source.mapInArrow(_blocks, BLOCKS), "blocks")
    rows = staged.filter("kind = 0").select("hash", "block", "place", "n")
    blocks = staged.filter("kind = 1").drop("hash", "place", "n")
    # a task holds its words' rows, so their number a partition stays bounded as the input grows
    parts = -(-rows.count() // TASK_ROWS)
    spread = rows.repartition(parts, "hash") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("hash")
    sums = scratch.keep(spread.mapInArrow(_totals, TOTALS), "totals")
    bucket_tokens, bucket_words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in sums.filter("kind = 2").groupBy("bucket").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect():
        bucket_tokens[r["bucket"]], bucket_words[r["bucket"]] = r["t"], r["w"]
    tokens, words = int(bucket_tokens.sum()), int(bucket_words.sum())
    start = np.zeros((1 + CLASSES, 3 * feature_rows(words) + 1, MEMBERS))
    share = bucket_tokens.reshape(CLASSES, MEMBERS) + 1.0
    start[0, -1] = np.log(share.sum(axis=1) / share.sum())
    start[1:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
    weights = start.ravel().astype(np.float32)
    weights = _fit(blocks, weights, max(MIN_TRAINERS, tokens // TRAINER_TOKENS), rounds) if tokens else weights
    shared = spark.sparkContext.broadcast(weights)
    tasks = max(blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = sums.filter("kind = 0").select("kind", "block", "places", "totals").unionByName(
        blocks.drop("tokens"), allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    scored = tagged.mapInArrow(_score(shared, tokens, words, bucket_tokens, bucket_words), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
