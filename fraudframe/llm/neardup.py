"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct shingles of ``k`` words (fewer words: the whole
sequence as one).  SuperMinHash gives each shingle one random permutation of the
signature's slots; its value in its j-th slot is j plus a random fraction, so ranks
are correlated over the slots and a slot filled in an earlier round is final.  Rounds
stop as soon as every slot of a document is filled (for long texts after a few of
the ``slots`` rounds).  Signatures are cut into ``bands`` bands of ``slots / bands``
slots; two documents of similarity 0.8 share none with probability 5e-6.

Documents with equal sets are one class before banding, so copies cost nothing later.
In every bucket one class is the first hub, the one whose buckets are the largest in
all; classes are compared with hubs, not with each other.  Pairs are confirmed on full sets (a pair whose signatures agree
in fewer than ``agree`` of the slots is not worth the text: at similarity 0.8 that is
4.6 standard deviations off or more) and linked pairs contracted to components.  What
is left are buckets that hold several components; their classes are compared in tiles of
bounded size, whole sets at once as a matrix product, which returns links and no pairs.

Returned: doc_id, n_shingles, component_id, kept.  Null or empty texts and texts of
white space have no shingles, are their own component and are kept.  A null doc_id is
returned with its set's size, has no component and is kept.  Rows that repeat a doc_id
are each returned.  Only the named columns are read.  Hashes are of 64 bits; sets are
equal when their size and two 64-bit sums agree.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .components import components
from .storage import Scratch

SLOTS, BANDS, AGREE = 240, 40, 0.68
#: Levels that are tried on all documents of a slice, before the small ones go on alone.
SHARED_LEVELS = 6
#: Most classes that are compared in one tile, and shingles at a time.
TILE, COLUMNS = 256, 1 << 16
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary"
_SALT = 0xA0761D6478BD642F


def _draw(h: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(place to swap with, 56-bit fraction) of each shingle at a level."""
    u = bw.mix(h + np.uint64((2 * level + 1) * _SALT % (1 << 64)))
    v = bw.mix(h + np.uint64((2 * level + 2) * _SALT % (1 << 64)))
    return level + (u % np.uint64(slots - level)).astype(np.int64), v >> np.uint64(8)


def _fill(sig: np.ndarray, row: np.ndarray, slot: np.ndarray, level: int, fraction: np.ndarray) -> None:
    np.minimum.at(sig.reshape(-1), row * sig.shape[1] + slot, (np.uint64(level) << np.uint64(56)) | fraction)


EMPTY = np.uint64(2 ** 64 - 1)


def signatures(row: np.ndarray, h: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values of each row's distinct shingles (rows ascend)."""
    sig = np.full((rows, slots), EMPTY, np.uint64)
    live_row, live_h = row, h
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(min(SHARED_LEVELS, slots)):
        if not len(live_row):
            return sig
        place, fraction = _draw(live_h, level, slots)
        slot, moved = place.copy(), np.full(len(live_h), level)
        for k, v in swaps:  # what an earlier swap put there
            slot = np.where(k == place, v, slot)
            moved = np.where(k == level, v, moved)
        _fill(sig, live_row, slot, level, fraction)
        open_rows = (sig == EMPTY).any(axis=1)
        go = open_rows[live_row]
        live_row, live_h = live_row[go], live_h[go]
        swaps = [(k[go], v[go]) for k, v in [*swaps, (place, moved)]]
    # the rest, with whole permutations, a bounded number of shingles at a time
    while len(live_row):
        stop = min(len(live_row), 40_000)
        stop = int(np.searchsorted(live_row, live_row[stop - 1], side="right"))
        r, g = live_row[:stop], live_h[:stop]
        live_row, live_h = live_row[stop:], live_h[stop:]
        perm = np.tile(np.arange(slots, dtype=np.int16), (len(r), 1))
        for level in range(slots):
            place, fraction = _draw(g, level, slots)
            at = np.arange(len(r))
            slot = perm[at, place].astype(np.int64)
            perm[at, place] = perm[:, level]
            if level >= SHARED_LEVELS:
                _fill(sig, r, slot, level, fraction)
            go = (sig == EMPTY).any(axis=1)[r]
            if not go.all():
                r, g, perm = r[go], g[go], perm[go]
                if not len(r):
                    break
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(bw.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_SALT)), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = bw.mix(key + parts[:, :, j])
    return key


def _sign(k: int, slots: int, bands: int):
    def run(batches):
        for batch in batches:
            for lo, hi, raw, offsets in bw.text_slices(batch.column(1)):
                n = hi - lo
                row, h = bw.distinct_pairs(*bw.shingles(bw.split_words(raw, offsets), k))
                size = np.bincount(row, minlength=n)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(a, row, h)
                np.add.at(b, row, bw.mix(h + np.uint64(_SALT)))
                sig = signatures(row, h, n, slots)
                keys = band_keys(sig, bands).astype(np.int64)
                marks = (bw.mix(sig) >> np.uint64(56)).astype(np.uint8)
                keys[size == 0] = 0
                full = (size > 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)),
                    pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), lists, pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "marks"])

    return run


def _similar(k: int, percent: int):
    """Passes pairs (a, b, text_a, text_b) with 100 * common >= percent * union."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            for lo in range(0, len(batch), 256):
                n = min(256, len(batch) - lo)
                sets = []
                for c in (2, 3):
                    rows, hashes = [], []
                    for s, e, raw, offsets in bw.text_slices(batch.column(c).slice(lo, n)):
                        r, h = bw.distinct_pairs(*bw.shingles(bw.split_words(raw, offsets), k))
                        rows.append(r + s)
                        hashes.append(h)
                    sets.append((np.concatenate(rows), np.concatenate(hashes)))
                row, h = (np.concatenate(x) for x in zip(*sets))
                if len(row):
                    order = np.argsort(bw.pair_key(row, h))
                    row, h = row[order], h[order]
                    same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                    common = np.bincount(row[1:][same], minlength=n)
                else:
                    common = np.zeros(n, np.int64)
                union = np.bincount(row, minlength=n) - common
                ok = np.flatnonzero((union > 0) & (100 * common >= percent * union)) + lo
                if len(ok):
                    at = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return run


def _alike(agree: float):
    """Passes pairs (a, b, marks_a, marks_b) whose signatures agree in enough slots."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in (2, 3))
            ok = np.flatnonzero((x == y).mean(axis=1) >= agree)
            if len(ok):
                at = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _tile_links(percent: int):
    """Links between the components of each tile (rows tile_a, tile_b, tile_c, rep, root, shingles, sorted
    by tile).  A tile's sets are compared at once as a matrix over the shingles that two of them share;
    of the links found, those that join components not yet joined are returned."""
    def links(rep: np.ndarray, root: np.ndarray, sets: list[np.ndarray]):
        rep, first = np.unique(rep, return_index=True)
        root, sets = root[first], [sets[i] for i in first]
        if (root == root[0]).all():
            return
        size = np.array([len(x) for x in sets])
        row, value = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        names, place, times = np.unique(value, return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        has = times[place] > 1
        row, column = row[has], column[place[has]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            shared = np.zeros((len(sets), COLUMNS), np.float32)
            shared[row[a:b], column[a:b] - lo] = 1
            common += (shared @ shared.T).astype(np.int64)
        alike = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in zip(*np.nonzero(np.triu(alike & (root[:, None] != root[None, :]), 1))):
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield int(rep[i]), int(rep[j])

    def run(batches):
        tile, held = None, ([], [], [])

        def close():
            found = list(links(np.array(held[0]), np.array(held[1]), held[2])) if held[0] else []
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for a, b, c, rep, root, shingles in zip(*cols):
                if (a, b, c) != tile:
                    yield from close()
                    tile, held = (a, b, c), ([], [], [])
                held[0].append(rep)
                held[1].append(root)
                held[2].append(np.frombuffer(shingles, np.uint64))
        yield from close()

    return run


def _sets(k: int):
    """(rep, shingles) with the distinct shingles of each text."""
    def run(batches):
        for batch in batches:
            for lo, hi, raw, offsets in bw.text_slices(batch.column(1)):
                row, h = bw.distinct_pairs(*bw.shingles(bw.split_words(raw, offsets), k))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    ["rep", "shingles"])

    return run


def _compare(rest: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links between the components of open buckets (rows key, rep, root, low, size).

    Buckets of up to TILE classes are tiles; equal ones are compared once.  Larger ones that
    share classes are put together, their classes dealt to blocks of about TILE / 2 and
    every two blocks compared, so no task holds more than a tile at a time.
    """
    lists = rest.filter(F.col("size") <= TILE).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("rep", "root"))).alias("all"))
    small = lists.groupBy(F.xxhash64("all").alias("a"), F.xxhash64("all", F.lit(1)).alias("b")).agg(F.first("all").alias("all"))
    small = small.select("a", "b", F.lit(-1).alias("c"), F.explode("all").alias("x")).select("a", "b", "c", "x.rep", "x.root")
    large = rest.filter(F.col("size") > TILE)
    if not large.isEmpty():
        group = components(large.select(F.col("low").alias("a"), F.col("rep").alias("b")), scratch)
        dealt = large.select("rep", "root").distinct().join(group.select(F.col("node").alias("rep"), F.col("root").alias("a")), "rep")
        blocks = dealt.groupBy("a").agg(F.ceil(F.count("*") / (TILE // 2)).cast("long").alias("blocks"))
        dealt = dealt.join(blocks, "a").select("a", "rep", "root", F.pmod(F.xxhash64("rep"), "blocks").alias("own"),
                                               F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        small = small.unionByName(dealt.select("a", F.least("own", "other").alias("b"), F.greatest("own", "other").cast("int").alias("c"), "rep", "root"))
    rows = scratch.keep(small, "tile-rows")
    own = texts.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    sets = own.mapInArrow(_sets(k), "rep long, shingles binary")
    tiles = rows.join(sets, "rep").select("a", "b", "c", "rep", "root", "shingles").repartition("a", "b", "c").sortWithinPartitions("a", "b", "c")
    return tiles.mapInArrow(_tile_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 2, percent: int = 80,
                    slots: int = SLOTS, bands: int = BANDS, agree: float = AGREE) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = scratch.keep(source.mapInArrow(_sign(k, slots, bands), SIGNED), "signed")
    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    fp = ["n_shingles", "set_a", "set_b"]
    classes = scratch.keep(known.groupBy(*fp).agg(F.min("doc_id").alias("rep")), "classes")
    # one row of marks and bands for each class (a repeated row repeats its class's values)
    marked = known.join(classes.select("rep", *[F.col(c).alias(f"_{c}") for c in fp]),
                        (F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") == F.col("_n_shingles"))
                        & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b")), "left_semi")
    marked = marked.select(F.col("doc_id").alias("rep"), "bands", "marks")
    rows = marked.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top"), F.count("*").alias("size")).filter(
        F.col("low") < F.col("top"))
    # members of buckets that hold at least two classes
    placed = scratch.keep(rows.join(shared, "key").select("key", "rep", "size"), "placed")
    # a text shares more buckets with its copies than they with each other, so the class
    # whose buckets are largest in all is a bucket's hub
    fame = placed.groupBy("rep").agg(F.sum("size").alias("fame"))
    ranked = placed.join(fame, "rep").select("key", "rep", "size", F.struct("fame", (-F.col("rep")).alias("rep")).alias("rank"))
    ranked = scratch.keep(ranked, "ranked")
    hubs_of = ranked.groupBy("key").agg(F.max("rank").alias("best")).select("key", (-F.col("best.rep")).alias("hub"), F.col("best.fame").alias("fame"))
    members = scratch.keep(ranked.join(hubs_of, "key").select("key", "rep", "hub", "fame", "size"), "members")
    marks = marked.join(fame.select("rep"), "rep", "left_semi")
    marks = scratch.keep(marks.dropDuplicates(["rep"]).select("rep", "marks"), "marks")
    # the candidates' texts, written once; merged by sort at every size
    texts = scratch.keep(source.hint("merge").join(marks.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "texts")

    def one_text(pairs: DataFrame, side: str) -> DataFrame:
        return pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar on full sets."""
        pairs = pairs.join(marks.select(F.col("rep").alias("a"), F.col("marks").alias("marks_a")), "a").join(
            marks.select(F.col("rep").alias("b"), F.col("marks").alias("marks_b")), "b")
        likely = scratch.keep(pairs.select("a", "b", "marks_a", "marks_b").mapInArrow(_alike(agree), "a long, b long"), f"{name}-likely")
        both = one_text(one_text(likely, "a"), "b").select("a", "b", "text_a", "text_b")
        return scratch.keep(both.mapInArrow(_similar(k, percent), "a long, b long").distinct(), f"{name}-links")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        x = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        y = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        return pairs.join(x, "a", "left").join(y, "b", "left").filter(
            F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    stars = scratch.keep(members.filter(F.col("rep") != F.col("hub")).groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(
        F.max("fame").alias("fame"), F.count("*").alias("times")), "stars")
    # first each class with one hub, the one it meets most often: most groups of copies merge by that
    first = stars.groupBy("b").agg(F.max(F.struct("times", "fame", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = confirm(first, "first")
    roots = components(links, scratch)
    more = scratch.keep(apart(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), roots), "more")
    if not more.isEmpty():
        links = links.unionByName(confirm(more, "more"))
        roots = components(links, scratch)
    # buckets in which several components are left
    named = members.filter("size > 2").select("key", "rep").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    open_ = named.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("size"), F.min("root").alias("lo"),
                                     F.max("root").alias("hi")).filter("lo < hi").select("key", "low", "size")
    rest = scratch.keep(named.join(open_, "key"), "open")
    if not rest.isEmpty():
        new = scratch.keep(_compare(rest, texts, scratch, k, percent), "tiles")
        if not new.isEmpty():
            roots = components(links.unionByName(new), scratch)
    labels = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        *fp, F.coalesce("root", "rep").alias("root"))
    found = signed.select("doc_id", *fp).join(labels, fp, "left")
    return found.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id")).alias("component_id")
    ).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
