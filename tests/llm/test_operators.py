"""Each operator against a brute-force version on small tables with nulls, empty and
long texts, repeated rows and columns of clashing names."""
import collections
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (9001, None, None), (9002, "", "en"), (9003, " \n\t ", "en"), (9004, "One", "en"), (9004, "One", "en"), (None, "Some words here", None),
    (9005, "x" * 50_000, "en"), (9006, "word " * 20_000, "en"), (9007, "ÉÀ ß 中文 don't <|endoftext|> 12½ ×", "fr"), (9008, "12 34!", "de"), (9009, "² ½ Ⅳ ٣", "de"),
]


@pytest.fixture(scope="module")
def rows():
    found = duckdb.connect().execute(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
    return found + EDGE


@pytest.fixture(scope="module")
def docs(spark, rows):
    # the last columns clash with names the operators use
    wide = [(*r, "s", len(r[1] or ""), 1, "x", True) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, score int, row string, accepted boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_top_k(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from fraudframe.llm import topk

    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)]
    vecs += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (304, []),
             (100, vecs[100][1]), (400, [1e9, -1e9, 1e9, 1e9]), (401, [1e9, -1e9, 1e9, 1e9])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=5, min_shards=5, fan_in=2).collect()}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in whole if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        want.update({(q, n + 1): (i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for n, (s, i) in enumerate(best)})
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_language(docs, empty, rows):
    from fraudframe.llm import langid

    out = langid.predictions(docs).collect()
    assert len(out) == len(rows) and langid.predictions(empty).count() == 0
    lang = {i: x for i, _, x in rows}
    text = {i: t for i, t, _ in rows}
    for r in out:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or "")))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)
    kept = langid.accepted(docs, langid.dictionaries(docs))
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0


def test_toxicity(spark, docs, empty, rows):
    from fraudframe.llm import toxicity

    spec = [(i, 0, int(i % 3 == 0)) for i in range(300)] + [(5, 0, None), (None, 0, 1)]
    base = "Plain words that say very little. Another sentence follows"
    made = [(i, f"{base} number {i} with a" + (f" nasty blockhe{'xyz'[i % 3]}ad here" if i % 3 == 0 else " calm remark here")) for i in range(300)]
    made += [(7001, "you b.l.o.c.k.h.e.a.d"), (7002, "you b l o c k h e a d"), (7003, None), (7004, ""), (None, base)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame(spec, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.predictions(d, labels).collect()}
    assert all(out[i].predicted == int(i % 3 == 0) for i in range(300))
    assert out[7001].predicted == out[7002].predicted == 1
    assert out[7003].predicted == out[7004].predicted == out[None].predicted == 0
    assert toxicity.predictions(docs, labels.limit(0)).filter("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.predictions(empty, labels).count() == 0


def test_shards(spark, docs, empty, rows, tmp_path):
    from fraudframe.llm import shards

    path = str(tmp_path / "map")
    out = shards.assign(docs, shards=4, slots=64, map_path=path).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.shard] += r.size
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    old, new = ({r.slot: r.shard for r in shards.read_map(spark, path, v).collect()} for v in (0, 1))
    assert old == shards.even_map(64, 4) and set(new) == set(old)
    load = {s: (n, 1) for s, n in enumerate([100, 1, 1, 1] * 16)}
    moved = shards.rebalance(shards.even_map(64, 4), load, 4)
    total = collections.Counter()
    for s, shard in moved.items():
        total[shard] += load[s][0]
    assert max(total.values()) - min(total.values()) <= 2
    assert shards.assign(empty).count() == 0


def test_shards_spread_copies_and_edit_the_stored_map(spark, tmp_path):
    from fraudframe.llm import shards

    path = str(tmp_path / "map")
    data = [(i, "text " * 40) for i in range(1000)] + [(5000, "copy " * 40)] * 400 + [(None, "copy " * 40)] * 500
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, record string, copy int").repartition(7)

    def run(rows, count=8):
        return shards.assign(rows, shards=count, slots=256, map_path=path).collect()

    first = run(docs)
    total = collections.Counter()
    for r in first:
        total[r.shard] += r.size
    assert max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 8 and len(total) == 8
    assert {r.map_version for r in first} == {1}
    # the same rows in other partitions: the slots of a record's copies are the same, no slot moves
    again = run(docs.repartition(3))
    assert {r.map_version for r in again} == {2} and shards.versions(spark, path) == [0, 1, 2]
    key = lambda rows: collections.Counter((r.doc_id, r.virtual_slot, r.shard) for r in rows)
    assert key(first) == key(again)
    # more rows: few slots move
    more = run(docs.unionByName(spark.createDataFrame([(9000 + i, "new " * 50, "x", 1) for i in range(60)], docs.schema)))
    old, new = ({r.slot: r.shard for r in shards.read_map(spark, path, v).collect()} for v in (2, 3))
    assert len(more) == 1960 and sum(old[s] != new[s] for s in old) <= 40
    for s in range(8):
        assert sorted(r.slot for r in more if r.shard == s) == list(range(sum(r.shard == s for r in more)))
    # two shards more: they take slots from the others; fewer shards than the map has are refused
    grown = run(docs, 10)
    assert len({r.shard for r in grown}) == 10
    with pytest.raises(ValueError):
        run(docs, 4)


def _luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def test_personal_data(spark, docs, empty, rows):
    from fraudframe.llm import pii

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and _luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15)]

    def base(t):
        found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, ok) in enumerate(kinds)
                 for m in re.finditer(p, t) if ok(m[0], re.sub(r"\D", "", m[0]))]
        return [x[2] for x in sorted(found)]

    odd = ["a@b.co, x@y.z.w_d@e.ff +1 (564) 555-4526 10.0.0.256 10.2.3.4.5 000010.1.1.1 4111 1111 1111 1111é4111-1111-1111-1111",
           "a@b" + ".c" * 20_000, "1" * 100_000, "+1" + " " * 50_000, "1.2.3.4 " * 500, "é@é a@@b.c 1-2-3", "account DE89 3704 0044 0532 0130 00."]
    more = spark.createDataFrame([(8000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    text = collections.defaultdict(list)
    for i, t in [*((i, t) for i, t, _ in rows), *((8000 + i, t) for i, t in enumerate(odd))]:
        text[i].append(t or "")
    out = pii.report(docs.select("doc_id", "text").unionByName(more)).collect()
    for r in out:
        got = [x for x in r.spans.split(",") if x and not x.startswith("iban")]
        assert got == base(text[r.doc_id][0]), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in got) for k, _, _ in kinds]
    assert {r.doc_id: r.spans for r in out}[8006] == "iban:8:35"
    masked = {r.doc_id: r.text for r in pii.mask(more).collect()}
    assert masked[8006] == "account [IBAN]." and masked[8004] == "[IP] " * 500 and masked[8002] == odd[2]
    assert pii.report(empty).count() == 0 and pii.mask(docs).columns == docs.columns


def test_lm_scores(docs, empty, rows):
    from fraudframe.llm import maxent

    tokens = [(i, words(t) + ["\n"]) for i, t, _ in rows]
    learnt = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in learnt for w in t)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    out = maxent.log_probabilities(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.log_probabilities(empty).count() == 0


def _near(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (c := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, rows, k):
    from fraudframe.llm import neardup

    base = [f"w{i % 97}x{i * i % 89}" for i in range(160)]
    copies = [(20_000 + c, " ".join(f"new{c}z{i}" if (i * 7 + c * 13) % 160 < c % 20 else w for i, w in enumerate(base)), None) for c in range(320)]
    made = rows + copies
    sets, root = _near(made, k, 80)
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    out = neardup.near_duplicates(df, k=k).collect()
    assert len(out) == len(made) and neardup.near_duplicates(empty).count() == 0
    for r in out:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == root.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)


def test_token_counts(docs, empty, rows):
    import public_tokenizers

    from fraudframe.llm import packing, tokencount

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocab, memo = set(json.load(f)["model"]["vocab"]), {}
    longest = max(map(len, vocab))

    def greedy(w):
        """The vocabulary's own strings: only one with the mark ends a word, only others stand before."""
        if w not in memo:
            s = w.decode("latin-1").translate(packing._ALPHABET)
            i = n = 0
            while i < len(s):
                j = min(len(s), i + longest)
                while s[i:j] + "</w>" * (j == len(s)) not in vocab and j > i + 1:
                    j -= 1
                i, n = j, n + 1
            memo[w] = n
        return memo[w]

    assert greedy(b"laughingly") > greedy(b"laughing") == 1
    want = collections.Counter((i, len(words(t)), sum(greedy(w.encode()) for w in words(t))) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()) == want
    assert tokencount.count_tokens(empty, path).count() == 0


def test_decontamination(spark, docs, empty, rows):
    from fraudframe.llm import decontam

    items = duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    items += [(501, "If the train leaves at 10 km from Paris and then 10 more km after 25 min what remains"), (502, None), (503, "Too short"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    asked = [(9101, "So: if the train leaves at 77 km from Berlin and then 77 more km after 3 min what remains"),
             (9102, "So: if the train leaves at 77 km from Berlin and then 78 more km after 3 min what remains"),
             (9103, "the train stayed where it was and nothing at all remained of what it had been")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(asked, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    exact = {(i, k) for i, t, _ in rows if i is not None for k, x in items if x and len(norm(x).split()) >= 5 and norm(x) in norm(t or "")}
    assert exact and exact <= set(got)
    assert not got[9101, 501].verbatim and (9102, 501) not in got and (9103, 501) not in got
    blocks = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_bytes=2000).collect()}
    assert blocks == set(got)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and not {r.doc_id for r in clean.collect()} & {i for i, _ in exact}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_packing(docs, empty, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from fraudframe.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path, group_tokens=20_000).collect()
    held, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        held[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        copies = sum(1 for j, _, _ in rows if j == i)
        pieces = sorted(held[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(want) and all(r.doc_tokens == len(want) for r in pieces)
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start:r.start + r.length]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two
    assert packing.pieces(empty, path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            left = {r.doc_id for r in out.select("doc_id").collect()}
            assert left <= ids and len(left) >= 0.75 * len(ids)
            docs, ids = out, left
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids
    twice = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    kept = corpus_pipeline.near_duplicates(spark, twice.unionByName(twice), SF)
    assert kept.count() == kept.select("doc_id").distinct().count()


def test_tile_links_by_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from fraudframe.llm import neardup

    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(400, size=int(rng.integers(150, 390)), replace=False)).astype(np.uint64) for _ in range(30)]
    sets += [np.delete(x, [3, 50]) for x in sets[:10]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 40), pa.array([2] * 40), pa.array([3] * 40), pa.array(range(40)), pa.array(range(40)), pa.array([x.tobytes() for x in sets])],
        ["tile_a", "tile_b", "tile_c", "rep", "root", "shingles"])

    def joined():
        parent = list(range(40))
        for batch in neardup._tile_links(80)([rows]):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if p == y else p for p in parent]
        return parent

    whole = joined()
    alike = [(a, b) for a in range(40) for b in range(a) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    assert all(whole[a] == whole[b] for a, b in alike) and all(whole[i] == whole[30 + i] for i in range(10)) and len(set(whole)) > 1
    monkeypatch.setattr(neardup, "COLUMNS", 37)
    assert joined() == whole


def test_lm_training_rounds(spark, monkeypatch):
    """The word before decides the next one, so a fitted model is far above the counts; every round reads every block."""
    from fraudframe.llm import maxent

    made = [(i, " ".join(f"w{(i + j * (1 + i % 2)) % 40}" for j in range(120))) for i in range(400)]
    monkeypatch.setattr(maxent, "BLOCK_TOKENS", 6_000)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    held = [r for r in maxent.log_probabilities(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_decontamination_without_windows(spark):
    from fraudframe.llm import decontam

    items = [(1, "What is 12 + 34 - 5 * 6 / 7"), (2, "Name the capital"), (3, "水的沸点是多少度"), (None, "A null id is still an item of the benchmark"),
             (4, "Which river flows through the town"), (5, "Sum 1 2 3 4 5 6 7 8 9 10")]
    texts = ["They asked: what is 12 + 34 - 5 * 6 / 7?", "Please name the capital now", "请问水的沸点是多少度呢", "here a null id is still an item of the benchmark too",
             "he wondered Which river flows through the town and left", "so sum 1 2 3 4 5 6 7 8 9 10 up", "what is 12 + 34 - 5 * 6 / 8", "sum 1 2 3 4 5 6 7 8 9 11"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, None), (4, 4), (5, 5)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {6, 7}


def test_decontamination_conflicting_slots_and_case(spark):
    from fraudframe.llm import decontam

    item = ("A farmer in Kent sells 12 baskets of ripe apples on the first day of the long summer market and on the last evening of the "
            "same market gives away 12 more to the children of Dover who helped to carry the heavy wooden boxes home")
    pair = ("A baker mixes 3 bowls of brown flour with the water from the old stone well behind the house and later in the same week adds 5 "
            "spoons of the finest salt before the dough goes into the oven")
    bench = spark.createDataFrame([(1, item), (2, pair)], "item_id long, text string")
    texts = [item.replace("away 12", "away 13"), pair.replace("3", "4").replace("5", "4"), item.lower(), item.upper(), "a farmer in kent sells apples"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(0, 1): False, (1, 2): False, (2, 1): True, (3, 1): True}
    few = spark.createDataFrame([(3, "when Anna met Boris in Paris with Clara from Delhi they walked along")], "item_id long, text string")
    lower = spark.createDataFrame([(7, "when anna met boris in paris with clara from delhi they walked along")], "doc_id long, text string")
    assert decontam.clean(lower, few).count() == 0


def test_iban_before_upper_case_words(spark):
    from fraudframe.llm import pii

    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "pay DE89370400440532013000 EUR 50", "NO93 8601 1117 947 AND GB29 NWBK 6016 1331 9268 19 NOW",
             "DE88 3704 0044 0532 0130 00 BIC", "MT84MALT011000012345MTLCAST001S 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.report(docs).collect()}
    assert spans == {0: ["iban:0:27"], 1: ["iban:4:26"], 2: ["iban:0:18", "iban:23:50"], 3: [], 4: ["iban:0:31"]}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[0] == "[IBAN] BIC COBADEFFXXX" and masked[1] == "pay [IBAN] EUR 50" and masked[2] == "[IBAN] AND [IBAN] NOW"


def test_lm_softmax_against_dense_formulas():
    """Log-probabilities sum to one over all buckets; a step equals the dense gradient's, on touched rows alone."""
    from fraudframe.llm import maxent

    rng = np.random.default_rng(5)
    rows, n = 8, 300
    w = rng.normal(size=(1 + maxent.CLASSES, 3 * rows + 1, maxent.MEMBERS)).astype(np.float32)
    f = rng.integers(0, rows - 1, (3, n)).astype(np.uint16)  # the last row of each kind is never touched
    model = maxent.Model(w.copy())
    each = [model.score(f, np.full(n, b, np.uint8)) for b in range(maxent.BUCKETS)]
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4)
    wide = maxent.Softmax(w[0] * 60)  # logits too wide for one shift
    assert np.isfinite(wide.logs(f, np.zeros(n, np.int64))).all()
    outcome = rng.integers(0, 16, n)
    dense = w[0].astype(np.float64)
    hot = np.zeros((n, 3 * rows + 1))
    for k in range(3):
        hot[np.arange(n), f[k] + k * rows] = 1
    hot[:, -1] = 1
    logits = hot @ dense
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(n), outcome]).sum()
    p[np.arange(n), outcome] -= 1
    g = hot.T @ p
    g[-1] = 0  # the bias keeps the counts' logarithms
    got = maxent.Softmax(w[0].copy())
    assert abs(got.update(f, outcome) - loss) < 1e-3 * loss
    assert np.allclose(got.w, dense - maxent.RATE * g / np.sqrt(g * g + maxent.SMOOTH), atol=1e-4)
    assert (got.w[[rows - 1, 2 * rows - 1, 3 * rows - 1]] == w[0][[rows - 1, 2 * rows - 1, 3 * rows - 1]]).all()
    assert maxent.feature_rows(0) == maxent.MIN_ROWS and maxent.feature_rows(64_000_000) == 4096


def test_mask_and_near_duplicates_keep_other_columns(spark):
    import corpus_pipeline
    from fraudframe.llm import pii

    text = "write to ann@example.org now about the seven things that we talked of on the long way home"
    rows = [(1, text, "x", [1], "y", {"k": 1}, "z"), (1, text, "x", [1], "y", {"k": 1}, "z"), (2, text, "u", None, None, None, None), (None, None, "v", [2], "w", {}, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, _m array<int>, _b string, m map<string,int>, `a.b` string")
    got = {(r["doc_id"], r["_t"], str(r["_m"]), r["_b"], r["a.b"]): r["text"] for r in pii.mask(docs).collect()}
    assert set(got) == {(r[0], r[2], str(r[3]), r[4], r[6]) for r in rows}
    assert got[(1, "x", "[1]", "y", "z")] == text.replace("ann@example.org", "[EMAIL]") and got[(None, "v", "[2]", "w", "q")] is None
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["_t"], r["m"], r["a.b"]) for r in kept.collect()) == [("1", "x", {"k": 1}, "z"), ("None", "v", {}, "q")]
