"""Secrets in whole texts: key assignments, access keys, long hex, and strings that look random.

Base kinds are patterns, matched from the left without overlap and then filtered:
``assign`` (a key word, ``:`` or ``=`` and a value of 6 characters or more), ``access``
(AKIA and 16 or more capitals or digits), ``hex`` (24 or more lower-case hex digits).

The kind ``entropy`` is added: a candidate is a whole run of 20 or more characters of
``A-Z a-z 0-9 + / _ -``, with up to two ``=`` behind.  A window of 20 characters slides
over it.  A step changes the counts of two characters only, the one that leaves and the
one that enters, and so updates the sum of c * log2(c) over the window's counts by two
differences; Shannon entropy is log2(20) less that sum over 20.  A candidate is a secret
if its most random window reaches the limit of its character class, the class's other
conditions hold and no pattern of the allow-list matches it.  Sums are whole numbers of
2^-20 bits, so equal windows compare equal everywhere.  Base spans are never suppressed.

Everything is built-in column functions; nothing is shuffled.  Null texts count as
empty; a document without spans has an empty list; repeated rows and null ids come back
as they are; kinds that start at one place are ordered as listed; long candidates are
walked whole; an empty table gives an empty table.  Only the two named columns are read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds' patterns.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "entropy": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE, WINDOW, UNIT = 6, 20, 1 << 20
#: A candidate's class is the first whose pattern matches it; bits a window needs; what else it must hold.
CLASSES = {
    "hex": (r"^[0-9a-f]+=*$", 2.8, (r"[0-9].*[0-9]", r"[a-f].*[a-f]")),
    "capital": (r"^[A-Z0-9]+=*$", 3.3, (r"[0-9].*[0-9]", r"[A-Z].*[A-Z]")),
    "small": (r"^[a-z0-9]+=*$", 3.3, (r"[0-9].*[0-9].*[0-9]", r"[a-z].*[a-z]")),
    "mixed": (r"", 3.7, (r"[0-9].*[0-9]", r"[A-Z]", r"[a-z]")),
}
#: Candidates that are no secrets (UUIDs, names of samples, alphabets, paths of words, dated names, letters only).
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(example|sample|placeholder|dummy|changeme|xxxxx|00000|your[_-])",
    r"(?i)(abcdef|ghijkl|qwerty|12345|98765)",
    r"^/?+(?:[a-z]++[0-9]?+|[A-Z][a-z]++|[0-9]{1,4}+)(?:[/_-](?:[a-z]++[0-9]?+|[A-Z][a-z]++|[0-9]{1,4}+))++/?+$",
    r"^[A-Za-z_/+-]+=*$",
)


def _cost(c: int) -> int:
    """c * log2(c) in units of 2^-20 bits."""
    return round(c * math.log2(c) * UNIT) if c > 1 else 0


def most_sum(bits: float) -> int:
    """The largest sum of c * log2(c) with which a window still has so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _least_sum(candidate: Column) -> Column:
    """The smallest sum of c * log2(c) over the candidate's windows."""
    step = F.array(*[F.lit(_cost(c + 1) - _cost(c)).cast("long") for c in range(WINDOW)])
    far = F.lit(1 << 60).cast("long")

    def count(window: Column, ch: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, ch, F.lit("")))

    def slide(acc: Column, ch: Column) -> Column:
        full = F.length(acc["window"]) == WINDOW
        gone = F.substring(acc["window"], 1, 1)
        rest = F.when(full, F.substring(acc["window"], 2, WINDOW)).otherwise(acc["window"])
        total = acc["total"] - F.when(full, F.get(step, count(rest, gone))).otherwise(F.lit(0).cast("long")) + F.get(step, count(rest, ch))
        return F.struct(F.concat(rest, ch).alias("window"), total.alias("total"),
                        F.when(F.length(rest) == WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    start = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("total"), far.alias("least"))
    chars = F.filter(F.split(F.regexp_replace(candidate, "=+$", ""), ""), lambda c: c != "")
    return F.aggregate(chars, start, slide, lambda acc: acc["least"])


def entropy_limit(candidate: Column) -> Column:
    """The largest sum of the candidate's class, null if one of its other conditions fails."""
    out = None
    for pattern, bits, needs in CLASSES.values():
        holds = F.lit(True)
        for need in needs:
            holds = holds & candidate.rlike(need)
        is_class, limit = candidate.rlike(pattern) if pattern else F.lit(True), F.when(holds, F.lit(most_sum(bits)).cast("long"))
        out = F.when(is_class, limit) if out is None else out.when(is_class, limit)
    return out


def _suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    limit = entropy_limit(candidate)
    return F.when(allowed | limit.isNull(), F.lit(False)).otherwise(_least_sum(candidate) <= limit)


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= LEAST_VALUE
    return _suspicious(match) if kind == "entropy" else F.lit(True)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The kept matches of a kind as structs (start, rank, kind, end), code points."""
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), F.greatest(F.size(matches), F.lit(0))).alias("b"))

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        return F.struct((start + F.length(x["m"])).cast("long").alias("at"), F.concat(acc["starts"], F.array(start.cast("long"))).alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(pairs, zero, walk, lambda acc: acc["starts"])
    found = F.filter(F.arrays_zip(matches.alias("m"), starts.alias("s")), lambda x: _kept(kind, x["m"]))
    rank = list(PATTERNS).index(kind)
    return F.when(F.size(matches) > 0, F.transform(found, lambda x: F.struct(
        x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).cast("long").alias("end")))).otherwise(none)


def _scan(docs: DataFrame, text: str, row: Column) -> DataFrame:
    """row, text (null as empty) and spans."""
    df = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    df = df.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    return df.select("row", "text", F.array_sort(F.concat(*[_spans(k, F.col("text"), F.col(f"m_{k}")) for k in PATTERNS])).alias("spans"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans: an array of (start, rank, kind, end), by start and kind."""
    return _scan(docs, text, F.col(f"`{doc_id}`")).select(F.col("row").alias("doc_id"), "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts of every kind, the base spans' digest and all spans."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every stretch of text that spans cover replaced by ``mark``; a null text stays null."""
    found = _scan(docs, text, F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]))
    value = F.col("text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(s["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(value, (acc["at"] + 1).cast("int"), F.length(value))))
    return found.withColumn("masked", F.when(F.size("spans") > 0, masked)).select(
        *[(F.coalesce(F.col("masked"), F.col(f"row.c{k}").cast("string")) if c == text else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
