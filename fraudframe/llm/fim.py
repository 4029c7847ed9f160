"""Fill-in-the-middle: whole texts cut at unit borders and rearranged behind marks.

A unit is a run of ASCII letters or any other single character.  One ``fullmatch`` of
``(unit)*`` by the regex library keeps every repetition of its group, so the ends of
group 1 give the number of units and, by index, both cut offsets; nothing is searched
a second time.  The repeats are possessive: no backtracking state is kept, and a text
costs linear time and an end offset for each of its units.

Four numbers drawn from the SHA-256 of ``seed:doc_id`` choose the two cuts (each among
n + 1 borders), whether the text stays plain and in which order the parts come.
``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``.
A text that is empty or already holds a mark stays plain, so every mark in a
rearranged output is one of the three and ``restored`` is exact.

Rows: a null text counts as empty (plain, n = 0); a null id draws from ``seed:`` alone;
repeated rows come out alike, ties of the two cuts give an empty middle; an empty table
gives an empty table.  Other columns of the input are not read, whatever their names.
Texts are handled a megabyte at a time (one longer text alone).
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import text_slices

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Texts in percent that stay plain, and rearranged texts in percent whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
PART_BYTES = 1 << 20

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the hex digits of SHA-256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def rearrange(text: str, ends: list[int], h: tuple[int, int, int, int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST):
    """(form, prefix_chars, middle_chars, output) of a text whose units end at ``ends``."""
    if not text or h[2] % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", None, None, text
    borders = len(ends) + 1
    low, high = sorted((h[0] % borders, h[1] % borders))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if h[3] % 100 < suffix_first:
        return "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, unit: str = UNIT, plain: int = PLAIN,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points; null if plain), output.

    ``unit`` must match at every position; a match, once taken, is kept."""
    key = F.col(f"`{doc_id}`").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       *[h.alias(f"h{k}") for k, h in enumerate(draws(key, seed), 1)])

    def run(batches):
        import regex

        units = regex.compile(f"({unit})*+")
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch.column("text"), PART_BYTES):
                part = batch.slice(lo, hi - lo)
                draw = list(zip(*[part.column(f"h{k}").to_pylist() for k in range(1, 5)]))
                found = []
                for value, h in zip(part.column("text").to_pylist(), draw):
                    value = value or ""
                    ends = units.fullmatch(value).ends(1)
                    found.append((len(ends), *rearrange(value, ends, h, plain, suffix_first)))
                columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], SCHEMA.names)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` turned into ``output``."""
    def before(mark: str) -> Column:
        return F.substring_index(output, mark, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(before(SUFFIX), PREFIX, -1), middle, F.substring_index(before(MIDDLE), SUFFIX, -1))
    spm = F.concat(F.substring_index(before(MIDDLE), PREFIX, -1), middle, F.substring_index(before(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The operator's rows with digests in place of the texts."""
    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                                  sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
