"""Language of a text by compression.

Each language has a raw-content zstandard dictionary: ``dict_bytes`` of normalised
text drawn from its labelled documents.  A text is normalised (lower case, runs of
anything but letters become one space), cut into blocks of ``block`` bytes so that
the dictionary counts as much at its end as at its beginning, and every block is
compressed with every dictionary.  The language with the fewest bytes in all wins;
the score is the share by which it beats the next, scaled so that ``full_margin``
gives 1; margins under SECOND_LOOK are taken from a finer coder.  ``accepted`` is false where that share is under ``min_margin``.

Training reads a bounded sample: for each language about ``samples`` documents with
the smallest hashes of their ids, from each one piece of ``piece`` characters at a
hashed place.  Null and empty texts and texts without a letter are ``und``, score 0,
not accepted; so is everything if nothing is labelled.  Ties go to the language that
sorts first.  Repeated rows are each predicted; a null doc_id is returned and not
learnt from.  Only the named columns are read.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES, PIECE, DICT_BYTES, BLOCK, LEVEL = 160, 700, 1 << 17, 4096, 3
MIN_MARGIN, FULL_MARGIN, UNKNOWN = 0.0005, 0.1, "und"
#: Margins under this are measured again by a slower coder that finds matches of three bytes.
SECOND_LOOK = 0.03
#: Languages whose dictionaries fit one broadcast; the most frequent are learnt.
MAX_LANGUAGES = 200

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def learnable(doc_id: str = "doc_id"):
    """Documents that may be learnt from: crc32 of the id's text modulo 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 samples: int = SAMPLES, piece: int = PIECE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """At most MAX_LANGUAGES * 1.5 * samples pieces reach the driver."""
    ok = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        learnable() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = ok.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 1.25 * samples / r["count"])).otherwise(share)
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - piece + 1, F.lit(1)))
    rows = ok.filter(place < share * (1 << 30)).select(
        "lang", place.alias("place"), "doc_id", F.substring("text", start.cast("int") + 1, F.lit(piece)).alias("part")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["doc_id"])):
        held = out.setdefault(r["lang"], b"")
        if len(held) < dict_bytes:
            out[r["lang"]] = held + normalise(r["part"]).encode("utf-8", "replace") + b" "
    return {k: v[:dict_bytes] for k, v in sorted(out.items()) if len(v) >= 8}


def _judged(rows: DataFrame, models: dict[str, bytes], text: str, block: int, min_margin: float, full_margin: float) -> DataFrame:
    """rows (one struct column, row) with lang_pred, score and accepted."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import zstandard as z

        names = list(shared.value)
        coders = []
        close = []
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        fine = z.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=z.STRATEGY_BTOPT, **plain)
        for name in names:
            d = z.ZstdCompressionDict(shared.value[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, **plain))
            d = z.ZstdCompressionDict(shared.value[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=fine)
            close.append(z.ZstdCompressor(compression_params=fine, dict_data=d))

        def judge(value):
            s = normalise(value) if value else ""
            if not any(map(str.isalpha, s)) or not names:
                return UNKNOWN, 0.0, False
            if len(names) == 1:
                return names[0], 1.0, True
            s = s.encode("utf-8", "replace")
            parts = [s[i:i + block] for i in range(0, len(s), block)]
            for tier in (coders, close):
                sizes = [sum(len(c.compress(p)) for p in parts) for c in tier]
                best = min(range(len(names)), key=lambda i: (sizes[i], names[i]))
                second = min(n for i, n in enumerate(sizes) if i != best)
                margin = (second - sizes[best]) / second
                if margin >= SECOND_LOOK:
                    break
            return names[best], min(1.0, margin / full_margin), margin >= min_margin

        for batch in batches:
            texts = batch.column(0).field(text)
            for lo in range(0, len(batch), 512):
                found = [judge(x) for x in texts.slice(lo, 512).to_pylist()]
                lang, score, ok = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 512), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                    ["row", "lang_pred", "score", "accepted"])

    fields = [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("accepted", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType(fields))


def identify(docs: DataFrame, models: dict[str, bytes], text: str = "text", doc_id: str = "doc_id", block: int = BLOCK,
             min_margin: float = MIN_MARGIN, full_margin: float = FULL_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    rows = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).alias("row"))
    return _judged(rows, models, "text", block, min_margin, full_margin).select("row.doc_id", "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, models: dict[str, bytes], text: str = "text", block: int = BLOCK, min_margin: float = MIN_MARGIN,
             full_margin: float = FULL_MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _judged(rows, models, text, block, min_margin, full_margin).filter("accepted").select("row.*")


def predictions(docs: DataFrame) -> DataFrame:
    out = identify(docs, dictionaries(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
