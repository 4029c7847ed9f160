"""Personal data in whole texts: patterns propose, checksums confirm, context weighs.

Kinds: email, ip, card, phone (the base) and iban.  A pattern's matches are taken from
the left without overlap; matches that fail their validator (IP parts at most 255,
12 to 19 digits and Luhn for cards, 9 to 15 digits for phones, modulo 97 for IBANs)
are dropped and not searched again.  An IBAN is matched in its country's length, so
words and digits after it don't belong to it.  A span's score is its kind's prior, raised when
one of the kind's context words stands in the 48 characters before it.

Everything is built-in column functions.  ``split`` gives the text between matches and
``regexp_extract_all`` the matches; running sums of their lengths are the positions, in
code points.  The patterns match what their plain forms match, written with possessive
repeats and look-behind so that long runs cost linear time and no stack.  Null texts
count as empty; documents without spans have an empty list; repeated rows and null ids
are returned as they are.  ``mask`` replaces spans kind by kind, in the order of MASK.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an IBAN, and the countries that use so many.
IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|PT|ST", 26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}" for size, countries in IBANS.items())
#: Pattern, cheap necessary condition, prior in percent, context words.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90,
              "mail|contact|write|reach"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 60, "ip|server|host|address|login"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None, 75, "card|visa|credit|payment|paid"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 60, "phone|tel|call|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9_])(?:{_IBAN})(?![A-Za-z0-9_])", None, 95,
             "iban|account|bank|transfer"),
}
BASE, MASK = ("email", "ip", "card", "phone"), ("email", "iban", "card", "phone", "ip")
CONTEXT, BONUS = 48, 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(total, i):
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.length(d).between(12, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def _octets(m: Column) -> Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, "[.]"), small)


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(r, c):
        v = F.ascii(c)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.length(s).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return _mod97(m) if kind == "iban" else F.lit(True)


def _found(kind: str, text: Column) -> Column:
    pattern, needs, _, _ = KINDS[kind]
    none = F.array().cast("array<string>")
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "card":
        return F.when(text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), got).otherwise(none)
    if kind == "iban":
        return F.when(text.rlike("[A-Z]{2}[0-9]{2}"), got).otherwise(none)
    return F.when(text.contains(needs), got).otherwise(none)


def _between(kind: str, text: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(text, KINDS[kind][0], -1)).otherwise(F.array().cast("array<string>"))


def _spans(kind: str, found: Column, between: Column) -> Column:
    """Confirmed spans as structs (start, rank, kind, end, score)."""
    _, _, prior, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    both = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.greatest(F.size(found), F.lit(0))).alias("b"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def walk(acc, x):
        start = acc["at"] + F.length(x["b"])
        return F.struct((start + F.length(x["m"])).cast("long").alias("at"),
                        F.concat(acc["starts"], F.array(start.cast("long"))).alias("starts"))

    starts = F.aggregate(both, empty, walk, lambda acc: acc["starts"])
    rows = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.greatest(F.size(found), F.lit(0))).alias("b"), starts.alias("s"))
    near = rf"(?i)\b({words})"
    return F.when(F.size(found) > 0, F.transform(
        F.filter(rows, lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                           (x["s"] + F.length(x["m"])).cast("long").alias("end"),
                           (F.lit(prior) + F.when(F.right(x["b"], F.lit(CONTEXT)).rlike(near), F.lit(min(BONUS, 100 - prior))).otherwise(F.lit(0))).alias("score"))
    )).otherwise(F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:int>>"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans: an array of (start, rank, kind, end, score), by start and kind."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = df.select("*", *[_found(k, F.col("text")).alias(f"m_{k}") for k in KINDS])
    df = df.select("doc_id", *[f"m_{k}" for k in KINDS], *[_between(k, F.col("text"), F.col(f"m_{k}")).alias(f"b_{k}") for k in KINDS])
    return df.select("doc_id", F.array_sort(F.concat(*[_spans(k, F.col(f"m_{k}"), F.col(f"b_{k}")) for k in KINDS])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts, the base spans' digest, all spans and their scores in percent."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def _replaced(kind: str):
    return lambda x: F.concat(x["b"], F.when(_valid(kind, x["m"]), f"[{kind.upper()}]").otherwise(x["m"]))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every confirmed span of the text replaced by its kind in brackets."""
    cols = docs.columns
    free = "_mask"
    while any(c.lower().startswith(free) for c in cols):
        free += "_"
    t, m, b = f"{free}t", f"{free}m", f"{free}b"
    df = docs.withColumn(t, F.col(f"`{text}`").cast("string"))
    for kind in MASK:
        df = df.withColumn(m, F.coalesce(_found(kind, F.col(t)), F.array().cast("array<string>")))
        df = df.withColumn(b, _between(kind, F.col(t), F.col(m)))
        pieces = F.transform(F.arrays_zip(F.slice(b, F.lit(1), F.size(m)).alias("b"), F.col(m).alias("m")), _replaced(kind))
        df = df.withColumn(t, F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), F.element_at(b, -1))).otherwise(F.col(t)))
    return df.select(*[F.col(t).alias(text) if c == text else F.col(f"`{c}`") for c in cols])
