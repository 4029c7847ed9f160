"""The registered queries of this package and their DuckDB SQL."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from . import decontam, fim, langid, maxent, neardup, packing, pii, secrets, shards, tokencount, topk, toxicity, whitening


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_language_id(spark, sf_dir):
    return langid.predictions(_t(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.predictions(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op4_virtual_slots(spark, sf_dir):
    return shards.assign(_t(spark, sf_dir, "documents"))


def op5_personal_data(spark, sf_dir):
    return pii.report(_t(spark, sf_dir, "documents"))


def op6_lm_scoring(spark, sf_dir):
    return maxent.log_probabilities(_t(spark, sf_dir, "documents"))


def op7_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_t(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_t(spark, sf_dir, "documents"), _vocabulary())


def op9_decontamination(spark, sf_dir):
    return decontam.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op10_packing(spark, sf_dir):
    return packing.pieces(_t(spark, sf_dir, "documents"), _vocabulary())


def op11_fill_in_middle(spark, sf_dir):
    return fim.digests(_t(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.digests(_t(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark, sf_dir):
    return secrets.report(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_language_id, op3_toxicity, op4_virtual_slots, op5_personal_data, op6_lm_scoring, op7_near_duplicates, op8_token_counts,
                                      op9_decontamination, op10_packing, op11_fill_in_middle, op12_whitening, op13_secret_scan)}

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""

_FIM = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:n], '') AS suf FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


def _secret_sql() -> str:
    """The secret scan with every window of a candidate counted anew."""
    letters = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    patterns = {"assign": f"""(?:{letters})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]{16,}",
                "hex": "[0-9a-f]{24,}", "entropy": "[A-Za-z0-9+/_-]{20,}={0,2}"}
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS b FROM d WHERE regexp_matches(text, '{p}')"
        for i, (k, p) in enumerate(patterns.items()))
    costs = [round(c * math.log2(c) * secrets.UNIT) if c else 0 for c in range(secrets.WINDOW + 1)]
    limits = " ".join(
        f"WHEN regexp_matches(m, '{pattern}') THEN CASE WHEN " + " AND ".join(f"regexp_matches(m, '{need}')" for need in needs)
        + f" THEN {secrets.most_sum(bits)} END" for pattern, bits, needs in secrets.CLASSES.values())
    allowed = " OR ".join("regexp_matches(m, '" + p.replace("++", "+").replace("?+", "?").replace("}+", "}") + "')" for p in secrets.ALLOWED)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
x AS (
  SELECT rid, rank, kind, m[k] AS m,
         list_sum(list_transform(b[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda p: length(p))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f)),
c AS (
  SELECT *, CASE WHEN kind = 'entropy' AND NOT ({allowed}) THEN CASE {limits} END END AS most, rtrim(m, '=') AS s FROM x),
w AS (
  SELECT *, CASE WHEN most IS NOT NULL THEN list_min(list_transform(range(1, length(s) - 18), lambda i: list_sum(list_transform(
    list_distinct(string_split(s[i:i + 19], '')), lambda ch: {costs}[21 - length(replace(s[i:i + 19], ch, ''))])))) END AS least FROM c),
kept AS (
  SELECT rid, rank, kind, start, concat(kind, ':', start::BIGINT, ':', (start + length(m))::BIGINT) AS span FROM w
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{patterns["assign"]}', 1)) >= {secrets.LEAST_VALUE}
                  WHEN 'entropy' THEN coalesce(least <= most, false) ELSE true END),
g AS (
  SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)}, string_agg(span, ',' ORDER BY start, rank) AS spans,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base FROM kept GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in patterns)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLE = {"op1_exact_topk": _TOPK, "op11_fill_in_middle": _FIM, "op13_secret_scan": _secret_sql()}
