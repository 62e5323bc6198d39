"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import crosstoken, decontaminate, fillmiddle, langid, linededup, quality, secrets, sentencepiece_bridge, substring, toxicity, urlfilter
from .common import table
from .fingerprint import edit_likeness
from .simhash import near_duplicates


def op1_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_urlfilter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_secrets(spark, sf_dir):
    words = secrets.dictionary(secrets.default_vocabulary())
    rows = secrets.scan(table(spark, sf_dir, "documents"), secrets.labelled_findings(spark), words)
    return rows.select("doc_id", "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "secret")


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring(spark, sf_dir):
    rows = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_linededup(spark, sf_dir):
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_sentencepiece(spark, sf_dir):
    model = sentencepiece_bridge.model_bytes(spark, sentencepiece_bridge.default_model())
    rows = sentencepiece_bridge.encode(table(spark, sf_dir, "documents"), model)
    ids = F.array_join("ids", " ")
    return rows.select("doc_id", "n_ids", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), "round_trip", "parity")


def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op9_langid(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark, sf_dir):
    return edit_likeness(table(spark, sf_dir, "documents"))


def op11_crosstoken(spark, sf_dir):
    rows = crosstoken.align(table(spark, sf_dir, "documents"), crosstoken.default_tokenizers(), groups="groups_sha256")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_fillmiddle(spark, sf_dir):
    rows = fillmiddle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fillmiddle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    made = (op1_quality, op2_urlfilter, op3_secrets, op4_decontaminate, op5_substring, op6_linededup, op7_sentencepiece, op8_simhash, op9_langid, op10_fingerprint, op11_crosstoken, op12_fillmiddle, op13_toxicity, pipeline)
    return {f.__name__: f for f in made}


#: Units by a regular expression and list slices; the text rebuilt from the output alone.
FILL_MIDDLE = r"""
WITH a AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
    FROM documents
), b AS (
    SELECT *, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS two,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM a
), c AS (
    SELECT doc_id, text, n, form, array_to_string(t[1:least(one, two)], '') AS p, array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS m,
           array_to_string(t[greatest(one, two) + 1:n], '') AS s
    FROM b
), d AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c
), e AS (
    SELECT *, split_part(substr(output, 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END, 1) AS x FROM d
), f AS (
    SELECT *, split_part(substr(output, 7 + length(x)), '<M>', 1) AS y FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x || substr(output, 10 + length(x) + length(y)) || y ELSE y || substr(output, 10 + length(x) + length(y)) || x END) AS restored_sha256
FROM f
"""


def oracle_sql():
    return {"op12_fillmiddle": FILL_MIDDLE}
