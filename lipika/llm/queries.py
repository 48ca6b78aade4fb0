"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm import langid, lexicon, merkle, packing, pll, rangecoder, rules, simhash, spans, warc
from lipika.session import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents under the policy ``full-2``."""
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "full-2")
    base = ~rules.passes("base-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "policy"
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) AS n_lower,
         length(t) - length(translate(t, '!', '')) AS n_marks
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_upper > 2 * n_lower AND n_upper >= 50 THEN 32 ELSE 0 END
    + CASE WHEN 4 * n_marks > n_words AND n_marks >= 10 THEN 64 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       failed = 0 AS kept, CAST(failed AS BIGINT) AS failed, 'full-2' AS policy
FROM b
"""



def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of all documents, linked at two or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, tau=2)
    word = F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0"))
    return found.select("doc_id", word.alias("fingerprint"), "component_id")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents by a network trained on all of them."""
    return pll.score_corpus(table(spark, sf_dir, "documents"))


def op3_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lexicon.encode(docs, path, lexicon.build(docs, path))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in order and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = rangecoder.read_tokens(rangecoder.write_tokens(table(spark, sf_dir, "documents"), path))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = langid.held_out(F.col("doc_id"))
    found, name = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.filter(~held)))
    x = F.col(name)
    return found.select("doc_id", held.alias("held_out"), x["language"].alias("lang_pred"), x["score"].alias("score"), x["bits"].alias("bits"), x["rejected"].alias("rejected"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, normalised, and read back by their indexes."""
    rows = warc.read(warc.archive_pages(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, 1024, with_ids=False).drop("ids")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans.remove_repeats(docs)
    return found.select("doc_id", "text", F.size("removed").alias("n_removed_spans"), F.col("removed").cast("string").alias("removed"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents, of their edited texts and of their neighbours."""
    found = merkle.edits(table(spark, sf_dir, "documents"))
    first = F.get("changed", F.lit(0))
    shown = F.when(F.size("changed") > 0, F.format_string("%06d.%06d", first["section"], first["paragraph"]))
    return found.select(*(c for c in found.columns if c != "changed"), F.size("changed").cast("long").alias("n_changed"), shown.alias("first_changed"))


_LEAF = r"'[^.!?]{1,160}[.!?]*|[.!?]+'"
_PARAGRAPHS = "string_split(s, chr(10))"
_P_HASH = f"md5(array_to_string(list_transform(regexp_extract_all(p, {_LEAF}), lambda x: md5(x)), ','))"


def _sections(text: str, body: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s, i: {body})"


def _merkle_sql(text: str) -> str:
    full = f"md5(array_to_string(list_transform({_PARAGRAPHS}, lambda p: {_P_HASH}), ';'))"
    leaves = f"array_to_string(list_transform(regexp_extract_all(p, {_LEAF}), lambda x: substr(md5(x), 1, 8)), ',')"
    shown = f"substr({full}, 1, 16) || ':' || array_to_string(list_transform({_PARAGRAPHS}, lambda p: substr({_P_HASH}, 1, 16) || '=' || {leaves}), ';')"
    return f"md5(array_to_string({_sections(text, full)}, '/')) || '|' || array_to_string({_sections(text, shown)}, '/')"


def _branches_sql(text: str) -> str:
    """Place and hash of each paragraph."""
    each = f"list_transform({_PARAGRAPHS}, lambda p, j: format('{{:06d}}.{{:06d}}=', i - 1, j - 1) || substr({_P_HASH}, 1, 16))"
    return f"flatten({_sections(text, each)})"


def _likeness_sql(a: str, b: str) -> str:
    leaves = lambda f: f"list_distinct(regexp_extract_all({f}, '[=,]([0-9a-f]{{8}})', 1))"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 ELSE coalesce(2.0 * len(list_intersect({leaves(a)}, {leaves(b)}))"
        f" / nullif(len({leaves(a)}) + len({leaves(b)}), 0), 0.0) END::DOUBLE"
    )


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 3) || left(nt, length(t) // 3) AS et FROM n),
f AS (SELECT *, {_merkle_sql("t")} AS fp, {_merkle_sql("et")} AS ef, {_merkle_sql("nt")} AS nf, {_branches_sql("t")} AS tb, {_branches_sql("et")} AS eb FROM e),
c AS (SELECT *, list_distinct(list_transform(list_filter(tb, lambda x: NOT list_contains(eb, x)) || list_filter(eb, lambda x: NOT list_contains(tb, x)), lambda x: split_part(x, '=', 1))) AS ch FROM f)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, fp AS fingerprint, ef AS edited_fingerprint,
       {_likeness_sql("fp", "ef")} AS near_edited, {_likeness_sql("fp", "nf")} AS near_next,
       CAST(len(ch) AS BIGINT) AS n_changed, list_min(ch) AS first_changed
FROM c
"""

def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy ``full-2`` rejects, alone and with others: bitwise sums over the written ledger."""
    ledger = written(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return rules.ablation(ledger, "full-2")


ABLATION_SQL = f"""
WITH l AS ({OP7_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << k})" for k, r in enumerate(rules.RULES))})
SELECT rule, CAST(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_failed_alone,
       CAST(sum(CASE WHEN failed & ~bit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without
FROM l, r GROUP BY rule
"""

QUERIES = {
    "rule_ablation": rule_ablation,
    "op1_simhash": op1_simhash,
    "op2_lm_score": op2_lm_score,
    "op3_lexicon_bpe": op3_lexicon_bpe,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_merkle": op10_merkle,
}
ORACLES = {"rule_ablation": ABLATION_SQL, "op7_quality_rules": OP7_SQL, "op10_merkle": OP10_SQL}
