"""The queries of this package over the documents table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattis.llm import op1_lm, op2_cotrain, op3_rules, op4_license, op5_audio, op6_suffix, op7_secrets, op8_mix, op9_pack, op10_jaccard
from lattis.llm.work import documents


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lm.score(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op2_cotrain.score(docs, op2_cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = op3_rules.ledger(documents(spark, sf_dir))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~op3_rules.passes("base")).alias("base_failed"), op3_rules.passes("v1").alias("kept"), "failed")


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, from the ledger's bits alone."""
    return op3_rules.ablation(op3_rules.ledger(documents(spark, sf_dir)), "v1")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license.scan(documents(spark, sf_dir)).drop("spans")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_audio.analyse(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_suffix.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secrets.scan(documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mix.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pack.pack(documents(spark, sf_dir))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.join(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_quality_classifier, op3_quality_rules, op4_license_scan, op5_audio_features, op6_suffix_dedup, op7_secret_scan, op8_source_mix, op9_best_fit_pack, op10_ngram_jaccard, rules_ablation)}


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '!')) AS n_exclaims
  FROM d LEFT JOIN covered ON covered.rid = d.rid),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 3 * n_exclaims > n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


def _ablation_sql() -> str:
    rules = ", ".join(f"('{name}', {1 << bit})" for name, (bit, _) in op3_rules.RULES.items())
    return f"""
WITH led AS ({OP3_SQL}), r(rule, bit) AS (VALUES {rules})
SELECT rule, CAST(coalesce(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fails, CAST(coalesce(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END), 0) AS BIGINT) AS fails_alone,
       CAST(coalesce(sum(CASE WHEN failed = 0 OR failed = bit THEN 1 ELSE 0 END), 0) AS BIGINT) AS kept_without
FROM r LEFT JOIN led ON true GROUP BY rule
"""


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


def _op4_sql() -> str:
    base = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in op4_license.BASE)
    notices = ", ".join(f"('{label}', string_split('{notice}', ' '), string_split('{key}', ' '), {len(notice[: notice.index(key)].split())})" for label, notice, key in op4_license.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
base(label, p) AS (VALUES {base}),
notice(label, n, p, off) AS (VALUES {notices}),
heads AS (SELECT DISTINCT p[1] AS head FROM base UNION SELECT DISTINCT p[1] FROM notice),
spot AS (
  SELECT rid, w, i, head FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d) JOIN heads ON head = w[i]),
places AS (SELECT rid, i - 1 AS i, label FROM spot JOIN base ON p[1] = head AND list_slice(w, i, i + len(p) - 1) = p),
hits AS (SELECT rid, w, i - off AS f, label, n FROM spot JOIN notice ON p[1] = head AND list_slice(w, i, i + len(p) - 1) = p),
scored AS (
  SELECT rid, label, CAST(len(list_filter(generate_series(1, len(n)), lambda k: f + k - 1 >= 1 AND w[f + k - 1] = n[k])) AS DOUBLE) / len(n) AS score
  FROM hits),
good AS (SELECT rid, label, score FROM scored WHERE score >= 0.6),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM places GROUP BY rid),
l AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT rid, label FROM places UNION SELECT rid, label FROM good) GROUP BY rid),
s AS (SELECT rid, max(score) AS score FROM (SELECT rid, 0.5 AS score FROM places UNION ALL SELECT rid, score FROM good) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
keyed AS (SELECT doc_id, w, array_to_string(w, ' ') AS k FROM d),
reps AS (SELECT k, min(doc_id) AS id, count(*) AS n_copies, any_value(w) AS w FROM keyed WHERE len(w) > 0 GROUP BY k),
shingles AS (
  SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN k ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
  FROM (SELECT id, k, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM reps)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, r) AS (SELECT id, id FROM reps UNION SELECT reached.id, edges.b FROM reached JOIN edges ON reached.r = edges.a),
classes AS (SELECT id, min(r) AS class_id FROM reached GROUP BY id),
degrees AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT doc_id, coalesce(class_id, CASE WHEN len(keyed.w) = 0 THEN doc_id END) AS class_id, CAST(coalesce(degrees.n, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM keyed LEFT JOIN reps ON reps.k = keyed.k AND len(keyed.w) > 0 LEFT JOIN classes ON classes.id = reps.id LEFT JOIN degrees ON degrees.id = reps.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "rules_ablation": _ablation_sql(), "op4_license_scan": _op4_sql(), "op10_ngram_jaccard": OP10_SQL}
