"""Queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, exact_dedup, filter_audit, language_id, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, suffix_dedup, token_alignment, url_reputation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.col("sha").alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(number(k) for k in ("email", "ip", "card", "phone")), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_model.is_held_out(F.col("doc_id"))
    model = quality_model.train(docs, labels.where(~held_out))
    found = quality_model.score_quality(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_language_id, op4_ngram_join, op5_decontamination, op6_line_dedup, op7_packing, op8_url_reputation, op9_pii, op10_quality_model, op11_token_alignment, op12_exact_dedup, op13_filter_audit)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_LOWER = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SUFFIXES = f"({', '.join(repr(x) for x in url_reputation.SUFFIXES)})"
_RATE = "((k + 0.5::DOUBLE) / (n + 1))"
_STRENGTH = f"CASE WHEN count(*) > 1 THEN least(greatest(avg({_RATE}) * (1 - avg({_RATE})) / greatest(var_pop({_RATE}) - avg({_RATE} * (1 - {_RATE}) / (n + 1)), 1e-6) - 1, 2.0), 200.0) ELSE 2.0 END"

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
grams AS (SELECT r, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS v(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT d.doc_id, d.text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR n_dup_lines * 100 > 30 * (length(text) - length(replace(text, chr(10), '')) + 1)
    OR (length(text) - length(replace(text, '!', ''))) * 5 > n_words
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))) AS kept FROM b
""",
    "op4_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_LOWER} AS w FROM documents),
x AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i+2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, doc_id, count(*) AS n FROM x GROUP BY 1, 2),
s AS (SELECT r, doc_id, n, sha256(string_agg(g, ' | ' ORDER BY g)) AS c FROM x JOIN n USING (r, doc_id) GROUP BY 1, 2, 3),
c AS (SELECT c, min(r) AS r, any_value(n) AS n FROM s WHERE doc_id IS NOT NULL GROUP BY c),
g AS (SELECT c.c, c.n, x.g FROM c JOIN x USING (r)),
m AS (SELECT a.c AS a, b.c AS b FROM g AS a JOIN g AS b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m UNION SELECT s.c, t.c FROM s JOIN s AS t ON s.doc_id = t.doc_id AND s.c <> t.c),
k AS (SELECT c AS a, c AS b FROM c UNION SELECT k.a, e.b FROM k JOIN e ON k.b = e.a),
l AS (SELECT k.a AS c, min(s.doc_id) AS component_id FROM k JOIN s ON s.c = k.b GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, CASE WHEN d.doc_id IS NULL OR s.n IS NULL THEN d.doc_id ELSE l.component_id END AS component_id
FROM d LEFT JOIN s USING (r) LEFT JOIN l ON l.c = s.c
""",
    "op5_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i+least(10, len(w))-1], ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
x AS (SELECT r, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM d, (SELECT DISTINCT k FROM q) AS z, unnest(range(1, len(w) - k + 2)) AS u(i)),
h AS (SELECT r, i, k, item FROM x JOIN q USING (k, g)),
n AS (SELECT r, count(DISTINCT i + j) AS n FROM h, unnest(range(0, k)) AS v(j) GROUP BY r),
o AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(o.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, i, l[i] AS line, translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
c AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN c USING (k) GROUP BY r
""",
    "op8_url_reputation": rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
x AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM p),
z AS (SELECT host, name, string_split(name, '.') AS l, regexp_matches(name, '^([0-9]+(\.[0-9]+){{3}}|\[.*)$') AS address FROM x),
y AS (SELECT host, CASE WHEN address THEN name WHEN array_to_string(l[-2:], '.') IN {_SUFFIXES} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
  CASE WHEN address THEN '#address' WHEN array_to_string(l[-2:], '.') IN {_SUFFIXES} THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM z),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(good) AS k FROM p JOIN g USING (page_id) JOIN y USING (host) WHERE good IS NOT NULL GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, {_STRENGTH} AS s FROM h GROUP BY 1, 2),
f AS (SELECT suffix, sum(n) AS n, sum(k) AS k, {_STRENGTH} AS s FROM d GROUP BY 1),
o AS (SELECT (coalesce(sum(k), 0) + 1::DOUBLE) / (coalesce(sum(n), 0) + 2) AS m, {_STRENGTH} AS s FROM f),
fm AS (SELECT suffix, f.s, (f.k + o.m * o.s) / (f.n + o.s) AS m FROM f, o),
dm AS (SELECT domain, d.s, (d.k + fm.m * fm.s) / (d.n + fm.s) AS m FROM d JOIN fm USING (suffix)),
e AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(dm.m, fm.m, o.m) AS m, coalesce(dm.s, fm.s, o.s) AS s
  FROM y LEFT JOIN (SELECT host, n, k FROM h) USING (host) LEFT JOIN dm USING (domain) LEFT JOIN fm USING (suffix), o),
q AS (SELECT host, n, s, (k + m * s) / (n + s) AS mean FROM e),
b AS (SELECT host FROM q WHERE mean + 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) < 0.5),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, coalesce(r.host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN b ON b.host = r.host
""",
    "op12_exact_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t),
k AS (SELECT t, min(r) AS r FROM (SELECT t, r, rank() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM d) WHERE place = 1 GROUP BY t)
SELECT doc_id, keep_id, group_size, d.r = k.r AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t) JOIN k USING (t)
""",
    "op13_filter_audit": rf"""
WITH RECURSIVE l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM d LEFT JOIN l USING (doc_id)),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(string_split('ABCDE', '')) AS u(x) WHERE instr(filter_order, x) = 0),
s AS (SELECT filter_order, step::INT AS step, instr('ABCDE', filter_order[step]) AS own, list_transform(string_split(filter_order[1:step-1], ''), lambda x: instr('ABCDE', x)) AS past
  FROM o, unnest(range(1, 6)) AS u(step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, own, f[own] AS fails, step > 1 AND list_bool_or(list_transform(list_filter(past, lambda i: i > 0), lambda i: f[i])) AS gone, list_count(list_filter(f, lambda v: v)) AS k, good, toxic FROM m, s),
r AS (SELECT part, filter_order, step, own, count(*) FILTER (WHERE NOT fails AND NOT gone) AS kept, count(*) FILTER (WHERE fails AND NOT gone) AS removed, count(*) FILTER (WHERE fails AND gone) AS redundant,
  count(*) FILTER (WHERE fails AND k = 1) AS unique_fails, count(*) FILTER (WHERE fails AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE fails AND NOT gone AND toxic) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
""",
}
