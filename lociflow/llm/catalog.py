"""Driver queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import divergence, exact_dedup, filter_audit, language_id, media_sequences, mixing, packing, secret_scan, simhash, spelling_variants, token_counts, url_filter, warc_bundles
from lociflow.llm.shared import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sequences.document_media(table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.page_archive(table(spark, sf_dir, "pages")).drop("bundle", "frame", "frame_offset")


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.document_quality(spread(table(spark, sf_dir, "documents")))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(table(spark, sf_dir, "documents"))


def op5_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.page_verdicts(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_classes(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.document_languages(spread(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.document_copies(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_media_sequences, op2_warc_bundles, op3_distribution_divergence, op4_pivotal_mixing, op5_url_bloom_filter, op6_token_counts, op7_secret_scan, op8_simhash_components, op9_harmonic_packing, op10_language_id, op11_spelling_variants, op12_exact_dedup, op13_filter_audit, pipeline)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
canon AS (
  SELECT *, regexp_replace(regexp_replace('&' || query, '&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS kept FROM parts),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM canon),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE regexp_matches(host, '(^|\.)(spam-farm|casino-win|free-bets|cheap-pills)\.') OR starts_with(md5(canonical), '00')),
rules(rule_host, rule_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT k.page_id, k.host, k.path, k.canonical, r.rule_host || r.rule_path AS rule, r.action
  FROM keyed k LEFT JOIN rules r ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)),
longest AS (SELECT * FROM fitting QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule) = 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM longest
"""

OP2_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM docs),
places AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS k FROM places),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
c AS (SELECT r, length(t) AS n, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS c0, length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS c1, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS c2,
  length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')) AS c3, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS c4, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS c5, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS cl FROM docs),
base AS (SELECT w.r, doc_id, lang, words, len(words) AS n_words, c.n - c1 AS word_chars, c4 AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [c0, c1, c2, c3, c4, c5, cl - c0 - c2, c.n - c1 - c3 - c4 - c5 - cl] AS counts, c.n AS chars, len(words) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(words) AS base_failed
  FROM w JOIN lines USING (r) JOIN c USING (r) LEFT JOIN covered USING (r)),
totals AS (SELECT lang, sum(n_words) AS n FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) > 0),
cells AS (SELECT r, lang, unnest(range(1, 9)) AS b, unnest(counts) AS x, chars FROM base),
class_ref AS (SELECT lang, b, sum(x) / sum(chars) AS q FROM cells JOIN totals USING (lang) GROUP BY lang, b),
class_js AS (SELECT r, d.lang, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM (SELECT r, b, x / nullif(chars, 0) AS p FROM cells) e JOIN class_ref d USING (b) GROUP BY r, d.lang),
class_d AS (SELECT r, sqrt(greatest(0, min(js))) AS class_distance FROM class_js GROUP BY r),
short AS (SELECT r, lang, lower(x) AS word, n_words FROM (SELECT r, lang, n_words, unnest(words) AS x FROM base) WHERE length(x) <= 6),
counted AS (SELECT lang, word, count(*) AS k FROM short JOIN totals USING (lang) GROUP BY lang, word),
vocabulary AS (SELECT DISTINCT word FROM counted JOIN totals USING (lang) WHERE k >= n * 0.0025),
word_ref AS (SELECT t.lang, v.word, coalesce(k, 0) / n AS q FROM totals t CROSS JOIN vocabulary v LEFT JOIN counted USING (lang, word)),
cover AS (SELECT lang, sum(q) AS c FROM word_ref GROUP BY lang),
have AS (SELECT r, word, count(*) / any_value(n_words) AS p FROM short JOIN vocabulary USING (word) GROUP BY r, word),
pairs AS (SELECT b.r, f.lang, coalesce(p, 0) AS p, q FROM (SELECT r FROM base WHERE n_words >= 50 AND NOT base_failed) b CROSS JOIN word_ref f LEFT JOIN have h ON h.r = b.r AND h.word = f.word),
bins AS (SELECT r, lang, p, q FROM pairs UNION ALL SELECT r, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM pairs GROUP BY r, lang),
word_js AS (SELECT r, lang, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM bins GROUP BY r, lang),
word_d AS (SELECT w.r, min(CASE WHEN c < 0.10 THEN 0 ELSE sqrt(greatest(0, w.js)) / sqrt(c / 2 + log2(2 / (2 - c)) / 2 + CASE WHEN c < 1 THEN (1 - c) * log2(2 * (1 - c) / (2 - c)) / 2 ELSE 0 END) END) AS word_distance
  FROM word_js w JOIN cover USING (lang) JOIN class_js k ON k.r = w.r AND k.lang = w.lang AND sqrt(greatest(0, k.js)) <= 0.30 GROUP BY w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < 50 OR (coalesce(class_distance, 0) <= 0.30 AND coalesce(word_distance, 0) <= 0.98)) AS kept
FROM base LEFT JOIN class_d USING (r) LEFT JOIN word_d USING (r)
"""

#: crc32 by its table, byte by byte; near words share a text with one code point left out, or with one replaced by a mark.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::UBIGINT AS i))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2),
coded AS (SELECT r, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))::UBIGINT[] AS bytes FROM runs),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM coded, crc_table),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN r[:(h % length(r))::BIGINT] || r[(h % length(r))::BIGINT + 2:] ELSE r END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM w)),
near AS (SELECT p.word, count(*) AS n_near, max(v.n) AS best_n FROM pairs p JOIN w v ON v.word = p.other GROUP BY p.word),
formed AS (SELECT p.word, min(p.other) AS form, any_value(best_n) AS form_n FROM near JOIN pairs p USING (word) JOIN w v ON v.word = p.other AND v.n = best_n JOIN w ON w.word = p.word AND best_n >= 5 * w.n GROUP BY p.word),
chain AS (SELECT word, form AS root, 1 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.root),
roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN near USING (word) LEFT JOIN formed USING (word) LEFT JOIN roots USING (word)
"""

OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS f FROM t LEFT JOIN told USING (doc_id)),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, o[s] AS x, o[:s - 1] AS before FROM orders, range(1, 6) r(s)),
judged AS (SELECT part, o, s, x, n, good, toxic, contains(f, x) AS fails, f <> translate(f, before, '') AS gone, f = x AS alone FROM counted, steps),
summed AS (SELECT part, o AS filter_order, s::INTEGER AS step, x, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM judged GROUP BY part, o, s, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM summed
"""

SQL = {"op2_warc_bundles": OP2_SQL, "op3_distribution_divergence": OP3_SQL, "op5_url_bloom_filter": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
