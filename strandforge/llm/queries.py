"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dialogue, exact_dedup, langid, lexical, licenses, media, mixing, packing, pii, simhash, substring, toxicity, wavelet
from .common import documents


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("mix_key")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS skey,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 k AS (SELECT *, md5(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(size AS VARCHAR))) AS key FROM d),
 s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS ssize FROM k GROUP BY skey),
 w AS (SELECT *, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(ssize * 3 AS DOUBLE) AS cap, CAST(sum(ssize) OVER () AS DOUBLE) AS total FROM s),
 l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT skey, ssize, least(cap, coalesce((SELECT max(level) FROM l WHERE cap >= level * w) * w, cap)) AS target FROM l),
 c AS (SELECT k.*, ssize, target, sum(size) OVER (PARTITION BY skey ORDER BY key ROWS UNBOUNDED PRECEDING) AS cum FROM k JOIN t USING (skey)),
 e AS (SELECT *, CAST(copy * ssize + cum AS DOUBLE) / target AS f FROM c, (VALUES (0), (1), (2)) AS v(copy) WHERE target > 0 AND size > 0),
 r AS (SELECT *, sum(size) OVER (ORDER BY f, skey, key, copy ROWS UNBOUNDED PRECEDING) - size AS start FROM e),
 cut AS (SELECT max(f) AS f, max(skey) AS skey, max(key) AS key, max(copy) AS copy FROM (SELECT * FROM r WHERE start < (SELECT sum(size) FROM k) ORDER BY f DESC, skey DESC, key DESC, copy DESC LIMIT 1) AS z),
 n AS (SELECT doc_id, size, ssize, target, CAST(CASE WHEN target > 0 THEN
   (CASE WHEN (cum / target, c.skey, c.key, 0) <= (cut.f, cut.skey, cut.key, cut.copy) THEN 1 ELSE 0 END)
   + (CASE WHEN (CAST(ssize + cum AS DOUBLE) / target, c.skey, c.key, 1) <= (cut.f, cut.skey, cut.key, cut.copy) THEN 1 ELSE 0 END)
   + (CASE WHEN (CAST(2 * ssize + cum AS DOUBLE) / target, c.skey, c.key, 2) <= (cut.f, cut.skey, cut.key, cut.copy) THEN 1 ELSE 0 END) ELSE 0 END AS INTEGER) AS copies FROM c, cut)
SELECT doc_id, size, ssize AS source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM n
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir)).drop("kept_text")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) AS x),
 f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
 r AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS j FROM g JOIN f ON g.k = f.k WHERE f.m < g.doc_id) AS y),
 p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p WHERE r.p IS NULL GROUP BY p.doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(documents(spark, sf_dir), vocabulary()))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n
"""

def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.write_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH t AS (SELECT doc_id, rid, unnest(terms) AS term, len(terms) AS n FROM (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOWER.format('text')}, '{lexical.TERM}') AS terms FROM documents WHERE text IS NOT NULL)),
 p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY rid, term),
 s AS (SELECT count(DISTINCT rid) AS nd, sum(tf) AS nt FROM p),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
 i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{lexical.TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
 q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
 r AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * nd) // nt AS BIGINT))))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, rid),
 o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def _regex(parts: list) -> str:
    """A template's parts as a regular expression over words, each with a space behind it."""
    return "".join(f"{x} " if isinstance(x, str) else f"(?:{_regex(x[1])})?" if x[0] == "optional" else f"(?:[^ ]+ ){{{x[1]},{x[2]}}}" for x in parts)


def _op12_sql() -> str:
    machines = licenses.automata()
    hits = ", ".join(f"CASE WHEN regexp_matches(j, ' {_regex(licenses.parsed(licenses.TEMPLATES[m.label]))}') THEN '{m.label}' END" for m in machines)
    sure = "".join(f" WHEN '{m.label}' THEN CAST({m.mandatory} AS DOUBLE) / {m.mandatory + 8}" for m in machines)
    at = ", ".join(f"list_transform(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + "), lambda i: i - 1)" for p in licenses.PHRASES)
    base = ", ".join(f"CASE WHEN contains(j, ' {p} ') THEN '{x}' END" for p, x in licenses.PHRASES.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 j AS (SELECT *, concat(' ', array_to_string(w, ' '), ' ') AS j FROM w),
 p AS (SELECT *, flatten([{at}]) AS found, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{hits}], lambda x: x IS NOT NULL) AS t FROM j),
 s AS (SELECT *, list_transform(t, lambda x: CASE x{sure} END) AS v, list_transform(list_filter([{", ".join(f"CASE WHEN contains(j, ' {p} ') THEN {len(p.split())} END" for p in licenses.PHRASES)}], lambda x: x IS NOT NULL), lambda x: CAST(x AS DOUBLE) / (x + 8)) AS u FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(found) AS BIGINT) AS n_base, list_min(found) AS first_word, list_max(found) AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(b, t))), ',') AS labels, coalesce(list_max(list_concat(u, v)), CAST(0 AS DOUBLE)) AS score FROM s
"""


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogue.repair_report(turns, dialogue.damaged(turns))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_substring_dedup, op3_media_columns, op4_toxicity, op5_personal_data, op6_token_shards, op7_simhash_near_dedup, op8_best_fit_packing, op9_exact_dedup, op10_language_id, op11_lexical_search, op12_license_scan, op13_dialogue_repair)}
SQL = {"op1_source_mix": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_license_scan": _op12_sql()}
