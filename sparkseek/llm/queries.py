"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontam, divergence, langid, linededup, lmscore, minhash, mixing, pii, quality, rlindex, urlrules, vectorcodes
from .common import read


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), lmscore.held_out(F.col("doc_id"), 4, 2))


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read(spark, sf_dir, "documents").select("doc_id", "text"), lmscore.held_out(F.col("doc_id"), 5, 1))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels"))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.temperature_mix(docs).drop("text")


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlindex.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_term_block_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(read(spark, sf_dir, "embeddings"))


def op13_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spaced_seeds, op2_contextual_pii, op3_superminhash, op4_partial_matching, op5_backoff_automaton,
        op6_compression_bands, op7_association_rules, op8_temperature_mix, op9_run_length_index, op10_fuzzy_lines,
        op11_term_block_audit, op12_exponion_codes, op13_credential_links,
    )
}



# --------------------------------------------------------------------------- what SQL can say

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of :func:`op2_contextual_pii` by kind."""
    return op2_contextual_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the sets of :func:`op3_superminhash`."""
    return minhash.signatures(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of :func:`op6_compression_bands`."""
    return op6_compression_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and fixed rule of :func:`op7_association_rules`."""
    return op7_association_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of :func:`op13_credential_links` by kind."""
    return op13_credential_links(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


for _f in (pii_base_counts, shingle_counts, quality_base, url_fixed_rules, secret_base_counts):
    QUERIES[_f.__name__] = _f

_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, p in (r[1].split("/", 1) for r in sorted(urlrules.RULES, key=lambda r: -len(r[1]))))
ORACLE: dict[str, str] = {
    "pii_base_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 c AS (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS m FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) AS m FROM d)),
 l AS (SELECT doc_id, list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(m)[i]::INT ELSE reverse(m)[i]::INT * 2 - CASE WHEN reverse(m)[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 AS luhn FROM c WHERE length(m) BETWEEN 12 AND 19),
 k AS (SELECT doc_id, count(*) FILTER (luhn = 0) AS n FROM l GROUP BY doc_id)
 SELECT d.doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: p::HUGEINT > 255)) = 0))::BIGINT AS n_ip, coalesce(k.n, 0) AS n_card,
 len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM d LEFT JOIN k USING (doc_id)""".replace("\\\\", "\\"),
    "shingle_counts": rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents), s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g FROM w WHERE len(w) >= 5),
 n AS (SELECT doc_id, count(DISTINCT g) AS n FROM s GROUP BY doc_id) SELECT w.doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE n END::BIGINT AS n_shingles FROM w LEFT JOIN n USING (doc_id)""",
    "quality_base": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS n FROM g),
 r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
 x AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w)
 SELECT doc_id, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
 n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM x LEFT JOIN r USING (doc_id)""",
    "url_fixed_rules": rf"""WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)
 SELECT page_id, host, path, CASE {_FITS} END AS rule FROM p""",
    "secret_base_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
 SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
 len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
 len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM d""",
    "op11_term_block_audit": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
 v AS (SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)),
 n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
 c AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::HUGEINT AS t FROM (SELECT lang, source, v, term FROM v JOIN k USING (lang)) LEFT JOIN n USING (lang, source, term)),
 p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (t + 2 * v))::BIGINT AS p FROM c),
 l AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM (SELECT lang, term, any_value(v) AS v, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term)),
 x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM v a JOIN v b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y QUALIFY part = 'pair' OR rank <= 10""",
}


def _codes_sql() -> str:
    """Each round as two tables: entries by part (b), and nearest entries (a).  Inner products of
    integers are exact in doubles."""
    parts, entries = vectorcodes.PARTS, vectorcodes.ENTRIES
    sql = [
        f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM e, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, v FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(vectorcodes.ROUNDS + 1):
        far = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"
        sql.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x.v) AS v, min(({far}) * {entries} + i) AS best FROM x JOIN b{k} b USING (p) GROUP BY vec_id, p)")
        if k < vectorcodes.ROUNDS:
            sql.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, i, list(floor(s / n) ORDER BY j) AS v FROM (
 SELECT p, best::BIGINT % {entries} AS i, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS j FROM a{k}) GROUP BY ALL) GROUP BY p, i) m ON m.p = b.p AND m.i = b.i)""")
    last = vectorcodes.ROUNDS
    return f"""WITH {", ".join(sql)}, c AS (SELECT vec_id, string_agg(format('{{:02x}}', best::BIGINT % {entries}), '' ORDER BY p) AS code, sum(best::BIGINT // {entries})::BIGINT AS error FROM a{last} GROUP BY vec_id),
 h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, i)) AS h FROM b{last})
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN e USING (vec_id), h"""


ORACLE["op12_exponion_codes"] = _codes_sql()
