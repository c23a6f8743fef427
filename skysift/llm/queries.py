"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import (
    filter_audit, katz, license_scan, merkle, mixing, ngram_join, packing, pii, quality_rules, toxicity, url_rules, vector_index, warc,
)
from skysift.llm.common import crc, ready, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark, sf):
    found = ngram_join.jaccard_classes(table(spark, sf, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark, sf):
    return license_scan.notices(table(spark, sf, "documents")).drop("spans")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_rules(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, sf, "pages"), rules)


def op4_nearest_vectors(spark, sf):
    return vector_index.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_source_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    return mixing.flat(mixing.mixed(docs, mixing.repetition_rates(docs)))


def op6_toxicity(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"), crc(F.col("id")) % 3 != 1)


def op7_personal_data(spark, sf):
    found = pii.found_in(table(spark, sf, "documents"))
    base = lambda spans: F.filter(spans, lambda s: s["rank"] < len(pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.digest(base(F.col("spans"))), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def op8_best_fit_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


def op9_katz_scoring(spark, sf):
    return katz.scored(table(spark, sf, "documents"), crc(F.col("id")) % 5 != 1)


def op10_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    rules = quality_rules.fit(docs, table(spark, sf, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    changed = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    return merkle.manifest(docs, merkle.one_in_three(), changed, merkle.FIELDS)


def op12_warc_archive(spark, sf):
    return warc.archived(table(spark, sf, "pages"), warc.archive_folder(spark))


def op13_filter_audit(spark, sf):
    return filter_audit.audited(filter_audit.masked(table(spark, sf, "documents")), table(spark, sf, "labels"))


_QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_license_scan": op2_license_scan,
    "op3_url_rules": op3_url_rules,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_katz_scoring": op9_katz_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_archive": op12_warc_archive,
    "op13_filter_audit": op13_filter_audit,
}


def queries() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, sf_dir: query(ready(spark), sf_dir)

    return {name: prepared(query) for name, query in _QUERIES.items()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.node = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_OP3 = f"""WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {_RULES}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)"""


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 13))::BIGINT / {16**13}.0::DOUBLE)"


_OP5 = f"""WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM c),
q AS (SELECT source, CAST(greatest(ceil(rate / 8), 1) AS INT) AS parts, rate / greatest(ceil(rate / 8), 1) AS mean FROM r),
f AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS s FROM q
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM f WHERE k < 63),
u AS (SELECT doc_id, source, {_unit("'0'", "doc_id::VARCHAR", "part::VARCHAR")} AS u
  FROM (SELECT doc_id, source, unnest(range(0, parts)) AS part FROM documents JOIN q USING (source))),
n AS (SELECT doc_id, count(*) AS n FROM u JOIN f ON u.source = f.source AND u >= s GROUP BY doc_id),
x AS (SELECT d.*, CAST(unnest(range(0, n.n)) AS INT) AS copy FROM documents d JOIN n USING (doc_id))
SELECT *, {_unit("'0'", "'place'", "doc_id::VARCHAR", "copy::VARCHAR")} AS place FROM x"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda s, k: xor(s >> 1, (s & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, i, n, h) over leaves (tree, i, n, h), and beside each what lies left and right of it in its run."""
    beside = "string_agg(h, '') OVER (PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN"
    return f"""{name} AS (SELECT tree, 0 AS level, i, n, h FROM {leaves} UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 8, n),
{name}_beside AS (SELECT *, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name})"""


_OP11 = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf("text")} AS h,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf("text")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree("low", "placed")},
subroots AS (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
heads AS (SELECT '' AS tree, i, n, subroot AS h FROM subroots),
{_tree("top", "heads")},
climb AS (SELECT doc_id, tree, i AS leaf_i, h AS leaf, 0 AS level, i, changed AS cur, '' AS proof FROM placed UNION ALL
  SELECT doc_id, c.tree, leaf_i, leaf, c.level + 1, c.i // 8, sha256(l || cur || r), proof || l || r
  FROM climb c JOIN low_beside b ON b.tree = c.tree AND b.level = c.level AND b.i = c.i WHERE b.n > 1),
arrived AS (SELECT c.* EXCLUDE (i, level), s.i, subroot FROM climb c JOIN subroots s ON s.name = c.tree
  QUALIFY row_number() OVER (PARTITION BY c.tree, leaf_i ORDER BY c.level DESC) = 1),
rise AS (SELECT *, 0 AS level FROM arrived UNION ALL
  SELECT doc_id, c.tree, leaf_i, leaf, sha256(l || cur || r), proof || l || r, c.i // 8, subroot, c.level + 1
  FROM rise c JOIN top_beside b ON b.level = c.level AND b.i = c.i WHERE b.n > 1),
ended AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY tree, leaf_i ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM ended, (SELECT h FROM top WHERE n = 1)"""

_OP12 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
c AS (SELECT *, strlen(html) AS size, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id <> newest THEN newest END AS refers_to, TRUE AS intact FROM c"""

_BITS = "CASE substr(o, step, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"
_EARLIER = " + ".join(f"CASE WHEN instr(substr(o, 1, step - 1), '{c}') > 0 THEN {1 << i} ELSE 0 END" for i, c in enumerate("ABCDE"))

_OP13 = f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > first_id, FALSE)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
c(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || d.c || e.c || f.c AS o FROM c a, c b, c d, c e, c f WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
s AS (SELECT o, step::INT AS step, substr(o, step, 1) AS f, {_BITS} AS bit, {_EARLIER} AS earlier FROM o, range(1, 6) r(step)),
x AS (SELECT part, o, step, f, sum(CASE WHEN (mask & (bit | earlier)) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN bad ELSE 0 END) AS toxic_lost FROM g, s GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x"""


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL can say; the others are tested against brute force or held-out rows."""
    return {
        "op1_ngram_jaccard": _OP1, "op3_url_rules": _OP3, "op5_source_mixing": _OP5, "op11_merkle_manifest": _OP11,
        "op12_warc_archive": _OP12, "op13_filter_audit": _OP13,
    }
