"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.ann import op2_nearest
from quietfield.llm.chat import op3_chat_format
from quietfield.llm.codes import op12_vector_codes
from quietfield.llm.decontaminate import op8_decontaminate
from quietfield.llm.exact import op11_exact_dedup
from quietfield.llm.langid import op10_language_id
from quietfield.llm.licenses import op6_license_scan
from quietfield.llm.lmscore import op5_lm_score
from quietfield.llm.mixing import op9_mixing
from quietfield.llm.near import op1_near_dedup
from quietfield.llm.pii import digest, find, op7_pii
from quietfield.llm.substrings import op4_substring_dedup
from quietfield.llm.zones import op13_centroids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_nearest": op2_nearest,
    "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\l')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS size FROM c),
f AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n - 1 THEN upto END) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_examples FROM f GROUP BY conv_id""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
v AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM v),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r CROSS JOIN (SELECT unnest(range(0, 20)) AS o) WHERE k > 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT u.doc_id, sum(CASE WHEN g.pos IS NULL THEN 0 ELSE 1 END) AS n, string_agg(CASE WHEN g.pos IS NULL THEN u.word END, ' ' ORDER BY u.pos) AS kept
  FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY 1) x ON x.doc_id = d.doc_id""",
    "op11_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY s) AS group_size, k = 1 AS kept, sha256(s) AS text_sha256 FROM g""",
}

_SOUND = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_PAIR = "list_sum(list_transform(list_zip(a.q, b.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _rounds(n: int) -> str:
    """Assignments a0, ..., an of rows k(part, id, q) to entries b0(part, e, q), with means in between."""
    near = "a{0} AS (SELECT part, id, q, e, CAST(d AS BIGINT) AS d FROM (SELECT a.part, a.id, a.q, b.e, %s AS d, row_number() OVER (PARTITION BY a.part, a.id ORDER BY %s, b.e) AS r FROM k a JOIN b{0} b ON b.part = a.part) WHERE r = 1)" % (_PAIR, _PAIR)
    mean = """m{1} AS (SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS q FROM (SELECT part, e, i, sum(v) AS s, count(*) AS n FROM (SELECT part, e, unnest(q) AS v, unnest(range(len(q))) AS i FROM a{0}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{1} AS (SELECT b.part, b.e, coalesce(m.q, b.q) AS q FROM b{0} b LEFT JOIN m{1} m ON m.part = b.part AND m.e = b.e)"""
    return ",\n".join([near.format(0), *[mean.format(i, i + 1) + ",\n" + near.format(i + 1) for i in range(n)]])


ORACLE_SQL["op12_vector_codes"] = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND {_SOUND}),
k AS (SELECT part, id, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS q FROM v CROSS JOIN (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, id - 1 AS e, q FROM k WHERE id <= 64),
{_rounds(2)},
x AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN x ON x.id = v.id CROSS JOIN h"""
ORACLE_SQL["op13_centroids"] = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
k AS (SELECT 0 AS part, id, q FROM v),
b0 AS (SELECT part, id - 1 AS e, q FROM k WHERE id <= 16),
{_rounds(3)}
SELECT v.vec_id, CAST(a.e AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.e) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b.q, ',')) AS centroid_sha256
FROM a3 a JOIN v ON v.id = a.id JOIN b3 b ON b.e = a.e"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_license_scan says of the fixed phrases, which SQL can express; -1 for a place that isn't there."""
    found = op6_license_scan(spark, sf_dir)
    place = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long")).alias(c)
    return found.select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


QUERIES["license_base"] = license_base
ORACLE_SQL["license_base"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT 'mit' AS label, ['under', 'the', 'mit', 'license'] AS ws UNION ALL SELECT 'apache-2', ['apache', 'license', 'version', '2'] UNION ALL SELECT 'cc-by-nc', ['cc', 'by', 'nc']),
u AS (SELECT doc_id, w, label, ws, unnest(range(0, greatest(len(w) - len(ws) + 1, 0))) AS pos FROM d CROSS JOIN p),
h AS (SELECT doc_id, label, pos FROM u WHERE w[pos + 1] = ws[1] AND w[pos + 1:pos + len(ws)] = ws)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_base, CAST(coalesce(x.lo, -1) AS BIGINT) AS first_word, CAST(coalesce(x.hi, -1) AS BIGINT) AS last_word, coalesce(x.labels, '') AS base_labels
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY 1) x ON x.doc_id = d.doc_id"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_pii says of the fixed kinds, which SQL can express."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    none = spark.createDataFrame([], "context string, kind int")
    return digest(find(docs, none)).drop("spans")


QUERIES["pii_base"] = pii_base
_CUT = r"string_split(replace(regexp_replace(t, '{}', chr(1) || '\0' || chr(2), 'g'), chr(2), chr(1)), chr(1))"
ORACLE_SQL["pii_base"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, 0 AS ord, 'email' AS kind, {_CUT.format(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")} AS parts FROM d
  UNION ALL SELECT doc_id, 1, 'ip', {_CUT.format(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")} FROM d
  UNION ALL SELECT doc_id, 2, 'card', {_CUT.format(r"[0-9]([\x20-]?[0-9])+")} FROM d
  UNION ALL SELECT doc_id, 3, 'phone', {_CUT.format(r"\+[0-9][\x20().0-9-]+[0-9]")} FROM d),
s AS (SELECT doc_id, ord, kind, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM m),
v AS (SELECT doc_id, ord, kind, parts[i] AS x, CAST(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))) AS BIGINT) AS a, regexp_replace(parts[i], '[^0-9]', '', 'g') AS g FROM s),
w AS (SELECT doc_id, ord, kind, a, a + length(x) AS b FROM v WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(left(ltrim(p, '0'), 3) AS INTEGER), 0) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(g)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(g, length(g) - j, 1) AS INTEGER)
    ELSE 2 * CAST(substr(g, length(g) - j, 1) AS INTEGER) - CASE WHEN CAST(substr(g, length(g) - j, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(g) BETWEEN 10 AND 15 END)
SELECT d.doc_id, CAST(coalesce(x.e, 0) AS BIGINT) AS n_email, CAST(coalesce(x.i, 0) AS BIGINT) AS n_ip, CAST(coalesce(x.c, 0) AS BIGINT) AS n_card, CAST(coalesce(x.p, 0) AS BIGINT) AS n_phone, sha256(coalesce(x.spans, '')) AS base_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(CASE WHEN ord = 0 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN ord = 1 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN ord = 2 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN ord = 3 THEN 1 ELSE 0 END) AS p,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM w GROUP BY 1) x ON x.doc_id = d.doc_id"""
