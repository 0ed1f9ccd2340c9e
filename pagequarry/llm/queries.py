"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_model, license_scan, near_dedup, quality_rules, quality_trees, substring_dedup, toxicity, vector_codes, vector_forest, warc
from .common import Scratch, fold, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_quality_rules(docs, model).drop("text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), Scratch(spark, "archive"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _scored(docs: DataFrame, score: str, threshold: float) -> DataFrame:
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), "toxicity", 0.5)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.bpe_decode(encoded, ranks, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), k=13)
    left = F.regexp_replace(F.coalesce("clean_text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(left), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = language_model.score_texts(docs, language_model.teaching())
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_trees.train_quality(docs, table(spark, sf_dir, "labels"))
    return _scored(quality_trees.score_quality(docs, model), "quality", 0.3)


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.lower(F.hex("codes"))  # of each code the low byte, then the high one, which 256 entries leave at zero
    code = F.concat(*(F.substring(digits, 4 * p + 1, 2) for p in range(vector_codes.PARTS)))
    digest = F.lit(vector_codes.books_digest(books))
    return vector_codes.with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_decontaminate, op3_quality_rules, op4_warc, op5_toxicity, op6_bpe, op7_substring_dedup, op8_license_scan, op9_lm_score, op10_quality_trees,
        op11_nearest_vectors, op12_vector_codes,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql_words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UP}', '{_LOW}')" if lower else text}, '{pattern}')"


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_sql_words("text", _PLAIN, True)} AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS g FROM g),
n AS (SELECT doc_id, len(gs) AS n FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, sym.b FROM r JOIN sym ON sym.a = r.u),
m AS (SELECT v, min(u) AS u FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.u AS component_id, n.doc_id = m.u AS kept FROM n JOIN m ON m.v = n.doc_id
"""

OP2_SQL = f"""
WITH iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_sql_words("text", _ALNUM, True)} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {_sql_words("text", _ALNUM, True)} AS ws FROM documents),
p AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) ks WHERE len(ws) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, win.item FROM p JOIN win ON win.k = p.k AND win.g = p.g),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

_BITS = "'0000000100100011010001010110011110001001101010111100110111101111'"
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1),
d AS (SELECT html, first, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: substr({_BITS}, 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM f)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
         + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p JOIN d ON d.html = p.html
"""

OP7_SQL = f"""
WITH w AS (SELECT doc_id, {_sql_words("text", _PLAIN, False)} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (g) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TEMPLATES = ", ".join(f"({i}, '{label}', {_sql_list(license_scan._template_words(text))})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {_sql_list(phrase.split())})" for phrase, label in license_scan.PHRASES.items())
OP8_SQL = f"""
WITH t(i, label, tw) AS (VALUES {_TEMPLATES}), ph(label, pw) AS (VALUES {_PHRASES}),
w AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_words("text", _ALNUM, True)} AS ws FROM documents),
hit AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, ws, label, pw, unnest(range(1, len(ws) - len(pw) + 2)) AS i FROM w, ph WHERE len(ws) >= len(pw) AND list_contains(ws, 'license')) WHERE ws[i:i + len(pw) - 1] = pw),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list_distinct(list(label))) AS ls FROM hit GROUP BY 1),
ln AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM w),
bl AS (SELECT doc_id, list_distinct({_sql_words("array_to_string(ls[i:i + 2], chr(10))", _ALNUM, True)}) AS bw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ln)),
c AS (SELECT doc_id, label, len(list_intersect(bw, tw)) AS k, len(tw) AS n FROM bl, t),
f AS (SELECT doc_id, list_distinct(list(label)) AS ls, max(k / n) AS share FROM c WHERE 100 * k >= {license_scan.PERCENT} * n GROUP BY 1)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
       array_to_string(coalesce(b.ls, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


#: The exact answer, which op11 gives as long as a query's ranges hold all rows; README has its recall beyond that.
OP11_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""


def _op12_sql() -> str:
    nearest = "SELECT p.r, p.q, arg_min(b.e, 256 * (list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c)) + b.e) AS e FROM p JOIN b{n} b ON b.q = p.q GROUP BY 1, 2"
    rounds = "".join(
        f"""a{n} AS MATERIALIZED ({nearest.format(n=n)}),
m{n} AS (SELECT q, e, list(m ORDER BY i) AS c FROM (SELECT a.q, a.e, i, floor(sum(p.x[i]) / count(*)) AS m FROM p JOIN a{n} a ON a.r = p.r AND a.q = p.q, range(1, 17) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n + 1} AS MATERIALIZED (SELECT b.q, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON m.q = b.q AND m.e = b.e),
"""
        for n in range(vector_codes.ROUNDS)
    )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, q, v[16 * q + 1:16 * q + 16] AS x FROM k, range(4) t(q)),
b0 AS MATERIALIZED (SELECT q, r - 1 AS e, x AS c FROM p WHERE r <= 256),
{rounds}a AS MATERIALIZED ({nearest.format(n=vector_codes.ROUNDS)}),
d AS (SELECT a.r, string_agg(printf('%02x', a.e), '' ORDER BY a.q) AS code, CAST(sum(list_inner_product(p.x, p.x) + list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c)) AS BIGINT) AS error
      FROM a JOIN p ON p.r = a.r AND p.q = a.q JOIN b{vector_codes.ROUNDS} b ON b.q = a.q AND b.e = a.e GROUP BY 1),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY q, e)) AS h FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN d USING (r), s
"""


ORACLES: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op11_nearest_vectors": OP11_SQL,
    "op12_vector_codes": _op12_sql(),
}
