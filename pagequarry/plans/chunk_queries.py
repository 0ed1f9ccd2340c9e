"""Queries of text chunking, over documents with headings added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import chunking
from pagequarry.plans.catalog import HEADED_SQL, headed, query
from pagequarry.plans.text_queries import level_sql

_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKENS_SQL = r"CAST(len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_.+%-]+')) AS INTEGER)"
_SPACED = r"CAST(len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')) AS INTEGER)"
_CLEAN = _S.format(r"regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '\n([a-z])', ' \1', 'g')")
_BLOCKS_SQL = f"""
ln AS (SELECT doc_id, i, {_S.format("l")} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM headed)),
lv AS (SELECT *, {level_sql("s")} AS level FROM ln),
gr AS (SELECT *, sum(CASE WHEN s = '' OR level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lv),
par AS (SELECT doc_id, min(i) AS i, CAST(NULL AS INTEGER) AS level, {_CLEAN.format("string_agg(CASE WHEN len(s) > 20 AND NOT contains('.。!?;:»)', right(s, 1)) THEN s || ' ' ELSE s END, chr(10) ORDER BY i)")} AS line
        FROM gr WHERE s <> '' AND level IS NULL GROUP BY doc_id, g),
al AS (SELECT doc_id, i, level, s AS line FROM lv WHERE level IS NOT NULL UNION ALL SELECT doc_id, i, level, line FROM par WHERE len(line) >= 3),
hs AS (SELECT doc_id, list(struct_pack(l := level, p := [line]) ORDER BY i) AS hs FROM al WHERE level IS NOT NULL GROUP BY 1),
bl AS (SELECT al.doc_id, row_number() OVER w - 1 AS pos, level, line, count(level) OVER w AS n FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
blk AS (SELECT bl.doc_id, pos, level, CASE WHEN n = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce(hs[1:n], lambda a, x: struct_pack(l := x.l, p := list_concat(a.p[1:x.l - 1], x.p))).p END AS path,
        regexp_replace(line, '^#+\\s*', '') AS content, CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' || line ELSE line END AS raw, line FROM bl LEFT JOIN hs USING (doc_id)),
blocks AS (SELECT doc_id, pos, level, path, content, raw, CASE WHEN level IS NOT NULL THEN {_SPACED.format("content")} ELSE {_SPACED.format("line")} END AS token_count FROM blk)
"""
BLOCKS_SQL = f"{HEADED_SQL}, {_BLOCKS_SQL}"


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, level, array_to_string(path, ' > ') AS path, content, raw, token_count FROM blocks")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.extract_blocks(headed(spark, sf_dir).drop("source")).withColumn("path", F.array_join("path", " > "))


def chunks_sql(headed_sql: str, most: int) -> str:
    """WITH's part that ends with ch, the chunks of headed (doc_id, source, text), which ``headed_sql`` gives."""
    return f"""
RECURSIVE {headed_sql.strip()}, {_BLOCKS_SQL},
se AS (SELECT *, sum(CASE WHEN pos = 0 OR level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec, {TOKENS_SQL.format("raw")} AS n FROM blocks),
pp AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY pos) - 1 AS k, raw, n FROM se WHERE level IS NULL),
r AS (SELECT doc_id, sec, k, 0 AS first, n AS total, n AS last_n, CAST(NULL AS BIGINT) AS ef, CAST(NULL AS BIGINT) AS el FROM pp WHERE k = 0
      UNION ALL
      SELECT p.doc_id, p.sec, p.k, CASE WHEN r.total + p.n > {most} THEN p.k - 1 ELSE r.first END, CASE WHEN r.total + p.n > {most} THEN r.last_n + p.n ELSE r.total + p.n END, p.n,
             CASE WHEN r.total + p.n > {most} THEN r.first END, CASE WHEN r.total + p.n > {most} THEN p.k - 1 END
      FROM r JOIN pp p ON p.doc_id = r.doc_id AND p.sec = r.sec AND p.k = r.k + 1),
sp AS (SELECT doc_id, sec, ef AS f, el AS l FROM r WHERE ef IS NOT NULL UNION ALL SELECT doc_id, sec, arg_max(first, k), max(k) FROM r GROUP BY 1, 2),
hd AS (SELECT doc_id, sec, arg_min(level, pos) FILTER (WHERE level IS NOT NULL) AS level, arg_min(path, pos) AS path, arg_min(raw, pos) AS raw, arg_min(token_count, pos) FILTER (WHERE level IS NOT NULL) AS tc FROM se GROUP BY 1, 2),
tx AS (SELECT sp.doc_id, sp.sec, f, l, string_agg(raw, chr(10) || chr(10) ORDER BY k) AS body FROM sp JOIN pp ON pp.doc_id = sp.doc_id AND pp.sec = sp.sec AND k BETWEEN f AND l GROUP BY 1, 2, 3, 4),
ch AS (SELECT tx.doc_id, tx.sec, f, l, level, path, {_S.format("CASE WHEN len(path) > 0 THEN array_to_string(list_transform(path, lambda h: '## ' || h), chr(10)) || chr(10) ELSE '' END || body")} AS text, l - f + 1 AS nb, CAST(NULL AS INTEGER) AS tc FROM tx JOIN hd USING (doc_id, sec)
       UNION ALL SELECT doc_id, sec, -1, -1, level, path, raw, 1, tc FROM hd WHERE tc >= 32)
"""


_MOST = 60


@query(
    f"WITH {chunks_sql(HEADED_SQL, _MOST)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, f) - 1 AS INTEGER) AS chunk_index, text, level AS heading_level, array_to_string(path, ' > ') AS path, "
    f"CAST(nb AS INTEGER) AS num_blocks, coalesce(tc, {TOKENS_SQL.format('text')}) AS token_count FROM ch"
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_regions(headed(spark, sf_dir).drop("source"), most=_MOST)
