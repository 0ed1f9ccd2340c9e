"""Queries of memory, verification and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import evaluate, memory, verify
from pagequarry.plans.catalog import ANSWERS_SQL, answers, query, table
from pagequarry.plans.text_queries import _TERMS
from pagequarry.streaming import memory as running

_TOK = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_.+%-]+')) AS BIGINT)"
_TURNS = f"tn AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {_TOK} AS n FROM conversations)"
_SMALL = memory.Budget(tokens=200, keep=2)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {_TURNS} SELECT conv_id, CAST(sum(n) AS BIGINT) AS total_tokens FROM tn GROUP BY 1")
def memory_total_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.totals(turns(spark, sf_dir)).select("conv_id", "total_tokens")


@query(f"WITH {_TURNS} SELECT conv_id, CAST(sum(n + 4) AS BIGINT) AS tokens FROM tn GROUP BY 1")
def memory_message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.message_tokens(turns(spark, sf_dir))


@query(f"WITH {_TURNS} SELECT conv_id, sum(n) >= 200 AS over, sum(n) >= 170 AS near FROM tn GROUP BY 1")
def memory_budget_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.totals(turns(spark, sf_dir), _SMALL).select("conv_id", "over", "near")


_FIT = """
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {src}),
f AS (SELECT conv_id, k, turn, role, text, n, CASE WHEN n <= {budget} THEN n ELSE 0 END AS total, n <= {budget} AS took FROM o WHERE k = 1
      UNION ALL SELECT o.conv_id, o.k, o.turn, o.role, o.text, o.n, f.total + CASE WHEN f.total + o.n <= {budget} THEN o.n ELSE 0 END, f.total + o.n <= {budget} FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
"""


@query(f"WITH RECURSIVE {_TURNS}, {_FIT.format(src='tn', budget=190)} SELECT conv_id, turn, role, text, n AS token_count FROM f WHERE took")
def memory_context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.context(turns(spark, sf_dir), budget=200, query_tokens=10)


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_FIFTH = f"array_to_string({_WORDS}[1:CAST(floor(len({_WORDS}) / 5.0) AS INTEGER)], ' ') || ' [... compressed]'"
_HEAD = "'[Prior conversation summary — do not assume any details not mentioned here]' || chr(10)"
_CUT = f"""
tot AS (SELECT conv_id, sum(n) >= 200 AS over FROM tn GROUP BY 1),
pl AS (SELECT tn.*, over, row_number() OVER (PARTITION BY tn.conv_id ORDER BY turn DESC) AS r FROM tn JOIN tot ON tot.conv_id = tn.conv_id),
sm AS (SELECT conv_id, max(turn) AS turn, {_FIFTH.replace('{}', "string_agg(text, ' ' ORDER BY turn)")} AS s FROM pl WHERE over AND r > 2 GROUP BY 1),
cut AS (SELECT conv_id, turn, role, text, n, false AS is_summary FROM pl WHERE NOT (over AND r > 2)
        UNION ALL SELECT conv_id, turn, 'system', {_HEAD} || s, CAST(len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_.+%-]+')) AS BIGINT), true FROM sm)
"""


@query(f"WITH {_TURNS}, {_CUT} SELECT conv_id, turn, role, text, n AS token_count, is_summary FROM cut")
def memory_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.truncate(turns(spark, sf_dir), _SMALL)


@query(
    f"WITH RECURSIVE {_TURNS}, {_CUT}, {_FIT.format(src='cut', budget=200)}, h AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS held, count(*) AS k FROM f WHERE took GROUP BY 1), "
    "a AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS k FROM tn GROUP BY 1) "
    "SELECT a.conv_id, over AS truncated, CASE WHEN over THEN coalesce(held, 0) ELSE total END AS total_tokens, CASE WHEN over THEN coalesce(h.k, 0) ELSE a.k END AS n_turns, s AS summary "
    "FROM a JOIN tot ON tot.conv_id = a.conv_id LEFT JOIN h ON h.conv_id = a.conv_id LEFT JOIN sm ON sm.conv_id = a.conv_id"
)
def memory_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.step(turns(spark, sf_dir), _SMALL)


_RUN = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM tn),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS turn, CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]) AS kept, CAST(NULL AS VARCHAR) AS s, false AS cut FROM tn
  UNION ALL
  SELECT conv_id, k, turn, CASE WHEN cut THEN kept[greatest(len(kept) - 1, 1):] ELSE kept END, CASE WHEN cut AND len(kept) > 2 THEN {_FIFTH.replace('{}', 'old')} ELSE s END, cut
  FROM (SELECT *, list_sum(list_transform(kept, lambda x: x.n)) >= 200 AS cut, array_to_string(list_concat(CASE WHEN s IS NULL THEN [] ELSE [{_HEAD} || s] END, list_transform(kept[1:len(kept) - 2], lambda x: x.t)), ' ') AS old
        FROM (SELECT o.conv_id, o.k, o.turn, list_append(r.kept, struct_pack(t := o.text, n := o.n)) AS kept, r.s FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1))),
e AS (SELECT *, list_concat(CASE WHEN s IS NULL THEN [] ELSE [CAST(len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_.+%-]+')) AS BIGINT)] END, list_transform(kept, lambda x: x.n)) AS c FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
f AS (SELECT *, list_reduce(list_prepend(struct_pack(t := CAST(0 AS HUGEINT), n := CAST(0 AS BIGINT)), list_transform(c, lambda x: struct_pack(t := CAST(x AS HUGEINT), n := CAST(1 AS BIGINT)))),
        lambda a, x: CASE WHEN a.t + x.t <= 200 THEN struct_pack(t := a.t + x.t, n := a.n + 1) ELSE a END) AS fit FROM e)
"""


@query(
    f"WITH RECURSIVE {_TURNS}, {_RUN} SELECT conv_id, turn AS last_turn, cut AS truncated, CAST(CASE WHEN cut THEN fit.t ELSE list_sum(list_transform(kept, lambda x: x.n)) END AS BIGINT) AS total_tokens, "
    "CAST(CASE WHEN cut THEN fit.n ELSE len(c) END AS BIGINT) AS n_turns, s AS summary FROM f"
)
def memory_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory node after every turn, as it stands after the last one."""
    return running.run(turns(spark, sf_dir), _SMALL)


@query(f"SELECT conv_id, turn, {_FIFTH.replace('{}', "coalesce(text, '')")} AS summary FROM conversations")
def memory_fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", memory.first_fifth(F.col("text")).alias("summary"))


@query(f"WITH {_TURNS} SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) ORDER BY turn) AS block FROM tn GROUP BY 1")
def memory_prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.prompt_block(turns(spark, sf_dir))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history_tail(turns(spark, sf_dir), 3).select("conv_id", "turn", "role")


# --- verification ----------------------------------------------------------------------------------------------------

_MARKS = r"""ci AS (SELECT doc_id, regexp_replace(d, '^\s+|\s+$', '', 'g') AS doc, CAST(p AS INTEGER) AS page, pos FROM (
  SELECT doc_id, unnest(regexp_extract_all(answer, '\[Source:\s*([^,\]]+),\s*page\s*(\d+)\]', 1)) AS d, unnest(regexp_extract_all(answer, '\[Source:\s*([^,\]]+),\s*page\s*(\d+)\]', 2)) AS p,
         unnest(range(0, len(regexp_extract_all(answer, '\[Source:\s*([^,\]]+),\s*page\s*(\d+)\]', 1)))) AS pos FROM answers)),
ev AS (SELECT doc_id, source AS doc, CAST(page AS INTEGER) AS page FROM answers)"""


def _evidence(a: DataFrame) -> DataFrame:
    return a.select("doc_id", F.col("source").alias("doc"), "page")


@query(f"WITH {ANSWERS_SQL}, {_MARKS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, doc, page FROM ci ANTI JOIN ev USING (doc_id, doc, page)")
def citation_hallucinated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return verify.hallucinated_citations(verify.cited(a, "doc_id"), _evidence(a), "doc_id").select("doc_id", "pos", "doc", "page")


@query(f"WITH {ANSWERS_SQL}, {_MARKS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, doc, page FROM ci SEMI JOIN ev USING (doc_id, doc, page)")
def citation_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return verify.valid_citations(verify.cited(a, "doc_id"), _evidence(a), "doc_id").select("doc_id", "pos", "doc", "page")


_VERIFY = f"""{ANSWERS_SQL}, {_MARKS}, j AS (SELECT ci.doc_id, ci.pos, ci.doc, ci.page, ev.doc IS NOT NULL AS ok FROM ci LEFT JOIN ev ON ev.doc_id = ci.doc_id AND ev.doc = ci.doc AND ev.page = ci.page),
vc AS (SELECT doc_id, count(*) AS f, count(*) FILTER (WHERE ok) AS v, coalesce(string_agg(doc || ':' || page, ',' ORDER BY pos) FILTER (WHERE NOT ok), '') AS i FROM j GROUP BY 1)"""


@query(f"WITH {_VERIFY} SELECT a.doc_id, CAST(coalesce(f, 0) AS BIGINT) AS n_found, CAST(v AS BIGINT) AS n_valid, coalesce(f = v, true) AS verified, round(v / f, 4) AS groundedness, coalesce(i, '') AS issues FROM answers a LEFT JOIN vc ON vc.doc_id = a.doc_id")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return verify.verify_citations(a, _evidence(a), "doc_id")


@query(f"WITH {_VERIFY} SELECT source, round(CAST(sum(v) AS DOUBLE) / sum(f), 4) AS groundedness FROM answers a JOIN vc ON vc.doc_id = a.doc_id GROUP BY 1")
def answer_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    judged = verify.verify_citations(a, _evidence(a), "doc_id").join(a.select("doc_id", "source"), "doc_id").where("n_found > 0")
    return judged.groupBy("source").agg(F.round(F.try_divide(F.sum("n_valid").cast("double"), F.sum("n_found").cast("double")), 4).alias("groundedness"))


@query(f"WITH {ANSWERS_SQL}, {_MARKS}, b AS (SELECT doc_id, doc, page, pos FROM ci UNION ALL SELECT doc_id, doc, page, pos + 2 FROM ci) SELECT doc_id, doc, page, CAST(min(pos) AS INTEGER) AS pos FROM b GROUP BY 1, 2, 3")
def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = verify.cited(answers(spark, sf_dir), "doc_id")
    return verify.first_citations(marks.union(marks.withColumn("pos", F.col("pos") + 2)), "doc_id").select("doc_id", "doc", "page", "pos")


_NUM = r"list_filter(list_distinct(regexp_extract_all(answer, '\b[\d,]+\.?\d*\b')), lambda x: NOT contains(evidence, replace(x, ',', '')))"
_YEAR = r"list_filter(list_distinct(regexp_extract_all(answer, '\b(20\d{2}|19\d{2})\b', 1)), lambda x: NOT contains(evidence, x))"
_PCT = r"list_filter(list_distinct(regexp_extract_all(answer, '\b\d+\.?\d*%')), lambda x: NOT contains(evidence, rtrim(x, '%')))"


@query(
    f"WITH {ANSWERS_SQL}, m AS (SELECT doc_id, {_NUM} AS a, {_YEAR} AS b, {_PCT} AS c FROM answers) SELECT doc_id, CAST(len(a) AS INTEGER) AS n_numbers, CAST(len(b) AS INTEGER) AS n_years, CAST(len(c) AS INTEGER) AS n_percents, "
    "array_to_string(list_sort(a), '|') AS numbers, CASE WHEN len(b) > 0 OR len(a) > 2 THEN 'HIGH' WHEN len(a) > 0 OR len(c) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS alert FROM m"
)
def missing_data_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, years, percents, level = verify.missing_data(F.col("answer"), F.col("evidence"))
    return answers(spark, sf_dir).select("doc_id", F.size(numbers).alias("n_numbers"), F.size(years).alias("n_years"), F.size(percents).alias("n_percents"), F.array_join(F.array_sort(numbers), "|").alias("numbers"), level.alias("alert"))


@query("SELECT doc_id, 'INSUFFICIENT' AS verdict, CASE WHEN text IS NULL OR doc_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM documents")
def evidence_check_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("text").isNull() | (F.col("doc_id") % 5 == 0), F.array().cast("array<string>")).otherwise(F.array("text"))
    verdict, confidence = verify.evidence_check_default(evidence)
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"), confidence.alias("confidence"))


_EV_ROWS = "er AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, '[Source: ' || source || ', page ' || (1 + doc_id % 50) || ']' || chr(10) || substr(text, 1, 500) AS line FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_EV_ROWS} SELECT source, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS evidence FROM er WHERE rank <= 10 GROUP BY 1")
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    ranked = d.select("source", F.col("source").alias("doc"), (1 + F.col("doc_id") % 50).alias("page"), "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"))
    return verify.pack_evidence(ranked, "source")


# --- evaluation ------------------------------------------------------------------------------------------------------

_SCORES = "sc AS (SELECT doc_id % 7 AS grp, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS s, CASE WHEN doc_id % 10 = 9 THEN 'failed' END AS error FROM documents)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((n % 7).alias("grp"), (((n * 37) % 101).cast("double") / 100).alias("faithfulness"), F.when(n % 10 == 9, "failed").alias("error"))


@query(f"WITH {_SCORES} SELECT grp, CAST(count(*) AS BIGINT) AS n, CAST(count(error) AS BIGINT) AS n_failed, round(avg(s) FILTER (WHERE error IS NULL), 4) AS mean, round(quantile_cont(s, 0.5) FILTER (WHERE error IS NULL), 4) AS median, round(coalesce(stddev_samp(s) FILTER (WHERE error IS NULL), 0), 4) AS stdev FROM sc GROUP BY 1")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(_scores(spark, sf_dir), "grp")


@query(f"WITH {_SCORES} SELECT grp, CAST(count(*) FILTER (WHERE error IS NULL AND s >= 0.9) AS BIGINT) AS excellent, CAST(count(*) FILTER (WHERE error IS NULL AND s >= 0.7 AND s < 0.9) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE error IS NULL AND s >= 0.5 AND s < 0.7) AS BIGINT) AS fair, "
       "CAST(count(*) FILTER (WHERE error IS NULL AND s < 0.5) AS BIGINT) AS poor, CAST(count(error) AS BIGINT) AS failed FROM sc GROUP BY 1")  # fmt: skip
def eval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(_scores(spark, sf_dir), "grp")


_T = lambda x: _TERMS.replace("coalesce(text, '')", x)


@query(
    f"WITH {ANSWERS_SQL}, s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(answer, '[.!?。！？]+(?:\\s+|$)'), lambda z: {_T('z')}), lambda t: len(t) > 0) AS ss, list_distinct({_T('evidence')}) AS known FROM answers) "
    "SELECT doc_id, coalesce(round(CAST(len(list_filter(ss, lambda t: len(list_intersect(list_distinct(t), known)) >= 0.5 * len(list_distinct(t)))) AS DOUBLE) / nullif(len(ss), 0), 4), 0.0) AS faithfulness FROM s"
)
def faithfulness_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", evaluate.faithfulness_proxy(F.col("answer"), F.col("evidence")).alias("faithfulness"))
