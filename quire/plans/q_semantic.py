"""Semantic queries over specification-like sentences and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rules import INTENT, LEGAL, MAY_DATE, REVIEW_ONLY, STRENGTH, TERM, TESTABLE, TOC
from ..functions.text import collapse, ref_key
from ..operators import semantics as op
from ..session import table
from .corpus_data import LINES_SQL, SPEC_SQL, lines, spec
from .registry import query, sql_case

SENT_SQL = f"""{SPEC_SQL}, sent AS (SELECT unit, page, CAST(i - 1 AS INT) AS sentence_no, parts[i] AS sentence FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM
 (SELECT unit, page, string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM spec)))"""
STRENGTH_CASE = sql_case(STRENGTH, t="sentence", u=f"regexp_replace(sentence, '{MAY_DATE}', '', 'g')")
NORM_SQL = f"""{SENT_SQL}, norm AS (SELECT *, {STRENGTH_CASE} AS strength FROM sent WHERE NOT ((page <= 5 AND regexp_matches(sentence, '{LEGAL}')) OR regexp_matches(sentence, '{TOC}')))"""


@query(f"WITH {SENT_SQL} SELECT unit, sentence_no, sentence FROM sent")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return op.sentences(spec(spark, d), ["unit"])


TEST_CASE = sql_case(TESTABLE, "review_required", t="sentence")


@query(f"""WITH {NORM_SQL} SELECT unit, page, sentence_no, format('page-{{:04d}}-sem-{{:04d}}', page, row_number() OVER (PARTITION BY page ORDER BY unit, sentence_no)) AS semantic_id, sentence, strength,
nullif(trim(regexp_extract(sentence, '{op.REQ_ID}')), '') AS requirement_id, nullif(trim(regexp_extract(sentence, '{op.CONDITION}')), '') AS condition, nullif(trim(regexp_extract(sentence, '{op.EXCEPTION}')), '') AS exception,
list_sort(list_distinct(list_transform(regexp_extract_all(sentence, '{op.DEPENDENCY}'), lambda x: trim(x)))) AS dependencies, {TEST_CASE} AS testability,
CASE {TEST_CASE} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INTENT.items())} END AS intent FROM norm WHERE strength IS NOT NULL""")
def normative_units(spark: SparkSession, d: str) -> DataFrame:
    return op.requirements(spec(spark, d), ["unit"])


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, regexp_extract(text, '{LEGAL}') AS hit FROM lines WHERE regexp_matches(text, '{LEGAL}')""")
def legal_notice_filter(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter(F.col("text").rlike(LEGAL)).select("doc_id", "line_no", F.regexp_extract("text", LEGAL, 0).alias("hit"))


@query(f"""WITH {SPEC_SQL}, t AS (SELECT unit, trim(coalesce(nullif(regexp_extract(text, '^({TERM})\\s*:\\s+\\S', 1), ''), nullif(regexp_extract(text, '^({TERM})\\s+-\\s+\\S', 1), ''), nullif(regexp_extract(text, '(?i)^({TERM})\\s+(?:is\\s+defined\\s+as|means|refers\\s+to)\\s+\\S', 1), '')), ' .:-') AS term FROM spec)
SELECT unit, term FROM t WHERE len(regexp_split_to_array(term, '\\s+')) <= 8""")
def definition_terms(spark: SparkSession, d: str) -> DataFrame:
    return spec(spark, d).select("unit", op.definition_term("text").alias("term")).filter("term is not null")


@query(f"WITH {SPEC_SQL}, k AS (SELECT page, {sql_case(REVIEW_ONLY, t='text')} AS kind FROM spec) SELECT page, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def review_only_kinds(spark: SparkSession, d: str) -> DataFrame:
    return spec(spark, d).withColumn("kind", op.review_kind("text")).filter("kind is not null").groupBy("page", "kind").agg(F.count("*").alias("n"))


@query()
def crossref_targets(spark: SparkSession, d: str) -> DataFrame:
    return op.reference_rows(spec(spark, d), ["unit"]).select("unit", "target_type", "label")


@query()
def crossref_spans(spark: SparkSession, d: str) -> DataFrame:
    return op.reference_rows(spec(spark, d), ["unit"])


@query()
def crossref_resolve(spark: SparkSession, d: str) -> DataFrame:
    return op.resolve(crossref_targets(spark, d), supplier_targets(spark, d), ["unit"])


def supplier_targets(spark: SparkSession, d: str) -> DataFrame:
    """(target_type, label, target)"""
    s = table(spark, d, "supplier")
    label = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN cast(s_suppkey % 40 as string) ELSE concat(s_suppkey % 9 + 1, CASE WHEN s_suppkey % 4 = 1 THEN '.' ELSE '-' END, s_suppkey % 5 + 1) END")
    return s.select(F.when(F.col("s_suppkey") % 2 == 0, "table").otherwise("section").alias("target_type"), label.alias("label"), F.concat(F.lit("block-"), "s_suppkey").alias("target"))


LABELS = """CASE p_partkey % 6 WHEN 0 THEN concat('0x0', p_size) WHEN 1 THEN concat('00', p_size, 'h') WHEN 2 THEN concat(p_size, '.', p_partkey % 7) WHEN 3 THEN concat('REQ-', p_partkey) WHEN 4 THEN concat('Log Identifier ', p_size % 10, 'Ch') ELSE 'Table' END"""


@query(f"""SELECT p_partkey, {LABELS} AS label, CASE p_partkey % 6 WHEN 0 THEN concat('hex:', p_size) WHEN 1 THEN concat('hex:', p_size) WHEN 2 THEN concat(p_size, p_partkey % 7) WHEN 3 THEN concat('req', p_partkey) WHEN 4 THEN concat('hex:', CASE WHEN p_size % 10 > 0 THEN CAST(p_size % 10 AS VARCHAR) ELSE '' END, 'c') ELSE 'table' END AS key FROM part""")
def reference_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(LABELS).alias("label")).withColumn("key", ref_key("label"))


@query("""WITH p AS (SELECT o_orderkey AS unit, concat('1. open ', o_orderpriority, chr(10), 'note', chr(10), '- close ', o_orderstatus, chr(10), '2) done') AS text FROM orders),
l AS (SELECT unit, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, 5)) AS i FROM p))
SELECT unit, CAST(row_number() OVER (PARTITION BY unit ORDER BY i) AS INT) AS step_no, trim(regexp_replace(line, '^\\s*([-*+]|\\d+[.)])\\s+', '')) AS step FROM l WHERE regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+')""")
def procedure_steps(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("1. open "), "o_orderpriority", F.lit("\nnote\n- close "), "o_orderstatus", F.lit("\n2) done"))
    return op.steps(table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), text.alias("text")), ["unit"])


@query(f"""WITH {NORM_SQL}, a AS (SELECT unit, page, sentence_no AS ordinal, sentence AS text, nullif(regexp_extract(sentence, '{op.REQ_ID}'), '') AS requirement_id, 0 AS source_rank FROM norm WHERE strength IS NOT NULL),
b AS (SELECT unit, page, 0 AS ordinal, text, NULL AS requirement_id, 1 AS source_rank FROM spec WHERE {sql_case(REVIEW_ONLY, t='text')} IS NOT NULL),
c AS (SELECT unit, page, 0 AS ordinal, concat('REQ-', unit, ' row') AS text, concat('REQ-', unit) AS requirement_id, 2 AS source_rank FROM spec WHERE unit % 10 = 9),
u AS (SELECT *, row_number() OVER (PARTITION BY requirement_id, text ORDER BY source_rank, unit, ordinal) AS nth FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c))
SELECT unit, page, ordinal, text, requirement_id, source_rank, CAST(row_number() OVER (PARTITION BY page ORDER BY source_rank, unit, ordinal) AS INT) AS trace_no FROM u WHERE nth = 1""")
def requirement_trace(spark: SparkSession, d: str) -> DataFrame:
    s = spec(spark, d)
    a = op.requirements(s, ["unit"]).select("unit", "page", F.col("sentence_no").alias("ordinal"), F.col("sentence").alias("text"), F.nullif(F.regexp_extract("sentence", op.REQ_ID, 0), F.lit("")).alias("requirement_id"))
    b = s.filter(op.review_kind("text").isNotNull()).select("unit", "page", F.lit(0).alias("ordinal"), "text", F.lit(None).cast("string").alias("requirement_id"))
    c = s.filter("unit % 10 = 9").select("unit", "page", F.lit(0).alias("ordinal"), F.concat(F.lit("REQ-"), "unit", F.lit(" row")).alias("text"), F.concat(F.lit("REQ-"), "unit").alias("requirement_id"))
    return op.trace(a, b, c)


@query(f"""WITH {SPEC_SQL}, s AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS seed FROM spec) SELECT unit,
sha1(concat_ws(chr(31), 'abc', concat('[', page, ',', page + 1, ']'), 'A > B', 'text_block', concat('block-', unit), sha1(seed))) AS stable_source_id, sha1(concat_ws(chr(31), 'abc', 'A > B', concat('block-', unit), seed)) AS requirement_seed FROM s""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    s = spec(spark, d).withColumns({"seed": collapse("text"), "sha": F.lit("abc"), "path": F.lit("A > B"), "kind": F.lit("text_block"), "sid": F.concat(F.lit("block-"), "unit"), "last": F.col("page") + 1})
    return s.select("unit", ids.stable_source_id("sha", "page", "last", "path", "kind", "sid", "seed").alias("stable_source_id"), ids.requirement_seed("sha", "path", "sid", "seed").alias("requirement_seed"))


@query("""SELECT o_custkey AS cust, nullif(string_agg(DISTINCT concat('order-', o_orderkey), '|' ORDER BY concat('order-', o_orderkey)), '') AS dedupe_key FROM orders GROUP BY 1""")
def source_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    refs = F.collect_set(F.struct(F.lit("order").alias("source_type"), F.concat(F.lit("order-"), "o_orderkey").alias("source_id")))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(refs.alias("refs")).select("cust", ids.dedupe_key("refs").alias("dedupe_key"))
