"""Quality and domain queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DOMAIN_WORDS
from ..operators import domain as dom
from ..operators import quality as op
from ..operators import tables as tab
from ..session import table
from .corpus_data import rows
from .q_tables import NAMED_SQL
from .registry import query

_COUNT = lambda w: f"((length(low) - length(replace(low, '{w}', ''))) // {len(w)})"
_SCORES = " UNION ALL ".join(f"SELECT id, '{a}' AS adapter, " + " + ".join(f"{3 if w.startswith('+') else 1} * {_COUNT(w.lstrip('+'))}" for w in ws.split("|")) + " AS score FROM texts" for a, ws in DOMAIN_WORDS.items())
TEXTS = "texts AS (SELECT p_partkey AS id, lower(concat(CASE p_partkey % 6 WHEN 0 THEN 'The NVMe controller and namespace opcode ' WHEN 1 THEN 'PCIe link status and link control ' WHEN 2 THEN 'SPDM certificate chain, NVMe ' WHEN 3 THEN 'vendor shall comply with Customer Requirements ' WHEN 4 THEN 'locking range opal TCG ' ELSE '' END, p_name, ' ', p_type)) AS low FROM part)"
SCORE_SQL = f"{TEXTS}, scores AS ({_SCORES})"


def texts(spark: SparkSession, d: str) -> DataFrame:
    sql = TEXTS[TEXTS.index("SELECT") : -1].replace("FROM part", "FROM {part}").replace("AS low", "AS text")
    return spark.sql(sql, part=table(spark, d, "part"))


@query(f"WITH {SCORE_SQL} SELECT id, adapter, CAST(score AS INT) AS score FROM scores")
def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    return dom.scores(texts(spark, d), ["id"])


@query(f"""WITH {SCORE_SQL}, r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS nxt, lead(adapter) OVER w AS second FROM scores WINDOW w AS (PARTITION BY id ORDER BY score DESC, adapter))
SELECT id, CASE WHEN score > 0 THEN adapter END AS adapter, CAST(score AS INT) AS score, CASE WHEN nxt > 0 THEN second END AS runner_up, CAST(score - nxt AS INT) AS margin,
CASE WHEN score <= 0 THEN 'none' WHEN score >= 4 AND score >= nxt + 2 THEN 'high' WHEN score >= 2 AND score > nxt THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE nth = 1""")
def domain_recommendation(spark: SparkSession, d: str) -> DataFrame:
    return dom.recommend(texts(spark, d), ["id"])


_CASE = lambda k: "CASE unit_type " + " ".join(f"WHEN '{u[0]}' THEN {u[k] if k > 1 else repr(u[k])}" for u in dom.NVME_UNITS) + " END"
UNITS_SQL = f"""{NAMED_SQL}, u AS (SELECT row_id, page, {_CASE(1)} AS domain_type, {_CASE(2)} AS name, {_CASE(3)} AS value FROM typed), o AS (SELECT *, row_number() OVER (PARTITION BY domain_type, name, value ORDER BY row_id) AS nth FROM u WHERE domain_type IS NOT NULL),
units AS (SELECT row_id, page, domain_type, name, value, CAST(row_number() OVER (PARTITION BY page ORDER BY row_id) AS INT) AS unit_no FROM o WHERE nth = 1)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    return dom.units(tab.typed_rows(rows(spark, d)))


@query(f"WITH {UNITS_SQL} SELECT * FROM units")
def domain_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d)


@query(f"""WITH {UNITS_SQL}, f AS (SELECT domain_type, field FROM (VALUES ('command', 'name'), ('command', 'value'), ('log_page', 'value'), ('status_code', 'hex'), ('register_field', 'value')) v(domain_type, field)),
c AS (SELECT page, units.domain_type, field, count(*) AS units, count(*) FILTER (CASE field WHEN 'name' THEN name <> '' WHEN 'value' THEN value <> '' WHEN 'hex' THEN regexp_matches(value, '^0[12]h$') END) AS present FROM units LEFT JOIN f ON f.domain_type = units.domain_type GROUP BY ALL)
SELECT page, domain_type, field, units, present, round(present / units, 4) AS ratio FROM c""")
def coverage_by_field(spark: SparkSession, d: str) -> DataFrame:
    return page_coverage(spark, d)


def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("command", "name"), ("command", "value"), ("log_page", "value"), ("status_code", "hex"), ("register_field", "value")], "domain_type string, field string")
    u = units(spark, d).withColumn("fields", dom.normalised({"name": F.col("name"), "value": F.col("value"), "hex": F.when(F.col("value").rlike("^0[12]h$"), F.col("value"))}))
    return dom.coverage(u, expected, ["page"])


@query(f"""WITH {UNITS_SQL}, f AS (SELECT domain_type, field FROM (VALUES ('command', 'name'), ('command', 'value'), ('log_page', 'value'), ('status_code', 'hex'), ('register_field', 'value')) v(domain_type, field))
SELECT units.domain_type, field, count(*) AS units, count(*) FILTER (CASE field WHEN 'name' THEN name <> '' WHEN 'value' THEN value <> '' WHEN 'hex' THEN regexp_matches(value, '^0[12]h$') END) AS present,
round(count(*) FILTER (CASE field WHEN 'name' THEN name <> '' WHEN 'value' THEN value <> '' WHEN 'hex' THEN regexp_matches(value, '^0[12]h$') END) / count(*), 4) AS ratio FROM units LEFT JOIN f ON f.domain_type = units.domain_type GROUP BY units.domain_type, field""")
def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    return dom.merged_coverage(page_coverage(spark, d))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def provenance_missing_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return op.missing_refs(table(spark, d, "orders"), known, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice AS actual FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS l_quantity FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE abs(l_quantity - o_totalprice) > 50000""")
def provenance_mismatch(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("l_quantity"))
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_quantity"))
    return op.mismatched_refs(refs, records, ["l_orderkey"], "l_quantity", 50000.0)


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS nth FROM orders) WHERE nth > 1""")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return op.duplicate_ids(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderkey")


FIND_SQL = """f AS (SELECT 'error' AS severity, 'empty_text' AS code, 'text' AS field, CAST(doc_id AS VARCHAR) AS record_id, source FROM documents WHERE length(text) < 60
UNION ALL SELECT 'warning', 'long_text', 'n_chars', CAST(doc_id AS VARCHAR), source FROM documents WHERE n_chars > 8000 UNION ALL SELECT 'info', 'has_mail', 'text', CAST(doc_id AS VARCHAR), source FROM documents WHERE regexp_matches(text, '@')
UNION ALL SELECT 'error', 'length_mismatch', 'n_chars', CAST(doc_id AS VARCHAR), source FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'error', 'bad_lang', 'lang', CAST(doc_id AS VARCHAR), source FROM documents WHERE lang NOT IN ('en', 'fr', 'de'))"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        ("error", "empty_text", "text", F.char_length("text") < 60), ("warning", "long_text", "n_chars", F.col("n_chars") > 8000), ("info", "has_mail", "text", F.col("text").rlike("@")),
        ("error", "length_mismatch", "n_chars", F.col("n_chars") != F.char_length("text")), ("error", "bad_lang", "lang", ~F.col("lang").isin("en", "fr", "de")),
    ]
    return op.check(table(spark, d, "documents"), "doc_id", rules)


@query(f"WITH {FIND_SQL} SELECT severity, code, field, record_id FROM f")
def index_contract(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d)


@query(f"""WITH {FIND_SQL}, g AS (SELECT code, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f GROUP BY code)
SELECT *, CASE WHEN error > 0 THEN 'failed' WHEN warning > 0 THEN 'warning' ELSE 'passed' END AS status FROM g""")
def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return op.by_severity(findings(spark, d), "code")


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS reason FROM benchmark) GROUP BY 1""")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.reason_counts(table(spark, d, "benchmark").select(F.split("text", " ").alias("r")), "r")


PAGE_SQL = """w AS (SELECT l_orderkey AS page, count(*) AS n FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1),
p AS (SELECT o_custkey AS job, o_orderkey AS page, coalesce(n, 0) AS warnings, CASE WHEN CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END = 'success' AND coalesce(n, 0) > 0 THEN 'partial' ELSE CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END END AS status FROM orders LEFT JOIN w ON page = o_orderkey)"""


def statuses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"))
    return op.page_status(p, table(spark, d, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("page")), ["page"])


@query(f"WITH {PAGE_SQL} SELECT * FROM p")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d)


@query(f"""WITH {PAGE_SQL}, j AS (SELECT job, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'success' END AS status, count(*) AS n_pages FROM p GROUP BY job) SELECT *, CASE WHEN status = 'success' THEN 0 ELSE 2 END AS exit_code FROM j""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    return op.job_status(statuses(spark, d), ["job"])


SIG_SQL = """sig AS (SELECT l_returnflag AS category, l_linestatus AS adapter, CAST(l_suppkey % 7 AS VARCHAR) AS domain, count(DISTINCT l_orderkey) AS documents, count(*) AS failures,
left(sha256(concat_ws('|', l_returnflag, l_linestatus, CAST(l_suppkey % 7 AS VARCHAR))), 16) AS signature_id FROM lineitem WHERE {} GROUP BY l_returnflag, l_linestatus, l_suppkey % 7)"""


def failing(spark: SparkSession, d: str, where: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(where).select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("adapter"), (F.col("l_suppkey") % 7).cast("string").alias("domain"), "l_orderkey")
    return op.signatures(li, ["category", "adapter", "domain"], "l_orderkey")


@query(f"WITH {SIG_SQL.format('l_quantity > 25')} SELECT * FROM sig")
def failure_signatures(spark: SparkSession, d: str) -> DataFrame:
    return failing(spark, d, "l_quantity > 25")


@query(f"WITH {SIG_SQL.format('l_quantity > 25')} SELECT category, adapter, domain, count(*) AS signatures, sum(documents) AS documents FROM sig GROUP BY GROUPING SETS ((category), (adapter, domain))")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return op.hotspots(failing(spark, d, "l_quantity > 25"))


@query(f"""WITH {SIG_SQL.format('l_quantity > 25 AND l_suppkey % 7 <> 2')}, cur AS (SELECT left(sha256(concat_ws('|', l_returnflag, l_linestatus, CAST(l_suppkey % 7 AS VARCHAR))), 16) AS signature_id, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_quantity > 40 AND l_suppkey % 7 <> 5 GROUP BY ALL)
SELECT signature_id, s.documents AS baseline, c.documents AS "current", CASE WHEN s.documents IS NULL THEN 'added' WHEN c.documents IS NULL THEN 'resolved' ELSE 'persisting' END AS status FROM sig s FULL JOIN cur c USING (signature_id)""")
def trend_report(spark: SparkSession, d: str) -> DataFrame:
    return op.trend(failing(spark, d, "l_quantity > 25 AND l_suppkey % 7 <> 2"), failing(spark, d, "l_quantity > 40 AND l_suppkey % 7 <> 5"), "signature_id", "documents")


@query("""SELECT l_returnflag, metric, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY ALL""")
def metric_groups(spark: SparkSession, d: str) -> DataFrame:
    return op.metric_groups(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query("""WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey, b.v AS "current", a.v AS baseline FROM b JOIN a USING (o_custkey) WHERE a.v > 0 AND b.v > a.v * 1.2::DOUBLE""")
def performance_gate(spark: SparkSession, d: str) -> DataFrame:
    half = lambda k: table(spark, d, "orders").filter(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return op.regressions(half(0), half(1), ["o_custkey"], "v")


@query("""WITH kv AS (SELECT event_id, unnest(json_keys(props)) AS field, props FROM events) SELECT event_id, field, json_extract_string(props, '$.' || field) AS value FROM kv WHERE regexp_matches(json_extract_string(props, '$.' || field), '[02468]$')""")
def confidential_scan(spark: SparkSession, d: str) -> DataFrame:
    return op.leaves(table(spark, d, "events"), "event_id", "props", "[02468]$")


@query("""SELECT e.lang, e.source, CAST(least_n AS BIGINT) AS least_n, coalesce(n, 0) AS n FROM (SELECT lang, source, 3 AS least_n FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)) e LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY ALL) a ON a.lang = e.lang AND a.source = e.source WHERE coalesce(n, 0) < 3""")
def coverage_expectations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    both = docs.agg(F.collect_set("lang").alias("langs"), F.collect_set("source").alias("sources"))  # two short lists
    expected = both.select(F.explode("langs").alias("lang"), "sources").select("lang", F.explode("sources").alias("source"), F.lit(3).cast("long").alias("least_n"))
    return op.expectation_failures(expected, docs.filter("n_chars > 2000").groupBy("lang", "source").agg(F.count("*").alias("n")), ["lang", "source"])
