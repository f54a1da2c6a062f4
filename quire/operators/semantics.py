"""Semantic units of texts: sentences, norms, definitions, requirements,
references and their resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import INTENT, LEGAL, MAY_DATE, REVIEW_ONLY, STRENGTH, TERM, TESTABLE, TOC
from ..functions.text import ref_key, sentence_list

REQ_ID = r"(?i)\b[a-z][0-9a-z]{1,12}(-[0-9a-z]{1,12})*-\d+\b"
CONDITION = r"(?i)\b(if|provided that|unless|when|where)\b[^.;]*"
EXCEPTION = r"(?i)\b(except|excluding|unless)\b[^.;]*"
DEPENDENCY = r"(?i)\b(according to|as specified in|per|see)\s+(Clause|Figure|Requirement|Section|Table)\s+[-\w.]+"


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a sentence, `sentence_no` from 0."""
    return df.select(*keys, F.posexplode(sentence_list(text)).alias("sentence_no", "sentence"))


def strength(text: str) -> Column:
    """prohibited > required > recommended > optional, else null. "may" before
    a day or a year is a month."""
    return F.expr(c_sql(STRENGTH, t=text, u=f"regexp_replace({text}, r'{MAY_DATE}', '')"))


def c_sql(rules, otherwise: str | None = None, **names: str) -> str:
    """Rule text over named expressions, as Spark SQL."""
    end = "NULL" if otherwise is None else f"'{otherwise}'"
    text = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in rules) + f" ELSE {end} END"
    text = re.sub(r"\brx\((\w+), '((?:[^']|'')*)'\)", lambda m: f"({names.get(m[1], m[1])} rlike r'{m[2]}')", text)
    for k, v in names.items():
        text = re.sub(rf"(?<![\w'\\])\b{k}\b(?= (?:LIKE|IN|=|AND|OR|THEN))", lambda _, v=v: v, text)
    return text


def is_noise(text: str, page: str) -> Column:
    """Legal notices of the first pages and headings of contents."""
    return ((F.col(page) <= 5) & F.col(text).rlike(LEGAL)) | F.col(text).rlike(TOC)


def definition_term(text: str) -> Column:
    """The defined term of at most eight words."""
    t = F.trim(text)
    forms = [rf"^({TERM})\s*:\s+\S", rf"^({TERM})\s+-\s+\S", rf"(?i)^({TERM})\s+(?:is\s+defined\s+as|means|refers\s+to)\s+\S"]
    term = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in forms])
    term = F.btrim(term, F.lit(" .:-"))
    return F.when(F.size(F.split(term, r"\s+")) <= 8, term)


def first(text: str, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit(""))


def dependencies(text: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DEPENDENCY), F.lit(0)), F.trim)))


def testability(text: str) -> Column:
    return F.expr(c_sql(TESTABLE, "review_required", t=text))


def intent(hint: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in INTENT.items() for x in kv]), F.col(hint))


def review_kind(text: str) -> Column:
    return F.expr(c_sql(REVIEW_ONLY, t=text))


def page_keys(df: DataFrame) -> list[str]:
    """A page is one of its document, where the relation has documents."""
    return [c for c in ("doc_id", "page") if c in df.columns]


def requirements(units: DataFrame, keys: list[str]) -> DataFrame:
    """Normative sentences with their parts, numbered by page of a document."""
    keys = [k for k in keys if k not in page_keys(units)]
    at = page_keys(units)
    s = sentences(units, [*keys, *at]).filter(~is_noise("sentence", "page")).withColumn("strength", strength("sentence")).filter("strength is not null")
    number = F.row_number().over(Window.partitionBy(*at).orderBy(*keys, "sentence_no"))
    return s.select(
        *keys, *at, "sentence_no", F.format_string("page-%04d-sem-%04d", F.col("page"), number).alias("semantic_id"), "sentence", "strength", first("sentence", REQ_ID).alias("requirement_id"),
        first("sentence", CONDITION).alias("condition"), first("sentence", EXCEPTION).alias("exception"), dependencies("sentence").alias("dependencies"), testability("sentence").alias("testability"),
    ).withColumn("intent", intent("testability"))


_MULTI = re.compile(r"\b(section|clause)s?\s+(\d+(\.\d+)*(\s*(,|or|and)\s*\d+(\.\d+)*)+)", re.I)
_SINGLE = re.compile(r"\b(section|clause|table|figure|appendi(?:x|ce))s?\s+([0-9a-z]+([-.][0-9a-z]+)*)", re.I)
_HEX = r"(0x[a-f\d]+|[a-f\d]+h)\b"
_EXTRA = [
    ("requirement", re.compile(r"\breq(?:uirement)?\.?(?:\s+id)?\s+([a-z][0-9a-z]{1,12}(-[0-9a-z]{1,12})*-\d+)\b", re.I)),
    ("log_page", re.compile(rf"\b(?:lid|log\s+(?:page|identifier))\s+{_HEX}", re.I)),
    ("feature", re.compile(rf"\b(?:fid|feature\s+identifier)\s+{_HEX}", re.I)),
    ("opcode", re.compile(rf"\b(?:command\s+)?opcode\s+{_HEX}", re.I)),
]


def references(text: str | None) -> list[tuple[str, str, int, int]]:
    """(type, label, start, end) of the references of a text in span order:
    lists of sections first, single references where those don't reach."""
    text, out, spans = text or "", [], []
    kinds = {"clause": "section", "appendice": "appendix"}
    for m in _MULTI.finditer(text):
        out += [("section", x, m.start(), m.end()) for x in re.findall(r"\d[.\d]*\d|\d", m[2])]
        spans.append(m.span())
    for m in _SINGLE.finditer(text):
        if not any(m.start() < b and a < m.end() for a, b in spans):
            kind = m[1].lower()
            out.append((kinds.get(kind, kind), m[2], m.start(), m.end()))
    for kind, pattern in _EXTRA:
        out += [(kind, m[1], m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[2], x[3]))


def reference_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a reference; offsets need a scan, which runs by Arrow batch."""
    @F.pandas_udf("array<struct<target_type:string,label:string,start:int,end:int>>")
    def run(batch):
        return batch.map(lambda t: [{"target_type": a, "label": b, "start": c, "end": e} for a, b, c, e in references(t)])

    return df.select(*keys, F.posexplode(run(text)).alias("ref_no", "r")).select(*keys, "ref_no", "r.*")


def resolve(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """refs (keys, target_type, label) against targets (target_type, label,
    target): the exact label decides, else the comparison key. target is null
    if missing or if several targets share the key."""
    exact = targets.groupBy("target_type", "label").agg(F.max("target").alias("exact"))
    known = targets.withColumn("key", ref_key("label")).groupBy("target_type", "key").agg(F.countDistinct("target").alias("n"), F.min("target").alias("only"))
    types = targets.select("target_type").distinct().withColumn("has_type", F.lit(True))
    j = refs.withColumn("key", ref_key("label")).join(exact, ["target_type", "label"], "left").join(known, ["target_type", "key"], "left").join(types, "target_type", "left")
    target = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    reason = F.when(target.isNotNull(), None).when(F.col("n") > 1, "ambiguous_target").when(F.col("has_type").isNull(), "missing_target_type").otherwise("missing_target_label")
    return j.select(*keys, "target_type", "label", "key", F.coalesce("n", F.lit(0)).cast("int").alias("candidates"), target.alias("target"), reason.alias("unresolved_reason"))


def steps(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Steps of list blocks: their lines without the marker."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return lines.select(*keys, number.alias("step_no"), F.trim(F.regexp_replace("line", r"^\s*([-*+]|\d+[.)])\s+", "")).alias("step"))


def trace(requirements_: DataFrame, review: DataFrame, rows_: DataFrame) -> DataFrame:
    """Union of text requirements, review-only units and table requirements:
    the first of equal (requirement_id, text) by source order, renumbered."""
    parts = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate((requirements_, review, rows_))]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    key = Window.partitionBy("requirement_id", "text").orderBy("source_rank", "unit", "ordinal")
    once = u.withColumn("nth", F.row_number().over(key)).filter("nth = 1").drop("nth")
    return once.withColumn("trace_no", F.row_number().over(Window.partitionBy(*page_keys(once)).orderBy("source_rank", "unit", "ordinal")))
