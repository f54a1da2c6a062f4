"""Chunks: budgeted merge and split, neighbours, sections, context text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import giving_back, slices
from ..functions.ids import parent_section

TECHNICAL_PRIORITY = dict(status_code=90, command_pointer_field=94, command_dword_field=94, command_opcode=96)
DOMAIN_PRIORITY = dict(status_code=96, command_pointer_field=97, command_dword_field=97, command=98)


def greedy_groups(df: DataFrame, keys: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """df with `grp`: rows of a key in order, packed greedily: a row opens a
    new group when the running size would pass the budget. An ordered fold a
    key; a key is one document (or section), which bounds it."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("z")))).alias("xs"))
    @F.pandas_udf("array<struct<o:bigint,g:int>>")
    def fold(batch):
        def one(xs):
            total, g, out = 0, 0, []
            for x in xs:
                if out and total + x["z"] > budget:
                    total, g = 0, g + 1
                total += x["z"]
                out.append({"o": x["o"], "g": g})
            return out

        return batch.map(one)

    placed = packed.select(*keys, F.explode(fold("xs")).alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.g").alias("grp"))
    return df.join(placed, [*keys, order])


def split_text(text: str | None, max_chars: int) -> list[str]:
    """Parts of at most max_chars: cut at the last sentence end, else at a
    line break or space past half of the budget, else at the budget."""
    out, rest = [], (text or "").strip()
    while len(rest) > max_chars:
        head = rest[:max_chars]
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", head)]
        soft = max(head.rfind("\n"), head.rfind(" "))
        at = ends[-1] if ends else soft if soft >= max_chars // 2 else max_chars
        if part := rest[:at].strip():
            out.append(part)
        rest = rest[at:].strip()
    return [*out, rest] if rest else out


def split_chunks(df: DataFrame, text: str, max_chars: int) -> DataFrame:
    """One row a part: part_index from 1, part_count, part."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 200):
            cut = [split_text(t, max_chars) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.list_(pa.string()))], [*batch.schema.names, "parts"])

    parts = df.mapInArrow(giving_back(run), StructType([*df.schema.fields, StructField("parts", ArrayType(StringType()))]))
    return parts.select(*df.columns, F.size("parts").alias("part_count"), F.posexplode("parts").alias("pos", "part")).withColumn("part_index", F.col("pos") + 1).drop("pos")


def relate(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Neighbours in the group, position in the section, anchors of the
    section and of its parent. chunks: doc, chunk_index, chunk_id, group_id,
    section_path."""
    group = Window.partitionBy(doc, "group_id").orderBy("chunk_index")
    section = Window.partitionBy(doc, "section_path").orderBy("chunk_index")
    whole = lambda *c: Window.partitionBy(*c)
    c = chunks.select(
        "*",
        F.row_number().over(group).alias("group_index"), F.count("*").over(whole(doc, "group_id")).alias("group_count"), F.lag("chunk_id").over(group).alias("previous_id"), F.lead("chunk_id").over(group).alias("next_id"),
        F.row_number().over(section).alias("section_index"), F.count("*").over(whole(doc, "section_path")).alias("section_count"), F.first("chunk_id").over(section).alias("anchor_id"),
        parent_section("section_path").alias("parent_path"),
    )
    anchors = chunks.groupBy(doc, F.col("section_path").alias("parent_path")).agg(F.min_by("chunk_id", "chunk_index").alias("parent_anchor_id"))
    c = c.join(anchors, [doc, "parent_path"], "left")
    related = F.array_distinct(F.array_compact(F.array("previous_id", "next_id", "anchor_id", "parent_anchor_id")))
    return c.withColumn("related_ids", F.filter(related, lambda x: x != F.col("chunk_id"))).withColumn("anchor_id", F.nullif("anchor_id", "chunk_id"))


def priority(unit_type: str = "unit_type", table: dict[str, int] = TECHNICAL_PRIORITY, other: int = 88) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(known, F.col(unit_type)), F.lit(other))


def context_text(parts: list[tuple[str, Column]], text: str = "text") -> Column:
    """"Label: value" lines for what is present, then the text itself."""
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Text: "), F.col(text)))


def unique_refs(df: DataFrame, key: list[str], refs: str) -> DataFrame:
    """refs of a key without repeats, in order of first occurrence."""
    e = df.select(*key, F.posexplode(refs).alias("pos", "ref"))
    first = e.groupBy(*key, "ref").agg(F.min("pos").alias("pos"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias(refs))
