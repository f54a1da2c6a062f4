"""Scalar text functions as column expressions. \\w, \\s and \\b are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Words = str | Column


def col(c: Words) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Words) -> Column:
    """Distinct lower-case tokens in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9_]+)"), F.lit(1)))


def char_tokens(c: Words) -> Column:
    return F.floor((F.char_length(col(c)) + 3) / 4).cast("int")


def regex_tokens(c: Words) -> Column:
    return F.regexp_count(col(c), F.lit(r"\w+|[^\w\s]"))


def collapse(c: Words) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def digit_mask(c: Words) -> Column:
    return F.regexp_replace(F.lower(collapse(c)), r"[0-9]+", "#")


def clean_key(c: Words) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def slug(c: Words, cap: int = 96) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.nullif(F.left(s, F.lit(cap)), F.lit(""))


def search_key(c: Words) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "), F.lit(" ")), F.lit(""))


def leading_index(c: Words) -> Column:
    return F.nullif(F.regexp_extract(F.trim(col(c)), r"^(\d+(\.\d+)*)\s+\S", 1), F.lit(""))


def heading_level(index: Words) -> Column:
    i = col(index)
    return F.when(i.isNull(), 1).otherwise(F.least(F.char_length(i) - F.char_length(F.replace(i, F.lit("."), F.lit(""))) + 1, F.lit(6)))


def sentence_list(c: Words) -> Column:
    """Sentences of a text, by lines, then after [.!?] before an opening."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), F.trim), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[!?.])\s+(?=[(\[0-9A-Z])")))
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def nfc(c: Words) -> Column:
    """NFC by Arrow batch; ASCII texts pass untouched."""
    @F.pandas_udf("string")
    def run(batch):
        import unicodedata

        return batch.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return run(col(c))


def seed_text(c: Words) -> Column:
    return collapse(nfc(c))


def ref_key(c: Words) -> Column:
    """Comparison key of a reference label: 0x02 and 02h are hex:2, hex words
    with a letter too, everything else loses its punctuation."""
    prefixes = r"(?i)^(?:log identifier|log page|lid|feature identifier|fid|requirement|req|opcode|command opcode|register|capability) "
    t = F.btrim(F.regexp_replace(F.btrim(col(c), F.lit(" .,;:")), prefixes, ""), F.lit(" .,;:"))
    digits = F.regexp_extract(t, r"(?i)^(0x[a-f\d]+|[a-f\d]+h|\d*[a-f][a-f\d]*)$", 0)
    hexed = F.regexp_replace(F.regexp_replace(F.lower(digits), "^0x|h$", ""), "^0+(?=.)", "")
    return F.when(digits != "", F.concat(F.lit("hex:"), hexed)).otherwise(clean_key(t))


def preview(c: Words, limit: int = 180) -> Column:
    t = collapse(c)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 3))), F.lit("...")))


def page_suffix(prefix: str, page: Words, kind: str, n: Words) -> Column:
    return F.format_string(f"{prefix}-%04d-{kind}-%04d", col(page).cast("int"), col(n).cast("int"))
