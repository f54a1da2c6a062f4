"""Ordered rule tables. A rule is (result, condition as SQL text); the first
that holds wins. `rx(c, 'p')` is a regular-expression search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]
_RX = re.compile(r"\brx\(")


def spark_sql(condition: str) -> str:
    """Rule text as Spark SQL (raw string literals keep backslashes)."""
    return re.sub(r"rx\((\w+), '((?:[^']|'')*)'\)", lambda m: f"({m[1]} rlike r'{m[2]}')", condition)


def first_match(rules: Rules, otherwise: str | None = None) -> Column:
    end = "NULL" if otherwise is None else f"'{otherwise}'"
    return F.expr("CASE " + " ".join(f"WHEN {spark_sql(c)} THEN '{r}'" for r, c in rules) + f" ELSE {end} END")


LINE_TYPE: Rules = [
    ("toc_line", r"rx(t, '[.][.][.][.][.]+\s*\d+\s*$')"),
    ("heading_index", r"rx(t, '^\d+([.]\d+)+\s+\S')"),
    ("figure_caption", r"rx(t, '(?i)^(도표|그림|fig(ure|[.])?)\s+\d')"),
    ("table_caption", r"rx(t, '(?i)^(표|table)\s+\d')"),
    ("list_item", r"rx(t, '^\s*(\d+[).]|[*-])\s+\S')"),
]

STRENGTH: Rules = [
    ("prohibited", r"rx(t, '(?i)\b(prohibited|shall\s+never|(may|must|shall)\s+not)\b')"),
    ("required", r"rx(t, '(?i)\b(mandatory|must|required|shall)\b')"),
    ("recommended", r"rx(t, '(?i)\b(recommended|should)\b')"),
    ("optional", r"rx(u, '(?i)\b(optional|may)\b')"),  # u: the text without "may" before a day or year
]
MAY_DATE = r"(?i)\bmay\s+(\d{4}|\d{1,2})\b"

LEGAL = r"(?i)\b(trademark|proprietary|permission|licensed?|warrant(y|ies)|liabilit(y|ies)|disclaimer|copyright|no\s+part\s+of\s+this\s+publication|all\s+rights\s+reserved)\b"
TOC = r"(?i)^\s*(contents|table\s+of\s+contents)\s*$"
TERM = r"[A-Z][-\w ()/]{1,80}"

TESTABLE: Rules = [
    ("unknown", r"NOT rx(t, '(?i)\b(clear|match|measure|must|report|return|set|shall be|shall not|support|test|verify)\b')"),
    ("directly_testable", r"rx(t, '(?i)clear|match|measure|report|return|set')"),
    ("conformance_check", r"rx(t, '(?i)must|shall be|shall not|support')"),
]
INTENT = {"directly_testable": "direct_test", "conformance_check": "conformance_check", "review_required": "manual_review", "unknown": "unknown"}

REVIEW_ONLY: Rules = [
    ("note", r"rx(t, '(?i)^\s*note(\s+\d+)?\s*[-.:]\s+\S')"),
    ("example", r"rx(t, '(?i)^\s*examples?\s*[-.:]\s+\S')"),
    ("definition", r"rx(t, '(?i)^\s*" + TERM + r"\s*(-|:|\s+(is\s+defined\s+as|means|refers\s+to))\s+\S')"),
    ("legal_notice", f"rx(t, '{LEGAL}')"),
]

STATUS_GROUP: Rules = [
    ("generic", r"k IN ('0','0h','00h','x0','x00','0x0','0x00') OR t LIKE '%generic%'"),
    ("command_specific", r"k IN ('1','1h','01h','x1','x01','0x1','0x01') OR t LIKE '%command specific%'"),
    ("media_data_integrity", r"k IN ('2','2h','02h','x2','x02','0x2','0x02') OR (t LIKE '%media%' AND t LIKE '%integrity%')"),
    ("path_related", r"k IN ('3','3h','03h','x3','x03','0x3','0x03') OR t LIKE '%path%'"),
    ("vendor_specific", "t LIKE '%vendor%'"),
    ("reserved", "t LIKE '%reserved%'"),
]
ERROR_CLASS: Rules = [
    ("success", "z AND (d LIKE '%success%' OR g = 'generic')"),
    ("aborted_command", "d LIKE '%abort%'"),
    ("timeout", "d LIKE '%timeout%' OR d LIKE '%time out%'"),
    ("invalid_address", "d LIKE '%lba%' AND (d LIKE '%range%' OR d LIKE '%invalid%')"),
    ("invalid_request", "d LIKE '%invalid%' OR d LIKE '%unsupported%' OR d LIKE '%not supported%'"),
    ("data_integrity", "d LIKE '%integrity%' OR d LIKE '%crc%' OR d LIKE '%guard%'"),
    ("conflict", "d LIKE '%conflict%'"),
]
RETRY: Rules = [
    ("not_applicable", "e = 'success' OR z"),
    ("do_not_retry", "d LIKE '%not retry%' OR d LIKE '%non-retry%'"),
    ("correct_command", "d LIKE '%correct%' OR d LIKE '%invalid%' OR d LIKE '%out of range%' OR d LIKE '%not supported%'"),
    ("retry_allowed", "d LIKE '%retry%'"),
]

SCOPE: Rules = [("admin", "t LIKE '%admin%'"), ("io", r"t LIKE '%i/o%' OR t LIKE '%i-o%' OR rx(t, '\bio\b') OR t LIKE '%nvm command%'")]
POINTER: Rules = [("metadata", r"rx(t, '\bmetadata\s+pointer\b') OR t LIKE '%mptr%'"), ("data", r"rx(t, '\bdata\s+pointer\b') OR rx(t, '\bdptr\b')")]

FIGURE_KIND: Rules = [
    ("register_map", "rx(t, '(address|memory|register) map')"),
    ("register_layout", "rx(t, 'bit ?field|bits |register layout')"),
    ("waveform", "rx(t, 'signal trace|waveform')"),
    ("block_diagram", "rx(t, 'architecture diagram|block diagram|system architecture')"),
    ("flow_diagram", "rx(t, 'flow diagram|flowchart|process flow')"),
    ("table_like_image", "rx(t, 'grid layout|matrix|table[- ]like')"),
    ("state_machine", "rx(t, 'state (diagram|machine|transition)')"),
    ("sequence_diagram", "rx(t, 'message sequence|sequence diagram|timing diagram')"),
    ("diagram", "rx(t, 'architecture|diagram|flow')"),
]

# adapter -> keywords; an anchor (marked +) counts three times
DOMAIN_WORDS = {
    "nvme": "+nvm command set|+nvm express|+nvme|admin command|cdw|command dword|completion queue|controller|identify controller|identify namespace|io command|namespace|opcode|submission queue",
    "pcie": "+pci express|+pci-sig|+pcie|capability id|configuration space|device control|extended capability|lane margining|link control|link status|ltssm|tlp|transaction layer packet",
    "ocp": "+data center nvme ssd|+datacenter nvme ssd|+ocp|+open compute project|cloud ssd|latency monitor|nvme cloud ssd|requirement id|ssd requirements|telemetry profile",
    "spdm": "+dsp0274|+dsp0286|+spdm|certificate chain|challenge_auth|get_measurements|key exchange|security protocol and data model",
    "tcg": "+opal|+tcg|+trusted computing group|locking range|pyrite|security method|security object|storage architecture core",
    "caliptra": "+caliptra|dice|dpe|mailbox|root of trust|rot service|rtrec|soc root of trust",
    "customer-requirements": "+compliance matrix|+customer requirement|+customer requirements|acceptance criteria|customer shall|customer specification|customer-requirements|product requirement|shall comply|supplier shall|vendor requirement|vendor requirements|vendor shall",
}

HEX = r"(?i)(0x[a-f\d]+|[a-f\d]+h)"
