"""Technical table rows: named cells under many header aliases, header hints,
and the ordered rules that give a row its type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import spark_sql
from .semantics import c_sql
from .tables import settled, cell, keyed

HEX = r"(?i)\b(0x[0-9a-f]+|[0-9a-f]+h)\b"
REQ = r"(?i)\b[A-Z][A-Z0-9]{1,12}(-[A-Z0-9]{1,12})*-\d+\b"
DW = r"(?i)\b(command\s+dword|cdw|dword|dw)\s*\d{1,2}\b"
NAMES = {
    "command": ("Command", "Command Name", "Name", "2 Command"), "opcode": ("Opcode", "Command Opcode", "Combined Opcode", "Combined Opcode 1", "Combined Opcode 2"),
    "field": ("Field", "Field Name", "Parameter", "Command Dword Field", "CDW Field", "Dword Field", "Pointer Field", "Data Pointer Field", "Metadata Pointer Field", "Queue Field", "Namespace Field", "Controller Field", "Data Structure Field", "Security Field"),
    "bits": ("Bits", "Bit", "Bit Range"), "description": ("Description", "Definition", "Meaning", "Security Description", "Requirement Description"), "log_id": ("Log Identifier", "LID", "Log Page", "Log Page Identifier", "Identifier"),
    "feature_id": ("Feature Identifier", "FID", "Feature"), "register": ("Register", "Register Name", "Property"), "offset_": ("Offset", "Address"), "sct_cell": ("Status Code Type", "SCT"), "sc_cell": ("Status Code", "Status Code Value", "SC", "Code"),
    "raw_value": ("Value",), "affected": ("Commands Affected",), "support": ("Controller Support", "Controller Support Requirements", "Namespace Support", "Namespace Support Requirements", "NVM Subsystem", "Support", "Supported", "Support Requirement"),
    "queue": ("Queue", "Queue Type"), "structure": ("Data Structure", "Structure"), "dword_cell": ("Command Dword", "Command Dword Number", "Command DW", "CDW", "Dword", "DW"), "pointer_cell": ("Pointer", "Pointer Type", "Command Pointer", "Data Pointer", "Metadata Pointer"),
    "method": ("Method", "Method ID"), "object_": ("Object", "Object ID"), "provider": ("Security Provider", "SP", "Provider"), "locking": ("Locking Range", "Range"), "key_name": ("Key", "Key Name", "Key Management"), "session_state": ("Session State", "Session", "State"),
    "authority": ("Authority",), "uid": ("UID", "Protocol ID", "ProtocolID"), "security_field": ("Security Field",), "value": ("Value", "Status", "Code"), "message": ("Message", "Message Name", "Command"), "message_code": ("Message Code", "Code", "Request Code", "Response Code"),
    "request": ("Request", "Request Message"), "response": ("Response", "Response Message"), "measurement": ("Measurement", "Measurement Index", "Measurement Block", "Measurement Type"), "certificate": ("Certificate", "Certificate Slot", "Slot"),
    "algorithm": ("Algorithm", "Algorithm Type", "Base Asym Algo", "Hash Algorithm"), "key_exchange": ("Key Exchange", "KeyExchange", "Key Exchange Parameter"),
}
HINT_WORDS = "access address algorithm attribute attributes bit bits byte certificate cdw command commanddword code controller default description dword field feature identifier key keyexchange locking log management measurement message method namespace object offset opcode parameter pointer property protocolid provider queue range register requirement reset sc sct security securityfield session slot state status structure subsystem support type uid value".split()


def _hint(*words: str) -> str:
    return rf"rx(hints, '\b({'|'.join(words)})\b')"


def _has(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


STATUS_WORDS = "abort|denied|error|exceeded|failed|failure|invalid|miscompare|out of range|protection"
#: Values that build on those before them, in the language of rules.
DERIVED = (
    {"any_text": "lower(concat_ws(' ', header_text, row_text))", "desc_text": "lower(concat_ws(' ', description, row_text))"},
    {
        "pointer_text": "lower(concat_ws(' ', pointer_cell, any_text))",
        "value_is_status": f"coalesce(rx(raw_value, '{HEX}'), false) AND (affected IS NOT NULL OR ({_hint('status')} AND {_hint('code')}) OR rx(desc_text, 'status code') OR (rx(desc_text, 'command') AND rx(desc_text, '{STATUS_WORDS}')))",
    },
    {
        "sc": "coalesce(sc_cell, CASE WHEN value_is_status THEN raw_value END)",
        "sct": "coalesce(sct_cell, CASE WHEN sc_cell IS NULL AND value_is_status THEN CASE WHEN affected IS NOT NULL THEN 'Command Specific Status' ELSE 'Generic' END END)",
        "is_dword": rf"coalesce(rx(dword_cell, '{DW}'), false) OR coalesce(rx(dword_cell, '^\d{{1,2}}$'), false) OR rx(any_text, '\bcdw\s*\d{{1,2}}\b') OR rx(any_text, '\bcommand\s+dword\s*\d{{1,2}}\b')",
        "is_pointer": r"rx(pointer_text, '\bmetadata\s+pointer\b|mptr|\bdata\s+pointer\b|\bdptr\b')",
    },
)
TYPES = [
    ("command_opcode", _has("command", "opcode")), ("opcode", _has("opcode")), ("spdm_message", f"{_has('message', 'message_code')} AND {_hint('message', 'code')}"), ("spdm_request_response", _has("request", "response")),
    ("spdm_measurement", f"{_has('measurement')} AND {_hint('measurement')}"), ("spdm_certificate", f"{_has('certificate')} AND {_hint('certificate', 'slot')}"), ("spdm_algorithm", f"{_has('algorithm')} AND {_hint('algorithm')}"),
    ("spdm_key_exchange", f"{_has('key_exchange')} AND {_hint('keyexchange', 'key')}"), ("security_method", f"{_has('method')} AND {_hint('method', 'uid', 'protocolid')}"), ("security_provider", f"{_has('provider')} AND {_hint('security', 'provider', 'object', 'uid')}"),
    ("locking_range", f"{_has('locking')} AND {_hint('locking', 'range', 'security', 'field', 'bits')}"), ("key_management", f"{_has('key_name')} AND {_hint('key', 'management', 'security')}"), ("session_state", f"{_has('session_state')} AND {_hint('session', 'state', 'security')}"),
    ("security_object", f"{_has('object_')} AND {_hint('object', 'uid', 'protocolid')}"), ("security_authority", f"{_has('authority')} AND {_hint('authority', 'uid')}"), ("security_field", f"{_has('security_field')} AND {_hint('securityfield', 'security', 'bits', 'field')}"),
    ("security_object", f"{_has('uid', 'description')} AND {_hint('uid', 'object', 'protocolid')}"), ("log_page", f"rx(log_id, '{HEX}')"), ("feature_identifier", f"rx(feature_id, '{HEX}')"),
    ("status_code", f"({_has('sct', 'sc')}) OR ({_has('sc', 'description')} AND {_hint('status')} AND {_hint('code', 'sc')})"), ("command_dword_field", "is_dword AND (field IS NOT NULL OR bits IS NOT NULL OR description IS NOT NULL)"),
    ("command_pointer_field", f"is_pointer AND (field IS NOT NULL OR description IS NOT NULL OR {_hint('pointer')})"), ("support_requirement", f"{_has('support')} AND (description IS NOT NULL OR rx(row_text, '{REQ}') OR {_hint('support', 'controller', 'namespace', 'subsystem')})"),
    ("queue_field", f"{_has('field')} AND (queue IS NOT NULL OR {_hint('queue')})"), ("namespace_field", f"{_has('field')} AND {_hint('namespace', 'subsystem')}"), ("controller_field", f"{_has('field')} AND {_hint('controller')}"),
    ("data_structure_field", f"{_has('field')} AND (structure IS NOT NULL OR {_hint('structure')})"), ("register_field", f"register IS NOT NULL OR ({_hint('register')} AND field IS NOT NULL) OR ((offset_ IS NOT NULL OR {_hint('offset', 'property')}) AND field IS NOT NULL)"),
    ("bitfield", rf"{_has('field')} AND rx(bits, '(?i)^\s*(bits?\s*)?\d+(:\d+)?\s*$')"), ("enum_value", _has("value", "description")), ("requirement_row", f"rx(row_text, '{REQ}')"),
    ("technical_parameter", "n_hints >= 2 AND (field IS NOT NULL OR value IS NOT NULL OR command IS NOT NULL)"),
]


def typed(rows: DataFrame) -> DataFrame:
    """rows (headers, cells) with their named cells, `hints` and `unit_type`;
    null where no rule holds. Narrow: the rules are one CASE."""
    words = F.flatten(F.transform("headers", lambda h: F.regexp_extract_all(F.lower(h), F.lit("[a-z]+"), F.lit(0))))
    known = F.array_distinct(F.filter(words, lambda w: w.isin(*HINT_WORDS)))
    named = keyed(rows).withColumns({"header_text": F.array_join("headers", " "), "hint_words": known}).withColumns({k: cell(*v) for k, v in NAMES.items()})
    named = settled(named.withColumns({"hints": F.array_join("hint_words", " "), "n_hints": F.size("hint_words")}))
    for stage in DERIVED:
        named = named.withColumns({k: F.expr(spark_sql(v)) for k, v in stage.items()})
    return settled(settled(named).withColumn("unit_type", F.expr(c_sql(TYPES))))
