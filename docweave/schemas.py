"""Schemas of the tables that pass between operators."""

BOX = "array<array<double>>"
TOKEN_STRUCT = f"struct<ord: int, text: string, confidence: double, box: {BOX}, type: string>"
TOKENS = f"doc_id bigint, ord int, text string, confidence double, box {BOX}, type string"
LINES = f"doc_id bigint, line_no int, text string, items array<{TOKEN_STRUCT}>"
MATCH = "struct<field: string, keyword: string>"
FIELDS_LONG = "doc_id bigint, field string, value string, src string, ord int"
IMAGE = "path string, height int, width int, channels int, data binary, error string"
METRICS = "width int, height int, sharpness double, contrast double, eta double, char_height double, density double, reflection double, brightness double"
