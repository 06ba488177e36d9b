"""JSON scalar strings, the payload format of log records on a message topic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_SPACE = " \t\n\r"

# One string literal and nothing else: a JSON parser may stop after the first value
# and not see what follows. The possessive group runs as a loop, so long text with
# many escapes needs no deep stack.
SINGLE_STRING = r'(?s)\A[ \t\n\r]*+"(?:[^"\\]++|\\.)*+"[ \t\n\r]*+\z'


def encode_json_scalar(line: Column) -> Column:
    """The line as a JSON string literal (quotes included)."""
    return F.to_json(line.cast("variant"))


def decode_json_scalar(payload: Column) -> Column:
    """The text of a JSON string literal; NULL for malformed or non-string JSON."""
    return F.when(
        F.rlike(payload, F.lit(SINGLE_STRING)),
        F.try_variant_get(F.try_parse_json(payload), "$", "string"),
    )


def payload_reason(payload: Column, decoded: Column) -> Column:
    """Why a payload gave no line; NULL where it did."""
    text = F.btrim(payload, F.lit(_JSON_SPACE))
    return (
        F.when(decoded.isNotNull(), F.lit(None).cast("string"))
        .when(payload.isNull(), F.lit("null_payload"))
        .when(F.startswith(text, F.lit('"')), F.lit("bad_json"))
        .when(F.try_parse_json(text).isNull(), F.lit("bad_json"))
        .otherwise(F.lit("not_json_string"))
    )
