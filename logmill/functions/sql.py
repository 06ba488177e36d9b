"""The record functions under SQL names, for use in ``spark.sql``."""

from pyspark.sql import SparkSession

from logmill.functions.codec import SINGLE_STRING
from logmill.functions.logline import (
    LINE_END,
    MARKERS,
    OTHER_DIGITS,
    PLAIN_LINE,
    PLAIN_SEPARATOR,
    SAME_DIGITS,
    SEARCHED_LINE,
    SEARCHED_SEPARATOR,
)
from logmill.schema import LINE_FIELDS


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _template(separator: str) -> str:
    return _literal(separator.join(f"${i}" for i in range(1, len(LINE_FIELDS) + 1)))


def _typed(position: int, kind: str) -> str:
    text = f"get(parts, {position})"
    if kind == "string":
        return text
    translated = f"translate({text}, '{OTHER_DIGITS}', '{SAME_DIGITS}')"
    return f"coalesce(try_cast({text} AS {kind}), try_cast({translated} AS {kind}))"


def _parse_log_body() -> str:
    # A lambda parameter is evaluated once however often it is used; a plain alias
    # would be inlined, and each regex run, at every use.
    fields = ", ".join(
        f"'{name}', {_typed(i, kind)}" for i, (name, kind) in enumerate(LINE_FIELDS.items())
    )
    may_match = " AND ".join(
        [f"contains(line, {_literal(marker)})" for marker in MARKERS]
        + [f"line RLIKE {_literal(LINE_END)}"]
    )
    searched = f"""get(transform(
        array(regexp_replace(line, {_literal(SEARCHED_LINE)}, {_template(SEARCHED_SEPARATOR)})),
        found -> CASE WHEN found <> line THEN split(found, {_literal(SEARCHED_SEPARATOR)}) END), 0)"""
    parts = f"""get(transform(
        array(regexp_replace(line, {_literal(PLAIN_LINE)}, {_template(PLAIN_SEPARATOR)})),
        plain -> CASE WHEN plain <> line THEN split(plain, {_literal(PLAIN_SEPARATOR)})
                      WHEN {may_match} THEN {searched} END), 0)"""
    return f"""get(transform(array({parts}),
        parts -> CASE WHEN parts IS NOT NULL THEN named_struct({fields}) END), 0)"""


def register_functions(spark: SparkSession) -> None:
    """``parse_json_string(payload)`` and ``parse_log(line)``, NULL where malformed, and the
    table function ``log_fields(line)``: one row of the ten fields, NULLs where malformed.

    ``FROM lines, LATERAL log_fields(value)`` parses a line once, however many fields are
    selected and filtered; each use of ``parse_log(value).field`` may parse it again.
    """
    columns = ", ".join(f"{name} {kind}" for name, kind in LINE_FIELDS.items())
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION log_fields(line STRING) RETURNS TABLE ({columns}) "
        f"RETURN SELECT * FROM inline(array({_parse_log_body()}))"
    )
    struct = ", ".join(f"{name}: {kind}" for name, kind in LINE_FIELDS.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_log(line STRING) "
        f"RETURNS STRUCT<{struct}> RETURN {_parse_log_body()}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_json_string(payload STRING) RETURNS STRING "
        f"RETURN CASE WHEN payload RLIKE {_literal(SINGLE_STRING)} "
        "THEN try_variant_get(try_parse_json(payload), '$', 'string') END"
    )
