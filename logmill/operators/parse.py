"""Raw lines to typed columns, with malformed lines kept apart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.logline import extract_fields, strip_line_end
from logmill.schema import LINE_FIELDS, NUMERIC_FIELDS

PERMISSIVE, DROPMALFORMED, FAILFAST = "PERMISSIVE", "DROPMALFORMED", "FAILFAST"

_MATCHED = "_matched"


def _any_null(names: list[str]) -> Column:
    test = F.col(names[0]).isNull()
    for name in names[1:]:
        test = test | F.col(name).isNull()
    return test


def parse_lines(
    df: DataFrame,
    line: str = "value",
    fields: list[str] | None = None,
    mode: str = PERMISSIVE,
    payload_reason: str | None = None,
    payload: str | None = None,
) -> DataFrame:
    """Parse column ``line``; the other columns of ``df`` pass through.

    ``fields`` limits the output to some line fields. The optimizer cannot prune
    inside a regex, so a report on raw lines names what it needs.

    ``mode``: PERMISSIVE returns every row, with ``raw`` and ``reason`` (both NULL for
    a good row) added, for :func:`good_rows` and :func:`malformed_rows`; DROPMALFORMED
    returns the rows that parse; FAILFAST raises on a bad line.

    ``payload_reason`` names a column that says why ``line`` could not be decoded
    from ``payload``; it takes precedence over the line's own reason.
    """
    if mode not in (PERMISSIVE, DROPMALFORMED, FAILFAST):
        raise ValueError(f"unknown mode: {mode}")
    wanted = list(LINE_FIELDS) if fields is None else list(fields)
    unknown = [name for name in wanted if name not in LINE_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")

    # The numbers always take part: a line whose numbers do not fit is malformed.
    extracted = [n for n in LINE_FIELDS if n in wanted or n in NUMERIC_FIELDS]
    helpers = {line, payload_reason, payload} - {None}
    clash = {c for c in df.columns if c not in helpers} & {*LINE_FIELDS, "raw", "reason"}
    if clash:
        raise ValueError(f"columns have the names of results: {sorted(clash)}")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in helpers]
    rows = extract_fields(df, line, extracted, _MATCHED)

    if mode == DROPMALFORMED:
        return rows.where(~_any_null(NUMERIC_FIELDS)).select(*kept, *wanted)

    reason = F.when(~F.col(_MATCHED), F.lit("no_match")).when(
        _any_null(NUMERIC_FIELDS), F.lit("number_overflow")
    )
    raw = strip_line_end(F.col(line))
    if payload_reason is not None:
        reason = F.coalesce(F.col(payload_reason), reason)
        raw = F.coalesce(raw, F.col(payload))
    judged = rows.withColumn("reason", reason).select(
        *kept, *wanted, F.when(F.col("reason").isNotNull(), raw).alias("raw"), "reason"
    )
    if mode == PERMISSIVE:
        return judged
    message = F.concat(F.lit("Invalid log line: "), F.coalesce(F.col("raw"), F.lit("NULL")))
    return judged.where(
        F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )
    ).drop("raw", "reason")


def good_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("raw", "reason")


def malformed_rows(judged: DataFrame) -> DataFrame:
    line_columns = [name for name in LINE_FIELDS if name in judged.columns]
    return judged.where(F.col("reason").isNotNull()).drop(*line_columns)
