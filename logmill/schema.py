"""Column layouts shared by the batch, streaming and serving jobs."""

# The ten fields of a log line, in line order, and their types.
# Byte counts are BIGINT: bodies above 2 GiB exist and INT would lose them.
LINE_FIELDS = {
    "ip_address": "string",
    "remote_log_name": "string",
    "user_id": "string",
    "log_timestamp": "string",
    "request": "string",
    "response_code": "int",
    "response_bytes": "bigint",
    "referrer": "string",
    "user_agent": "string",
    "response_time": "int",
}
NUMERIC_FIELDS = [name for name, kind in LINE_FIELDS.items() if kind != "string"]

# Column order of the stored, enriched rows.
ENRICHED_FIELDS = {
    "ip_address": "string",
    "remote_log_name": "string",
    "user_id": "string",
    "log_timestamp": "timestamp",
    "response_code": "int",
    "response_bytes": "bigint",
    "referrer": "string",
    "user_agent": "string",
    "response_time": "int",
    "process_timestamp": "string",
    "request_type": "string",
    "api": "string",
    "protocol": "string",
    "process_date": "date",
}


# Which load wrote a row: a streaming query id or a batch load name, and the
# micro-batch number. Both are partition columns of every table we write, so a
# retried batch replaces its own files and nothing else.
LOAD_FIELDS = {"load_id": "string", "batch_id": "bigint"}

QUARANTINE_FIELDS = {"process_timestamp": "timestamp", "raw": "string", "reason": "string"}


def ddl(*fields: dict[str, str]) -> str:
    """Schema string of the given columns, in order."""
    return ", ".join(f"{name} {kind}" for part in fields for name, kind in part.items())
