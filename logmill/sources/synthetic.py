"""Synthetic access-log lines for load tests, one per input row.

Every value is drawn from a hash of (seed, row key), so a line depends on nothing
but its key: not on partitioning, task order or retries.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a synthetic line is made of.
METHODS = ["GET", "POST", "PUT", "DELETE"]
ENDPOINTS = ["/usr", "/usr/admin", "/usr/admin/developer", "/usr/login", "/usr/register"]
STATUS_CODES = ["303", "404", "500", "403", "502", "304", "200"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:84.0) Gecko/20100101 Firefox/84.0",
    "Mozilla/5.0 (Android 10; Mobile; rv:84.0) Gecko/84.0 Firefox/84.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/87.0.4280.141 Safari/537.36",
    "Mozilla/5.0 (Linux; Android 10; ONEPLUS A6000) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/87.0.4280.141 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/89.0.4380.0 Safari/537.36 Edg/89.0.759.0",
    "Mozilla/5.0 (Linux; Android 10; ONEPLUS A6000) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/77.0.3865.116 Mobile Safari/537.36 EdgA/45.12.4.5121",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/87.0.4280.88 Safari/537.36 OPR/73.0.3856.329",
    "Mozilla/5.0 (Linux; Android 10; ONEPLUS A6000) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/86.0.4240.198 Mobile Safari/537.36 OPR/61.2.3076.56749",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_9_3) AppleWebKit/537.75.14 (KHTML, like Gecko) Version/7.0.3 Safari/7046A194A",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 12_4_9 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/12.1.2 Mobile/15E148 Safari/604.1",
]
REFERRERS = ["-", "https://www.example.com/search/main.html"]
ADDRESSES = 100
MOMENTS = 10_000
FIRST_MOMENT, LAST_MOMENT = "2015-01-01 12:00:00", "2053-01-01 12:00:00"
ZONE_OFFSET = "+0530"
MEAN_BYTES, SPREAD_BYTES = 5000, 50
MAX_MILLISECONDS = 5000

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

_DRAW_DIGITS = 13  # hex digits per draw: 52 bits, exact in a double


def log_time(clock: Column) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss`` of a wall-clock time, free of the session zone."""
    text = clock.cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(clock))
    return F.concat(
        F.substring(text, 9, 2), F.lit("/"), month, F.lit("/"),
        F.substring(text, 1, 4), F.lit(":"), F.substring(text, 12, 8),
    )


def _draw(number: int) -> Column:
    digits = F.substring("_digest", 1 + number * _DRAW_DIGITS, _DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint")


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def _pick(values: list[str], number: Column) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (number % len(values) + 1).cast("int"))


def synthetic_lines(keys: DataFrame, key: str, seed: int = 42, into: str = "line") -> DataFrame:
    """Add a synthetic line to every row of ``keys``; ``key`` must be unique."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    drawn = keys.withColumn("_digest", digest).select(
        *keys.columns, *[_draw(i).alias(f"_d{i}") for i in range(4)]
    )

    # Independent choices are the digits of one draw in a mixed radix.
    rest, fields = F.col("_d0"), []
    for values in (METHODS, ENDPOINTS, STATUS_CODES, REFERRERS, USER_AGENTS):
        fields.append(_pick(values, rest))
        rest = _div(rest, len(values))
    method, endpoint, status, referrer, agent = fields
    milliseconds = rest % MAX_MILLISECONDS + 1

    # Addresses follow a rule: 223 is prime, so the first part is unique per address.
    host = F.col("_d1") % ADDRESSES
    address = F.concat_ws(
        ".",
        host * 37 % 223 + 1, (host * 91 + 17) % 256, (host * 53 + 101) % 256, host * 29 % 254 + 1,
    )
    moment = _div(F.col("_d1"), ADDRESSES) % MOMENTS
    span = F.timestamp_diff(
        "SECOND", F.lit(f"{FIRST_MOMENT}Z").cast("timestamp"), F.lit(f"{LAST_MOMENT}Z").cast("timestamp")
    )
    clock = F.timestamp_add(
        "SECOND", _div(moment * span, MOMENTS), F.lit(FIRST_MOMENT).cast("timestamp_ntz")
    )

    scale = F.lit(float(16**_DRAW_DIGITS))
    normal = F.sqrt(-2 * F.ln((F.col("_d2") + 1) / scale)) * F.cos(
        F.lit(2) * F.pi() * (F.col("_d3") / scale)
    )
    size = (MEAN_BYTES + SPREAD_BYTES * normal).cast("bigint")

    line = F.concat(
        address, F.lit(" - - ["), log_time(clock), F.lit(f' {ZONE_OFFSET}] "'),
        method, F.lit(" "), endpoint, F.lit(' HTTP/1.0" '), status, F.lit(" "),
        size.cast("string"), F.lit(' "'), referrer, F.lit('" "'), agent, F.lit('" '),
        milliseconds.cast("string"),
    )
    return drawn.withColumn(into, line).select(*keys.columns, into)


def synthetic_log(spark: SparkSession, lines: int = 1_000_000, seed: int = 42) -> DataFrame:
    """``lines`` synthetic lines, column ``value``."""
    return synthetic_lines(spark.range(lines), "id", seed, "value").select("value")
