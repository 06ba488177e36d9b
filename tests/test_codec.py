import json
import random

import pytest
from pyspark.sql import functions as F

from logmill.functions.codec import decode_json_scalar, encode_json_scalar, payload_reason
from logmill.functions.sql import register_functions
from logmill.sources.lines import decode_records, encode_records, records


def decoded(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    value = df.withColumn("value", decode_json_scalar(F.col("payload")))
    rows = value.withColumn("reason", payload_reason(F.col("payload"), F.col("value")))
    return {r.payload: (r.value, r.reason) for r in rows.collect()}


def python_decoded(payload):
    try:
        value = json.loads(payload)
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, str) else None


CASES = {
    '"a\\nb"': ("a\nb", None),
    ' \t\n"a"\r ': ("a", None),
    '""': ("", None),
    '"caf\\u00e9 \\ud83d\\ude00"': ("caf\u00e9 \U0001f600", None),
    '"a\\\\"': ("a\\", None),
    '"\\\\\\""': ('\\"', None),
    '{"a":1}': (None, "not_json_string"),
    "5": (None, "not_json_string"),
    "null": (None, "not_json_string"),
    '["a"]': (None, "not_json_string"),
    "{bad": (None, "bad_json"),
    "": (None, "bad_json"),
    '"a': (None, "bad_json"),
    '"': (None, "bad_json"),
    '"a" "b"': (None, "bad_json"),
    '"a" x': (None, "bad_json"),
    '"a"\\"': (None, "bad_json"),
    '"a\\"': (None, "bad_json"),
    '"a"]': (None, "bad_json"),
    '"a"//"': (None, "bad_json"),
    '"a\nb"': (None, "bad_json"),
    '"a\\x"': (None, "bad_json"),
    "'a'": (None, "bad_json"),
    '\ufeff"a"': (None, "bad_json"),
    '\xa0"a"': (None, "bad_json"),
}


def test_decode_cases(spark):
    assert decoded(spark, list(CASES)) == CASES
    for payload, (value, _) in CASES.items():
        assert python_decoded(payload) == value


def test_null_payload(spark):
    assert decoded(spark, [None]) == {None: (None, "null_payload")}


def test_decode_agrees_with_python_on_random_payloads(spark):
    rng = random.Random(3)
    alphabet = list('"\\nu09a {}[]:,\t\x01\u00e9\U0001f600/')
    payloads = {
        '"' * rng.randint(0, 1) + "".join(rng.choices(alphabet, k=rng.randint(0, 8))) + '"'
        for _ in range(20_000)
    }
    got = decoded(spark, sorted(payloads))
    register_functions(spark)
    spark.createDataFrame([(p,) for p in sorted(payloads)], "p string").createOrReplaceTempView("payloads")
    by_sql = dict(spark.sql("SELECT p, parse_json_string(p) FROM payloads").collect())
    found = 0
    for payload in payloads:
        want = python_decoded(payload)
        if want is not None and any("\ud800" <= c <= "\udfff" for c in want):
            continue  # half a surrogate pair is not text
        found += want is not None
        assert got[payload][0] == want == by_sql[payload]
        assert (got[payload][1] is None) == (want is not None)
    assert found > 100


@pytest.mark.parametrize("line", ["", "plain", 'q"\\\n\t\x01', "é😀"])
def test_encode_round_trip(spark, line):
    df = spark.createDataFrame([(line,)], "value string")
    encoded = df.select(encode_json_scalar(F.col("value"))).first()[0]
    assert json.loads(encoded) == line
    assert decoded(spark, [encoded, json.dumps(line)])[encoded] == (line, None)


def test_long_text_with_many_escapes(spark):
    line = '"\\' * 200_000
    assert decoded(spark, [json.dumps(line), json.dumps(line) + '"']) == {
        json.dumps(line): (line, None), json.dumps(line) + '"': (None, "bad_json"),
    }


def test_records_round_trip(spark, valid_line):
    source = encode_records(spark.createDataFrame([(valid_line,)], "value string")).selectExpr(
        "timestamp'2024-01-01 00:00:00' AS timestamp", "cast(payload AS binary) AS value",
        "'ignored' AS topic",
    )
    row = decode_records(records(source)).first()
    assert (row.value, row.payload_reason) == (valid_line + "\n", None)
    assert records(source).columns == ["process_timestamp", "payload"]
