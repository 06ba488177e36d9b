import random
import re
import time

import pytest
from pyspark.errors import PySparkException

from logmill.functions.sql import register_functions
from logmill.operators.parse import (
    DROPMALFORMED,
    FAILFAST,
    PERMISSIVE,
    good_rows,
    malformed_rows,
    parse_lines,
)
from logmill.schema import LINE_FIELDS, NUMERIC_FIELDS

from conftest import SMALL, VALID

# Fixed value: the line layout.
LAYOUT = re.compile(
    r'(\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d+) (\d+) "([^"]*)" "([^"]*)" (\d+)'
)
EXPECTED = (
    "1.2.3.4", "-", "-", "10/Sep/2023:12:34:56 +0530", "GET /usr HTTP/1.0",
    200, 4988, "-", "Mozilla/5.0 (X11)", 1234,
)
LIMITS = {"response_code": 2**31, "response_bytes": 2**63, "response_time": 2**31}


def expected_fields(line):
    """By brute force: the ten values, or why there are none."""
    match = LAYOUT.search(line)
    if match is None:
        return "no_match"
    values = dict(zip(LINE_FIELDS, match.groups()))
    for name in NUMERIC_FIELDS:
        values[name] = int(values[name])
        if values[name] >= LIMITS[name]:
            return "number_overflow"
    return tuple(values.values())


def judged(df):
    rows = parse_lines(df, mode=PERMISSIVE).collect()
    return {
        r.id: r.reason if r.reason else tuple(r[name] for name in LINE_FIELDS) for r in rows
    }


@pytest.mark.parametrize(
    "line",
    [
        VALID,
        "xx " + VALID,
        "xx\nyy " + VALID,
        VALID + "\n",
        VALID + "\n\n",
        VALID + " extra",
        VALID + "x\ny",
    ],
)
def test_accepted(lines, line):
    assert judged(lines(line)) == {0: EXPECTED}


def test_digits_of_other_scripts(lines):
    texts = [VALID + "\u0663", VALID.replace("200", "\u06630\uff12"), VALID.replace("4988", "\u096a\U0001d7ce")]
    texts += [VALID.replace("4988", "\u0663" * 20), VALID.replace(" 200 ", " \u2460 ")]
    got = judged(lines(*texts))
    assert got == {i: expected_fields(text) for i, text in enumerate(texts)}
    assert (got[0][9], got[1][5], got[2][6]) == (12343, 302, 40)
    assert (got[3], got[4]) == ("number_overflow", "no_match")


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("", "no_match"),
        (None, "no_match"),
        ("\n", "no_match"),
        (VALID.replace("4988", "-"), "no_match"),
        (VALID.replace(" 200 ", " 3000000000 "), "number_overflow"),
        (VALID[:-4] + "99999999999", "number_overflow"),
        (VALID.replace("4988", "9" * 19), "number_overflow"),
    ],
)
def test_malformed(lines, line, reason):
    assert judged(lines(line)) == {0: reason}


def test_large_body_and_odd_fields(lines):
    sizes = ["3000000000", "9223372036854775807", "0004988"]
    texts = [VALID.replace("4988", size) for size in sizes]
    texts += [
        VALID.replace("Mozilla", "a\x01b"),
        VALID.replace("Mozilla", "a\nb"),
        VALID.replace("GET /usr", 'GET "/u"sr'),
        VALID.replace("GET /usr", "GET ] /usr"),
        VALID.replace("10/Sep", "] 10/Sep"),
        VALID.replace('"-"', '""'),
        VALID.replace("1.2.3.4", 'a"b"'),
        VALID.replace("GET /usr HTTP/1.0", ""),
    ]
    got = judged(lines(*texts))
    assert got == {i: expected_fields(text) for i, text in enumerate(texts)}
    assert got[0][6] == 3000000000


def test_text_that_looks_like_extracted_fields(lines):
    # Lines made of the separators used inside the extraction never pass for a match.
    texts = ["\n".join("123456789x"), '"\n'.join("123456789x"), '"\n' * 12, "\n" * 12]
    texts += [t + ' [] "" ""' for t in texts] + ["a [] \"\n\" \"\n\"" * 5]
    assert set(judged(lines(*texts)).values()) == {"no_match"}


def mutated(rng, count):
    alphabet = list(
        'abz019 "[]-\\/:+\t\n\r'
        '\x01\x1c\x85\xa0\u1680\u2003\u200b\u2028\u3000\u0663\u00e9\U0001f600'
    )
    for _ in range(count):
        chars = list(VALID)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(chars))
            action = rng.randrange(4)
            if action == 0:
                chars[at] = rng.choice(alphabet)
            elif action == 1:
                chars.insert(at, rng.choice(alphabet))
            elif action == 2:
                del chars[at]
            else:
                other = rng.randrange(len(chars))
                chars[at], chars[other] = chars[other], chars[at]
        line = "".join(chars)
        if rng.random() < 0.1:
            line = line[rng.randrange(len(line)):] + line
        if rng.random() < 0.1:
            line += line[: rng.randrange(len(line))]
        yield line


def test_matches_brute_force_on_mutated_lines(spark, lines):
    texts = list(mutated(random.Random(7), 20_000))
    expected = {i: expected_fields(text) for i, text in enumerate(texts)}
    outcomes = [type(value) for value in expected.values()]
    assert outcomes.count(tuple) > 2_000 and outcomes.count(str) > 2_000

    df = lines(*texts)
    got = judged(df)
    assert {i: (texts[i], got[i], expected[i]) for i in got if got[i] != expected[i]} == {}

    register_functions(spark)
    df.createOrReplaceTempView("mutated_lines")
    rows = spark.sql("SELECT id, parse_log(value) AS fields FROM mutated_lines").collect()
    for row in rows:
        want = expected[row.id]
        if isinstance(want, tuple):
            assert tuple(row.fields) == want
        elif want == "no_match":
            assert row.fields is None
    spread = spark.sql("SELECT id, f.* FROM mutated_lines, LATERAL log_fields(value) f").collect()
    fields = {row.id: tuple(row.fields or [None] * len(LINE_FIELDS)) for row in rows}
    assert len(spread) == len(rows) and {row[0]: tuple(row[1:]) for row in spread} == fields


def test_table_function_parses_a_line_once(spark, tmp_path):
    register_functions(spark)
    texts = [VALID, VALID.replace(" 200 ", " 404 "), "junk", "", None, VALID.replace("4988", "9" * 30)]
    spark.createDataFrame(list(enumerate(texts)), "id int, value string").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("stored_lines")
    found = spark.sql(
        "SELECT id, ip_address, response_code FROM stored_lines, LATERAL log_fields(value) "
        "WHERE response_code >= 200 AND response_bytes > 10 AND user_agent LIKE 'Moz%'"
    )
    assert sorted(map(tuple, found.collect())) == [(0, "1.2.3.4", 200), (1, "1.2.3.4", 404)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The pattern of plain lines and that of others.
    assert plan.count("regexp_replace(") == 2 and "Join" not in plan and "EvalPython" not in plan
    every = spark.sql("SELECT id, response_code, response_bytes FROM stored_lines, LATERAL log_fields(value)")
    assert sorted(map(tuple, every.collect()), key=lambda r: r[0]) == [
        (0, 200, 4988), (1, 404, 4988), (2, None, None), (3, None, None), (4, None, None), (5, 200, None),
    ]
    counted = spark.sql("SELECT response_code, count(*) AS n FROM stored_lines, LATERAL log_fields(value) GROUP BY 1")
    assert dict(map(tuple, counted.collect())) == {200: 2, 404: 1, None: 3}


def assembled(rng, count):
    """Text put together from pieces of lines: several starts, ends and newlines."""
    pieces = [
        "a b c [", "x y [", " - [", "t", "] ", '] "', '"', '" ', '" 1 2 ', '" 1 2 "', '"r" "u" 3',
        '" 1 - "-" "u" 3', "\n", " ", "1 2 ", 'a b c [t] "q" 1 2 "r" "u" 3', 'c [t] "', '"r"', "\u0663", "\x1c",
    ]
    for _ in range(count):
        yield "".join(rng.choices(pieces, k=rng.randint(3, 14)))


def test_matches_brute_force_on_assembled_text(lines):
    texts = list(assembled(random.Random(9), 40_000))
    expected = {i: expected_fields(text) for i, text in enumerate(texts)}
    assert sum(isinstance(value, tuple) for value in expected.values()) > 5_000
    got = judged(lines(*texts))
    assert {i: (texts[i], got[i], expected[i]) for i in got if got[i] != expected[i]} == {}


@pytest.mark.parametrize(
    "text",
    [
        "a b c [" * 30_000 + '\n] "" "',
        'a b c [t] "' * 30_000 + '" "',
        'a b c [t] "' + '" 1 2 "r" ' * 30_000,
        "x" * 200_000 + ' [] "" ""',
        "a b c [t] \"q\n" * 20_000 + '" 1 2 "r" "u" 3',
        "\n" * 200_000 + ' [] " "" "',
    ],
)
def test_long_text_without_a_match(lines, text):
    start = time.monotonic()
    assert judged(lines(text)) == {0: "no_match"}
    assert time.monotonic() - start < 20


def test_long_text_around_a_match(lines):
    texts = [
        "junk\n" * 40_000 + VALID + "\njunk" * 40_000,
        "a b c [" * 20_000 + "\n" + VALID,
        VALID.replace("Mozilla", "x" * 300_000),
    ]
    got = judged(lines(*texts))
    assert got[0] == got[1] == EXPECTED
    assert len(got[2][8]) == len(EXPECTED[8]) - len("Mozilla") + 300_000


def test_subset_of_fields_agrees_with_all(lines):
    df = lines(*mutated(random.Random(8), 2_000))
    whole = parse_lines(df, mode=DROPMALFORMED)
    for names in (["response_code"], ["user_agent", "ip_address"], ["log_timestamp"]):
        part = parse_lines(df, fields=names, mode=DROPMALFORMED)
        assert part.columns == ["id", *names]
        assert sorted(map(str, part.collect())) == sorted(
            map(str, whole.select("id", *names).collect())
        )


def test_unknown_field_or_mode(lines, valid_line):
    with pytest.raises(ValueError):
        parse_lines(lines(valid_line), fields=["color"])
    with pytest.raises(ValueError):
        parse_lines(lines(valid_line), mode="LENIENT")


def test_column_named_like_a_field(spark, valid_line):
    df = spark.createDataFrame([(valid_line, 7)], "value string, user_id int")
    with pytest.raises(ValueError, match="user_id"):
        parse_lines(df)


def test_split_into_good_and_malformed(lines, valid_line):
    both = parse_lines(lines(valid_line, "junk\n", None))
    assert [r.id for r in good_rows(both).collect()] == [0]
    assert good_rows(both).columns == ["id", *LINE_FIELDS]
    bad = malformed_rows(both)
    assert bad.columns == ["id", "raw", "reason"]
    assert {tuple(r) for r in bad.collect()} == {(1, "junk", "no_match"), (2, None, "no_match")}


@pytest.mark.parametrize(
    ("line", "raw"), [("a\n", "a"), ("a\n\n", "a"), ("a\n\n\n", "a\n"), ("a\nb", "a\nb")]
)
def test_raw_text_loses_its_line_end(lines, line, raw):
    assert re.sub(r"\n$", "", line) == raw
    assert malformed_rows(parse_lines(lines(line), mode=PERMISSIVE)).first().raw == raw


def test_failfast(lines, valid_line):
    assert parse_lines(lines(valid_line), mode=FAILFAST).count() == 1
    for fields in (None, ["response_code"]):
        strict = parse_lines(lines(valid_line, "junk"), fields=fields, mode=FAILFAST)
        assert "raw" not in strict.columns
        with pytest.raises(PySparkException, match="Invalid log line: junk"):
            strict.collect()
        with pytest.raises(PySparkException, match="Invalid log line: junk"):
            strict.count()


def test_free_text_has_no_matches(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr(
        "explode(split(text, '\n')) AS value"
    )
    assert parse_lines(texts, mode=DROPMALFORMED).isEmpty()
    assert parse_lines(texts, mode=PERMISSIVE).count() == texts.count()


def test_filter_does_not_run_the_pattern_twice(lines, valid_line):
    codes = parse_lines(lines(valid_line), fields=["response_code"], mode=DROPMALFORMED)
    plan = codes.groupBy("response_code").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 2  # the plain and the searched layout, once each
    assert "Python" not in plan
