import random
from collections import Counter

import pytest

from logmill.operators import reports

COLUMNS = "response_code int, response_bytes bigint, user_agent string, log_timestamp string, ip_address string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [
        (
            rng.choice([200] * 10 + list(range(300, 330))),
            rng.randint(0, 5_000_000_000),
            f"agent/{rng.choice([0] * 20 + list(range(12)))}",
            f"{rng.randint(1, 9)}/Jan/2024:00:00:00 {rng.choice(['+0000', '+0530'])}",
            f"10.0.0.{rng.randint(1, 40)}",
        )
        for _ in range(3_000)
    ]
    return made


@pytest.fixture(scope="module")
def parsed(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(8).cache()


def ranked(counts, k=None):
    return sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:k]


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_content_size_stats(parsed, rows):
    sizes = [r[1] for r in rows]
    assert pairs(reports.content_size_stats(parsed)) == [
        (sum(sizes) // len(sizes), min(sizes), max(sizes))
    ]


def test_response_codes(parsed, rows):
    counts = Counter(r[0] for r in rows)
    assert dict(pairs(reports.response_code_counts(parsed))) == counts
    assert pairs(reports.top_response_codes(parsed)) == ranked(counts, 10)
    assert pairs(reports.response_code_totals(parsed)) == [(len(counts), len(rows))]


def test_user_agents(parsed, rows):
    counts = Counter(r[2] for r in rows)
    assert dict(pairs(reports.requests_per_user_agent(parsed))) == counts
    assert pairs(reports.top_user_agents(parsed)) == ranked(counts, 5)


def test_ascending_reports(parsed, rows):
    for report, column in ((reports.requests_per_timestamp, 3), (reports.requests_per_ip, 4)):
        counts = Counter(r[column] for r in rows)
        want = sorted(counts.items(), key=lambda item: (item[1], item[0]))
        assert pairs(report(parsed)) == want


def test_ties_are_broken_by_name(spark):
    tied = spark.createDataFrame([(i, 1, f"agent/{9 - i}", "t", "ip") for i in range(9)], COLUMNS)
    assert [r.user_agent for r in reports.top_user_agents(tied).collect()] == [
        f"agent/{i}" for i in range(1, 6)
    ]
    assert [r.response_code for r in reports.top_response_codes(tied, 3).collect()] == [0, 1, 2]


def test_empty_log(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert pairs(reports.content_size_stats(empty)) == [(None, None, None)]
    assert pairs(reports.response_code_totals(empty)) == [(0, 0)]
    assert pairs(reports.top_response_codes(empty)) == []


def test_counts_combine_before_the_shuffle(parsed):
    plan = reports.response_code_counts(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") == 1
