from collections import Counter

import pytest

from logmill.__main__ import main, parser
from logmill.operators.enrich import enrich
from logmill.operators.parse import DROPMALFORMED, parse_lines
from logmill.operators import reports
from logmill.plans.batch import LogAnalysis, analyze
from logmill.sources.events import read_event_lines
from logmill.sources.tables import write_facts

from conftest import SMALL, VALID


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "lines")
    read_event_lines(spark, SMALL).select("value").write.text(path)
    return path


@pytest.mark.parametrize("stored", [False, True])
def test_analysis(spark, log, tmp_path, stored):
    analysis = analyze(spark, log, str(tmp_path / "parsed") if stored else None)
    texts = [r.value for r in spark.read.text(log).collect()]
    assert analysis.parsed.count() + analysis.malformed.count() == len(texts) == 1000
    assert Counter(r.reason for r in analysis.malformed.collect()) == {"no_match": 11}
    want = Counter(t.split('"')[5] for t in texts if t.split('"')[2].split()[1] != "-")
    per_agent = dict(map(tuple, analysis.reports["requests per user agent"].collect()))
    assert per_agent == want
    codes = Counter(int(t.split('"')[2].split()[0]) for t in texts if t.split('"')[2].split()[1] != "-")
    assert dict(map(tuple, analysis.reports["top response codes"].collect())) == codes
    assert spark.sql("SELECT count(*) FROM logs").first()[0] == sum(codes.values())
    for report in analysis.reports.values():
        assert not report.isEmpty()


def test_stored_reports_read_one_column(spark, log, tmp_path):
    analysis = analyze(spark, log, str(tmp_path / "parsed"))
    plan = analysis.reports["requests per address"]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ip_address:string>" in plan
    assert "regexp" not in plan


def test_command_line(spark, log, tmp_path, capsys):
    main(["batch", log, "--store", str(tmp_path / "parsed")])
    out = capsys.readouterr().out
    assert "requests per address" in out and "no_match" in out
    facts = str(tmp_path / "facts")
    good = parse_lines(read_event_lines(spark, SMALL), mode=DROPMALFORMED)
    write_facts(enrich(good), facts, "a")
    main(["day", facts, "--day", "2024-01-05", "--json"])
    assert '{"process_timestamp":"2024-01-05 ' in capsys.readouterr().out
    main(["day", facts, "--day", "20240105"])
    assert "No data" not in capsys.readouterr().out
    main(["day", facts])
    assert "No data available for the day" in capsys.readouterr().out
    main(["synth", str(tmp_path / "made"), "--lines", "50"])
    assert parse_lines(spark.read.text(str(tmp_path / "made")), mode=DROPMALFORMED).count() == 50
    args = parser().parse_args(["rollup", "--brokers", "b:1", "--topic", "t", "--out", "o"])
    assert (args.starting_offsets, args.every) == ("latest", "1 minute")


def test_a_closed_analysis_keeps_nothing(spark, log):
    def kept():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    spark.catalog.clearCache()
    before = kept()
    with analyze(spark, log) as analysis:
        for report in analysis.reports.values():
            report.collect()
        assert kept() > before
    assert kept() == before


def test_shared_counts_give_the_same_reports(spark, log):
    with analyze(spark, log) as analysis:
        for name, report in (
            ("content size", reports.content_size_stats),
            ("top response codes", reports.top_response_codes),
            ("response codes", reports.response_code_totals),
            ("top user agents", reports.top_user_agents),
        ):
            assert analysis.reports[name].collect() == report(analysis.parsed).collect()
        empty = LogAnalysis(analysis.parsed.limit(0), analysis.malformed)
        assert empty.reports["content size"].collect() == [(None, None, None)]
        assert empty.reports["response codes"].collect() == [(0, 0)]


def jobs(spark, act):
    """Jobs that ``act`` starts."""
    context, group = spark.sparkContext, f"counted {id(act)}"
    context.setJobGroup(group, "")
    try:
        act()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_sizes_and_numbers_of_codes_are_known_once_stored(spark, log, tmp_path):
    analysis = analyze(spark, log, str(tmp_path / "parsed"))
    shown = {name: analysis.reports[name] for name in ("content size", "response codes")}
    for name, report in (("content size", reports.content_size_stats), ("response codes", reports.response_code_totals)):
        want = report(analysis.parsed)
        assert shown[name].columns == want.columns and shown[name].collect() == want.collect()
        assert dict(shown[name].dtypes) == dict(want.dtypes)
        assert "FileScan" not in shown[name]._jdf.queryExecution().executedPlan().toString()
    assert jobs(spark, lambda: [r.collect() for r in shown.values()]) <= 2  # of a single row each, no files


@pytest.mark.parametrize("codes", [[], [1, 32768, 200, 200], [0, 200], [32769], [2_000_000_000, 1, 1]])
def test_observed_codes_of_any_size(spark, tmp_path, codes):
    (tmp_path / "in").mkdir()
    big = 999_999_999_999_999_999
    text = "".join(VALID.replace(" 200 4988", f" {code} {big - k}") + "\n" for k, code in enumerate(codes))
    (tmp_path / "in" / "a.log").write_text(text + "junk\n" * bool(codes))
    analysis = analyze(spark, str(tmp_path / "in"), str(tmp_path / "parsed"))
    assert [tuple(r) for r in analysis.reports["response codes"].collect()] == [(len(set(codes)), len(codes))]
    sizes = [big - k for k in range(len(codes))]
    want = (sum(sizes) // len(sizes), min(sizes), max(sizes)) if sizes else (None, None, None)
    assert [tuple(r) for r in analysis.reports["content size"].collect()] == [want]


def test_observed_sizes_do_not_overflow(spark, tmp_path):
    big = 999_999_999_999_999_999
    (tmp_path / "a.log").write_text((VALID.replace("4988", str(big)) + "\n") * 30)
    analysis = analyze(spark, str(tmp_path / "a.log"), str(tmp_path / "parsed"))
    assert [tuple(r) for r in analysis.reports["content size"].collect()] == [(big, big, big)]
