"""Bad records judged again, and moved to the facts where they parse now.

After a change of the parser, some records of the quarantine are good. A replay takes them
out of it and stores them as facts of the batch that they came with, so a batch that its
stream writes again replaces them like its own. Each record is in one table, whatever step
a replay dies at: the facts' commit decides, and a plan written before says what the
quarantine still has to do; the next replay does it first.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.codec import decode_json_scalar, payload_reason
from logmill.operators.enrich import enrich
from logmill.operators.parse import good_rows, malformed_rows, parse_lines
from logmill.schema import LOAD_FIELDS, QUARANTINE_FIELDS, ddl
from logmill.sources.tables import read_entries, write_files
from logmill.sources.versions import Change, Conflict, Ranges, Table, Version, in_ranges, merge_loads

# The load under which both tables count replays; no row carries it.
REPLAY = "logmill-replay"
# Reasons of records whose payload gave no line; ``raw`` is the payload then, else the line.
PAYLOAD_REASONS = ("null_payload", "bad_json", "not_json_string")

Judge = Callable[[DataFrame], DataFrame]


def judge_again(bad: DataFrame) -> DataFrame:
    """Quarantined records parsed anew: all of them, with ``raw`` and ``reason`` where still bad."""
    undecoded = F.col("reason").isin(*PAYLOAD_REASONS)
    again = bad.withColumn("payload", F.when(undecoded, F.col("raw")))
    again = again.withColumn("value", F.when(undecoded, decode_json_scalar(F.col("payload"))).otherwise(F.col("raw")))
    again = again.withColumn("payload_reason", F.when(undecoded, payload_reason(F.col("payload"), F.col("value"))))
    return parse_lines(again.drop("raw", "reason"), payload_reason="payload_reason", payload="payload")


def replay(
    spark: SparkSession, quarantine: str, facts: str, zone: str = "UTC", extra: dict[str, str] | None = None,
    stopped: bool = False, judge: Judge = judge_again,
) -> int:
    """Move the records that parse now; the number of them. Safe to repeat, and beside the stream.

    The last batch of each load may be under way, half in one table, and is left for a later
    replay; ``stopped`` takes it too, for streams that are not running. ``zone`` and ``extra``
    are those the tables were written with. Replays side by side do not double a record: one
    of them starts over. Do not write a closed batch again by hand while a replay runs.
    """
    bad, good = Table(spark, quarantine), Table(spark, facts)
    while True:
        _settle(spark, bad, good, extra)
        try:
            return _replay_once(spark, bad, good, zone, extra, stopped, judge)
        except Conflict:
            continue


def _numbers(version: Version | None) -> Ranges:
    return [] if version is None else version.loads.get(REPLAY, [])


def _plan_file(number: int) -> str:
    return f"_replays/{number}.json"


def _next_plan(bad: Table) -> int:
    numbers = [int(name.split(".")[0]) for name, _ in bad.store.list("_replays/*.json")]
    return max(numbers, default=-1) + 1


def _open_batches(*versions: Version | None) -> dict[str, int]:
    """The newest batch of each load, that any of the tables has seen."""
    newest: dict[str, int] = {}
    for version in versions:
        for load, ranges in (version.loads if version else {}).items():
            newest[load] = max(newest.get(load, -1), ranges[-1][1])
    newest.pop(REPLAY, None)
    return newest


def _in_batches(loads: dict[str, Ranges]):
    """Whether a row belongs to one of the batches."""
    found = F.lit(False)
    for load, ranges in loads.items():
        for low, high in ranges:
            found = found | ((F.col("load_id") == load) & F.col("batch_id").between(low, high))
    return found


def _one_batch(loads: dict[str, Ranges]) -> bool:
    return sum(high - low + 1 for ranges in loads.values() for low, high in ranges) == 1


def _schema(extra: dict[str, str] | None) -> str:
    return ddl(extra or {}, QUARANTINE_FIELDS, LOAD_FIELDS)


def _replay_once(
    spark: SparkSession, bad: Table, good: Table, zone: str, extra: dict[str, str] | None, stopped: bool, judge: Judge
) -> int:
    base = bad.latest()
    newest = {} if stopped else _open_batches(base, good.latest())
    open_now = {load: [[number, number]] for load, number in newest.items()}
    everything = bad.entries(base, "") if base else []
    # Files of open batches alone stay as they are.
    entries = [e for e in everything if any(r != open_now.get(load) for load, r in e["loads"].items())]
    if not entries:
        return 0
    rows = read_entries(spark, bad.store.table, _schema(extra), entries)
    judged = judge(rows.where(~_in_batches(open_now)))
    loads = merge_loads(e["loads"] for e in entries)
    moved = write_files(enrich(good_rows(judged), zone=zone), good.store.table, ["process_date"], loads)
    count = sum(e["rows"] for day in moved.values() for e in day)
    if not count:
        return 0
    left = malformed_rows(judged).select(*rows.columns).union(rows.where(_in_batches(open_now)))
    plan = {
        "gone": [e["path"] for e in entries],
        "left": write_files(left, bad.store.table, [], loads).get("", []),
        "kept": [e["path"] for e in everything if e not in entries],
    }
    number = _next_plan(bad)
    if not bad.store.publish(_plan_file(number), json.dumps(plan)):
        raise Conflict(number)

    def change(latest: Version) -> Change:
        then = bad.latest()
        if _numbers(latest) != _numbers(then) or not set(plan["gone"]) <= {e["path"] for e in bad.entries(then, "")}:
            raise Conflict(number)
        return Change(dict(moved))

    good.commit("replay", merge_loads([loads, {REPLAY: [[number, number]]}]), change)
    _settle(spark, bad, good, extra)
    return count


def _settle(spark: SparkSession, bad: Table, good: Table, extra: dict[str, str] | None) -> None:
    """Take out of the quarantine what replays have committed to the facts."""
    decided, done = _numbers(good.latest()), _numbers(bad.latest())
    for low, high in decided:
        for number in range(low, high + 1):
            if not in_ranges(done, number):
                _take_out(spark, bad, number, extra)


def _take_out(spark: SparkSession, bad: Table, number: int, extra: dict[str, str] | None) -> None:
    plan = json.loads(bad.store.read(_plan_file(number)))
    gone, known = set(plan["gone"]), {*plan["gone"], *plan["kept"]}

    def change(latest: Version) -> Change:
        if in_ranges(_numbers(latest), number):
            return Change({})
        entries = bad.entries(latest, "")
        here = gone & {e["path"] for e in entries}
        left = plan["left"]
        if here != gone:
            # A batch was written again since: its rows of then, here and in the facts, have
            # been replaced. New files of several batches are those of the plan without it.
            new = [e for e in entries if e["path"] not in known]
            here |= {e["path"] for e in new if not _one_batch(e["loads"])}
            again = merge_loads(e["loads"] for e in new if _one_batch(e["loads"]))
            rows = read_entries(spark, bad.store.table, _schema(extra), left)
            loads = merge_loads(e["loads"] for e in left)
            left = write_files(rows.where(~_in_batches(again)), bad.store.table, [], loads).get("", [])
        return Change({"": left} if left else {}, {"": here} if here else {})

    bad.commit("replay", {REPLAY: [[number, number]]}, change)
