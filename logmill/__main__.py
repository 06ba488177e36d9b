"""Command line: ``python -m logmill batch|stream|rollup|day|days|replay|compact|history|vacuum|publish|synth``."""

import argparse
from datetime import UTC, datetime

from logmill.functions.clock import as_day, today
from logmill.operators import serving
from logmill.plans.batch import analyze
from logmill.schema import ENRICHED_FIELDS
from logmill.session import build_session
from logmill.sources import partials
from logmill.sources.compact import compact
from logmill.sources.lines import publish, publish_stream, read_text_lines, read_topic, records, stream_text_lines
from logmill.sources.synthetic import synthetic_log
from logmill.sources.tables import read_facts, vacuum
from logmill.sources.versions import Table
from logmill.streaming.accounts import keep_accounts
from logmill.streaming.pipelines import (
    await_streams,
    connector_writer,
    console_writer,
    fact_writer,
    fan_out,
    quarantine_writer,
)
from logmill.streaming.replay import replay
from logmill.streaming.rollup import ROLLUP_FIELDS, update_rollup


def _batch(spark, args):
    with analyze(spark, args.path, args.store) as analysis:
        analysis.parsed.printSchema()
        analysis.parsed.show(5)
        for title, report in analysis.reports.items():
            print(title)
            report.show(truncate=False)
        print("malformed lines")
        analysis.malformed.groupBy("reason").count().show()


def _topic(spark, args):
    options = {"maxOffsetsPerTrigger": args.batch_records} if args.batch_records else {}
    return records(
        read_topic(spark, args.brokers, args.topic, args.starting_offsets, **options)
    )


def _trigger(args):
    return {"processingTime": args.every}


def _stream(spark, args):
    writers = [] if args.sink else [fact_writer(f"{args.out}/facts")]
    if args.sink:
        options = dict(option.split("=", 1) for option in args.sink_option)
        writers.append(connector_writer(args.sink, f"{args.out}/ledger", **options))
    if args.console:
        writers.append(console_writer())
    keep_accounts(spark, f"{args.out}/accounts")
    await_streams(
        fan_out(
            _topic(spark, args),
            writers,
            [quarantine_writer(f"{args.out}/quarantine")],
            f"{args.out}/checkpoints/facts",
            _trigger(args),
            args.zone,
        )
    )


def _rollup(spark, args):
    keep_accounts(spark, f"{args.out}/accounts")
    await_streams(
        update_rollup(
            _topic(spark, args), f"{args.out}/minutes", f"{args.out}/checkpoints/minutes",
            _trigger(args), args.zone,
        )
    )


def _day(spark, args):
    day = as_day(args.day) if args.day else today(args.zone)
    between = None
    if args.hour is not None:
        between = {"process_timestamp": (f"{day} {args.hour:02}:00", f"{day} {args.hour:02}:59")}
    facts = read_facts(spark, args.facts, day, between=between)
    if facts.isEmpty():
        print("No data available for the day")
        return
    for figure in (
        serving.total_requests_by_minute,
        serving.response_codes_by_minute,
        serving.response_code_distribution,
        serving.output_bytes_by_minute,
    ):
        rows = figure(facts, day)
        if args.json:
            rows = serving.rows_as_json(rows)
        print(figure.__name__)
        rows.show(truncate=False)


def _days(spark, args):
    print(f"{len(partials.refresh_partials(spark, args.facts, args.partials))} days made anew")
    made = partials.read_partials(spark, args.partials, args.first, args.last)
    for figure in (
        partials.response_code_totals,
        partials.response_code_counts,
        partials.requests_per_user_agent,
        partials.requests_per_ip,
    ):
        print(figure.__name__)
        figure(made).show(truncate=False)


def _compact(spark, args):
    compact(spark, args.table, args.day, ROLLUP_FIELDS if args.rollup else ENRICHED_FIELDS)


def _replay(spark, args):
    moved = replay(spark, f"{args.out}/quarantine", f"{args.out}/facts", args.zone, stopped=args.stopped)
    print(f"{moved} records moved to the facts")


def _history(spark, args):
    for version in Table(spark, args.table).history():
        at = datetime.fromtimestamp(version.at, UTC).isoformat(" ", "seconds")
        print(version.number, at, version.what, f"{len(version.days)} dates", sep="\t")


def _vacuum(spark, args):
    print(f"{vacuum(spark, args.table, args.keep_hours)} versions, lists and folders removed")


def _publish(spark, args):
    if not args.follow:
        publish(read_text_lines(spark, args.path), args.brokers, args.topic)
        return
    options = dict(option.split("=", 1) for option in args.sink_option)
    lines = stream_text_lines(spark, args.path)
    trigger = {"availableNow": True} if args.once else {"processingTime": "10 seconds"}
    query = publish_stream(
        lines, args.brokers, args.topic, args.follow, trigger=trigger, connector=args.connector, **options
    )
    await_streams(query)


def _synth(spark, args):
    synthetic_log(spark, args.lines, args.seed).write.text(args.path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logmill")
    commands = top.add_subparsers(required=True)

    def command(name, run, about):
        added = commands.add_parser(name, help=about)
        added.set_defaults(run=run)
        return added

    batch = command("batch", _batch, "statistics of a log file or folder")
    batch.add_argument("path")
    batch.add_argument("--store", help="keep the parsed rows here as Parquet")

    for name, run, about in (
        ("stream", _stream, "topic records to date-partitioned tables"),
        ("rollup", _rollup, "topic records to figures per minute and code"),
    ):
        stream = command(name, run, about)
        stream.add_argument("--brokers", required=True)
        stream.add_argument("--topic", required=True)
        stream.add_argument("--out", required=True, help="folder for tables and checkpoints")
        stream.add_argument("--starting-offsets", default="latest")
        stream.add_argument("--batch-records", help="most records per micro-batch")
        stream.add_argument("--every", default="1 minute")
        stream.add_argument("--zone", default="UTC")
        if name == "stream":
            stream.add_argument("--console", action="store_true", help="also show each batch")
            stream.add_argument("--sink", help="append good rows through this connector instead of a table")
            stream.add_argument("--sink-option", action="append", default=[], metavar="KEY=VALUE")

    day = command("day", _day, "per-minute figures of one day")
    day.add_argument("facts")
    day.add_argument("--day", help="yyyy-mm-dd or yyyymmdd, default today")
    day.add_argument("--hour", type=int, choices=range(24), help="only this hour of the day")
    day.add_argument("--zone", default="UTC")
    day.add_argument("--json", action="store_true")

    days = command("days", _days, "figures over many days, from partial figures of each")
    days.add_argument("facts")
    days.add_argument("partials", help="folder of the partial figures; changed days are made anew")
    days.add_argument("--first", help="yyyy-mm-dd or yyyymmdd, default all")
    days.add_argument("--last", help="yyyy-mm-dd or yyyymmdd, default all")

    merge = command("compact", _compact, "merge the batches of a closed day")
    merge.add_argument("table")
    merge.add_argument("--day", required=True, help="yyyy-mm-dd or yyyymmdd")
    merge.add_argument("--rollup", action="store_true", help="the table is a minute rollup")

    again = command("replay", _replay, "move records of the quarantine that parse now to the facts")
    again.add_argument("out", help="folder that stream writes to")
    again.add_argument("--zone", default="UTC")
    again.add_argument("--stopped", action="store_true", help="the stream is not running: take its last batch too")

    history = command("history", _history, "versions of a table")
    history.add_argument("table")

    tidy = command("vacuum", _vacuum, "remove files that no recent version of a table needs")
    tidy.add_argument("table")
    tidy.add_argument("--keep-hours", type=float, default=168)

    sender = command("publish", _publish, "send the lines of a log file to a topic")
    sender.add_argument("path")
    sender.add_argument("--brokers", required=True)
    sender.add_argument("--topic", required=True)
    sender.add_argument("--follow", metavar="CHECKPOINT", help="go on with new files of the folder")
    sender.add_argument("--once", action="store_true", help="with --follow: end when all files are sent")
    sender.add_argument("--connector", default="kafka", help="with --follow: sink that takes a value column")
    sender.add_argument("--sink-option", action="append", default=[], metavar="KEY=VALUE")

    synth = command("synth", _synth, "write synthetic log lines as text")
    synth.add_argument("path")
    synth.add_argument("--lines", type=int, default=1_000_000)
    synth.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
