"""Jobs for spark-submit.

    python -m workload_lens ingest  --config job.json --snapshots IN --star OUT --batch ID
    python -m workload_lens stream  --config job.json --snapshots IN --star OUT --checkpoint DIR
    python -m workload_lens report  --star OUT --name most_frequent --interval "3 hours"
    python -m workload_lens retain  --star OUT --as-of 2024-01-31 [--config job.json]
    python -m workload_lens maintain --star OUT [--as-of 2024-01-31] [--close-before 2024-01-31]
    python -m workload_lens check   --star OUT
    python -m workload_lens collect --config job.json --url jdbc:postgresql://host/db --star OUT

``maintain`` is to run regularly: it closes days, folds statistics, deletes what is past retention
and what nothing refers to. ``collect`` pulls one window, or with ``--windows`` several, one after
another at the observation interval.
"""

import argparse
import time
from datetime import date, datetime, timedelta, timezone

from workload_lens.config import JobConfig
from workload_lens.operators import checks
from workload_lens.plans import reports
from workload_lens.plans.collect import collect_window
from workload_lens.plans.ingest import ingest_batch
from workload_lens.plans.maintain import maintain
from workload_lens.session import build_session
from workload_lens.sources.snapshots import read_snapshots, stream_snapshots
from workload_lens.sources.star import create_star, drop_expired, read_star
from workload_lens.streaming.ingest import StatusLines, start_ingest

REPORTS = {
    "most_frequent": (reports.report_top, {"by": "calls"}),
    "most_time": (reports.report_top, {"by": "total_ms"}),
    "vs_history": (reports.report_vs_history, {}),
    "role_share_job": (reports.report_role_share, {"keys": ["job_tag"]}),
    "role_share_action": (reports.report_role_share, {"keys": ["controller", "action"]}),
}


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="workload_lens")
    jobs = parser.add_subparsers(dest="job", required=True)
    ingest, stream = jobs.add_parser("ingest"), jobs.add_parser("stream")
    for job in (ingest, stream):
        job.add_argument("--config")
        job.add_argument("--snapshots", required=True)
        job.add_argument("--format", default="parquet")
        job.add_argument("--split-timings", action="store_true")
    ingest.add_argument("--batch", required=True)
    stream.add_argument("--checkpoint", required=True)
    stream.add_argument("--once", action="store_true")
    report, retain = jobs.add_parser("report"), jobs.add_parser("retain")
    report.add_argument("--name", choices=REPORTS, required=True)
    report.add_argument("--interval", default="3 hours")
    report.add_argument("--as-of", type=datetime.fromisoformat)
    for label in ("project", "environment", "cluster"):
        report.add_argument(f"--{label}")
    report.add_argument("--output", help="write the report there instead of showing it")
    keep, check, collect = jobs.add_parser("maintain"), jobs.add_parser("check"), jobs.add_parser("collect")
    retain.add_argument("--as-of", type=date.fromisoformat, required=True)
    keep.add_argument("--as-of", type=date.fromisoformat)
    keep.add_argument("--close-before", type=date.fromisoformat)
    for job in (retain, keep):
        job.add_argument("--config")
        job.add_argument("--days", type=int, help="instead of RetentionDays of the settings")
    collect.add_argument("--config", required=True)
    collect.add_argument("--url", required=True)
    collect.add_argument("--relation", default="pg_stat_statements")
    collect.add_argument("--windows", type=int, default=1)
    for job in (ingest, stream, report, retain, keep, check, collect):
        job.add_argument("--star", required=True)
    return parser.parse_args()


def main() -> None:
    args = arguments()
    spark = build_session()
    config = JobConfig()
    if getattr(args, "config", None):
        text = spark.read.text(args.config, wholetext=True).first()
        config = JobConfig.from_json(text.value)
    if args.job == "ingest":
        snapshots = read_snapshots(spark, args.snapshots, args.format, args.split_timings)
        ingest_batch(snapshots, args.star, args.batch, config)
    elif args.job == "stream":
        snapshots = stream_snapshots(spark, args.snapshots, args.format, args.split_timings)
        query = start_ingest(snapshots, args.star, args.checkpoint, config, args.once)
        with StatusLines(query, config):
            query.awaitTermination()
    elif args.job == "report":
        create_star(spark, args.star)
        build, fixed = REPORTS[args.name]
        wanted = {"project": args.project, "environment": args.environment}
        if build is not reports.report_role_share:
            wanted["cluster"] = args.cluster
        star = read_star(spark, args.star)
        table = build(star, interval=args.interval, as_of=args.as_of, **fixed, **wanted)
        if args.output:
            table.write.parquet(args.output)
        else:
            print("\t".join(table.columns))
            for row in table.toLocalIterator():
                print("\t".join("" if value is None else str(value) for value in row))
    elif args.job == "check":
        for name, violations in checks.store_violations(read_star(spark, args.star).tables()).items():
            print(name, violations.count(), sep="\t")
    elif args.job == "collect":
        collect_windows(spark, args, config)
    else:
        days = config.retention_days if args.days is None else args.days
        if args.job == "retain":
            done = {"expired": drop_expired(spark, args.star, args.as_of, days)}
        else:
            done = maintain(spark, args.star, args.as_of, days, args.close_before)
        for what, names in done.items():
            for name in names:
                print(what, name)
    spark.stop()


def collect_windows(spark, args: argparse.Namespace, config: JobConfig) -> None:
    """Pull windows at the observation interval; a pull that takes longer than it is an overrun."""
    interval = timedelta(seconds=config.observation_interval)
    start = datetime.now(timezone.utc)
    for number in range(args.windows):
        due = start + (number + 1) * interval
        time.sleep(max(0.0, (due - datetime.now(timezone.utc)).total_seconds()))
        collect_window(spark, {"url": args.url}, args.star, (due - interval, due), config, args.relation)
        taken = datetime.now(timezone.utc) - due
        print("window", due.isoformat(), "overrun" if taken > interval else "done", flush=True)


if __name__ == "__main__":
    main()
