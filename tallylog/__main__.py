"""Command line: ``python -m tallylog COMMAND ...`` over one project folder."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tallylog.operators import exporting, paging, reconstruct, rules, stats
from tallylog.operators.filters import LogFilter, apply_filter
from tallylog.plans import lease
from tallylog.plans.store import Store
from tallylog.sources import formats, guessing, lines, synth
from tallylog.streaming.progress import Throttle


def session() -> SparkSession:
    return SparkSession.builder.appName("tallylog").config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()


def show(rows: object) -> None:
    for row in rows.collect() if isinstance(rows, DataFrame) else rows:
        print(json.dumps(row.asDict(True) if hasattr(row, "asDict") else row, default=str, ensure_ascii=False))


def show_stats(found: dict) -> None:
    table = found.pop("table")
    for name, told in found.items():
        show([{name: [r.asDict() for r in told.collect()] if isinstance(told, DataFrame) else told}])
    table.unpersist()


def profile_of(name: str) -> dict:
    if found := formats.preset(name):
        return found
    with open(name, encoding="utf-8") as f:
        return formats.from_text(f.read())


def filter_of(a: argparse.Namespace) -> LogFilter:
    return LogFilter(
        job_id=a.job, active_only=a.job is None, log_kind=a.kind, status=a.status, status_class=a.status_class, client_ip=a.ip, method=a.method, target_contains=a.contains, target_regex=a.regex,
        time_from=a.time_from, time_to=a.time_to, bookmarked_only=a.bookmarked, expr=rules.parse_rule(open(a.rule).read(), a.kind or "access").expr if a.rule else None,
    )


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallylog")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, store: bool = True, filtered: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if store:
            p.add_argument("store")
        for x in arguments:
            p.add_argument(x)
        if filtered:
            for x, kind in (("job", int), ("status", int), ("status-class", int), ("time-from", int), ("time-to", int), ("ip", str), ("method", str), ("contains", str), ("regex", str), ("rule", str)):
                p.add_argument(f"--{x}", type=kind)
            p.add_argument("--kind", choices=("access", "error"))
            p.add_argument("--bookmarked", action="store_true")
        return p

    p = command("gen", "out", store=False)
    p.add_argument("--lines", type=int, default=100_000)
    p.add_argument("--format", choices=synth.FORMATS, default="combined")
    p.add_argument("--seed", type=int, default=1)
    p = command("scan", "folder", store=False)
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    command("preview", "profile", "file", store=False)
    command("profile", "name", store=False)
    p = command("import", "profile")
    p.add_argument("files", nargs="+")
    p.add_argument("--kind", choices=("access", "error"), default="access")
    p.add_argument("--replaces", type=int)
    for name in ("resume", "activate", "delete-results", "cancel", "job-sources"):
        command(name, "job")
    for name in ("jobs", "sources", "counts"):
        command(name)
    command("guess", "file", store=False)
    command("verify", "source")
    p = command("query", filtered=True)
    p.add_argument("--rows", type=int, default=200)
    p.add_argument("--desc", action="store_true")
    p.add_argument("--name", default="query")
    p = command("detail", "source", "line")
    p = command("stats", filtered=True)
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--bucket", default="auto")
    p.add_argument("--offset", type=int, default=0)
    p = command("analyze")
    p.add_argument("--job", type=int)
    p.add_argument("--from-micros", type=int)
    p.add_argument("--to-micros", type=int)
    p.add_argument("--top-n", type=int, default=10)
    p = command("export", "out", filtered=True)
    p.add_argument("--format", choices=("csv", "json_lines"), default="csv")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--name", default="export")
    p = command("stop", "kind", "name")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    store = Store(spark, a.store) if hasattr(a, "store") else None
    match a.command:
        case "gen":
            synth.generate(spark, a.lines, a.format, a.seed).sort("line_number").select("value").write.text(a.out)
        case "scan":
            found = lines.scan(a.folder, tuple(a.include), tuple(a.exclude), spark=spark)
            named = {r.source_id: r for r in lines.detect(lines.read_heads(spark, list(enumerate(found.files)))).collect()} if found.files else {}
            show([{"path": p, "format": named[k].candidate if k in named else None} for k, p in enumerate(found.files)])
        case "preview":
            outcomes, rate = lines.preview(lines.read_heads(spark, [(1, a.file)]), profile_of(a.profile))
            show(outcomes.orderBy("line_number"))
            show(rate)
        case "profile":
            found = profile_of(a.name)
            show([found, {"hash": formats.definition_hash(found), "issues": formats.validate(found)}])
        case "import":
            profile = profile_of(a.profile)
            job = store.create_job(store.upsert_profile(profile), store.register_sources(a.files), a.kind, a.replaces)
            show([store.run(job, profile, progress=Throttle(lambda j: print(json.dumps({k: j[k] for k in ("job_id", "committed_records", "committed_errors")}), file=sys.stderr)))])
        case "resume":
            job = store.job(int(a.job))
            show([store.run(job["job_id"], store.profile(job["profile_id"]))])
        case "activate":
            store.activate(int(a.job))
        case "delete-results":
            store.delete_results(int(a.job))
        case "cancel":
            store.cancel(int(a.job))
        case "stop":
            lease.stop(store.files, f"{a.kind}-{a.name}")
        case "job-sources":
            show(store.job_sources(int(a.job)))
        case "counts":
            show([store.table_counts()])
        case "guess":
            show(list(guessing.profiles(lines.read_heads(spark, [(1, a.file)])).values()))
        case "analyze":
            began = time.time()
            logs = apply_filter(store.logs(), LogFilter(job_id=a.job, time_from=a.from_micros, time_to=a.to_micros), store.jobs(), store.bookmarks())
            show_stats(stats.compute(logs, None, a.top_n))
            show([{"seconds": round(time.time() - began, 3)}])
        case "jobs":
            show(store.jobs())
        case "sources":
            show(store.sources())
        case "verify":
            show([{"unchanged": store.verify(int(a.source))}])
        case "query":
            with lease.Stoppable(spark, store.files, f"query-{a.name}"):
                show(store.page(filter_of(a), a.rows, a.desc).rows)
        case "detail":
            show(paging.detail(store.logs(), store.sources(), int(a.source), int(a.line)).withColumn("text", reconstruct.combined_like()))
        case "stats":
            logs = apply_filter(store.logs(), filter_of(a), store.jobs(), store.bookmarks())
            show_stats(stats.compute(logs, a.kind, a.top, int(a.bucket) if a.bucket.isdigit() else a.bucket, a.offset))
        case "export":
            show([vars(exporting.export_store(store, filter_of(a), a.out, a.format, max_rows=a.max_rows, name=a.name))])
    return 0


if __name__ == "__main__":
    sys.exit(main())
