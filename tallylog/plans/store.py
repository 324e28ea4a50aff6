"""The store of parsed results: Parquet folders, committed wave by wave.

A batch is up to BATCH_ROWS lines of a source.  A wave is a number of spans of one or more
sources, up to WAVE_BYTES, that one Spark job parses and writes, below a folder by job and
wave and, within it, by kind.  The wave's spans are counted before, and a wave whose rows
aren't as many as its lines fails the job.  A wave counts once its entry is in the manifest,
which is written last, with the place at which each source goes on: bytes, lines and the W3C
header.  A run that failed, was interrupted or cancelled goes on there and reads nothing
before it.  The entry also has the times and batches of each file, so pages open the files
that can have their rows.

Small tables (jobs, sources, profiles, views, bookmarks) are JSON files that are replaced in
one step, under a lock.  Opening a store changes nothing: an import holds a lease, and a job
that is called running without one is interrupted.  Raw text is never written.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.operators.filters import FilterError, LogFilter
from tallylog.operators.paging import Cursor, Page, cut_page, page_plan
from tallylog.plans import lease
from tallylog.plans.manifest import Manifest
from tallylog.plans.schema import BATCH_ERRORS, BATCH_ROWS, BOOKMARKS, IMPORT_BATCHES, IMPORT_JOB_SOURCES, IMPORT_JOBS, LOGS, PARSE_ERRORS, PARSER_PROFILES, RESUMABLE, SAVED_VIEWS, SOURCES, STORE_VERSION, VIEW_NAME_BYTES
from tallylog.sources import lines as files
from tallylog.sources import parse, ranges, storage
from tallylog.sources.formats import definition_hash

#: bytes of the spans of one wave, files whose first look is taken together, and files that a page opens at first
WAVE_BYTES, LOOK_FILES, PAGE_FILES = 64 << 30, 10_000, 4
#: seconds after which a lock that a process left behind is removed
LOCK_SECONDS = 20.0
TABLES = ("jobs", "sources", "profiles", "views", "bookmarks")
#: columns of stored rows
_ROWS = {f.name: f.dataType.simpleString() for f in LOGS} | {"code": "string", "field": "string", "kind": "string", "wave": "bigint"}


class StoreError(ValueError):
    pass


class Store:
    """One project folder, local or on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.files = storage.storage(spark, root)
        self.root = self.files.url
        self.manifest = Manifest(self.files)
        found = self.version()
        if found > STORE_VERSION:
            raise StoreError(f"the store has version {found}, this library {STORE_VERSION}")
        if found < STORE_VERSION:
            self.migrate()

    # --- layout -------------------------------------------------------------------------

    def version(self) -> int:
        data = self.files.read("version.json")
        if data is not None:
            return json.loads(data)["version"]
        return 1 if self.files.exists("jobs.json") or self.files.exists("batches.json") else 0

    def migrate(self, target: int = STORE_VERSION) -> None:
        """Bring the layout up, step by step; each step's version is written when it is whole, and until then the old layout is read."""
        with lease.Lease(self.files, job_id=None):
            for version, step in enumerate((lambda: None, self._to_folders, self._to_log_kinds), 1):
                if self.version() < version <= target:
                    step()
                    self.files.replace("version.json", json.dumps({"version": version}).encode())

    def _to_folders(self) -> None:
        """Version 1 had its tables at the top, and one list of batches, by waves below jobs, rows by kind and batch."""
        for name in TABLES:
            if (data := self.files.read(f"{name}.json")) is not None:
                self.files.replace(f"tables/{name}.json", data)
        waves: dict[tuple[int, int], list[dict]] = {}
        for b in json.loads(self.files.read("batches.json") or b"[]"):
            waves.setdefault((b["job_id"], b["wave"]), []).append(b)
        for name in self.files.names("manifest"):
            self.files.delete(f"manifest/{name}")
        for (job, wave), batches in sorted(waves.items()):
            number = self.manifest.next_number()
            self._save_batches(number, batches)
            self.manifest.append(_entry(job, batches, f"rows/job_id={job}/wave={wave}", None))

    def _to_log_kinds(self) -> None:
        """Jobs without a kind get the one that their profile's name tells."""
        errors = {p["profile_id"] for p in self._load("profiles") if p["name"].startswith("error_log")}
        with self._table("jobs") as rows:
            rows[:] = [r | {"log_kind": r.get("log_kind") or ("error" if r["profile_id"] in errors else "access")} for r in rows]

    # --- small tables -------------------------------------------------------------------

    def _load(self, name: str) -> list[dict]:
        data = self.files.read(f"tables/{name}.json")
        return json.loads(data) if data else []

    @contextmanager
    def _table(self, name: str) -> Iterator[list[dict]]:
        """The rows of a small table, to be changed in place; nobody else changes them meanwhile."""
        lock, mine = f"tables/{name}.lock", json.dumps({"at": time.time(), "by": uuid.uuid4().hex}).encode()
        while not self.files.create(lock, mine):
            held = self.files.read(lock)
            if held and time.time() - json.loads(held)["at"] > LOCK_SECONDS:
                self.files.rename(lock, f"tables/{name}.{uuid.uuid4().hex}.old")
            time.sleep(0.02)
        try:
            rows = self._load(name)
            yield rows
            self.files.replace(f"tables/{name}.json", json.dumps(rows).encode())
        finally:
            self.files.delete(lock)

    def _add(self, name: str, key: str, row: dict) -> int:
        with self._table(name) as rows:
            row[key] = max((r[key] for r in rows), default=0) + 1
            rows.append(row)
        return row[key]

    def _update(self, name: str, key: str, value: int, **changes: object) -> None:
        with self._table(name) as rows:
            rows[:] = [r | changes if r[key] == value else r for r in rows]

    def _frame(self, rows: list[dict], schema: object) -> DataFrame:
        when = {f.name for f in schema if f.dataType.typeName() == "timestamp"}
        return self.spark.createDataFrame([tuple(datetime.fromtimestamp(r[f], UTC) if f in when and r.get(f) is not None else r.get(f) for f in schema.names) for r in rows], schema)

    def _refuse_while_importing(self) -> None:
        if told := lease.holder(self.files):
            raise StoreError(f"a job is being imported: {told.get('job_id')}")

    # --- sources, profiles, jobs --------------------------------------------------------

    def upsert_profile(self, profile: dict) -> int:
        digest = definition_hash(profile)
        for p in self._load("profiles"):
            if p["definition_hash"] == digest:
                return p["profile_id"]
        return self._add("profiles", "profile_id", {"name": profile["name"], "version": profile["version"], "definition_json": json.dumps(profile), "definition_hash": digest})

    def profile(self, profile_id: int) -> dict:
        """The definition of a profile."""
        return next(json.loads(p["definition_json"]) for p in self._load("profiles") if p["profile_id"] == profile_id)

    def register_source(self, path: str) -> int:
        return self.register_sources([path])[0]

    def register_sources(self, paths: list[str]) -> list[int]:
        """Ids of files, the same as before for those that are known and unchanged."""
        own = files.identities_of(self.spark, paths)
        with self._table("sources") as rows:
            held = {(s["current_path"], s["file_size"], s["head_hash"]): s["source_id"] for s in rows}
            last, found = max((s["source_id"] for s in rows), default=0), []
            for path, told in zip(paths, own, strict=True):
                key = (path, told["file_size"], told["head_hash"])
                if key not in held:
                    last += 1
                    held[key] = last
                    rows.append({"source_id": last, "original_path": path, "current_path": path, "encoding": "utf-8", "registered_at": time.time()} | told)
                found.append(held[key])
        return found

    def relink(self, source_id: int, path: str) -> None:
        """The same file at another place."""
        self._refuse_while_importing()
        if not self.verify(source_id, path):
            raise StoreError("another file is at that place")
        self._update("sources", "source_id", source_id, current_path=path)

    def verify(self, source_id: int, path: str | None = None) -> bool:
        row = next(s for s in self._load("sources") if s["source_id"] == source_id)
        own = files.identity(self.spark, path or row["current_path"], whole=row.get("full_hash") is not None)
        return all(own[k] == row[k] for k in ("file_size", "head_hash", "full_hash"))

    def create_job(self, profile_id: int, source_ids: list[int], log_kind: str = "access", replaces: int | None = None) -> int:
        version = 1 + sum(1 for j in self._load("jobs") if j.get("replaces_job_id") == replaces and replaces is not None)
        return self._add("jobs", "job_id", {
            "result_version": version, "status": "queued", "profile_id": profile_id, "started_at": time.time(), "finished_at": None, "committed_records": 0, "committed_errors": 0,
            "committed_skipped": 0, "failure_reason": None, "active": replaces is None, "replaces_job_id": replaces, "log_kind": log_kind, "source_ids": source_ids,
        })

    def _jobs(self) -> list[dict]:
        """The jobs as they are: one that is called running is interrupted if nobody imports it."""
        told = lease.holder(self.files)
        alive = told.get("job_id") if told else None

        def state(job: dict) -> str:
            if job["status"] != "running":
                return job["status"]
            if job["job_id"] != alive:
                return "interrupted"
            return "cancelling" if self.files.exists(f"tokens/import-{alive}") else "running"

        return [j | {"status": state(j)} for j in self._load("jobs")]

    def job(self, job_id: int) -> dict:
        for job in self._jobs():
            if job["job_id"] == job_id:
                return job
        raise StoreError("no such job")

    def activate(self, job_id: int) -> None:
        """Show a finished job's results, and no longer those that it replaces."""
        self._refuse_while_importing()
        job = self.job(job_id)
        if job["status"] not in ("completed", "completed_with_errors"):
            raise StoreError("only finished jobs are shown")
        with self._table("jobs") as rows:
            rows[:] = [r | {"active": r["job_id"] == job_id} if r["job_id"] in (job_id, job["replaces_job_id"]) else r for r in rows]

    def delete_results(self, job_id: int) -> None:
        self._refuse_while_importing()
        job = self.job(job_id)
        if job["status"] in ("running", "queued", "cancelling") or job["active"] and job["status"].startswith("completed"):
            raise StoreError("the results are in use")
        waves = [e["wave"] for e in self.manifest.entries() if e["job_id"] == job_id]
        self.manifest.append({"deleted": job_id})
        self.files.delete(f"rows/job_id={job_id}")
        for wave in waves:
            self.files.delete(f"batches/{wave:012d}.json")
        with self._table("jobs") as rows:
            rows[:] = [j for j in rows if j["job_id"] != job_id]

    # --- import -------------------------------------------------------------------------

    def run(self, job_id: int, profile: dict, batch_rows: int = BATCH_ROWS, wave_bytes: int = WAVE_BYTES, progress: Callable[[dict], None] | None = None) -> dict:
        """Parse and commit what the job hasn't committed yet, wave by wave; ``progress`` is told the job's counts after each."""
        try:
            with lease.Lease(self.files, job_id=job_id) as held:
                job = next((j for j in self._load("jobs") if j["job_id"] == job_id), None)
                # whoever has the lease knows that a job called running was interrupted
                if job is None or job["status"] not in ("queued", "running", *RESUMABLE):
                    raise StoreError("the job isn't waiting")
                self._update("jobs", "job_id", job_id, status="running", failure_reason=None, finished_at=None)
                try:
                    with lease.Stoppable(self.spark, self.files, f"import-{job_id}") as work:
                        self._run(job_id, job["source_ids"], profile, batch_rows, wave_bytes, held, work, progress)
                    status, why = "completed_with_errors" if self._counts(job_id)["error"] else "completed", None
                except lease.Stopped:
                    status, why = "cancelled", None
                except Exception as error:
                    self._update("jobs", "job_id", job_id, status="failed", failure_reason=str(error) if isinstance(error, StoreError) else type(error).__name__, finished_at=time.time())
                    raise
                self._update("jobs", "job_id", job_id, status=status, failure_reason=why, finished_at=time.time())
        except lease.Busy as busy:
            raise StoreError(str(busy)) from busy
        return self.job(job_id)

    def cancel(self, job_id: int) -> None:
        """Ask a running job to stop, from any process: its wave is given up, those before it stay; a waiting job is stopped at once."""
        status = self.job(job_id)["status"]
        if status == "running":
            lease.stop(self.files, f"import-{job_id}")
        elif status == "queued":
            self._update("jobs", "job_id", job_id, status="cancelled", finished_at=time.time())
        else:
            raise StoreError("the job doesn't run")

    def _unchanged(self, sources: Iterable[dict]) -> None:
        own = list(sources)
        for row, told in zip(own, files.identities_of(self.spark, [s["current_path"] for s in own]), strict=True):
            if any(told[k] != row[k] for k in ("file_size", "head_hash")):
                raise StoreError(f"source {row['source_id']} has changed")

    def _counts(self, job_id: int) -> dict[str, int]:
        own = [e for e in self.manifest.entries() if e["job_id"] == job_id]
        return {k: sum(e[k] for e in own) for k in ("record", "error", "skipped")}

    def _ends(self, job_id: int) -> dict[int, dict]:
        """Where each source of a job goes on."""
        found: dict[int, dict] = {}
        for e in self.manifest.entries():
            if e["job_id"] == job_id:
                found |= {int(s): told for s, told in e["sources"].items()}
        return found

    def _run(self, job_id: int, source_ids: list[int], profile: dict, batch_rows: int, wave_bytes: int, held: lease.Lease, work: lease.Stoppable, progress: Callable[[dict], None] | None) -> None:
        rows = {s["source_id"]: s for s in self._load("sources")}
        headers = profile["strategy"]["kind"] == "w3c"
        ends = self._ends(job_id)
        starts = {s: ranges.Start(e["offset"], e["line"], e["header"]) for s, e in ends.items() if e["offset"] is not None}
        for first in range(0, len(source_ids), LOOK_FILES):
            some = [rows[s] for s in source_ids[first : first + LOOK_FILES]]
            self._unchanged(some)
            # a job of an older layout knows its lines, but not its bytes
            local = [s for s in some if storage.mounted(self.spark, s["current_path"]) is not None and (s["source_id"] in starts or s["source_id"] not in ends)]
            for spans, size in self._waves(local, starts, headers, wave_bytes):
                work.check()
                lines: dict[int, int] = {}
                for s in spans:
                    lines[s.source_id] = lines.get(s.source_id, 0) + s.lines
                if sum(lines.values()):
                    self._commit(job_id, files.read_spans(self.spark, spans, headers, size), {s: n for s, n in lines.items() if n}, [rows[s] for s in lines], profile, batch_rows, held, work)
                    if progress:
                        progress(self.job(job_id))
            far = [s for s in some if s not in local]
            if far:
                work.check()
                whole, counts = files.read_counted(self.spark, [(s["source_id"], s["current_path"]) for s in far], headers)
                left = {s: n - ends.get(s, {}).get("line", 0) for s, n in counts.items()}
                if any(left.values()):
                    self._commit(job_id, whole, {s: n for s, n in left.items() if n}, far, profile, batch_rows, held, work)
                    if progress:
                        progress(self.job(job_id))

    def _waves(self, sources: list[dict], starts: dict[int, ranges.Start], headers: bool, wave_bytes: int) -> Iterator[tuple[list[ranges.Span], int]]:
        """(numbered spans, bytes of a span) of each wave; spans are counted wave by wave, packed files when their turn comes."""
        total = sum(s["file_size"] for s in sources)
        size = ranges.span_bytes(self.spark, min(total, wave_bytes))
        state, first = dict(starts), 0
        while first < len(sources):
            # as many files as a wave may have bytes, one at least; their packed ones are looked into together
            upto, used = first, 0
            while upto < len(sources) and (upto == first or used + sources[upto]["file_size"] <= wave_bytes):
                used += sources[upto]["file_size"]
                upto += 1
            pending = self._pending(sources[first:upto], state, headers, size)
            first, k = upto, 0
            while k < len(pending):
                wave, used = [], 0
                while k < len(pending) and (not wave or used + pending[k].high - pending[k].low <= wave_bytes):
                    wave.append(pending[k])
                    used += pending[k].high - pending[k].low
                    k += 1
                plain = ranges.counted(self.spark, [s for s in wave if not s.packed], state, headers, size)
                # what lies before a source's next spans
                for s in plain:
                    state[s.source_id] = ranges.Start(s.high, s.before + s.lines, s.last)
                yield plain + [s for s in wave if s.packed], size

    def _pending(self, sources: list[dict], starts: dict[int, ranges.Start], headers: bool, size: int) -> list[ranges.Span]:
        """The spans of some files from where each starts; those of packed ones by the lists of their members, which are made once."""
        paths = {s["source_id"]: storage.mounted(self.spark, s["current_path"]) for s in sources}
        name = lambda source: f"members/{source}{'-w3c' if headers else ''}.json"
        known = {s["source_id"]: self.files.read(name(s["source_id"])) for s in sources if s["compression"] == "gzip"}
        fresh = [ranges.Span(i, paths[i], True, 0, 0, 0, 0) for i, data in known.items() if data is None]
        if fresh:
            found: dict[int, list] = {s.source_id: [] for s in fresh}
            for s in ranges.counted(self.spark, fresh, {}, headers, size):
                found[s.source_id].append([s.physical, s.at, s.low, s.high, s.before, s.lines, s.header, s.last])
            for source, rows in found.items():
                known[source] = json.dumps(rows).encode()
                self.files.replace(name(source), known[source])
        spans: list[ranges.Span] = []
        for s in sources:
            source, start = s["source_id"], starts.get(s["source_id"], ranges.Start())
            if source not in known:
                if start.offset < s["file_size"]:
                    spans += ranges.cut([ranges.Span(source, paths[source], False, start.offset, start.offset, start.offset, s["file_size"])], size)
                continue
            for physical, at, low, high, before, lines, header, last in json.loads(known[source]):
                if start.offset < high:
                    if start.offset > low:
                        low, before, lines, header = start.offset, start.line, before + lines - start.line, start.header
                    spans.append(ranges.Span(source, paths[source], True, physical, at, low, high, before, lines, header, last))
        return spans

    def _commit(self, job_id: int, lines: DataFrame, expected: dict[int, int], sources: list[dict], profile: dict, batch_rows: int, held: lease.Lease, work: lease.Stoppable) -> None:
        """Parse and write a wave's lines, compare what was written with what was counted, and enter the wave."""
        before = {s: e["line"] for s, e in self._ends(job_id).items()}
        last_batch = self.max_batch()
        # batches of a source are runs of lines; a source's first one in this wave begins after what is done
        first, shift = {}, last_batch
        for s in sorted(expected):
            first[s] = (before.get(s, 0), shift + 1)
            shift += -(-expected[s] // batch_rows)
        begins = self.spark.createDataFrame([(s, a, b) for s, (a, b) in first.items()], "source_id long, _after long, _first long")
        outcomes = parse.parse(lines, profile)
        numbered = outcomes.join(F.broadcast(begins), "source_id") if len(first) <= 1 << 20 else outcomes.join(begins, "source_id")
        numbered = numbered.where(F.col("line_number") > F.col("_after"))
        batch = F.floor((F.col("line_number") - F.col("_after") - 1) / batch_rows).cast("long") + F.col("_first")
        flat = [f"record.{n}" for n in LOGS.names if n in parse.RECORD_NAMES]
        places = [c for c in parse.PLACES if c in numbered.columns and (c != "header" or profile["strategy"]["kind"] == "w3c")]
        rows = numbered.select("source_id", "line_number", *flat, parse.extra_json(F.col("record.extra")).alias("extra_json"), "code", "field", "kind", batch.alias("batch_id"), *places)
        number = self.manifest.next_number()
        folder = f"rows/job_id={job_id}/wave={number}"
        rows.sortWithinPartitions("kind", "timestamp_utc", "source_id", "line_number").write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/{folder}")
        told = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("record", "error", "skipped")]
        span = [F.min("line_number").alias("first"), F.max("line_number").alias("last"), *([F.min("start_offset").alias("from"), F.max("next_offset").alias("to")] if "next_offset" in places else [])]
        state = [F.max_by("header", "line_number").alias("header")] if "header" in places else []
        times = [F.min(F.unix_micros("timestamp_utc")).alias("least"), F.max(F.unix_micros("timestamp_utc")).alias("most"), F.count_if(F.col("timestamp_utc").isNull()).alias("untimed")]
        # one row for each batch and file that has rows of it
        parts = told.groupBy("batch_id", "source_id", "kind", F.col("_metadata.file_path").alias("file")).agg(*counts, *span, *state, *times).collect()
        batches, zones = _merged(parts, self.root)
        for s, n in expected.items():
            seen = sum(b["record_count"] + b["error_count"] + b["skipped_count"] for b in batches if b["source_id"] == s)
            if seen != n:
                raise StoreError(f"source {s}: {seen} rows were written for {n} lines")
        work.check()
        self._unchanged(sources)
        total = self._counts(job_id)
        if total["error"] + sum(b["error_count"] for b in batches) > BATCH_ERRORS and not total["record"] + sum(b["record_count"] for b in batches):
            raise StoreError("the file doesn't fit its format")
        if not held.held():
            raise StoreError("another process has taken the import over")
        now, seqs = time.time(), {s: e["batches"] for s, e in self._ends(job_id).items()}
        for b in batches:
            seqs[b["source_id"]] = seqs.get(b["source_id"], 0) + 1
            b |= {"job_id": job_id, "batch_seq": seqs[b["source_id"]] - 1, "committed_at": now}
        self._save_batches(number, batches)
        if self.manifest.append(_entry(job_id, batches, folder, zones)) != number:
            raise StoreError("another process has written to the store")
        total = self._counts(job_id)
        self._update("jobs", "job_id", job_id, committed_records=total["record"], committed_errors=total["error"], committed_skipped=total["skipped"])

    def _save_batches(self, number: int, batches: list[dict]) -> None:
        self.files.replace(f"batches/{number:012d}.json", "".join(json.dumps(b) + "\n" for b in batches).encode())

    # --- reading ------------------------------------------------------------------------

    def _read(self, entries: list[dict], kind: str) -> DataFrame | None:
        """Rows of one kind of some waves; other kinds' folders are pruned."""
        kinds = ", ".join(f"{n} {t}" for n, t in _ROWS.items())
        folders = [f"{self.root}/{e['folder']}" for e in entries if e[kind]]
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.root}/rows").schema(kinds).parquet(*folders).where(F.col("kind") == kind)

    def logs(self) -> DataFrame:
        found = self._read(self.manifest.entries(), "record")
        return self.spark.createDataFrame([], LOGS) if found is None else found.select(LOGS.names)

    def parse_errors(self) -> DataFrame:
        found = self._read(self.manifest.entries(), "error")
        if found is None:
            return self.spark.createDataFrame([], PARSE_ERRORS)
        return found.withColumns({"error_code": F.col("code"), "field_name": F.col("field")}).select(PARSE_ERRORS.names)

    def page(self, f: LogFilter, rows: int = 200, descending: bool = False, cursor: Cursor | None = None) -> Page:
        """A page of the rows that ``f`` lets pass, from the files that can have them.

        Files are opened by their times, a few first, until no file that is left can have a
        row before the last one found.
        """
        if cursor is not None and (cursor.digest != f.digest() or cursor.descending != descending):
            raise FilterError("the cursor belongs to another query")
        entries = self.manifest.entries()
        limit = cursor.max_batch if cursor else max((e["last_batch"] for e in entries), default=0)
        jobs = self._jobs_of(f)
        held = [(e, z) for e in entries if e["job_id"] in jobs and e["first_batch"] <= limit for z in e["zones"] or [None]]
        loose = [e for e, z in held if z is None]
        zones = [z for _, z in held if z is not None and self._may_have(z, f, cursor, descending)]
        # by the first time that a file can have in page order; those without times last
        zones.sort(key=lambda z: (z["least"] is None, (-z["most"] if descending else z["least"]) if z["least"] is not None else 0))
        opened = PAGE_FILES
        marks, table = self.bookmarks(), self.jobs()
        while True:
            some, left = zones[:opened], zones[opened:]
            plan = page_plan(self._files(some, loose), f, table, marks, rows, descending, cursor, limit).withColumn("_micros", F.unix_micros("timestamp_utc"))
            got = plan.collect()
            if not left or len(got) > rows and self._settled(got[rows]["_micros"], left, descending):
                return cut_page(got, rows, f, descending, limit)
            opened *= 4

    @staticmethod
    def _may_have(zone: dict, f: LogFilter, cursor: Cursor | None, descending: bool) -> bool:
        timed = zone["least"] is not None
        if f.time_from is not None and (not timed or zone["most"] < f.time_from) or f.time_to is not None and (not timed or zone["least"] > f.time_to):
            return False
        if cursor is None or zone["untimed"]:
            return True
        if cursor.time is None:
            return False
        return zone["least"] <= cursor.time if descending else zone["most"] >= cursor.time

    @staticmethod
    def _settled(last: int | None, left: list[dict], descending: bool) -> bool:
        """Whether all rows of the files that are left come after a row of time ``last``."""
        if last is None:
            return False
        timed = [z for z in left if z["least"] is not None]
        return all(z["most"] < last for z in timed) if descending else all(z["least"] > last for z in timed)

    def _files(self, zones: list[dict], loose: list[dict]) -> DataFrame:
        kinds = ", ".join(f"{n} {t}" for n, t in _ROWS.items())
        paths = [f"{self.root}/{z['file']}" for z in zones]
        found = self.spark.read.option("basePath", f"{self.root}/rows").schema(kinds).parquet(*paths).select(LOGS.names) if paths else self.spark.createDataFrame([], LOGS)
        more = self._read(loose, "record")
        return found if more is None else found.unionByName(more.select(LOGS.names))

    def _jobs_of(self, f: LogFilter) -> set[int]:
        return {j["job_id"] for j in self._jobs() if (f.job_id is None or j["job_id"] == f.job_id) and (not f.active_only or j["active"]) and (f.log_kind is None or j.get("log_kind") == f.log_kind)}

    def time_slices(self, f: LogFilter, files_each: int) -> list[tuple[DataFrame, F.Column]]:
        """(logs, condition) of runs of time in order, each from the files that can have its rows; rows without a time come last."""
        jobs = self._jobs_of(f)
        entries = [e for e in self.manifest.entries() if e["job_id"] in jobs]
        loose = [e for e in entries if e["zones"] is None]
        zones = [z for e in entries for z in e["zones"] or [] if self._may_have(z, f, None, False)]
        timed = sorted((z for z in zones if z["least"] is not None), key=lambda z: z["least"])
        cuts = sorted({z["least"] for z in timed[files_each::files_each]})
        micros, found = F.unix_micros("timestamp_utc"), []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            own = [z for z in timed if (low is None or z["most"] >= low) and (high is None or z["least"] < high)]
            condition = F.col("timestamp_utc").isNotNull()
            condition = condition if low is None else condition & (micros >= low)
            found.append((self._files(own, loose), condition if high is None else condition & (micros < high)))
        untimed = [z for z in zones if z["untimed"]]
        if untimed or loose:
            found.append((self._files(untimed, loose), F.col("timestamp_utc").isNull()))
        return found

    def max_batch(self) -> int:
        """The last committed batch."""
        return max((e["last_batch"] for e in self.manifest.entries()), default=0)

    def last_checkpoint(self, job_id: int, source_id: int) -> dict | None:
        """The last committed batch of a source, after which a run goes on."""
        own = [e["wave"] for e in self.manifest.entries() if e["job_id"] == job_id and str(source_id) in e["sources"]]
        if not own:
            return None
        held = (json.loads(x) for x in (self.files.read(f"batches/{own[-1]:012d}.json") or b"").decode().splitlines())
        return max((b for b in held if b["source_id"] == source_id), key=lambda b: b["batch_seq"], default=None)

    def job_sources(self, job_id: int) -> list[dict]:
        """The job's sources in order, with their paths and how far each is."""
        held = {s["source_id"]: s for s in self._load("sources")}
        job, ends, found = self.job(job_id), self._ends(job_id), []
        for k, source_id in enumerate(job["source_ids"]):
            last = ends.get(source_id)
            state = "completed" if job["status"].startswith("completed") else "queued" if last is None else "running"
            found.append({"job_id": job_id, "source_id": source_id, "ordinal": k, "status": state, "current_path": held[source_id]["current_path"], "original_path": held[source_id]["original_path"], "end_line": last and last["line"]})
        return found

    def table_counts(self) -> dict[str, int]:
        """Rows of every table; those of the large ones are added up from the manifest."""
        entries = self.manifest.entries()
        found = {n: len(self._load(n)) for n in TABLES}
        return found | {"batches": sum(e["batches"] for e in entries), "logs": sum(e["record"] for e in entries), "parse_errors": sum(e["error"] for e in entries)}

    def jobs(self) -> DataFrame:
        return self._frame(sorted(self._jobs(), key=lambda j: -j["job_id"]), IMPORT_JOBS)

    def batches(self) -> DataFrame:
        paths = [f"{self.root}/batches/{e['wave']:012d}.json" for e in self.manifest.entries()]
        if not paths:
            return self.spark.createDataFrame([], IMPORT_BATCHES)
        plain = ", ".join(f"{f.name} {'double' if f.name == 'committed_at' else f.dataType.simpleString()}" for f in IMPORT_BATCHES)
        return self.spark.read.schema(plain).json(paths).withColumn("committed_at", F.col("committed_at").cast("timestamp")).select(IMPORT_BATCHES.names)

    def sources(self) -> DataFrame:
        return self._frame(self._load("sources"), SOURCES)

    def all_job_sources(self) -> DataFrame:
        return self._frame([r for j in self._load("jobs") for r in self.job_sources(j["job_id"])], IMPORT_JOB_SOURCES)

    def profiles(self) -> DataFrame:
        return self._frame(sorted(self._load("profiles"), key=lambda p: p["profile_id"]), PARSER_PROFILES)

    def bookmarks(self) -> DataFrame:
        return self._frame(self._load("bookmarks"), BOOKMARKS)

    def views(self) -> DataFrame:
        return self._frame(sorted(self._load("views"), key=lambda v: v["name"]), SAVED_VIEWS)

    # --- bookmarks and views ------------------------------------------------------------

    def toggle_bookmark(self, source_id: int, line_number: int) -> bool:
        with self._table("bookmarks") as rows:
            kept = [r for r in rows if (r["source_id"], r["line_number"]) != (source_id, line_number)]
            on = len(kept) == len(rows)
            rows[:] = [*kept, {"source_id": source_id, "line_number": line_number, "created_at": time.time()}] if on else kept
        return on

    def save_view(self, name: str, definition: dict) -> int:
        if not 1 <= len(name.strip().encode()) <= VIEW_NAME_BYTES:
            raise StoreError(f"a view's name has 1 to {VIEW_NAME_BYTES} bytes")
        if unknown := set(definition.get("columns", [])) - {*LOGS.names, "bookmarked"}:
            raise StoreError(f"unknown columns: {len(unknown)}")
        text = json.dumps(definition)
        with self._table("views") as rows:
            for v in rows:
                if v["name"] == name:
                    v["definition_json"] = text
                    return v["view_id"]
            rows.append({"view_id": max((v["view_id"] for v in rows), default=0) + 1, "name": name, "definition_json": text})
            return rows[-1]["view_id"]

    def delete_view(self, view_id: int) -> None:
        with self._table("views") as rows:
            rows[:] = [v for v in rows if v["view_id"] != view_id]

    # --- cases --------------------------------------------------------------------------

    @staticmethod
    def cases(spark: SparkSession, folder: str) -> list[str]:
        own = storage.storage(spark, folder)
        return [n for n in own.names("") if own.exists(f"{n}/version.json") or own.exists(f"{n}/jobs.json")]

    @staticmethod
    def create_case(spark: SparkSession, folder: str, name: str) -> str:
        if not re.fullmatch(r"[\w -]{1,64}", name):
            raise StoreError("not a name for a case")
        own = storage.storage(spark, folder)
        if not own.create(f"{name}/version.json", json.dumps({"version": STORE_VERSION}).encode()):
            raise StoreError("the case is there already")
        return f"{own.url}/{name}"

    @staticmethod
    def delete_case(spark: SparkSession, folder: str, name: str) -> None:
        if name not in Store.cases(spark, folder):
            raise StoreError("no such case")
        own = storage.storage(spark, folder)
        if lease.holder(storage.storage(spark, f"{own.url}/{name}")):
            raise StoreError("a job is being imported")
        own.delete(name)


def _entry(job_id: int, batches: list[dict], folder: str, zones: list[dict] | None) -> dict:
    """A wave as the manifest has it; no more rows than it has sources and files."""
    sources: dict[str, dict] = {}
    for b in sorted(batches, key=lambda b: b["batch_seq"]):
        sources[str(b["source_id"])] = {"offset": b.get("next_offset"), "line": b["end_line"], "header": b.get("header_state_json"), "batches": b["batch_seq"] + 1}
    counts = {k: sum(b[f"{k}_count"] for b in batches) for k in ("record", "error", "skipped")}
    return {"job_id": job_id, "folder": folder, "batches": len(batches), "first_batch": min(b["batch_id"] for b in batches), "last_batch": max(b["batch_id"] for b in batches), "sources": sources, "zones": zones} | counts


def _merged(parts: list, root: str) -> tuple[list[dict], list[dict]]:
    """(batches, zones of the files of records) of what was written, one row a batch, kind and file."""
    batches: dict[int, dict] = {}
    zones: dict[str, dict] = {}
    for p in parts:
        told = p.asDict()
        b = batches.setdefault(told["batch_id"], {"batch_id": told["batch_id"], "source_id": told["source_id"], "start_line": told["first"], "end_line": 0, "start_offset": told.get("from"), "next_offset": None, "header_state_json": None, "record_count": 0, "error_count": 0, "skipped_count": 0})
        for k in ("record", "error", "skipped"):
            b[f"{k}_count"] += told[k]
        b["start_line"] = min(b["start_line"], told["first"])
        if told["last"] > b["end_line"]:
            b["end_line"], b["header_state_json"] = told["last"], told.get("header")
        if told.get("to") is not None:
            b["start_offset"], b["next_offset"] = min(b["start_offset"], told["from"]), max(b["next_offset"] or 0, told["to"])
        if told["record"]:
            file = "rows/" + told["file"].rsplit("/rows/", 1)[1]
            z = zones.setdefault(file, {"file": file, "least": None, "most": None, "untimed": 0})
            z["untimed"] += told["untimed"]
            for name, pick in (("least", min), ("most", max)):
                if told[name] is not None:
                    z[name] = told[name] if z[name] is None else pick(z[name], told[name])
    return sorted(batches.values(), key=lambda b: b["batch_id"]), sorted(zones.values(), key=lambda z: z["file"])
