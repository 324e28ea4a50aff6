"""One writer at a time, and stopping work from another process.

The writer of a store holds a lease, a file that it renews; a lease that isn't renewed for
LEASE_SECONDS is taken over.  A token is a file whose existence asks for a stop; work that can
be stopped has a job tag, and a thread beside it looks for its token and interrupts the tag's
Spark jobs.  Both are seen by every process that sees the store's folder.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import SparkSession

from tallylog.sources.storage import HadoopFolder, LocalFolder

#: seconds after which a lease that isn't renewed is void, and between looks
LEASE_SECONDS, BEAT = 30.0, 0.5


class Busy(ValueError):
    """Another process writes."""


class Stopped(Exception):
    """The work was asked to stop."""


class Stoppable:
    """``with Stoppable(...):`` work that its token stops; raises Stopped then."""

    def __init__(self, spark: SparkSession, files: LocalFolder | HadoopFolder, token: str):
        self.context, self.files, self.token = spark.sparkContext, files, f"tokens/{token}"
        self.tag, self.hit, self._over = f"tallylog-{uuid.uuid4().hex}", False, threading.Event()

    def check(self) -> None:
        if self.hit or self.files.exists(self.token):
            self.hit = True
            raise Stopped(self.token)

    def beat(self) -> None:
        if not self.hit and self.files.exists(self.token):
            self.hit = True
        if self.hit:
            # again and again, as the work may begin further jobs before it looks
            self.context.cancelJobsWithTag(self.tag)

    def _watch(self) -> None:
        while not self._over.wait(BEAT):
            self.beat()

    def __enter__(self) -> Stoppable:
        self.context.addJobTag(self.tag)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        self._over.set()
        self._thread.join()
        self.context.removeJobTag(self.tag)
        self.files.delete(self.token)
        if self.hit and kind is not None and not issubclass(kind, Stopped):
            raise Stopped(self.token) from error


def stop(files: LocalFolder | HadoopFolder, token: str) -> None:
    files.create(f"tokens/{token}", b"")


def holder(files: LocalFolder | HadoopFolder) -> dict | None:
    """Who writes now, if anyone does."""
    data = files.read("lease.json")
    if not data:
        return None
    told = json.loads(data)
    return told if time.time() - told["renewed_at"] < LEASE_SECONDS else None


class Lease:
    """``with Lease(files, ...):`` the only writer; ``what`` tells others about it."""

    def __init__(self, files: LocalFolder | HadoopFolder, **what: object):
        self.files, self.what, self.owner, self._over = files, what, uuid.uuid4().hex, threading.Event()

    def _content(self) -> bytes:
        return json.dumps({"owner": self.owner, "renewed_at": time.time(), **self.what}).encode()

    def _renew(self) -> None:
        while not self._over.wait(LEASE_SECONDS / 6):
            if self.held():
                self.files.replace("lease.json", self._content())

    def held(self) -> bool:
        data = self.files.read("lease.json")
        return bool(data) and json.loads(data)["owner"] == self.owner

    def __enter__(self) -> Lease:
        while not self.files.create("lease.json", self._content()):
            if told := holder(self.files):
                raise Busy(f"a job is being imported: {told.get('job_id')}")
            # of several processes one moves a void lease away
            if self.files.rename("lease.json", f"lease-{uuid.uuid4().hex}.old"):
                for name in self.files.names(""):
                    if name.startswith("lease-"):
                        self.files.delete(name)
        self._thread = threading.Thread(target=self._renew, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self._over.set()
        self._thread.join()
        if self.held():
            self.files.delete("lease.json")
