"""Which waves of rows count: an append-only list of entries, merged level by level.

An entry is a file that is made whole or not at all, under a number that only one writer gets.
A wave of an import is one entry, written after its rows; so is the deletion of a job's
results.  FAN entries of a level are merged into one of the next, so a list of n entries is
read from few files, and adding n of them costs n log n.  Merged files stay until the next
merge, for readers that listed them before.
"""

from __future__ import annotations

import json

from tallylog.sources.storage import HadoopFolder, LocalFolder

#: entries that are merged into one file
FAN = 16


class Manifest:
    def __init__(self, files: LocalFolder | HadoopFolder):
        self.files = files

    def _segments(self) -> list[tuple[int, int, int, str]]:
        """(first, last, level, name) of the files that together hold every entry once, in order; a file of a higher level stands for those that it was merged from."""
        held = []
        for name in self.files.names("manifest"):
            level, first, last = name.removesuffix(".json").split("-")
            held.append((int(first), int(last), int(level), name))
        found, at = [], 0
        for first, last, level, name in sorted(held, key=lambda s: (s[0], -s[1])):
            if first > at:
                found.append((first, last, level, name))
                at = last
        return found

    def entries(self) -> list[dict]:
        """All entries in order, those of deleted results left out."""
        found = []
        for _, _, _, name in self._segments():
            data = self.files.read(f"manifest/{name}")
            if data is None:
                # merged away since it was listed
                return self.entries()
            found += json.loads(data)
        gone = {e["deleted"] for e in found if "deleted" in e}
        return [e for e in found if "deleted" not in e and e["job_id"] not in gone]

    def append(self, entry: dict) -> int:
        """Add an entry under the next number, which it is told as ``wave``."""
        while True:
            held = self._segments()
            number = held[-1][1] + 1 if held else 1
            if self.files.create(f"manifest/0-{number:012d}-{number:012d}.json", json.dumps([entry | {"wave": number}]).encode()):
                self._merge()
                return number

    def next_number(self) -> int:
        held = self._segments()
        return held[-1][1] + 1 if held else 1

    def _merge(self) -> None:
        while True:
            held = self._segments()
            run = [s for s in held if s[2] == held[-1][2]][-FAN:]
            if len(run) < FAN:
                return
            whole = [e for s in run for e in json.loads(self.files.read(f"manifest/{s[3]}"))]
            level = run[0][2] + 1
            if not self.files.create(f"manifest/{level}-{run[0][0]:012d}-{run[-1][1]:012d}.json", json.dumps(whole).encode()):
                return
            if level > 1:
                return
            # what was merged twice is read by nobody any more
            for first, last, lower, name in [(int(n.split("-")[1]), int(n.split("-")[2].removesuffix(".json")), int(n.split("-")[0]), n) for n in self.files.names("manifest")]:
                if lower < level and last < run[0][0]:
                    self.files.delete(f"manifest/{name}")
