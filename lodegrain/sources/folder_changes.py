"""Changes of a folder as a stream of its own: what was created, modified or deleted, each once.

A file source only shows new files.  Here a trigger takes a listing and compares it with the one before.  A listing is cut
into shares by the names at the top two levels; each share is walked by a task, in order of path, and written beside the
stream's checkpoint, once for all: a trigger that runs again after a failure finds the listing it made and gives the
same events.  The stream's offset is the listing's number.  Two listings are merged line by line, so a task holds
one folder's names and no more, and the driver none.

The folder and the state must be mounted where the tasks run.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from time import time_ns

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodegrain.sources.files import EXCLUDED, LARGEST

EVENTS = "file_path string, event string, size long, mtime timestamp"
SHARES = 8
Entry = tuple[str, int, int]


def mounted(path: str) -> str | None:
    """The folder of a path without scheme, or of a ``file:`` one; None for a store that is not mounted."""
    return re.sub("^file:/*", "/", path) if re.match("file:", path) or not re.match("[a-zA-Z][a-zA-Z0-9+.-]+:/", path) else None


def walk(root: str, share: int, shares: int, skip: str = "") -> Iterator[Entry]:
    """(path below ``root``, size, milliseconds) of one share's files, in order of the path's parts.  Excluded folders, links to
    folders and ``skip`` are not entered; what goes away meanwhile is left out.  A root that cannot be listed is an error."""

    def below(folder: str, names: tuple[str, ...]) -> Iterator[Entry]:
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError):
            if not names:
                raise
            return
        for e in entries:
            at = (*names, e.name)
            own = len(at) > 2 or zlib.crc32(os.fsencode("/".join(at))) % shares == share
            if e.is_dir(follow_symlinks=False):
                if (own or len(at) < 2) and e.path != skip and not any(x in "/" + "/".join(at) for x in EXCLUDED):
                    yield from below(e.path, at)
            elif own:
                try:
                    stat = e.stat()
                except FileNotFoundError:
                    continue
                if e.is_file():
                    yield "/".join(at), stat.st_size, stat.st_mtime_ns // 1_000_000

    return below(root, ())


def differences(before: Iterable[Entry], now: Iterable[Entry]) -> Iterator[tuple[str, str, int, int]]:
    """(path, event, size, milliseconds) from two listings in order of the path's parts; a deleted file has its last size and time."""
    old, new = iter(before), iter(now)
    a, b = next(old, None), next(new, None)
    while a or b:
        x, y = a and a[0].split("/"), b and b[0].split("/")
        if not b or (a and x < y):
            yield a[0], "deleted", *a[1:]
            a = next(old, None)
        elif not a or y < x:
            yield b[0], "created", *b[1:]
            b = next(new, None)
        else:
            if a[1:] != b[1:]:
                yield b[0], "modified", *b[1:]
            a, b = next(old, None), next(new, None)


class Listings:
    """The written listings of a stream: one file for each number and share, never changed."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def numbers(self) -> dict[int, list[int]]:
        """By share, the numbers of its listings, rising."""
        out: dict[int, list[int]] = {}
        for name in os.listdir(self.folder) if self.folder.is_dir() else ():
            if found := re.fullmatch(r"(\d+)-(\d+)\.jsonl", name):
                out.setdefault(int(found[2]), []).append(int(found[1]))
        return {share: sorted(held) for share, held in out.items()}

    def path(self, number: int, share: int) -> Path:
        return self.folder / f"{number:015d}-{share:04d}.jsonl"

    def keep(self, number: int, share: int, entries: Iterable[Entry]) -> None:
        """Write a listing whole; if another attempt was faster, its listing stays."""
        final, draft = self.path(number, share), self.folder / f".{uuid.uuid4().hex}"
        if final.exists():
            return
        self.folder.mkdir(parents=True, exist_ok=True)
        try:
            with draft.open("w", encoding="utf-8", errors="surrogateescape") as to:
                to.writelines(json.dumps(e, ensure_ascii=True) + "\n" for e in entries)
            try:
                os.link(draft, final)
            except FileExistsError:
                pass
        finally:
            draft.unlink(missing_ok=True)

    def read(self, number: int | None, share: int) -> Iterator[Entry]:
        if number is not None:
            with self.path(number, share).open(encoding="utf-8") as lines:
                for line in lines:
                    yield tuple(json.loads(line))

    def forget(self, number: int) -> None:
        """Remove what is older than each share's last listing up to ``number``."""
        for share, held in self.numbers().items():
            for old in [n for n in held if n <= number][:-1]:
                self.path(old, share).unlink(missing_ok=True)


@dataclass
class Share(InputPartition):
    start: int
    end: int
    share: int


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.shares = options["path"], int(options.get("shares", SHARES))
        self.listings, self.last = Listings(options["state"]), 0

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new number at each trigger, after all before it; the listing is made by the tasks that read it."""
        held = max((n for numbers in self.listings.numbers().values() for n in numbers), default=0)
        self.last = max(time_ns() // 1_000_000, held + 1, self.last + 1)
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(start["listing"], end["listing"], i) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[tuple]:
        self.listings.keep(partition.end, partition.share, walk(self.root, partition.share, self.shares, str(self.listings.folder)))
        held = [n for n in self.listings.numbers()[partition.share] if n <= partition.start]
        before = self.listings.read(held[-1] if held else None, partition.share)
        for path, event, size, ms in differences(before, self.listings.read(partition.end, partition.share)):
            yield os.fsencode(path).decode("utf-8", errors="replace"), event, size, datetime.fromtimestamp(ms / 1000, UTC)

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes").option("state", ...).load(folder)``: rows of EVENTS.  The number of shares must
    stay as it is while a state is kept."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> FolderReader:  # noqa: N802
        return FolderReader(dict(self.options))


def folder_changes(spark: SparkSession, root: str, state: str, shares: int = SHARES) -> DataFrame:
    """The stream of a mounted folder's changes; all files are created in its first batch."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("state", os.path.abspath(mounted(state))).option("shares", shares).load(os.path.abspath(mounted(root)))


def changed_contents(events: DataFrame, root: str) -> DataFrame:
    """(file_path, length, modificationTime, content) of the files that events name and that are still there, read by the tasks
    that hold the events, as they are now; of files too large to be admitted the content is null."""
    top = os.path.abspath(mounted(root))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    stat = os.stat(f"{top}/{path}")
                    content = Path(top, path).read_bytes() if stat.st_size <= LARGEST else None
                except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
                    continue
                at = pa.array([stat.st_mtime_ns // 1_000_000 * 1000], pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([stat.st_size], pa.int64()), at, pa.array([content], pa.binary())], names=["file_path", "length", "modificationTime", "content"])

    return events.select("file_path").distinct().mapInArrow(read, "file_path string, length long, modificationTime timestamp, content binary")
