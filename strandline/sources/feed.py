"""A change feed as a Spark data source, in batch and as a stream, over a folder of recorded pages.

A page is a JSON file with a list of change records, newest first, as a live endpoint would give it; pages are named so that they
sort in the order of arrival. The batch reader has a partition per page and leaves out pages and records outside the asked
time; the stream reader's offset is the number of pages read. `land_pages` follows a live endpoint page by page into the folder.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from strandline import schemas


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_pages(path: str) -> list[str]:
    system, folder = _place(path)
    prefix = path[: len(path) - len(folder)] if path.endswith(folder) else ""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.endswith(".json") and not f.base_name.startswith("."))


def read_page(page: str) -> Iterator[tuple]:
    """(title, comment, revid, old_revid, timestamp) of the edits of a page; a page that is no list of records has none."""
    system, path = _place(page)
    try:
        with system.open_input_stream(path) as file:
            records = json.loads(file.read().decode("utf-8"))
    except (OSError, ValueError):
        return
    for r in records if isinstance(records, list) else []:
        if isinstance(r, dict):
            yield r.get("title"), r.get("comment"), r.get("revid"), r.get("old_revid"), r.get("timestamp")


def paged(client: Callable[[dict], dict], since: str | None = None, size: int = 500, wait: float = 5.0, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """The pages of an endpoint, newest first, as far back as `since` (all of them without it).

    client(request) gives {"records": [...], "continue": {...}}; what it says to continue with is put into the next request, and none ends the
    feed. A failed request is tried again after `wait` seconds, without end or `tries` times, after which its error is raised.
    """
    request: dict = {"limit": size, **({"end": since} if since else {})}
    failed = 0
    while True:
        try:
            reply = client(dict(request))
        except Exception:  # noqa: BLE001  whatever the service raises
            failed += 1
            if tries is not None and failed >= tries:
                raise
            sleep(wait)
            continue
        failed = 0
        yield reply.get("records", [])
        if not reply.get("continue"):
            return
        request |= reply["continue"]


def land_pages(pages: Iterator[list[dict]], path: str) -> int:
    """Writes pages into a folder behind those that are there, each whole or not at all, and gives their number."""
    system, folder = _place(path)
    system.create_dir(folder, recursive=True)
    there = len(list_pages(path))
    n = 0
    for n, page in enumerate(pages, 1):
        name = f"{there + n:09d}.json"
        with system.open_output_stream(f"{folder}/.{name}") as file:
            file.write(json.dumps(page, ensure_ascii=False).encode("utf-8"))
        system.move(f"{folder}/.{name}", f"{folder}/{name}")
    return n


class Page(InputPartition):
    def __init__(self, page: str) -> None:
        self.page = page


class FeedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.since, self.until = path, "", "~"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the timestamp are kept by the reader; other filters are left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("timestamp",) and isinstance(f, (GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since, f.value)
            if column == ("timestamp",) and isinstance(f, (LessThanOrEqual, EqualTo)):
                self.until = min(self.until, f.value)
            if column != ("timestamp",) or not isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo)):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in list_pages(self.path)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return (r for r in read_page(partition.page) if r[4] is None and not self.since or r[4] is not None and self.since <= r[4] <= self.until)


class FeedStream(DataSourceStreamReader):
    """Offset: the number of pages there were; a partition per new page."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(list_pages(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(p) for p in list_pages(self.path)[start["pages"] : end["pages"]]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(partition.page)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class ChangeFeed(DataSource):
    """spark.read.format("change_feed").load(folder) and spark.readStream.format("change_feed").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return schemas.CHANGE_RECORD

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangeFeed)
