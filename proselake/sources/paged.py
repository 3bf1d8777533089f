"""Lists that a service hands out page by page, and feeds that it appends to, as data sources; signatures of what it sends.

A list is read by parts that the service can list apart (a payment, a day, a range of ids): each part is a partition, whose pages follow one
another by cursor. A feed has positions; a micro-batch is a range of them, cut into partitions, and Spark's checkpoint remembers
the last one, so a restart goes on where the stream stopped.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Pages of a part at most, items of a page, and seconds that a signature stays good.
MOST_PAGES, PAGE = 100, 100
TOLERANCE = 300
ITEMS = "part string, page int, item_id string, body string"
RECORDS = "position long, body string, signature string"


class Pager(Protocol):
    """A service's list: its parts, and a part's items (each with an ``id``) behind a cursor, and whether more follow."""

    def parts(self) -> list[str]: ...

    def page(self, part: str, after: str | None, limit: int) -> tuple[list[dict], bool]: ...


class Feed(Protocol):
    """What only grows: the position behind the last record, and the records (body, signature) of a range."""

    def end(self) -> int: ...

    def read(self, start: int, stop: int) -> Iterator[tuple[str, str | None]]: ...


def pages(pager: Pager, part: str, most: int = MOST_PAGES, limit: int = PAGE) -> Iterator[tuple[str, int, str, str]]:
    """ITEMS of a part. A page that says more follows but is empty, or whose last item was there before, ends in an error, as does a part of more than ``most`` pages."""
    after, last = None, set()
    for n in range(most):
        items, more = pager.page(part, after, limit)
        if more and not items:
            raise ValueError(f"{part}: page {n} is empty, but more should follow")
        for item in items:
            yield part, n, str(item["id"]), json.dumps(item, sort_keys=True, separators=(",", ":"))
        if not more:
            return
        after = str(items[-1]["id"])
        if after in last:
            raise ValueError(f"{part}: page {n} ends where an earlier one did")
        last.add(after)
    raise ValueError(f"{part}: more than {most} pages; to be looked at by hand")


class _Part(InputPartition):
    def __init__(self, part: str):
        super().__init__(part)
        self.part = part


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def register_pages(spark: SparkSession, name: str, make: Callable[[], Pager], most: int = MOST_PAGES, limit: int = PAGE) -> None:
    """From now on ``spark.read.format(name).load()`` has ITEMS; ``make`` builds a client in the driver and in every task."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(p) for p in make().parts()] or [_Part("")]

        def read(self, partition):
            return pages(make(), partition.part, most, limit) if partition.part else iter(())

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ITEMS

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Pages)


def register_feed(spark: SparkSession, name: str, make: Callable[[], Feed], records: int = 10_000) -> None:
    """From now on ``spark.readStream.format(name).load()`` has RECORDS, ``records`` of them in a partition at most."""

    class Reader(DataSourceStreamReader):
        def initialOffset(self):
            return {"at": 0}

        def latestOffset(self):
            return {"at": make().end()}

        def partitions(self, start, end):
            return [_Range(a, min(a + records, end["at"])) for a in range(start["at"], end["at"], records)] or [_Range(0, 0)]

        def read(self, partition):
            for i, (body, signature) in enumerate(make().read(partition.start, partition.stop)):
                yield partition.start + i, body, signature

        def commit(self, end):
            pass

    class Records(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return RECORDS

        def streamReader(self, schema):
            return Reader()

    spark.dataSource.register(Records)


class FolderPager:
    """Parts are folders, items the lines (JSON) of their one file ``items.jsonl``, by id."""

    def __init__(self, root: str):
        self.root = root

    def parts(self) -> list[str]:
        return sorted(os.listdir(self.root))

    def page(self, part: str, after: str | None, limit: int) -> tuple[list[dict], bool]:
        with open(os.path.join(self.root, part, "items.jsonl"), encoding="utf-8") as f:
            items = [json.loads(x) for x in f if x.strip()]
        ids = [str(x["id"]) for x in items]
        start = ids.index(after) + 1 if after is not None else 0
        return items[start : start + limit], start + limit < len(items)


class FolderFeed:
    """Records are files of ten digits, from 0 without a gap: ``{"body": ..., "signature": ...}``."""

    def __init__(self, root: str):
        self.root = root

    def end(self) -> int:
        return sum(name.endswith(".json") for name in os.listdir(self.root))

    def read(self, start: int, stop: int) -> Iterator[tuple[str, str | None]]:
        for i in range(start, stop):
            with open(os.path.join(self.root, f"{i:010d}.json"), encoding="utf-8") as f:
                record = json.load(f)
            yield record["body"], record.get("signature")


def sign(body: str, secret: str, at: int) -> str:
    """The header of a body: the time, and the keyed hash of both."""
    return f"t={at},v1={hmac.new(secret.encode(), f'{at}.{body}'.encode(), hashlib.sha256).hexdigest()}"


def check(body: str | None, header: str | None, secrets: list[str], now: int, tolerance: int = TOLERANCE) -> str:
    """``valid``, ``invalid``, ``missing`` (no header, or none that can be read) or ``stale`` (right, but too old or from the future)."""
    fields = [x.strip().split("=", 1) for x in (header or "").split(",") if "=" in x]
    times, given = [v for k, v in fields if k == "t"], [v for k, v in fields if k == "v1"]
    if body is None or len(times) != 1 or not times[0].isascii() or not times[0].isdigit() or not given:
        return "missing"
    want = [hmac.new(s.encode(), f"{times[0]}.{body}".encode(), hashlib.sha256).hexdigest() for s in secrets]
    if not any(hmac.compare_digest(w.encode(), g.encode()) for w in want for g in given):
        return "invalid"
    return "valid" if abs(now - int(times[0])) <= tolerance else "stale"


def signature(body: Column, header: Column, now: Column, secrets: list[str], tolerance: int = TOLERANCE) -> Column:
    """``check`` of every row over its raw body. The secrets travel inside the function, not in the plan, where logs would show them."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, headers: pa.Array, nows: pa.Array) -> pa.Array:
        rows = zip(bodies.to_pylist(), headers.to_pylist(), nows.to_pylist(), strict=True)
        return pa.array([check(b, h, secrets, n, tolerance) for b, h, n in rows], pa.string())

    return run(body, header, now)
