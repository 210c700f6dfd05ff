"""Paged services as tables: executors walk the pages of their keys by cursor or offset."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.shared import Scratch

#: (records of a page, what to ask for next or None after the last) of a key and a position, None at first.
Fetch = Callable[[object, object], tuple[list[dict], object]]


class Unavailable(Exception):
    """A page can't be had now; `after` is how many seconds the service asks to wait."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def patient(fetch: Fetch, *, tries: int = 4, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """fetch that waits and tries again when it raises Unavailable: as long as asked, or delay, twice as long each time; the last failure is raised."""

    def run(key: object, at: object) -> tuple[list[dict], object]:
        for n in range(tries):
            try:
                return fetch(key, at)
            except Unavailable as e:
                if n == tries - 1:
                    raise
                sleep(e.after if e.after is not None else delay * 2**n)
        raise ValueError("tries must be at least 1")

    return run


def by_offset(pages: Callable[[object, int, int], list[dict]], size: int) -> Fetch:
    """A Fetch of pages(key, offset, size); a page that isn't full is the last."""

    def fetch(key: object, at: object) -> tuple[list[dict], object]:
        start = int(at or 0)
        rows = pages(key, start, size)
        return rows, start + size if len(rows) == size else None

    return fetch


def paged(keys: DataFrame, key: str, fetch: Fetch, schema: str, *, most_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, page, fields of schema) of all records of each different key, and (key, page, record) of records that don't fit the schema.

    Each key is walked by one task; a task holds one page. A key without
    records gives no rows; null keys are left out. most_pages ends a walk where
    a service never does: a key that has more raises.
    """
    own = keys.where(F.col(key).isNotNull()).select(key).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, page = None, 0
                while True:
                    if most_pages is not None and page >= most_pages:
                        raise ValueError(f"{k} has more than {most_pages} pages")
                    rows, at = fetch(k, at)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), batch.column(0).type), pa.array([page] * len(rows), pa.int64()), pa.array([json.dumps(r) for r in rows])], names=[key, "page", "record"])
                    if at is None:
                        break
                    page += 1

    kind = own.schema[key].dataType.simpleString()
    # A service is asked once: both results read what it gave.
    raw = Scratch(keys.sparkSession, "paged").write(own.mapInArrow(run, f"`{key}` {kind}, page long, record string"), "pages")
    row = F.from_json("record", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = raw.withColumn("r", row)
    return parsed.where("r._corrupt is null").select(key, "page", "r.*").drop("_corrupt"), parsed.where("r._corrupt is not null").select(key, "page", "record")
