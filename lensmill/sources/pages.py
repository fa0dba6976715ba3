"""Review pages as a Spark data source.

``spark.dataSource.register(ReviewPages)`` and ``spark.read.format("review_pages")`` walk the pages
of an app window by window: one partition per window, cursor after cursor. Where there is no
network the pages come from files that hold what the store would answer.
"""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lensmill.operators.planning import fell_short  # noqa: F401  (the same rule in columns)

#: Rows a page may have, attempts at a page, seconds before the first retry, walks of a window that falls short.
PAGE_ROWS, ATTEMPTS, BACKOFF, WALKS = 100, 5, 2.0, 3
#: Seconds between two requests of a crawl, and windows that are walked at once.
PACE, CONCURRENCY = 0.25, 4
#: Seconds after which a request counts as lost.
TIMEOUT = 60.0


class NoSuchCorpus(Exception):
    """The store answered, but knows no such app."""


@dataclass(frozen=True)
class ReviewQuery:
    """What is asked for: always all languages, all purchases and nothing filtered out."""

    cursor: str = "*"
    per_page: int = PAGE_ROWS
    order: str = "recent"
    window: tuple[int, int] | None = None

    def url(self, base: str, app_id: int) -> str:
        parts = ["json=1", f"filter={self.order}", "language=all", "purchase_type=all", "filter_offtopic_activity=0", f"num_per_page={min(self.per_page, PAGE_ROWS)}", f"cursor={quote(self.cursor, safe='*')}"]
        if self.window:
            parts += [f"start_date={self.window[0]}", f"end_date={self.window[1]}", "date_range_type=include"]
        return f"{base.rstrip('/')}/appreviews/{app_id}?" + "&".join(parts)


def retry_after(headers) -> float | None:
    """Whole seconds of a Retry-After header."""
    value = (headers.get("Retry-After") or "").strip()
    return float(value) if value.isdigit() else None


class Pace:
    """Lets one request through every ``seconds``, over all threads of a process."""

    def __init__(self, seconds: float = 0.25):
        self.seconds, self.lock, self.free_at = seconds, threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            pause = max(0.0, self.free_at - now)
            self.free_at = max(now, self.free_at) + self.seconds
        time.sleep(pause)


def fetch(url: str, pace: Pace | None = None, opened: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page. 429, server errors and broken connections are tried again, after what the server says or ever longer."""
    for attempt in range(1, ATTEMPTS + 1):
        if pace:
            pace.wait()
        try:
            with opened(url, timeout=TIMEOUT) as answer:
                page = json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if attempt == ATTEMPTS or not (error.code == 429 or error.code >= 500):
                raise
            sleep(retry_after(error.headers) or BACKOFF * 2 ** (attempt - 1))
            continue
        except (urllib.error.URLError, ConnectionError, TimeoutError, http.client.HTTPException):
            if attempt == ATTEMPTS:
                raise
            sleep(BACKOFF * 2 ** (attempt - 1))
            continue
        if page.get("success") != 1:
            raise NoSuchCorpus(url)
        return page
    raise AssertionError("unreachable")


def stored_pages(folder: str) -> Callable[[int, ReviewQuery], dict]:
    """Answers queries from ``<folder>/<app>.json``, an array of review objects, as the store would page them."""

    def answer(app_id: int, query: ReviewQuery) -> dict:
        path = os.path.join(folder, f"{app_id}.json")
        if not os.path.exists(path):
            raise NoSuchCorpus(path)
        with open(path, encoding="utf-8") as f:
            rows = json.load(f)
        if query.window:
            rows = [r for r in rows if query.window[0] <= (r.get("timestamp_created") or 0) <= query.window[1]]
        rows.sort(key=lambda r: (-(r.get("timestamp_created") or 0), str(r.get("recommendationid"))))
        at = 0 if query.cursor == "*" else int(query.cursor)
        page = rows[at : at + query.per_page]
        return {"success": 1, "query_summary": {"total_reviews": len(rows)}, "reviews": page, "cursor": str(at + len(page))}

    return answer


def walk(page_of: Callable[[ReviewQuery], dict], window: tuple[int, int] | None) -> tuple[list[dict], str]:
    """All reviews of a window, each id once, and why the walk ended: ``exhausted``, ``cursor repeated`` or ``no cursor``."""
    seen: dict[str, dict] = {}
    cursors = set()
    query = ReviewQuery(window=window)
    while True:
        page = page_of(query)
        for r in page.get("reviews", []):
            if isinstance(r.get("recommendationid"), str):
                seen.setdefault(r["recommendationid"], r)
        if not page.get("reviews"):
            return list(seen.values()), "exhausted"
        cursor = page.get("cursor")
        if not cursor:
            return list(seen.values()), "no cursor"
        if cursor in cursors:
            return list(seen.values()), "cursor repeated"
        cursors.add(cursor)
        query = ReviewQuery(cursor=cursor, window=window)


def walk_again(page_of: Callable[[ReviewQuery], dict], window: tuple[int, int] | None, expected: int) -> tuple[list[dict], str, bool]:
    """``walk``, up to three times while too little comes back; the last value says whether it still fell short."""
    best, why, short = [], "exhausted", False
    for _ in range(WALKS):
        rows, why = walk(page_of, window)
        best = max(best, rows, key=len)
        short = expected > 0 and expected - len(best) > 20 and len(best) < 0.95 * expected
        if not short:
            break
    return best, why, short


@dataclass
class _Windows(InputPartition):
    """The windows that one task walks, one after the other, and the seconds it leaves between requests."""

    windows: list[tuple[int, int, int]]
    pace: float

    def __init__(self, windows: list[tuple[int, int, int]], pace: float):
        super().__init__(None)
        self.windows, self.pace = windows, pace


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.app = int(options["app"])
        self.folder, self.base = options.get("folder"), options.get("base")
        self.windows = [tuple(w) for w in json.loads(options.get("windows", "[[0, 4102444800, 0]]"))]
        self.pace, self.concurrency = float(options.get("pace", PACE)), int(options.get("concurrency", CONCURRENCY))
        self.tally = options.get("tally") == "true"

    def partitions(self) -> list[InputPartition]:
        """At most ``concurrency`` tasks; each waits so many times longer that all together keep the pace of the crawl.

        The fullest windows are dealt out first, each to the task with the least to walk.
        """
        tasks: list[list] = [[] for _ in range(min(self.concurrency, len(self.windows)) or 1)]
        load = [0] * len(tasks)
        for w in sorted(self.windows, key=lambda w: -w[2]):
            k = load.index(min(load))
            tasks[k].append(w)
            load[k] += w[2] + 1
        return [_Windows(t, self.pace * len(tasks)) for t in tasks]

    def read(self, partition: _Windows) -> Iterator[tuple]:
        if self.folder:
            answer = stored_pages(self.folder)
            page_of = lambda q: answer(self.app, q)
        else:
            pace = Pace(partition.pace)
            page_of = lambda q: fetch(q.url(self.base, self.app), pace)
        for start, end, expected in partition.windows:
            fetched = []

            def counted(q: ReviewQuery, fetched: list = fetched) -> dict:
                fetched.append(q)
                return page_of(q)

            rows, why, short = walk_again(counted, (start, end), expected)
            if short and not self.tally:
                raise RuntimeError(f"window {start} to {end} stays short of {expected}")
            for r in rows:
                yield self.app, json.dumps(r, ensure_ascii=False), *([None] * 7 if self.tally else ())
            if self.tally:
                newest = max((r["timestamp_created"] for r in rows if isinstance(r.get("timestamp_created"), int)), default=None)
                yield self.app, None, start, end, len(rows), len(fetched), why, newest, short


class ReviewPages(DataSource):
    """``appid, raw_json`` of the reviews of one app. Options: app, folder or base, windows (JSON), pace, concurrency.

    With ``tally`` "true" each window ends with a row without ``raw_json`` that says how it was
    walked and whether it stayed ``short``; without it a window that stays short is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "review_pages"

    def schema(self) -> str:
        tally = ", window_start bigint, window_end bigint, row_count bigint, pages bigint, stop_reason string, max_created bigint, short boolean"
        return "appid bigint, raw_json string" + (tally if self.options.get("tally") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def summary(page_of: Callable[[ReviewQuery], dict]) -> dict:
    """What the store states about an app: totals, positive and negative ones, and its verdict in words."""
    return page_of(ReviewQuery(per_page=0)).get("query_summary", {})


def count(page_of: Callable[[ReviewQuery], dict], window: tuple[int, int] | None = None) -> int:
    """Reviews in a window, asked for without rows."""
    return int(page_of(ReviewQuery(per_page=0, window=window)).get("query_summary", {}).get("total_reviews", 0))


def app_names(apps, names):
    """Apps with their name where one is known."""
    return apps.join(names, "appid", "left")
