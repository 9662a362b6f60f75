"""Fetching as a source: any function that gets a url, with the retry policy, over Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.urls import backoff, should_retry

#: (status, content type, body) of a url; None for a timeout; another exception is final.
Get = Callable[[str], tuple[int, str, str] | None]
SCHEMA = "url string, status int, html string, reason string, attempts int"


def fetch_one(url: str, get: Get, retries: int = 3, base: float = 1.8, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, str | None, str | None, int]:
    """(status, html, reason, attempts): timeouts and server errors are tried again after a pause,
    anything else that fails is final; a page that is no HTML is told apart."""
    status, attempt = None, 0
    while True:
        attempt += 1
        try:
            found = get(url)
        except Exception:
            return None, None, "fetch_failed", attempt
        status = found[0] if found else None
        if found and status < 400:
            if "text/html" not in (found[1] or "").lower():
                return status, None, "non_html_content_type", attempt
            return status, found[2], None, attempt
        if not should_retry(status, attempt, retries):
            return status, None, "fetch_failed", attempt
        sleep(backoff(attempt, base))


def fetch(urls: DataFrame, get: Get, retries: int = 3, base: float = 1.8, delay: float = 1.0) -> DataFrame:
    """SCHEMA for every row of urls (url); a task waits ``delay`` seconds between its fetches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                status, html, reason, attempts = fetch_one(url, get, retries, base)
                rows.append((url, status, html, reason, attempts))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "status", "html", "reason", "attempts"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, SCHEMA)
