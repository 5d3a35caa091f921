"""Small HTTP clients of the two data services; every getter can be replaced, for tests and offline use."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

Get = Callable[[str], str]

#: Fixed values of the services' public documentation.
PRICES_URL = "https://api.tiingo.com/tiingo/daily/{ticker}/prices"
MACRO_URL = "https://api.stlouisfed.org/fred/series/observations"
PAGE = 10_000
WAITS = (5.0, 15.0, 45.0)
TEMPORARY = frozenset((429, 500, 502, 503, 504))
HINTS = {401: "the API key was rejected", 403: "the API key was rejected", 404: "the service does not know this ticker", 429: "the usage limit was reached; wait an hour and try again"}


class Temporary(RuntimeError):
    """A failure that may pass: a timeout, a lost connection, a busy server."""


def key_from_env(name: str) -> str:
    key = os.environ.get(name, "").strip()
    if not key:
        raise RuntimeError(f"No API key found; set {name} first.")
    return key


def getter(headers: dict[str, str] | None = None, timeout: float = 60.0, hints: dict[int, str] | None = None) -> Get:
    """GET to text; messages name the status, never the URL, as that may hold a key."""

    def get(url: str) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as reply:
                return reply.read().decode("utf-8")
        except urllib.error.HTTPError as err:
            what = (hints or {}).get(err.code, "unexpected response")
            kind = Temporary if err.code in TEMPORARY else RuntimeError
            raise kind(f"request failed (HTTP {err.code}): {what}") from None
        except (TimeoutError, ConnectionError, urllib.error.URLError) as err:
            raise Temporary(f"request did not complete: {err}") from None

    return get


def retrying(get: Get, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> Get:
    """get, tried again after each wait if the failure is temporary."""

    def patient(url: str) -> str:
        for wait in waits:
            try:
                return get(url)
            except Temporary:
                sleep(wait)
        try:
            return get(url)
        except Temporary as err:
            raise RuntimeError(f"{err}; gave up after {len(waits) + 1} attempts") from None

    return patient


def daily_prices(ticker: str, start: str, end: str, get: Get) -> list[dict]:
    url = f"{PRICES_URL.format(ticker=urllib.parse.quote(ticker.lower()))}?{urllib.parse.urlencode({'startDate': start, 'endDate': end})}"
    rows = json.loads(get(url))
    if not rows:
        raise RuntimeError(f"No data returned for {ticker} between {start} and {end}.")
    return rows


def observation_pages(series: str, key: str, start: str, end: str, vintages: bool, get: Get):
    """Yields the pages of a series, as lists of records; with vintages, every figure ever current."""
    asked = {"series_id": series, "api_key": key, "file_type": "json", "observation_start": start, "observation_end": end, "limit": PAGE}
    if vintages:
        asked |= {"realtime_start": "1776-07-04", "realtime_end": "9999-12-31"}
    offset = 0
    while True:
        reply = json.loads(get(f"{MACRO_URL}?{urllib.parse.urlencode(asked | {'offset': offset})}"))
        if "observations" not in reply:
            raise RuntimeError(f"Unexpected response for {series}: {str(reply)[:200].replace(key, '***')}")
        page = reply["observations"]
        if page:
            yield page
        offset += len(page)
        if not page or offset >= int(reply.get("count", offset)):
            return
