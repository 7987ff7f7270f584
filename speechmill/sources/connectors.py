"""Clients of outside services, with the transport passed in; nothing here opens a connection itself."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable

#: (status, body) of a URL
Fetch = Callable[[str], tuple[int, bytes]]


def fetch_with_retry(fetch: Fetch, url: str, tries: int = 5, wait: float = 0.0) -> bytes:
    """The body; server errors (500 and up) are tried again, other errors raise at once."""
    for k in range(tries):
        status, body = fetch(url)
        if status < 400:
            return body
        if status < 500:
            raise ValueError(f"{url}: status {status}")
        if wait and k + 1 < tries:
            time.sleep(wait)
    raise ValueError(f"{url}: no answer after {tries} tries")


def fetch_complete(fetch: Fetch, url: str, least: int = 10_000, again: int = 5, tries: int = 5) -> bytes:
    """A body of at least ``least`` bytes; smaller ones are fetched again up to ``again`` times."""
    body = fetch_with_retry(fetch, url, tries)
    for _ in range(again):
        if len(body) >= least:
            break
        body = fetch_with_retry(fetch, url, tries)
    if len(body) < least:
        raise ValueError(f"{url}: {len(body)} bytes after {again} more fetches")
    return body


def alignment_link(reply: str) -> str:
    """The download link in the XML answer of an alignment service."""
    root = ET.fromstring(reply)

    def value(name: str) -> str:
        return (root.findtext(f".//{name}") or "").strip()

    if value("success") == "false" or not value("downloadLink"):
        raise ValueError(value("output") or value("warnings") or "no alignment")
    return value("downloadLink")
