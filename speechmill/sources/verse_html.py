"""Verses of a chapter page: numbered elements paired with the texts that follow."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_NUMBER = re.compile(r"\d+[a-z]?")


class _Leaves(HTMLParser):
    """The childless span and sup elements of the first text block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.found = 0, False, False
        self.open: list[list] = []  # [tag, text, has children]
        self.leaves: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if not self.depth:
            if tag == "div" and "justify" in (dict(attrs).get("class") or "").split():
                self.depth, self.found = 1, True
            return
        if tag == "div":
            self.depth += 1
        if self.open:
            self.open[-1][2] = True
        if tag not in ("br", "img", "hr", "input", "meta", "link", "wbr"):
            self.open.append([tag, "", False])

    def handle_data(self, data):
        if self.depth and self.open:
            self.open[-1][1] += data

    def handle_endtag(self, tag):
        if not self.depth or self.done:
            return
        while self.open and any(o[0] == tag for o in self.open):
            name, text, parent = self.open.pop()
            if name in ("span", "sup") and not parent:
                self.leaves.append((name, text.strip()))
            if name == tag:
                break
        if tag == "div":
            self.depth -= 1
            self.done = self.depth == 0


def parse_verses(html: str) -> list[tuple[int, str]]:
    """(verse, text) pairs; raises ValueError on pages that don't hold together."""
    p = _Leaves()
    p.feed(html)
    p.close()
    if not p.found:
        raise ValueError("no text block")

    def is_number(text: str) -> bool:
        return bool(text) and all(_NUMBER.fullmatch(part) for part in text.split("-"))

    numbers = [t for _, t in p.leaves if is_number(t)][1:]  # the first is the chapter's
    texts = [t for name, t in p.leaves if name == "span" and not is_number(t)]
    if len(numbers) != len(texts):
        raise ValueError(f"{len(numbers)} numbers, {len(texts)} texts")
    verses = [int(re.match(r"\d+", n)[0]) for n in numbers]
    if not verses or verses[0] != 1 or any(a >= b for a, b in zip(verses, verses[1:])):
        raise ValueError("numbers don't rise from 1")
    return list(zip(verses, texts))


def verses(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, verse, verse_text, problem): a row a verse, or one row with the problem of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, html in zip(b.column("key").to_pylist(), b.column("html").to_pylist()):
                try:
                    rows += [(k, v, t, None) for v, t in parse_verses(html or "")]
                except ValueError as e:
                    rows.append((k, None, None, str(e)))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            types = (b.schema.field("key").type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "verse", "verse_text", "problem"])

    kind = dict(pages.dtypes)[key]
    return pages.selectExpr(f"{key} as key", "html").mapInArrow(run, f"key {kind}, verse int, verse_text string, problem string").withColumnRenamed("key", key)
