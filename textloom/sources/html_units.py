"""Text units of web pages, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is no prose, and those that end a paragraph.
SKIPPED = frozenset("pre code script style head title svg math var sup sub nav".split())
BLOCKS = frozenset("p div li td th h1 h2 h3 h4 h5 h6 blockquote section article br tr dt dd figcaption".split())
VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())


class Units(HTMLParser):
    """Collects (tag, text, leaf) of blocks in page order; leaf blocks have no block inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units: list[tuple[str, str, bool]] = []
        self.skip: list[str] = []
        self.held: list[str] = []
        self.tag = "body"

    def flush(self, leaf: bool) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if len(text) > 1:
            self.units.append((self.tag, text, leaf))

    def handle_starttag(self, tag, attrs):
        if "head" in self.skip and (tag == "body" or tag in BLOCKS):
            self.skip.clear()  # the page's head may be left open
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag in BLOCKS:
            self.flush(False)
            if tag not in VOID:
                self.tag = tag

    def handle_endtag(self, tag):
        if self.skip and tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag in BLOCKS:
            self.flush(tag == self.tag)
            self.tag = "body"

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_units(pages: DataFrame) -> DataFrame:
    """page_id, unit_no, tag, leaf, text of every unit of every page."""

    def split(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                parser = Units()
                parser.feed(html or "")
                parser.close()
                parser.flush(False)
                rows += [(page_id, k, tag, leaf, text) for k, (tag, text, leaf) in enumerate(parser.units)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()))], ["page_id", "unit_no", "tag", "leaf", "text"])

    return pages.select("page_id", "html").mapInArrow(split, "page_id long, unit_no long, tag string, leaf boolean, text string")
