"""Pages to typed blocks and tables by one pass of a markup parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

#: Fixed names: elements and marks that are left out, headings, and text blocks.
DROPPED = frozenset("script style nav header footer aside form noscript".split())
DROPPED_MARKS = frozenset("cookie breadcrumb share related navigation".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
TEXTS = frozenset(("p", "li"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Reader(HTMLParser):
    """Collects headings, text blocks and tables outside what is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.headings, self.texts, self.tables, self.loose = [], [], [], []
        self.dropped, self.depth = None, 0
        self.kind, self.level, self.buffer = None, 0, []
        self.row, self.cell = None, None

    def close_block(self):
        text = " ".join("".join(self.buffer).split())
        if text and self.kind == "heading":
            self.headings.append(("heading", text, self.level))
        elif text and self.kind:
            self.texts.append((self.kind, text, None))
        self.kind, self.buffer = None, []

    def close_cell(self):
        if self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.buffer.append(" ")
            return
        if self.dropped:
            self.depth += tag == self.dropped
            return
        marks = {m for name, value in attrs if name in ("class", "role") for m in (value or "").lower().split()}
        if tag in DROPPED or marks & DROPPED_MARKS:
            self.dropped, self.depth = tag, 1
            return
        if tag in HEADINGS or tag in TEXTS:
            self.close_block()
            self.kind, self.level = ("heading", HEADINGS[tag]) if tag in HEADINGS else ("paragraph" if tag == "p" else "list_item", 0)
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if self.dropped:
            self.depth -= tag == self.dropped
            if self.depth == 0:
                self.dropped = None
            return
        if tag in HEADINGS or tag in TEXTS:
            self.close_block()
        elif tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.dropped:
            return
        if self.cell is not None:
            self.cell.append(data)
        if self.kind:
            self.buffer.append(data)
        elif self.cell is None:
            self.loose.append(data)


def markdown(rows: list[list[str]]) -> str:
    """A table as markdown; ragged rows are padded."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def blocks(html: str | None) -> tuple[list[tuple[str, str, int | None]], list[str]]:
    """All headings first, then text blocks; without any, the loose text by lines. And the tables as markdown."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    found = reader.headings + reader.texts
    if not found:
        found = [("paragraph", line, None) for line in (" ".join(x.split()) for x in "".join(reader.loose).split("\n")) if line]
    return found, [markdown(t) for t in reader.tables if t]


def read_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text, level): blocks, then tables as blocks of kind table."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                found, tables = blocks(html)
                out += [(page_id, pos, *b) for pos, b in enumerate([*found, *(("table", t, None) for t in tables)])]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page_id", "pos", "kind", "text", "level"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos long, kind string, text string, level int")
