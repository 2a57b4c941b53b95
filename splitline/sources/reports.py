"""Result reports as rows: fixed-width text, HTML tables, CSV and TSV uploads, with header synonyms.

One text holds one report, which its length bounds; the parsers are table functions that Spark runs text by text.
A column is known by its title; :data:`TITLES` lists the titles of each.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

#: The titles under which result columns are known.
TITLES = {
    "place": ("place", "pl", "rank", "pos", "position"),
    "name": ("name", "athlete", "runner", "competitor"),
    "grade": ("grade", "gr", "year", "yr", "class"),
    "team": ("team", "school", "club", "affiliation"),
    "mark": ("time", "mark", "finals", "result", "finish"),
    "points": ("points", "pts", "score"),
}
COLUMN_OF = {title: column for column, titles in TITLES.items() for title in titles}
FIELDS = tuple(TITLES)
SCHEMA = "line int, place string, name string, grade string, team string, mark string, points string"
_CHUNK = re.compile(r"\S+(?: \S+)*")


def header_of(cells: list[str]) -> dict[int, str]:
    """Column by place of the titles among ``cells``; empty unless a name or team and a mark are among them."""
    found: dict[int, str] = {}
    for i, cell in enumerate(cells):
        column = COLUMN_OF.get(cell.strip().lower().rstrip(":."))
        if column and column not in found.values():
            found[i] = column
    return found if {"name", "team"} & set(found.values()) and "mark" in found.values() else {}


def _row(line: int, cells: dict[str, str]) -> tuple:
    return (line, *[cells.get(f) or None for f in FIELDS])


def _fields(line: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, column) of a line's fields: runs of words with single spaces; a run under several titles is cut into its words."""
    overlap = lambda a, b, s: min(b, s[1]) - max(a, s[0])
    for m in _CHUNK.finditer(line):
        if sum(overlap(m.start(), m.end(), s) > 0 for s in spans) < 2:
            yield m.start(), m.end(), max(spans, key=lambda s: overlap(m.start(), m.end(), s))[2]  # noqa: B023
            continue
        for w in re.finditer(r"\S+", m.group()):
            a, b = m.start() + w.start(), m.start() + w.end()
            before = [s for s in spans if s[0] < b]
            yield a, b, (before[-1] if before else spans[0])[2]


def fixed_width(text: str) -> Iterator[tuple]:
    """Rows of a report laid out by columns of characters: a field belongs to the title it overlaps most, else to the nearest one."""
    spans: list[tuple[int, int, str]] = []
    for number, line in enumerate(text.splitlines()):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", line)]
        titles = header_of([w for _, _, w in words])
        if titles:
            spans = [(words[i][0], words[i][1], column) for i, column in titles.items()]
            continue
        if not spans or not line.strip() or set(line.strip()) <= set("=-_ "):
            continue
        cells: dict[str, str] = {}
        lead = re.match(r"\s*(\d+)\s", line)  # a leading number is the place, titled or not
        if lead:
            cells["place"] = lead.group(1)
            line = " " * lead.end() + line[lead.end() :]
        for start, end, column in _fields(line, spans):
            cells[column] = f"{cells[column]} {line[start:end]}" if column in cells else line[start:end]
        if "name" in cells or "team" in cells:
            yield _row(number, cells)


class _Tables(HTMLParser):
    """Cells of all tables, row by row; a table within a table is read as its own rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open: list[list[str]] = []
        self.cell: list[str] | None = None

    def _close(self) -> None:
        if self.cell is not None and self.open:
            self.open[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.open.append([])
        elif tag in ("td", "th"):
            self._close()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._close()
        elif tag in ("tr", "table"):
            self._close()
            if self.open:
                self.rows.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(text: str) -> Iterator[tuple]:
    """Rows of the result tables of a page. Tables without a result header give none, unless no table has one: then columns are found by what most
    rows hold (:func:`voted_columns`)."""
    parser = _Tables()
    parser.feed(text)
    parser.close()
    if any(header_of(cells) for cells in parser.rows):
        yield from _titled(parser.rows)
    else:
        width = Counter(len(cells) for cells in parser.rows).most_common(1)
        rows = [(number, cells) for number, cells in enumerate(parser.rows) if width and len(cells) == width[0][0]]
        at = voted_columns([cells for _, cells in rows])
        if {"name", "mark"} <= set(at.values()):
            for number, cells in rows:
                yield _row(number, {c: cells[i].strip() for i, c in at.items()})


_LOOKS = {
    "mark": re.compile(r"(\d{1,2}:)?\d{1,2}:\d{2}(\.\d+)?|\d+\.\d+"),
    "place": re.compile(r"\d+\.?"),
    "grade": re.compile(r"0?[6-9]|1[0-2]|fr|so|jr|sr", re.IGNORECASE),
    "text": re.compile(r".*[^\W\d_].*"),
}


def voted_columns(rows: list[list[str]], share: float = 0.6, least: int = 3) -> dict[int, str]:
    """{index: column} of a table without titles, by the share of its rows whose cells look like a place, a mark, a grade or text.

    A place column never falls; of text columns the one with the most different values is the name, the next the team. Fewer than ``least`` rows
    decide nothing.
    """
    if len(rows) < least:
        return {}
    columns = [[x.strip() for x in c] for c in zip(*rows)]
    looks = lambda c, kind: sum(bool(_LOOKS[kind].fullmatch(x)) for x in c) >= share * len(c)
    out: dict[int, str] = {}
    for kind in ("mark", "place", "grade"):
        fits = [i for i, c in enumerate(columns) if i not in out and looks(c, kind)]
        if kind == "place":
            number = lambda c: [int(x.rstrip(".")) for x in c if _LOOKS["place"].fullmatch(x)]
            fits = [i for i in fits if all(a <= b for a, b in zip(number(columns[i]), number(columns[i])[1:]))]
        if fits:
            out[fits[0]] = kind
    texts = sorted((i for i, c in enumerate(columns) if i not in out and looks(c, "text")), key=lambda i: (-len(set(columns[i])), i))
    return out | dict(zip(texts, ("name", "team")))


def _titled(rows) -> Iterator[tuple]:
    at: dict[int, str] = {}
    for number, cells in enumerate(rows):
        titles = header_of(cells)
        if titles:
            at = titles
        elif at and len(cells) > max(at):
            yield _row(number, {c: cells[i].strip() for i, c in at.items()})
        else:
            at = at if cells else {}


def separated(text: str, by: str) -> Iterator[tuple]:
    yield from _titled(csv.reader(text.splitlines(), delimiter=by))


def sniff(text: str) -> str:
    """'html', 'tab', 'csv' or 'text', by the first lines."""
    head = text.lstrip()[:4096]
    if head.startswith("<"):
        return "html"
    lines = [x for x in head.splitlines() if x.strip()][:5]
    if lines and all("\t" in x for x in lines):
        return "tab"
    return "csv" if lines and any(header_of(x.split(",")) for x in lines) else "text"


def parse(text: str) -> Iterator[tuple]:
    kind = sniff(text)
    if kind == "html":
        yield from html_tables(text)
    elif kind == "text":
        yield from fixed_width(text)
    else:
        yield from separated(text, "\t" if kind == "tab" else ",")


def register(spark) -> None:
    """The table function ``parse_report(text)`` for SQL and LATERAL joins."""

    @F.udtf(returnType=SCHEMA)
    class ParseReport:
        def eval(self, text: str):
            if text:
                yield from parse(text)

    spark.udtf.register("parse_report", ParseReport)


def rows_of(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, place, name, grade, team, mark, points) of every report, whatever its format; a null text has no rows."""
    register(reports.sparkSession)
    return reports.sparkSession.sql(f"SELECT d.`{key}`, r.* FROM {{d}} AS d, LATERAL parse_report(d._text) AS r", d=reports.select(key, F.col(text).alias("_text")))
