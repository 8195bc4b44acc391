"""Spreadsheets (Office Open XML) as DataFrames, with the standard library's zip and XML readers.

Files are read by Spark (``binaryFile``), so any path that Spark reads will do, and parsed one at a time in the tasks, row by
row; a file's own XML is the only thing a task holds. All columns are text, as the cells of a sheet have no common type:
``ingest.metadata`` and ``ingest.holdings`` clean them.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _all(root, name: str) -> list:
    return [] if root is None else [e for e in root.iter() if _name(e.tag) == name]


def _text(e) -> str:
    """The text of a string item: all its runs, without phonetic hints."""
    if _name(e.tag) == "rPh":
        return ""
    return (e.text or "") if _name(e.tag) == "t" else "".join(map(_text, e))


def _is_date(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|general', "", code.lower())))


def _moment(serial: float, since_1904: bool) -> str:
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if serial < 60 else 30)
    at = start + timedelta(seconds=round(serial * 86_400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, by number or name, that have a value; blank cells and errors are null, dates in ISO form."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = _xml(z, "xl/workbook.xml")
        sheets = _all(book, "sheet")
        one = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        target = next(r.get("Target") for r in _all(_xml(z, "xl/_rels/workbook.xml.rels"), "Relationship") if r.get("Id") == one.get(_REL))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in _all(book, "workbookPr"))
        shared = [_text(e) for e in _all(_xml(z, "xl/sharedStrings.xml"), "si")]
        styles = _xml(z, "xl/styles.xml")
        own = {int(f.get("numFmtId")): _is_date(f.get("formatCode", "")) for f in _all(styles, "numFmt")}
        formats = [int(x.get("numFmtId", 0)) for xfs in _all(styles, "cellXfs") for x in xfs]
        dates = [own.get(i, i in DATE_FORMATS) for i in formats]

        def value(c) -> str | None:
            kind, parts = c.get("t", "n"), {_name(e.tag): e for e in c}
            if kind == "inlineStr":
                return _text(parts["is"]) if "is" in parts else None
            raw = parts["v"].text if "v" in parts else None
            if not raw or kind == "e":
                return None
            if kind == "s":
                return shared[int(raw)]
            if kind == "b":
                return "true" if raw == "1" else "false"
            style = int(c.get("s", 0))
            return _moment(float(raw), since_1904) if kind == "n" and style < len(dates) and dates[style] else raw

        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) != "row":
                    continue
                got: dict[int, str] = {}
                for c in e:
                    at = _column(c.get("r", "")) if c.get("r") else max(got, default=-1) + 1
                    v = value(c)
                    if v is not None and v.strip():
                        got[at] = v
                e.clear()
                if got:
                    yield [got.get(i) for i in range(max(got) + 1)]


def _parse(names: list[str] | None, sheet: int | str, skip: int, footer: int, skip_unreadable: bool):
    def table(path: str, content: bytes) -> Iterator[tuple]:
        it = rows(content, sheet)
        for _ in range(skip):
            next(it, None)
        head = [(h or "").strip() for h in next(it, [])]
        if names is None:
            yield path, 0, head
            return
        where = [head.index(n) if n in head else None for n in names]
        held: deque = deque()
        for i, r in enumerate(it):
            held.append((path, i, *[r[w] if w is not None and w < len(r) else None for w in where]))
            if len(held) > footer:
                yield held.popleft()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_file", "row_idx", *(names if names is not None else ["header"])]
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                batch: list[tuple] = []
                try:
                    for r in table(path, content):
                        batch.append(r)
                        if len(batch) == 10_000:
                            yield pd.DataFrame(batch, columns=columns)
                            batch = []
                except (zipfile.BadZipFile, ElementTree.ParseError, LookupError, StopIteration, ValueError) as error:
                    if not skip_unreadable:
                        raise ValueError(f"{path} is no readable spreadsheet") from error
                if batch:
                    yield pd.DataFrame(batch, columns=columns)

    return work


def spreadsheet(spark: SparkSession, path: str, names: list[str] | None = None, sheet: int | str = 0, skip: int = 0, footer: int = 0, skip_unreadable: bool = False) -> DataFrame:
    """(source_file, row_idx, *names) of every file under ``path``.

    ``names`` are looked up in the header of each file, the first row with a value after ``skip`` such rows; a file without
    one of them has nulls there. Without ``names`` those of the first file (by path) are taken, the first of equal ones.
    The last ``footer`` rows of a file are left out. A file that cannot be read is an error, unless it is to be skipped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    if names is None:
        heads = files.mapInPandas(_parse(None, sheet, skip, footer, skip_unreadable), "source_file string, row_idx long, header array<string>")
        first = heads.orderBy("source_file").first()
        if first is None:
            raise ValueError(f"no spreadsheet under {path}")
        names = [n for n in dict.fromkeys(first["header"]) if n]
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    d = files.mapInPandas(_parse(list(names), sheet, skip, footer, skip_unreadable), f"source_file string, row_idx long, {quoted}" if names else "source_file string, row_idx long")
    return d.withColumn("row_idx", F.col("row_idx").cast("long"))
