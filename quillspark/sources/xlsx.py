"""Workbooks with the standard library alone: a batch data source ``xlsx`` and a writer of several sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_LOCAL = re.compile(r"\{.*\}")


def _cells(data: bytes, sheet: str | None) -> list[list[str]]:
    """The values of a sheet (the first if it isn't named), row by row."""
    z = zipfile.ZipFile(io.BytesIO(data))
    tree = lambda name: ElementTree.fromstring(z.read(name))
    tag = lambda e: _LOCAL.sub("", e.tag)
    shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for e in tree("xl/workbook.xml").iter() if tag(e) == "sheet"]
    targets = {e.get("Id"): e.get("Target") for e in tree("xl/_rels/workbook.xml.rels")}
    rid = next((r for n, r in sheets if n == sheet), sheets[0][1])
    path = targets[rid].lstrip("/")
    rows: list[list[str]] = []
    for row in (e for e in tree(path if path.startswith("xl/") else f"xl/{path}").iter() if tag(e) == "row"):
        values: dict[int, str] = {}
        for i, c in enumerate(e for e in row if tag(e) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = i
            if letters:
                at = 0
                for x in letters[0]:
                    at = at * 26 + ord(x) - 64
                at -= 1
            text = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
            values[at] = shared[int(text)] if c.get("t") == "s" and text else text
        rows.append([values.get(k, "") for k in range(max(values, default=-1) + 1)])
    return rows


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("path", ...)[.option("sheet", ...)]``: text columns by the first row.

    A workbook is one partition, as its sheets can't be split; give many paths, joined by commas, for many partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _paths(self) -> list[str]:
        return self.options["path"].split(",")

    def schema(self) -> StructType:
        with open(self._paths()[0], "rb") as f:
            head = (_cells(f.read(), self.options.get("sheet")) or [[]])[0]
        return StructType([StructField(c or f"column_{i}", StringType()) for i, c in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths(), self.options.get("sheet"), len(schema))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str | None, width: int):
        self.paths, self.sheet, self.width = paths, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            rows = _cells(f.read(), self.sheet)[1:]
        for r in rows:
            yield tuple((r + [""] * self.width)[: self.width])


def parse(contents: DataFrame, columns: list[str], sheet: str | None = None, content: str = "content") -> DataFrame:
    """Rows of workbooks that stand in a binary column (as the ``binaryFile`` source reads them from any store), as text."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for data in pdf[content]:
                rows = _cells(bytes(data), sheet)[1:]
                yield pd.DataFrame([(r + [""] * len(columns))[: len(columns)] for r in rows], columns=columns, dtype=str)

    return contents.select(content).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def workbook(spark, path: str, sheet: str | None = None) -> DataFrame:
    """Workbooks below a path of any store; the first one's first row names the columns."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = (_cells(bytes(files.orderBy("path").first()["content"]), sheet) or [[]])[0]
    return parse(files, [c or f"column_{i}" for i, c in enumerate(head)], sheet)


def sheet_names(names: list[str]) -> list[str]:
    """Legal names of at most 31 characters, all different."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            tail = f"_{k}"
            name, k = base[: 31 - len(tail)] + tail, k + 1
        out.append(name)
    return out


def write_workbook(sheets: dict[str, DataFrame], path, most_rows: int = 1_048_575) -> None:
    """One sheet for each table, cells as text or numbers; ``path`` may be an open file. Rows stream to the driver; a sheet holds ``most_rows`` at most, as the format does."""
    names = sheet_names(list(sheets))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v:
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData><row>{"".join(cell(c) for c in df.columns)}</row>'.encode())
                for k, r in enumerate(df.toLocalIterator()):
                    if k >= most_rows:
                        break
                    f.write(f"<row>{''.join(cell(v) for v in r)}</row>".encode())
                f.write(b"</sheetData></worksheet>")
