"""Workbooks (.xlsx, .xlsm) and decks (.pptx) as data sources: a partition for each worksheet or slide part.

spark.dataSource.register(Workbooks); spark.read.format("workbook").load("a.xlsx,b.xlsx") gives a row for each populated
cell. Python parses the XML part by part; everything after is Spark.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.functions.formulas import column_number

CELLS = "member string, sheet string, row int, col int, vtype string, num double, txt string, formula string, number_format string"
SHAPES = "member string, slide int, shape string, kind string, row int, col int, text string"
# Number formats that a workbook refers to without defining them.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 49: "@"}
TYPES = {"b": "bool", "e": "error", "s": "text", "str": "text", "inlineStr": "text", "d": "date"}


def opened(path: str) -> zipfile.ZipFile:
    """The package at a path or URI, of which only the parts that are asked for are read; raises on parts that leave the package or occur twice."""
    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
    z = zipfile.ZipFile(store.open_input_file(at))
    names = z.namelist()
    if len(set(names)) != len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise ValueError(f"{path}: not a safe package")
    return z


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets inside the package by relationship id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels".lstrip("/")
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ET.fromstring(z.read(rels)) if r.get("TargetMode") != "External"}


def children(z: zipfile.ZipFile, part: str, tag: str) -> list[tuple[str, str]]:
    """(name, part) of a main part's sheets or slides, in order."""
    rel = related(z, part)
    out = []
    for e in ET.fromstring(z.read(part)).iter():
        if local(e.tag) == tag:
            target = next((v for k, v in e.attrib.items() if k.startswith("{") and local(k) == "id"), None)
            out.append((e.get("name") or "", rel[target]))
    return out


def texts(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")


class Part(InputPartition):
    def __init__(self, path: str, name: str, part: str, number: int):
        self.path, self.name, self.part, self.number = path, name, part, number


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = [p.strip() for p in path.split(",") if p.strip()]

    def partitions(self) -> list[InputPartition]:
        return [Part(p, n, x, i) for p in self.paths for i, (n, x) in enumerate(children(opened(p), "xl/workbook.xml", "sheet"))]

    def read(self, partition: Part) -> Iterator[tuple]:
        z = opened(partition.path)
        strings = [texts(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        formats = self.formats(z)
        member = posixpath.basename(partition.path)
        shared: dict[str, tuple[str, int, int]] = {}
        row = 0
        with z.open(partition.part) as f:
            for _, e in ET.iterparse(f):
                if local(e.tag) != "row":
                    continue
                row, col = int(e.get("r") or row + 1), 0
                for c in e:
                    m = re.match(r"([A-Z]+)(\d+)", c.get("r") or "")
                    col = column_number(m[1]) if m else col + 1
                    kids = {local(k.tag): k for k in c}
                    kind, raw, formula = c.get("t", "n"), kids["v"].text if "v" in kids else None, None
                    if "f" in kids:
                        own = kids["f"]
                        formula = "=" + own.text if own.text else None
                        if own.get("t") == "array" and formula:  # one formula for all cells of its range, shown once
                            formula = "{" + formula + "}"
                        if own.get("t") == "shared":
                            if own.text:
                                shared[own.get("si")] = (own.text, row, col)
                            elif own.get("si") in shared:
                                text, r, k = shared[own.get("si")]
                                formula = "=" + moved(text, row - r, col - k)
                    text = strings[int(raw)] if kind == "s" and raw is not None else texts(kids["is"]) if kind == "inlineStr" and "is" in kids else raw
                    if text is None and formula is None:
                        continue
                    number = float(raw) if kind == "n" and raw is not None else None
                    yield (member, partition.name, row, col, TYPES.get(kind, "number") if text is not None else None, number, text, formula, formats.get(c.get("s", "0"), "General"))
                e.clear()

    @staticmethod
    def formats(z: zipfile.ZipFile) -> dict[str, str]:
        """Number formats by style index."""
        if "xl/styles.xml" not in z.namelist():
            return {}
        root, own, out = ET.fromstring(z.read("xl/styles.xml")), dict(BUILT_IN), {}
        for e in root.iter():
            if local(e.tag) == "numFmt":
                own[int(e.get("numFmtId"))] = e.get("formatCode")
        for e in root:
            if local(e.tag) == "cellXfs":
                out = {str(i): own.get(int(x.get("numFmtId", 0)), "General") for i, x in enumerate(e)}
        return out


def moved(formula: str, rows: int, cols: int) -> str:
    """A shared formula at another place: its relative references move along."""
    from tallyloom.functions.formulas import CELL, TOKEN

    def cell(m: re.Match) -> str:
        n = column_number(m[2]) + (0 if m[1] else cols)
        letters = ""
        while n:
            n, r = divmod(n - 1, 26)
            letters = chr(65 + r) + letters
        return f"{m[1]}{letters}{m[3]}{int(m[4]) + (0 if m[3] else rows)}"

    return "".join(CELL.sub(cell, m.group()) if m.lastgroup == "ref" else m.group() for m in TOKEN.finditer(formula))


class Workbooks(DataSource):
    """format workbook: a row of CELLS for each populated cell of each sheet; the path may list several files with commas."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


class DeckReader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = [p.strip() for p in path.split(",") if p.strip()]

    def partitions(self) -> list[InputPartition]:
        return [Part(p, n, x, i + 1) for p in self.paths for i, (n, x) in enumerate(children(opened(p), "ppt/presentation.xml", "sldId"))]

    def read(self, partition: Part) -> Iterator[tuple]:
        root = ET.fromstring(opened(partition.path).read(partition.part))
        member = posixpath.basename(partition.path)
        for shape in root.iter():
            tag = local(shape.tag)
            if tag not in ("sp", "graphicFrame"):
                continue
            name = next((e.get("name") for e in shape.iter() if local(e.tag) == "cNvPr"), "")
            if tag == "graphicFrame":
                for r, tr in enumerate(e for e in shape.iter() if local(e.tag) == "tr"):
                    for c, tc in enumerate(e for e in tr if local(e.tag) == "tc"):
                        yield (member, partition.number, name, "table", r, c, self.lines(tc))
                continue
            kind = next(("title" for e in shape.iter() if local(e.tag) == "ph" and e.get("type") in ("title", "ctrTitle")), "text")
            if text := self.lines(shape):
                yield (member, partition.number, name, kind, None, None, text)

    @staticmethod
    def lines(e: ET.Element) -> str:
        return "\n".join(texts(p) for p in e.iter() if local(p.tag) == "p")


class Decks(DataSource):
    """format deck: a row of SHAPES for each text shape and table cell of each slide."""

    @classmethod
    def name(cls) -> str:
        return "deck"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> DataSourceReader:
        return DeckReader(self.options["path"])


def register(spark) -> None:
    from tallyloom.sources.parts import WorkbookParts

    for source in (Workbooks, WorkbookParts, Decks):
        spark.dataSource.register(source)
