"""What a workbook holds besides cells, as rows: sheets and their visibility, defined names, tables, rules, charts, comments, links, risks.

spark.dataSource.register(WorkbookParts); spark.read.format("workbook_parts").load("a.xlsx,b.xlsx"). A partition for each file
reads its small parts alone, never cells.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.sources.ooxml import children, local, opened, related, texts

ROWS = "member string, kind string, sheet string, name string, fields map<string,string>"
# Content that makes a package risky, by a pattern of its parts' names.
RISKS = {"macro": r"vbaProject\.bin$", "ole_object": r"/embeddings/.*oleObject", "activex": r"/activeX/", "external_link": r"/externalLinks/externalLink\d+\.xml$", "connection": r"/connections\.xml$", "query": r"/queryTables/|/customXml/.*DataMashup"}


def attributes(e: ET.Element) -> dict[str, str]:
    return {local(k): v for k, v in e.attrib.items()}


def named(e: ET.Element, tag: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if local(x.tag) == tag)


def first_text(e: ET.Element, *path: str) -> str | None:
    """The text under a path of tags, the first that there is."""
    for tag in path:
        e = next(named(e, tag), None) if e is not None else None
    return e.text if e is not None else None


def typed(z: zipfile.ZipFile, part: str, suffix: str) -> list[str]:
    """Parts that a part is related to by a type that ends so."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels".lstrip("/")
    if rels not in z.namelist():
        return []
    found = related(z, part)
    return [found[r.get("Id")] for r in ET.fromstring(z.read(rels)) if (r.get("Type") or "").endswith(suffix) and r.get("Id") in found]


def series_of(chart: ET.Element) -> Iterator[dict[str, str | None]]:
    """Series of a chart: its plot's kind, order, name, and the references of name, categories and values."""
    for plot in (x for x in chart.iter() if local(x.tag).endswith("Chart") and local(x.tag) != "chart"):
        for s in (x for x in plot if local(x.tag) == "ser"):
            kids = {local(k.tag): k for k in s}
            ref = lambda *tags, kids=kids: next((first_text(kids[t], "f") for t in tags if t in kids), None)
            order = kids["order"].get("val") if "order" in kids else None
            yield {"plot": local(plot.tag).removesuffix("Chart"), "order": order, "name": first_text(kids["tx"], "v") if "tx" in kids else None, "name_ref": ref("tx"), "categories_ref": ref("cat", "xVal"), "values_ref": ref("val", "yVal")}


def sheet_parts(z: zipfile.ZipFile, sheet: str, part: str) -> Iterator[tuple[str, str, dict]]:
    """kind, name, fields of a worksheet's rules, tables, comments, charts and pivots. Its rows of cells are skipped."""
    n = {"validation": 0, "conditional_format": 0}
    with z.open(part) as f:
        for _, e in ET.iterparse(f):
            tag = local(e.tag)
            if tag == "row":
                e.clear()
            elif tag == "dataValidation":
                n["validation"] += 1
                yield "validation", str(n["validation"]), attributes(e) | {k: first_text(e, k) for k in ("formula1", "formula2")}
            elif tag == "conditionalFormatting":
                for rule in named(e, "cfRule"):
                    n["conditional_format"] += 1
                    yield "conditional_format", str(n["conditional_format"]), attributes(rule) | {"sqref": e.get("sqref")} | {f"formula{i}": x.text for i, x in enumerate(named(rule, "formula"), 1)}
            elif tag == "dimension":
                yield "dimension", "", attributes(e)
    for t in typed(z, part, "/table"):
        e = ET.fromstring(z.read(t))
        yield "table", e.get("displayName") or e.get("name") or "", attributes(e) | {"columns": "\n".join(c.get("name") or "" for c in named(e, "tableColumn"))}
    for t in typed(z, part, "/comments"):
        for e in named(ET.fromstring(z.read(t)), "comment"):
            yield "comment", e.get("ref") or "", {"text": texts(e)}
    for t in typed(z, part, "/pivotTable"):
        e = ET.fromstring(z.read(t))
        where = next(named(e, "location"), None)
        source = next((s for c in typed(z, t, "/pivotCacheDefinition") for s in named(ET.fromstring(z.read(c)), "worksheetSource")), None)
        yield "pivot", e.get("name") or "", {"location": where.get("ref") if where is not None else None} | ({f"source_{k}": v for k, v in attributes(source).items()} if source is not None else {})
    for drawing in typed(z, part, "/drawing"):
        rel = related(z, drawing)
        for i, anchor in enumerate(x for x in ET.fromstring(z.read(drawing)) if local(x.tag).endswith("Anchor")):
            at = {f"{side}_{k}": first_text(anchor, side, k) for side in ("from", "to") for k in ("col", "row")}
            for c in named(anchor, "chart"):
                chart = rel.get(next((v for k, v in c.attrib.items() if local(k) == "id"), ""))
                if not chart or chart not in z.namelist():
                    continue
                e = ET.fromstring(z.read(chart))
                title = next(named(e, "title"), None)
                name = posixpath.basename(chart)
                yield "chart", name, at | {"title": texts(title) if title is not None else None, "index": str(i), "legend": next((p.get("val") for p in named(e, "legendPos")), None)}
                for k, s in enumerate(series_of(e)):
                    yield "chart_series", f"{name}/{k}", s | {"chart": name}


def parts_of(path: str) -> Iterator[tuple[str, str | None, str, dict]]:
    """kind, sheet, name, fields of all a workbook's parts."""
    z = opened(path)
    root = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = children(z, "xl/workbook.xml", "sheet")
    states = [e.get("state") or "visible" for e in named(root, "sheet")]
    for (name, part), state in zip(sheets, states, strict=True):
        yield "sheet", name, name, {"state": state}
        for kind, own, fields in sheet_parts(z, name, part):
            yield kind, name, own, fields
    for e in named(root, "definedName"):
        scope = e.get("localSheetId")
        yield "name", sheets[int(scope)][0] if scope is not None else None, e.get("name") or "", {"ref": e.text, "hidden": e.get("hidden")}
    if "xl/connections.xml" in z.namelist():
        for e in named(ET.fromstring(z.read("xl/connections.xml")), "connection"):
            yield "connection", None, e.get("name") or "", attributes(e) | {f"db_{k}": v for d in named(e, "dbPr") for k, v in attributes(d).items()}
    for part in z.namelist():
        for risk, pattern in RISKS.items():
            if re.search(pattern, part):
                yield "risk", None, part, {"risk": risk, "sha256": hashlib.sha256(z.read(part)).hexdigest()}
        if re.search(RISKS["external_link"], part):
            folder, name = posixpath.split(part)
            rels = f"{folder}/_rels/{name}.rels"
            for r in ET.fromstring(z.read(rels)) if rels in z.namelist() else ():
                if r.get("TargetMode") == "External":
                    yield "external_target", None, part, {"target": r.get("Target")}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PartsReader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = [p.strip() for p in path.split(",") if p.strip()]

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        member = posixpath.basename(partition.path)
        for kind, sheet, name, fields in parts_of(partition.path):
            yield member, kind, sheet, name, {k: v for k, v in fields.items() if v is not None}


class WorkbookParts(DataSource):
    """format workbook_parts: a row of ROWS for each part; the path may list several files with commas."""

    @classmethod
    def name(cls) -> str:
        return "workbook_parts"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return PartsReader(self.options["path"])
