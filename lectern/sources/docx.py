"""A reader of Word files: paragraphs in order, as rows.

Whole files come in as ``binaryFile`` rows; the standard library unpacks and
parses them inside the tasks, a file at a time. A Word file is a zip of one XML
text, so it cannot be split; files larger than a task's memory don't occur in practice.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The name space of word-processing markup, and the values that switch a property off.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OFF = ("0", "false", "off", "none")
BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
RUN = "struct<text:string,bold:boolean,underline:boolean,italic:boolean,highlight:boolean>"
SCHEMA = f"path string, pos int, views array<string>, line string, runs array<{RUN}>, rescued boolean, error string"


@dataclass
class Paragraph:
    """A paragraph without the paragraphs inside it; ``raw`` has their text too."""

    views: set[str]
    runs: list[tuple] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)

    @property
    def line(self) -> str:
        return "".join(r[0] for r in self.runs)


def _style(run: ElementTree.Element) -> tuple[bool, ...]:
    found = run.find(W + "rPr")
    on = lambda name: found is not None and (p := found.find(W + name)) is not None and p.get(W + "val", "true").lower() not in OFF
    marked = found is not None and any(found.find(W + name) is not None for name in ("highlight", "shd"))
    return on("b"), on("u"), on("i"), marked


def paragraphs(data: bytes) -> list[Paragraph]:
    """All paragraphs in document order, each once.

    Views: ``all``; ``leaf`` without a paragraph inside; ``direct`` right in the
    body; ``textbox`` and ``cell`` inside of those. Tabs and breaks are text;
    runs carry their style; runs of a text box belong to its own paragraphs.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out: list[Paragraph] = []
    plain = (False, False, False, False)
    # (node, open paragraphs from the outermost, views, style, whether the parent is the body)
    stack = [(root, (), frozenset(), plain, False)]
    while stack:
        node, opened, views, style, top = stack.pop()
        if node.tag == W + "p":
            for outer in opened:
                outer.views.discard("leaf")
            own = Paragraph({"all", "leaf", *views, *(["direct"] if top else [])})
            out.append(own)
            opened, style = (*opened, own), plain
        elif node.tag == W + "txbxContent":
            views = views - {"cell"} | {"textbox"}
        elif node.tag == W + "tc":
            views = views | {"cell"}
        elif node.tag == W + "r":
            style = _style(node)
        elif opened and (node.tag == W + "t" or node.tag in BREAKS):
            text = BREAKS.get(node.tag) or node.text or ""
            opened[-1].runs.append((text, *style))
            if node.tag == W + "t":
                for outer in opened:
                    outer.raw.append(text)
        stack.extend((child, opened, views, style, node.tag == W + "body") for child in reversed(node))
    return out


def file_rows(where: str, data: bytes, anchors: tuple[str, ...] = ()) -> list[tuple]:
    """The rows of one file, as tuples of ``SCHEMA``; see ``read_docx``."""
    names = ["text", "bold", "underline", "italic", "highlight"]
    rows = []
    try:
        for pos, p in enumerate(paragraphs(data)):
            raw = "".join(p.raw)
            rescue = any(a in raw and a not in p.line for a in anchors)
            runs = [(raw, False, False, False, False)] if rescue else [r for r in p.runs if r[0]]
            rows.append((where, pos, sorted(p.views), raw if rescue else p.line, [dict(zip(names, r)) for r in runs], rescue, None))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as problem:
        return [(where, None, None, None, None, None, type(problem).__name__)]
    return rows


def read_docx(spark: SparkSession, path: str, anchors: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``SCHEMA`` of all Word files under a path; a file that is none gives one row with its error.

    A paragraph whose inner paragraphs hold one of ``anchors`` that it lacks itself
    takes the whole text, as plain text (``rescued``).
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                rows = file_rows(where, bytes(data), anchors)
                yield pd.DataFrame(rows, columns=["path", "pos", "views", "line", "runs", "rescued", "error"]).astype({"pos": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def view(rows: DataFrame, name: str) -> DataFrame:
    """(doc, pos, line, runs) of one view, as the paper operators take them."""
    return rows.where(F.array_contains("views", name)).select(F.col("path").alias("doc"), "pos", "line", "runs")
