"""EPUB files: their pages in reading order, cleaned, and their style sheets."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.dom import parse

_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_OPF = "{http://www.idpf.org/2007/opf}"
SCHEMA = "path string, kind string, number int, name string, content string, missing boolean"


def clean_page(html: str) -> str:
    """Without readings of ruby text, empty paragraphs and line ends."""
    root = parse(html)
    for x in root.all("rt", "rp"):
        x.remove()
    for x in root.all("rb", "ruby"):
        x.unwrap()
    for x in root.all("p"):
        if not x.text():
            x.remove()
    return root.html().replace("\n", "").replace("\r", "")


def entries(data: bytes) -> list[tuple[str, int | None, str, str | None, bool]]:
    """(kind, number, name, content, missing) of an EPUB. Numbers follow the spine; a missing file keeps its number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf_path = ET.fromstring(z.read("META-INF/container.xml")).find(f".//{_CONTAINER}rootfile").get("full-path")
        opf, base = ET.fromstring(z.read(opf_path)), posixpath.dirname(opf_path)
        manifest = {x.get("id"): (x.get("href"), x.get("media-type") or "") for x in opf.iterfind(f".//{_OPF}manifest/{_OPF}item")}
        inside, out = set(z.namelist()), []
        spine = [manifest.get(x.get("idref")) for x in opf.iterfind(f".//{_OPF}spine/{_OPF}itemref")]
        pages = [x[0] for x in spine if x and "html" in x[1]]
        sheets = [href for href, kind in manifest.values() if kind == "text/css"]
        for kind, names in (("html", pages), ("css", sheets)):
            for k, href in enumerate(names):
                at = posixpath.join(base, href).split("#")[0]
                text = z.read(at).decode("utf-8", "replace") if at in inside else None
                if text is not None:
                    text = clean_page(text) if kind == "html" else text.replace("\n", "").replace("\r", "")
                out.append((kind, k + 1 if kind == "html" else None, f"{k + 1}.html" if kind == "html" else posixpath.basename(href), text, text is None))
        return out


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all *.epub files below path; missing entries have missing = true and no content."""

    def run(batches):
        for pdf in batches:
            made = [(p, *e) for p, data in zip(pdf["path"], pdf["content"]) for e in entries(data)]
            yield pd.DataFrame(made, columns=["path", "kind", "number", "name", "content", "missing"]).astype({"number": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def image_payload(content):
    """A PNG's bytes as a data URL."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(content), "\\s", ""))
