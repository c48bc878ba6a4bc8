"""Files as tables: CSV, JSON, JSON lines, HTML and XML, plain, compressed, in archives or from the web.

Plain local files are read by Spark itself, in splits; compressed, archived and remote ones are fetched by the driver.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import json
import lzma
import re
import tarfile
import urllib.parse
import urllib.request
import zipfile
import zlib
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.exceptions import CypherExecutionError

ARCHIVES = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".zip")


def local(source: str) -> str | None:
    """The path of a plain local file."""
    if re.match(r"https?://", source) or "!" in source or source.lower().endswith((".gz", ".bz2", ".xz", ".zip", ".zst")):
        return None
    return source[7:] if source.startswith("file://") else source


def unpacked(data: bytes, kind: str) -> bytes:
    kind = kind.upper()
    if kind in ("", "NONE"):
        return data
    if kind == "ZIP":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(next(n for n in z.namelist() if not n.endswith("/")))
    makers = {"GZIP": gzip.decompress, "GZ": gzip.decompress, "BZ2": bz2.decompress, "XZ": lzma.decompress, "DEFLATE": zlib.decompress}
    if kind not in makers:
        raise CypherExecutionError(f"unknown compression {kind}")
    return makers[kind](data)


def fetch(source: str, headers: dict | None = None, payload: Any = None, options: dict | None = None) -> bytes:
    """The bytes of a file, a web address or an archive's member (`archive!member`), decompressed by option or suffix."""
    options = options or {}
    place, _, member = source.partition("!")
    if re.match(r"https?://", place):
        data = payload.encode() if isinstance(payload, str) else json.dumps(payload).encode() if payload is not None else None
        head = dict(headers or {})
        request = urllib.request.Request(place, data=data, headers=head, method=head.pop("method", options.get("method")))
        for attempt in range(int(options.get("retry", 0)) + 1):
            try:
                with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as r:
                    raw = r.read()
                break
            except OSError as e:
                if attempt == int(options.get("retry", 0)):
                    if options.get("failOnError", True):
                        raise CypherExecutionError(f"cannot read {place}: {e}") from None
                    return b"null"
    else:
        try:
            with open(place[7:] if place.startswith("file://") else place, "rb") as f:
                raw = f.read()
        except OSError as e:
            raise CypherExecutionError(f"cannot read {place}: {e}") from None
    if member:
        if place.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return z.read(member)
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            names = [m for m in t.getmembers() if m.name.removeprefix("./") == member.removeprefix("./")]
            found = t.extractfile(names[0]) if names else None
            if found is None:
                raise CypherExecutionError(f"no {member} in {place}")
            return found.read()
    suffix = {".gz": "GZIP", ".bz2": "BZ2", ".xz": "XZ", ".zip": "ZIP"}
    kind = options.get("compression") or next((k for s, k in suffix.items() if place.lower().endswith(s)), "")
    return unpacked(raw, kind)


def with_params(source: str, params: dict | None) -> str:
    if not params or not re.match(r"https?://", source):
        return source
    return source + ("&" if "?" in source else "?") + urllib.parse.urlencode(params)


def csv_rows(spark: SparkSession, source: str, headers: bool, separator: str = ",") -> tuple[DataFrame, T.DataType]:
    """A column `row`: a map by header names, or a list; all values are texts."""
    path = local(source)
    options = {"header": headers, "inferSchema": False, "sep": separator, "quote": '"', "escape": '"', "multiLine": True}
    if path is not None:
        df = spark.read.options(**options).csv(path)
    else:
        import csv

        rows = list(csv.reader(io.StringIO(fetch(source).decode("utf-8-sig")), delimiter=separator))
        names = rows.pop(0) if headers and rows else [f"_c{k}" for k in range(max(map(len, rows), default=1))]
        df = spark.createDataFrame([tuple([*r, *[None] * (len(names) - len(r))][: len(names)]) for r in rows], ", ".join(f"`{n}` string" for n in names))
    cells = [F.col(f"`{c}`") for c in df.columns]
    if headers:
        row: Column = F.map_from_arrays(F.array(*(F.lit(c.strip("﻿")) for c in df.columns)), F.array(*cells))
        return df.select(row.alias("row")), T.MapType(T.StringType(), T.StringType())
    return df.select(F.array(*cells).alias("row")), T.ArrayType(T.StringType())


def csv_each(sources: DataFrame, headers: bool, separator: str = ",") -> tuple[DataFrame, T.DataType]:
    """source and row of every record of the files named in the column `source`, each file read by a worker."""
    import csv

    kind: T.DataType = T.MapType(T.StringType(), T.StringType()) if headers else T.ArrayType(T.StringType())

    def run(batches: Any) -> Any:
        for b in batches:
            for source in b["source"].dropna():
                rows = csv.reader(io.StringIO(fetch(source).decode("utf-8-sig"), newline=""), delimiter=separator)
                names = [n.strip() for n in next(rows, [])] if headers else []
                while part := list(itertools.islice(rows, 10_000)):
                    filled = [[x or None for x in r] for r in part if r]
                    cells = [dict(zip(names, [*r, *[None] * (len(names) - len(r))], strict=False)) for r in filled] if headers else filled
                    yield pd.DataFrame({"source": [source] * len(cells), "row": cells})

    return sources.mapInPandas(run, T.StructType([T.StructField("source", T.StringType()), T.StructField("row", kind)])), kind


def json_texts(text: str, must_be_array: bool = False) -> list[str]:
    """The items of an array, or one value, as JSON texts; none for null."""
    text = text.removeprefix("\ufeff")
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value = json.loads(re.sub(r",(\s*[\]}])", r"\1", text))
        except ValueError:
            raise CypherExecutionError("the file is no JSON") from None
    if must_be_array and not isinstance(value, list):
        raise CypherExecutionError("the file is no JSON array")
    return [json.dumps(x) for x in (value if isinstance(value, list) else [value]) if x is not None]


def tidy(text: Column) -> Column:
    """Without a byte-order mark and trailing commas."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r",(\s*[\]}])", "$1")


def texts(spark: SparkSession, source: str, **how: Any) -> DataFrame:
    path = local(source)
    if path is not None:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return spark.createDataFrame([(fetch(source, **how).decode("utf-8-sig"),)], "text string")


def json_values(spark: SparkSession, source: str, must_be_array: bool = False, **how: Any) -> DataFrame:
    """A column `value`: one row for each item of an array, one for any other value, none for null."""
    df = texts(spark, source, **how)
    value = F.coalesce(F.try_parse_json("text"), F.try_parse_json(tidy(F.col("text"))))
    df = df.select(value.alias("value"))
    is_array = F.schema_of_variant("value").startswith("ARRAY")
    if must_be_array and not df.where(F.col("value").isNull() | ~is_array).isEmpty():
        raise CypherExecutionError("the file is no JSON array")
    if not must_be_array and not df.where(F.col("value").isNull()).isEmpty():
        raise CypherExecutionError("the file is no JSON")
    items = F.when(is_array, F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    return df.select(F.explode(items).alias("value")).where(~F.is_variant_null("value"))


# HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Any] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def below(self) -> list[Element]:
        out = []
        for c in self.elements():
            out += [c, *c.below()]
        return out


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.now
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.now = e.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


STEP = re.compile(r"^([\w-]*)((?:\.[\w-]+)*)(?::eq\((\d+)\))?$")


def select(root: Element, selector: str) -> list[Element]:
    """Descendant chain of tag.class:eq(n) steps; :eq counts siblings of the same tag."""
    found = [root]
    for step in selector.split():
        m = STEP.match(step)
        if not m or not (m[1] or m[2]):
            raise CypherExecutionError(f"invalid selector {step!r}")
        classes = [c for c in m[2].split(".") if c]
        out: list[Element] = []
        for base in found:
            for e in base.below():
                if (m[1] and e.tag != m[1].lower()) or not set(classes) <= set(e.attributes.get("class", "").split()):
                    continue
                if m[3] is not None and e.parent is not None:
                    same = [x for x in e.parent.elements() if x.tag == e.tag]
                    if int(m[3]) >= len(same) or same[int(m[3])] is not e:
                        continue
                out.append(e)
        found = out
    return found


def html_select(text: Column, selectors: dict[str, str]) -> Column:
    """JSON text {key: [{text}]} of each selector's elements in an HTML text."""

    @F.pandas_udf(T.StringType())  # type: ignore[call-overload]
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else html_text(page, selectors))

    return run(text)


def html_text(page: str, selectors: dict[str, str]) -> str:
    b = TreeBuilder()
    b.feed(page)
    b.close()
    return json.dumps({k: [{"text": " ".join(e.text().split())} for e in select(b.root, s)] for k, s in selectors.items()})


# XML
def xml_map(e: ElementTree.Element) -> dict[str, Any]:
    """_tag, _attributes, _text and the children by tag; a repeated child is a list."""
    out: dict[str, Any] = {"_tag": e.tag}
    if e.attrib:
        out["_attributes"] = dict(e.attrib)
    if e.text and e.text.strip():
        out["_text"] = e.text.strip()
    if len(e):
        out["_children"] = [xml_map(c) for c in e]
    by: dict[str, list] = {}
    for c in e:
        by.setdefault(c.tag, []).append(xml_map(c))
    for tag, items in by.items():
        out[tag] = items[0] if len(items) == 1 else items
    return out


def xml_select(text: Column, path: str) -> Column:
    """JSON texts of the elements an XPath (of ElementTree's subset) selects."""

    @F.pandas_udf(T.ArrayType(T.StringType()))  # type: ignore[call-overload]
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda doc: None if doc is None else xml_texts(doc, path))

    return run(text)


def xml_texts(doc: str, path: str) -> list[str]:
    root = ElementTree.fromstring(doc)
    if path in ("/", "", "."):
        found = [root]
    elif path.startswith("//"):
        found = root.findall("." + path)
    elif path.startswith("/"):
        steps = path.strip("/").split("/")
        found = ([root] if len(steps) == 1 else root.findall("./" + "/".join(steps[1:]))) if steps[0] == root.tag else root.findall("." + path)
    else:
        found = root.findall(path)
    return [json.dumps(xml_map(e)) for e in found]
