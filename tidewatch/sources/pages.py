"""What a page holds, element by element: links with their text, forms, frames, and what its hidden parts say.

A stack of open elements says of each place whether it is hidden, by itself or by what it lies in. Comments and the insides
of scripts and styles are no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LINK = "struct<url:string,element:string,attribute:string,text:string,hidden:boolean>"
PAGE = f"struct<links:array<{LINK}>,forms:array<struct<action:string,method:string>>,inputs:array<string>,scripts:int,frames:int,hidden:int,hidden_chars:int,pixels:int,refreshes:int>"
#: Attributes that hold an address, in HTML (living standard and what came before it).
ADDRESSES = ("action", "background", "cite", "data", "dynsrc", "formaction", "href", "longdesc", "lowsrc", "ping", "poster", "src", "srcset", "xlink:href")
#: Elements that never hold others, and those that end when another of their kind begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNCLOSED = frozenset("dd dt li option p td th tr".split())
FRAMES = ("embed", "frame", "iframe", "object")
_HIDDEN = re.compile(r"display:none|visibility:hidden|font-size:0(?![.\d]*[1-9])|max-height:0(?![.\d]*[1-9])|opacity:0(?![.\d]*[1-9])")
_STYLE_URL = re.compile(r"url\(\s*['\"]?([^'\"()]+)", re.I)
_REFRESH_URL = re.compile(r"url\s*=\s*['\"]?([^'\";]+)", re.I)
#: Characters of a link's text that are kept.
MOST_TEXT = 500


class Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.forms: list[dict] = []
        self.inputs: list[str] = []
        self.counts = dict.fromkeys(("scripts", "frames", "hidden", "hidden_chars", "pixels", "refreshes"), 0)
        self.open: list[tuple[str, bool, dict | None]] = []  # element, whether hidden, its link

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNCLOSED and any(t == tag for t, *_ in self.open[-1:]):
            self.open.pop()
        has = {k.lower(): v or "" for k, v in reversed(attrs)}
        inside = bool(self.open) and self.open[-1][1]
        own = "hidden" in has or bool(_HIDDEN.search(re.sub(r"\s+", "", has.get("style", "")).lower()))
        for name, what in (("hidden", own), ("scripts", tag == "script"), ("frames", tag in FRAMES), ("pixels", tag == "img" and {has.get("width"), has.get("height")} <= {"0", "1"}), ("refreshes", tag == "meta" and has.get("http-equiv", "").lower() == "refresh")):
            self.counts[name] += what
        if tag == "form":
            self.forms.append({"action": has.get("action", ""), "method": has.get("method", "get").lower()})
        if tag == "input":
            self.inputs.append(has.get("type", "text").lower())
        first = len(self.links)
        for name in ADDRESSES:
            value = has.get(name, "")
            for url in [x.split()[0] for x in value.split(",") if x.strip()] if name == "srcset" else [value]:
                self._link(url, tag, name, own or inside)
        for url in _STYLE_URL.findall(has.get("style", "")):
            self._link(url, tag, "style", own or inside)
        if tag == "meta" and (m := _REFRESH_URL.search(has.get("content", ""))):
            self._link(m[1], tag, "content", own or inside)
        if tag not in VOID:
            self.open.append((tag, own or inside, self.links[first] if tag == "a" and len(self.links) > first else None))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.open:
            return
        if self.open[-1][0] in ("script", "style"):
            return
        if self.open[-1][1]:
            self.counts["hidden_chars"] += len(data.strip())
        for *_, link in reversed(self.open):
            if link is not None:
                link["text"] = (link["text"] + data)[:MOST_TEXT]
                return

    def _link(self, url: str, tag: str, attribute: str, hidden: bool) -> None:
        if url.strip():
            self.links.append({"url": url.strip(), "element": tag, "attribute": attribute, "text": "", "hidden": hidden})


def read(html: str | None) -> dict:
    """The PAGE of a text; null is as empty."""
    page = Page()
    page.feed(html or "")
    page.close()
    return {"links": page.links, "forms": page.forms, "inputs": page.inputs, **page.counts}


def with_page(rows: DataFrame, html: str = "html") -> DataFrame:
    """rows with page (PAGE), read from a column of texts, whole. Null and empty texts have a page with nothing in it."""
    columns = [c for c in rows.columns if c != "page"]
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("page", T._parse_datatype_string(PAGE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["page"].dataType)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([read(x) for x in b.column(html).to_pylist()], kind)], names=[*columns, "page"])

    return rows.select(*columns).mapInArrow(run, schema)
