"""Messages as rows: each part of a message is one, with its headers, so that what is asked of mail are DataFrame queries.

Parts are found by the places of their delimiters, so that each can be shown as it stands in the message; the standard
library reads headers and undoes encodings. All judgement is in operators.mail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import policy
from email.message import Message
from email.parser import BytesHeaderParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PARTS = "mail_id string, part_id int, parent_id int, depth int, content_type string, charset string, filename string, disposition string, headers array<struct<name:string,value:string>>, content binary, text string, defects array<string>, start int, body_start int, end int"
#: Bounds against crafted messages: fixed values.
MOST_DEPTH, MOST_PARTS, MOST_HEADERS = 30, 2000, 20_000


def _body_start(data: bytes, start: int, end: int) -> int:
    """Where the headers of a part end; a part without a blank line is all headers."""
    if m := re.compile(rb"\r?\n").match(data, start, end):
        return m.end()
    m = re.compile(rb"\r?\n\r?\n").search(data, start, end)
    return m.end() if m else end


def _between(data: bytes, start: int, end: int, boundary: bytes) -> tuple[list[tuple[int, int]], list[str]]:
    """The ranges of a multipart body's parts, and what is wrong with its delimiters (RFC 2046, section 5.1.1)."""
    line = re.compile(rb"(?:\A|(?<=\n))--" + re.escape(boundary) + rb"(--)?[ \t]*(?:\r?\n|\Z)", re.M)
    marks, closed = [], False
    for m in line.finditer(data[start:end]):
        marks.append((start + m.start(), start + m.end()))
        closed = m[1] is not None
        if closed:
            break
    found = []
    for (_, a), (b, _) in zip(marks, marks[1:] if closed else [*marks[1:], (end, end)], strict=False):
        cut = b - 2 if data[b - 2 : b] == b"\r\n" else b - 1 if data[b - 1 : b] == b"\n" and b < end else b
        found.append((a, max(cut, a)))
    return found, [] if closed else ["CloseBoundaryNotFoundDefect"] if marks else ["StartBoundaryNotFoundDefect"]


def parts(data: bytes) -> Iterator[dict]:
    """The parts of a message in order, the message itself first; those beyond the bounds are left out, and defects say so.

    start, body_start and end are places in the message's bytes: a part is data[start:end], its body, still encoded,
    data[body_start:end].
    """
    todo: list[tuple[int, int, int | None, int]] = [(0, len(data), None, 0)]
    n = 0
    while todo and n < MOST_PARTS:
        start, end, parent, depth = todo.pop(0)
        body = _body_start(data, start, end)
        m = BytesHeaderParser(policy=policy.compat32).parsebytes(data[start:body])
        kind, charset, boundary = m.get_content_type(), m.get_content_charset() or "utf-8", m.get_boundary()
        inner, defects = [], [type(d).__name__ for d in m.defects if type(d).__name__ not in _BY_BODY]
        if kind.startswith("multipart/"):
            inner, wrong = _between(data, body, end, boundary.encode("ascii", "surrogateescape")) if boundary else ([], ["NoBoundaryInMultipartDefect"])
            defects += wrong
        elif kind == "message/rfc822":
            inner = [(body, end)]
        content = b""
        if not inner:
            leaf = Message(policy.compat32)
            if encoding := m.get("content-transfer-encoding"):
                leaf["content-transfer-encoding"] = str(encoding)
            leaf.set_payload(data[body:end].decode("ascii", "surrogateescape"))
            content = leaf.get_payload(decode=True) or b""
        yield {
            "part_id": n, "parent_id": parent, "depth": depth, "content_type": kind, "charset": charset, "filename": m.get_filename(), "disposition": m.get_content_disposition(),
            "headers": [{"name": k.lower(), "value": str(v)} for k, v in m.items()[:MOST_HEADERS]], "content": content, "text": _text(content, charset) if kind.startswith("text/") else None,
            "defects": defects + ["TooDeep"] * (bool(inner) and depth >= MOST_DEPTH), "start": start, "body_start": body, "end": end,
        }
        if depth < MOST_DEPTH:
            todo[:0] = [(a, b, n, depth + 1) for a, b in inner]
        n += 1


#: Defects that the parser of headers reports for want of a body.
_BY_BODY = ("StartBoundaryNotFoundDefect", "CloseBoundaryNotFoundDefect", "NoBoundaryInMultipartDefect", "MultipartInvariantViolationDefect")


def _text(content: bytes, charset: str) -> str:
    try:
        return content.decode(charset, "replace")
    except LookupError:
        return content.decode("latin-1")


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all message files under path; a message is named by the file's path."""
    return decoded(spark.read.format("binaryFile").load(path).selectExpr("path as mail_id", "content"))


def decoded(messages: DataFrame) -> DataFrame:
    """The parts of messages (mail_id, content). A null content has none; what cannot be parsed at all is one plain part."""
    schema = T._parse_datatype_string(PARTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None:
                    yield pa.RecordBatch.from_pylist([{"mail_id": name, **p} for p in parts(data)], schema=arrow)

    return messages.select("mail_id", "content").mapInArrow(run, schema)
