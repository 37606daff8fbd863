"""What is packed in files, read from their structure: the central directory of ZIP, the sectors of compound files (OLE).

Nothing is unpacked: names, sizes and marks stand in the directories, so that an archive costs what its directory holds,
whatever it would unpack to. An archive that lies in another as it is, without compression, is read in its place.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENTRY = "struct<name:string,depth:int,size:long,packed:long,encrypted:boolean,macros:boolean>"
PACKED = f"struct<kind:string,broken:boolean,entries:array<{ENTRY}>>"
#: Entries that are listed of a file, and archives in archives that are followed; more are said to be broken.
MOST, DEEPEST = 10_000, 4
#: Marks of the formats (APPNOTE 4.3, [MS-CFB] 2.2): values fixed by them.
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST_SECTOR, _WIDE = 0xFFFFFFFA, 0xFFFFFFFF
#: Names that hold macros: streams of compound files, and members of packages (ends of names).
MACRO_STREAMS = ("_vba_project", "vba", "macros", "_vba_project_cur")
MACRO_MEMBERS = ("vbaproject.bin", "vbadata.xml")


class Broken(Exception):
    """A file whose structure does not hold together; the entries read so far count."""


def zipped(data: bytes, depth: int = 0) -> Iterator[dict]:
    """The members of a ZIP, in the order of its central directory."""
    end = data.rfind(_END, max(0, len(data) - 65_557))
    if end < 0 or len(data) < end + 22:
        raise Broken
    count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    if size == _WIDE or start == _WIDE or count == 0xFFFF:  # the wide form; the directory is where its own end record says
        at = data.rfind(b"PK\x06\x06", 0, end)
        if at < 0 or len(data) < at + 56:
            raise Broken
        count, size, start = struct.unpack("<QQQ", data[at + 32 : at + 56])
        end = at
    shift = end - size - start  # bytes before the archive, as self-extracting ones have
    at = start + shift
    for _ in range(count):
        if at < 0 or data[at : at + 4] != _CENTRAL or len(data) < at + 46:
            raise Broken
        marks, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, whole, n, extra, note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (place,) = struct.unpack("<I", data[at + 42 : at + 46])
        raw = data[at + 46 : at + 46 + n]
        name = raw.decode("utf-8" if marks & 0x800 else "cp437", "replace")
        yield {"name": name, "depth": depth, "size": whole, "packed": packed, "encrypted": bool(marks & 1), "macros": name.lower().endswith(MACRO_MEMBERS)}
        at += 46 + n + extra + note
        if method == 0 and not marks & 1 and depth < DEEPEST:
            inside = _stored(data, place + shift, packed)
            if inside[:4] in (_LOCAL, _END) or inside[:8] == _COMPOUND:
                yield from (x | {"name": f"{name}/{x['name']}"} for x in entries(inside, depth + 1))


def _stored(data: bytes, at: int, size: int) -> bytes:
    """The bytes of a member that is not compressed."""
    if at < 0 or data[at : at + 4] != _LOCAL or len(data) < at + 30:
        return b""
    n, extra = struct.unpack("<HH", data[at + 26 : at + 30])
    return data[at + 30 + n + extra : at + 30 + n + extra + size]


def compound(data: bytes, depth: int = 0) -> Iterator[dict]:
    """The streams and storages of a compound file, by following its directory's chain of sectors."""
    if len(data) < 512:
        raise Broken
    shift = struct.unpack("<H", data[30:32])[0]
    if shift not in (9, 12):
        raise Broken
    width = 1 << shift
    sector = lambda n: data[(n + 1) * width : (n + 2) * width]
    n_tables, directory = struct.unpack("<I", data[44:48])[0], struct.unpack("<I", data[48:52])[0]
    more, n_more = struct.unpack("<II", data[68:76])
    tables = list(struct.unpack("<109I", data[76:512]))
    seen: set[int] = set()
    while more < _LAST_SECTOR and len(seen) < n_more:
        block = sector(more)
        if more in seen or len(block) < width:
            raise Broken
        seen.add(more)
        numbers = struct.unpack(f"<{width // 4}I", block)
        tables += numbers[:-1]
        more = numbers[-1]
    tables = [t for t in tables if t < _LAST_SECTOR][:n_tables]

    def following(n: int) -> int:
        table = tables[n // (width // 4)] if n // (width // 4) < len(tables) else _LAST_SECTOR
        block = sector(table) if table < _LAST_SECTOR else b""
        at = n % (width // 4) * 4
        if len(block) < at + 4:
            raise Broken
        return struct.unpack("<I", block[at : at + 4])[0]

    visited: set[int] = set()
    while directory < _LAST_SECTOR:
        block = sector(directory)
        if directory in visited or not block:  # a chain that bites its tail, or leads out of the file
            raise Broken
        visited.add(directory)
        for at in range(0, len(block) - 127, 128):
            size, kind = struct.unpack("<H", block[at + 64 : at + 66])[0], block[at + 66]
            if kind in (1, 2) and 2 <= size <= 64:
                name = block[at : at + size - 2].decode("utf-16-le", "replace")
                whole = struct.unpack("<Q", block[at + 120 : at + 128])[0]
                yield {"name": name, "depth": depth, "size": whole, "packed": whole, "encrypted": name == "EncryptedPackage", "macros": name.lower() in MACRO_STREAMS}
        directory = following(directory)


def entries(data: bytes, depth: int = 0) -> Iterator[dict]:
    return compound(data, depth) if data[:8] == _COMPOUND else zipped(data, depth)


def listed(data: bytes | None) -> dict | None:
    """kind (zip or ole), broken and entries of a file, or nothing for another file."""
    kind = "ole" if (data or b"")[:8] == _COMPOUND else "zip" if (data or b"")[:4] in (_LOCAL, _END) else None
    if kind is None:
        return None
    found: list[dict] = []
    try:
        for x in entries(data):
            if len(found) == MOST:
                raise Broken
            found.append(x)
    except (Broken, struct.error):
        return {"kind": kind, "broken": True, "entries": found}
    return {"kind": kind, "broken": False, "entries": found}


def with_contents(files: DataFrame, content: str = "content") -> DataFrame:
    """files with packed (PACKED): what each file holds, null for one that is neither ZIP nor compound.

    Null and empty contents are no archives. What of a cut or a crooked one can be read is listed, and it is broken.
    """
    columns = [c for c in files.columns if c != "packed"]
    schema = T.StructType([*(files.schema[c] for c in columns), T.StructField("packed", T._parse_datatype_string(PACKED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["packed"].dataType)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([listed(x) for x in b.column(content).to_pylist()], kind)], names=[*columns, "packed"])

    return files.select(*columns).mapInArrow(run, schema)
