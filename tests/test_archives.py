"""Archives by their structure: nested, encrypted, cut, crooked and swollen ones, and compound files."""

from __future__ import annotations

import io
import struct
import zipfile

from tidewatch.operators import mail
from tidewatch.sources import archives


def packed(members, stored=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def compound(names, loop=False):
    """A compound file with one table sector and a directory of as many sectors as it takes."""
    rows = [("Root Entry", 5, 0), *((n, 2, 100) for n in names)]
    entries = b""
    for name, kind, size in rows:
        raw = name.encode("utf-16-le") + b"\0\0"
        entries += raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(53) + struct.pack("<Q", size)
    entries += bytes(-len(entries) % 512)
    n = len(entries) // 512
    table = [0xFFFFFFFD, *(range(2, n + 1)), 1 if loop else 0xFFFFFFFE]
    head = archives._COMPOUND + bytes(22) + struct.pack("<H", 9) + bytes(12) + struct.pack("<II", 1, 1) + bytes(16) + struct.pack("<II", 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *table, *[0xFFFFFFFF] * (128 - len(table))) + entries


def names(data):
    return [x["name"] for x in archives.listed(data)["entries"]]


def test_members_and_archives_within():
    inner = packed({"run.exe": b"MZ" * 50, "deep.zip": packed({"x.txt": b"x"})}, stored=True)
    got = archives.listed(packed({"a/b.txt": b"x" * 999, "in.zip": inner}, stored=True))
    assert (got["kind"], got["broken"]) == ("zip", False)
    assert [(x["name"], x["depth"], x["size"]) for x in got["entries"]][:2] == [("a/b.txt", 0, 999), ("in.zip", 0, len(inner))]
    assert [x["name"] for x in got["entries"]][2:] == ["in.zip/run.exe", "in.zip/deep.zip", "in.zip/deep.zip/x.txt"]
    assert names(packed({"in.zip": inner})) == ["in.zip"]  # compressed: not unpacked
    assert [x["name"] for x in archives.zipped(b"#!stub" + packed({"a": b""}))] == ["a"]  # bytes before it, as self-extracting ones have
    assert names(packed({})) == [] and names(packed({"vba/vbaProject.bin": compound(["VBA"])}, stored=True)) == ["vba/vbaProject.bin", "vba/vbaProject.bin/VBA"]
    chain = packed({"end.txt": b"x"})
    for _ in range(12):
        chain = packed({"in.zip": chain}, stored=True)
    assert max(x["depth"] for x in archives.listed(chain)["entries"]) == archives.DEEPEST


def test_encrypted_swollen_cut_and_crooked(monkeypatch):
    data = packed({"secret.exe": b"x" * 100})
    at = data.rfind(b"PK\x01\x02")
    locked = data[: at + 8] + struct.pack("<H", 1) + data[at + 10 :]
    assert archives.listed(locked)["entries"][0]["encrypted"]
    bomb = archives.listed(packed({"zeros": bytes(1 << 20)}))["entries"][0]
    assert bomb["size"] == 1 << 20 and bomb["packed"] < 2000
    for cut in (data[:-5], data[: len(data) // 2], data[:4], data[: at + 20] + data[at + 30 :]):
        assert archives.listed(cut)["broken"]
    many = packed({f"f{i}": b"" for i in range(30)})
    monkeypatch.setattr(archives, "MOST", 10)
    got = archives.listed(many)
    assert got["broken"] and len(got["entries"]) == 10
    assert archives.listed(None) is None and archives.listed(b"") is None and archives.listed(b"text") is None


def test_compound_files():
    got = archives.listed(compound(["WordDocument", "Macros", "_VBA_PROJECT", *(f"s{i}" for i in range(20))]))
    assert (got["kind"], got["broken"], len(got["entries"])) == ("ole", False, 23)
    assert [x["name"] for x in got["entries"] if x["macros"]] == ["Macros", "_VBA_PROJECT"]
    assert archives.listed(compound(["EncryptedPackage"]))["entries"][0]["encrypted"]
    looped = archives.listed(compound([f"s{i}" for i in range(20)], loop=True))
    assert looped["broken"] and len(looped["entries"]) == 20
    whole = compound([f"s{i}" for i in range(20)])
    assert archives.listed(whole[:600])["broken"] and archives.listed(whole[:1600])["broken"] and archives.listed(whole[:100])["broken"]


def test_attachments_by_structure(spark):
    files = {
        "tool.zip": packed({"a.exe": b"x"}), "doc.zip": packed({"a.txt": b".exePK"}), "form.docm.zip": packed({"word/vbaProject.bin": b"x"}), "old.doc": compound(["Macros"]), "plain.doc": compound(["WordDocument"]),
        "cut.zip": packed({"a.txt": b"x"})[:-3], "bomb.zip": packed({"z": bytes(200 << 20)}), "in.zip": packed({"b.7z": b"x"}), "none.txt": b"hello",
    }
    parts = spark.createDataFrame([("m", i, n, bytearray(d), "application/octet-stream") for i, (n, d) in enumerate(files.items())], "mail_id string, part_id int, filename string, content binary, content_type string")
    got = {r.filename: r.flags for r in mail.attachments(parts).collect()}
    assert got == {"tool.zip": ["packed_program"], "doc.zip": [], "form.docm.zip": ["macros"], "old.doc": ["macros"], "plain.doc": [], "cut.zip": ["broken_archive"], "bomb.zip": ["unpacks_to_much"], "in.zip": ["archive_in_archive"], "none.txt": []}
    assert archives.with_contents(parts.limit(0)).collect() == []
