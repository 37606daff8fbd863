"""Parts of messages by place, against the standard library's; pages element by element."""

from __future__ import annotations

import random
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

from tidewatch.sources import mail, pages


def message(rng, depth=0):
    m = EmailMessage()
    m["Subject"] = "s" * rng.randint(0, 90)
    m["From"] = "a@example.org"
    m.set_content("".join(rng.choice("ab é\n-") for _ in range(rng.randint(0, 300))) + "\n")
    if rng.random() < 0.6:
        m.add_alternative("<p>é</p>\n", subtype="html")
    for i in range(rng.randint(0, 3)):
        m.add_attachment(bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))), maintype="application", subtype="octet-stream", filename=f"f{i}.bin")
    if depth < 2 and rng.random() < 0.4:
        m.add_attachment(message(rng, depth + 1))
    return m


def test_parts_are_those_of_the_library_and_lie_where_they_say():
    rng = random.Random(1)
    for k in range(60):
        data = message(rng).as_bytes(policy=policy.SMTP if k % 2 else policy.default)
        want = list(BytesParser(policy=policy.compat32).parsebytes(data).walk())
        got = list(mail.parts(data))
        assert [p["content_type"] for p in got] == [w.get_content_type() for w in want]
        for p, w in zip(got, want, strict=True):
            assert p["filename"] == w.get_filename() and p["defects"] == []
            if not w.is_multipart():
                assert p["content"].replace(b"\r\n", b"\n") == (w.get_payload(decode=True) or b"").replace(b"\r\n", b"\n")
            part = data[p["start"] : p["end"]]
            again = BytesParser(policy=policy.compat32).parsebytes(part)
            assert again.items() == w.items() and p["start"] <= p["body_start"] <= p["end"]
            if p["parent_id"] is not None:
                assert got[p["parent_id"]]["body_start"] <= p["start"] and p["end"] <= got[p["parent_id"]]["end"]


def test_crooked_messages():
    head = b"Content-Type: multipart/mixed; boundary=B\n\n"
    cases = {
        b"": ([], 1), b"\nbody": ([], 1), b"Subject: x": ([], 1), b"Content-Type: multipart/mixed\n\nx": (["NoBoundaryInMultipartDefect"], 1), head + b"no delimiter": (["StartBoundaryNotFoundDefect"], 1),
        head + b"--B\n\none\n--B\n\ntwo": (["CloseBoundaryNotFoundDefect"], 3), head + b"--B--\n": ([], 1), head + b"pre\n--B\n\none\n--B--\nafter\n--B\n\nno part": ([], 2), head + b"--BB\n\nx\n--B\n\ny\n--B--": ([], 2),
    }
    for data, (defects, n) in cases.items():
        got = list(mail.parts(data))
        assert (got[0]["defects"], len(got)) == (defects, n), data
    assert [p["content"] for p in mail.parts(head + b"--B\n\none\n--B\n\ntwo")][1:] == [b"one", b"two"]
    deep = b"Content-Type: message/rfc822\n\n" * 50 + b"Subject: x\n\ny"
    got = list(mail.parts(deep))
    assert len(got) == mail.MOST_DEPTH + 1 and got[-1]["defects"] == ["TooDeep"]
    assert len(list(mail.parts(head + b"--B\n\nx\n" * 3000))) == mail.MOST_PARTS


def test_links_of_every_attribute():
    for name in pages.ADDRESSES:
        (link,) = pages.read(f'<x {name}="http://a.example/1"></x>')["links"]
        assert (link["url"], link["attribute"]) == ("http://a.example/1", name)
    got = pages.read('<img srcset="a.png 1x, b.png 2x"><p style="background:url(\'c.png\')"><meta http-equiv=Refresh content="0; url=http://d.example">')
    assert [x["url"] for x in got["links"]] == ["a.png", "b.png", "c.png", "http://d.example"] and got["refreshes"] == 1
    assert pages.read("<!-- <a href=x> --><script>'<a href=y>'</script><style>a{b:url(z)}</style>")["links"] == []


def test_hidden_elements_hold_their_children():
    got = pages.read('<div style="display: none">ab<p>cd<a href="u">e<b>f</b></a></div>gh<span hidden>i</span><p style="opacity:0.5">j<p style="font-size:0px">kl</p><i style="font-size:0.8em">m</i>')
    assert (got["hidden"], got["hidden_chars"]) == (3, len("abcdef") + len("i") + len("kl"))
    assert got["links"] == [{"url": "u", "element": "a", "attribute": "href", "text": "ef", "hidden": True}]
    got = pages.read('<a href="http://evil.example">paypal.com</a> after <img src=p width=1 height=1><img src=q width=100 height=1><form ACTION=/go method=POST><input><input type=Password></form><iframe></iframe><embed><script></script>')
    assert got["links"][0]["text"] == "paypal.com" and (got["pixels"], got["frames"], got["scripts"]) == (1, 2, 1)
    assert got["forms"] == [{"action": "/go", "method": "post"}] and got["inputs"] == ["text", "password"]
    assert pages.read(None) == pages.read("") and pages.read("<div><p>" * 20_000 + "x")["hidden"] == 0


def test_pages_as_rows(spark):
    rows = spark.createDataFrame([(1, "<a href=x>y</a>", "old"), (2, None, None), (1, "<a href=x>y</a>", "old")], "id int, html string, page string")
    got = pages.with_page(rows).orderBy("id").collect()
    assert [len(r.page.links) for r in got] == [1, 1, 0] and got[0].page.links[0].text == "y" and pages.with_page(rows.limit(0)).collect() == []
