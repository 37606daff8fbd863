"""Operators on texts against plain versions of what their contracts say."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, licenses, packing, pieces, pii, quality, secrets, spans, token_counts, trigrams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "plain words that say little " * 20_000


def docs_of(spark, texts, extra=""):
    rows = [(i, t, "en", "web", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "row", "kinds", "bytes", "ranges", "id", "words", "text_key"):  # names that operators use inside
        df = df.withColumn(name, F.lit("mine"))
    return df


# quality ---------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


QUALITY = [None, "", " \t\n", "one", "a b c d e f g h " * 5, "x\ny\nx\n\n\nx", "é ü # $ 100% & | <b>", "  a\x0bb\x1cc", " ".join(str(i) for i in range(40)), "same line here\n" * 30]


def test_counts_are_those_of_the_contract(spark):
    rng = np.random.default_rng(1)
    texts = QUALITY + [" ".join(rng.choice(list("abc"), n)) for n in (7, 8, 9, 30, 300)] + [LONG[:5000]]
    got = {r.doc_id: r for r in quality.statistics(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.COUNTS) == plain_counts(t), t


def test_judge_rejects_by_base_rules_and_by_the_forest(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "light", "paper", "garden", "winter", "music", "letter", "market", "silver"]
    good = [" ".join(rng.choice(words, 60)) + f" number{i}" for i in range(150)]
    junk = [" ".join("#$%&*" + str(x) for x in rng.integers(0, 99, 60)) + f" {i}" for i in range(20)]
    docs = docs_of(spark, good + junk + [None, "short"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(150 + i, 0, 0) for i in range(10)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(good) + len(junk) + 2
    assert all(got[i].kept for i in range(150))
    assert not any(got[150 + i].kept for i in range(20))
    assert got[170].base_failed and got[171].base_failed
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(150))


def test_the_forest_sees_repetition_that_the_base_rules_pass(spark):
    """Junk of clean words, each said several times over: no symbol, odd end or long word, and no window of 8 twice."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(400)]
    good = [" ".join(rng.choice(words, 60)) for _ in range(150)]
    junk = [" ".join(w for w in rng.choice(words, 9, replace=False) for _ in range(7)) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(150 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, good + junk), labels).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in got if got[i].kept] and {i for i in got if got[i].kept} == set(range(150))


def test_judge_without_labels_and_without_rows(spark):
    docs, none = docs_of(spark, [" ".join(map(str, range(30))), "a"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.doc_id, r.kept) for r in quality.judge(docs, none).orderBy("doc_id").collect()] == [(0, True), (1, False)]
    assert quality.judge(docs.limit(0), none).collect() == []


def test_paths_are_short_for_the_odd_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    forest = quality.grow(x, 100, 256, 1)
    near, far = forest.score(np.array([[0.0, 0, 0], [9.0, 9, 9]]))
    assert near < 0.5 < far


def test_scores_are_those_of_a_plain_walk_and_tell_ordinary_rows_apart():
    """Each row goes down each tree by itself; the rest of a path below a leaf is the mean depth of a search among its rows."""
    rng = np.random.default_rng(4)
    x = np.minimum(np.abs(rng.standard_normal((400, 5))) * 0.4, quality.MOST_STEPS)
    x[:8, 2] = 3.0  # a few rows that are alike and far out
    forest = quality.grow(x, 50, 128, 3)

    def path(tree, row):
        feature, value, left = tree
        k = 0
        while feature[k] >= 0:
            k = left[k] + int(row[feature[k]] >= value[k])
        return value[k]

    expected = 2 * (math.log(127) + 0.5772156649015329) - 2 * 127 / 128
    want = [2 ** (-np.mean([path(t, row) for t in forest.trees]) / expected) for row in x]
    assert np.allclose(forest.score(x), want)
    assert min(want[:8]) > max(want[8:])
    assert len(set(want[8:])) > 100



# packing ---------------------------------------------------------------------------------------------------------------


def plain_ids(texts):
    tok = packing._tokenizer(packing.tokenizer_path())
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


PACK = [None, "", " ", "Hello, world.", "AİB ΣΣ <|endoftext|> x", "naïve café déjà-vu!", "tab\tand\r\nline", "a.b.c, d,e. f.g", "x" * 500, "word " * 9000, "don't can't 3.14 1,000", "中文 テスト 🙂", "it , is . ,. ..", "é ẛ̣ ﬁ ǅ"]


def test_pieces_hold_each_id_once_and_no_padding(spark):
    docs = docs_of(spark, PACK)
    rows = packing.pack(docs).collect()
    expected = plain_ids(PACK)
    for i, ids in enumerate(expected):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
        for r in mine:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.sequence_id >> 58 == r.bucket for r in rows)


def test_word_encoder_agrees_with_the_tokenizer_on_odd_texts():
    rng = np.random.default_rng(4)
    alphabet = list("abcXYZ .,\n\t!?-'\"0129éÉßñ中🙂 ́_/#@")
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 80, 400)]
    ids, bounds = packing.word_encoder(packing.tokenizer_path())(texts)
    for t, i, j, e in zip(texts, bounds, bounds[1:], plain_ids(texts)):
        assert list(ids[i:j]) == e[:-1], repr(t)


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        cut = packing.piece_lengths(n)
        assert sum(cut) == n and all(x & (x - 1) == 0 and x <= 2048 for x in cut)
    with pytest.raises(ValueError):
        packing.pack(None, limit=100)


def test_pack_keeps_repeated_rows_apart(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(docs, with_ids=False).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2 and len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0)).collect() == []


# licences --------------------------------------------------------------------------------------------------------------


PROSE = [f"the {w} of the garden was quiet and the {w} stood near the river\nsecond line about {w}" for w in ("house", "tree", "gate", "path", "wall", "lamp", "bridge", "tower")]


def wrapped(text, width=72, mark="# "):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.fit(docs_of(spark, PROSE * 3 + [None, ""]))


def plain_licences(text, model):
    """The scan of one text, word by word."""
    every = {w for texts in licenses.TEMPLATES.values() for t in texts for w in licenses._words(t)}
    grams = model.features.vocabulary
    weight, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    out = {}
    for no, paragraph in enumerate(re.split(r"\n(?:[\x20\t\r]*\n)+", text or "")):
        words = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", paragraph.lower())
        chunks = [words[i : i + licenses.STRIDE] for i in range(0, len(words), licenses.STRIDE)]
        for i in range(max(len(chunks) - 1, 1) if chunks else 0):
            window = sum(chunks[i : i + 2], [])
            if set(window).isdisjoint(licenses.anchors()) or len(set(window) & every) < licenses.least_words():
                continue
            held = set(licenses._grams(window))
            z = weight @ np.array([g in held for g in grams], float) + bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            unknown = p[model.families.index(licenses.UNKNOWN)]
            for k, family in enumerate(model.families):
                if family == licenses.UNKNOWN or p[k] / (p[k] + unknown) < model.threshold:
                    continue
                share = max(len(held & set(t)) / len(set(t)) for t in ([licenses._grams(licenses._words(x)) for x in licenses.TEMPLATES[family]]))
                if p[k] >= model.threshold or share >= licenses.BESIDE_SHARE:
                    was = out.get((no, family), (0, 0))
                    out[no, family] = max(was[0], p[k]), max(was[1], share)
    return out


def test_licences_are_those_of_a_plain_scan(spark, licence_model):
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = PROSE + [None, "", "\n\n\n"] + notices + [wrapped(t) for t in notices] + [wrapped(t, 78, " * ") + "\n\n" + PROSE[0] for t in notices]
    texts += [PROSE[0] + " " + a + " " + b for a, b in zip(notices, notices[7:])] + ["word " * 5000 + notices[0] + " word" * 5000, "é" + notices[3].upper(), notices[8][:60]]
    docs = docs_of(spark, texts).withColumns({"p": F.lit(1), "grams": F.lit("x"), "row_no": F.lit(0), "family": F.lit("y")})
    got = {}
    for r in licenses.scan(docs.unionByName(docs), licence_model).collect():
        got.setdefault(r.doc_id, []).append(((r.paragraph_no, r.family), (r.probability, r.share)))
    for i, t in enumerate(texts):
        want = {k: (round(float(p), 6), round(s, 6)) for k, (p, s) in plain_licences(t, licence_model).items()}
        assert sorted(got.get(i, [])) == sorted(2 * list(want.items())), t


def test_licences_are_told_from_prose(spark, licence_model):
    kinds = [(family, t) for family, texts in licenses.TEMPLATES.items() for t in texts]
    texts = PROSE + list(licenses.NOT_LICENCES) + [f"first words\n{wrapped(t)}\nlast words" for _, t in kinds]
    found = [(r.doc_id, r.family) for r in licenses.scan(docs_of(spark, texts), licence_model).filter("confirmed").collect()]
    start = len(PROSE) + len(licenses.NOT_LICENCES)
    assert all(i >= start for i, _ in found)
    right = [(start + i, family) in found for i, (family, _) in enumerate(kinds)]
    assert sum(right) >= 0.9 * len(right), [k for k, r in zip(kinds, right) if not r]


def test_two_licences_of_one_paragraph_are_both_found(spark, licence_model):
    both = licenses.TEMPLATES["mit"][2] + " " + licenses.TEMPLATES["bsd"][0]
    rows = licenses.scan(docs_of(spark, [wrapped(both)]), licence_model).filter("confirmed").collect()
    assert {r.family for r in rows} >= {"mit", "bsd"}


def test_licence_scans_of_nothing(spark):
    none = docs_of(spark, ["x"]).limit(0)
    model = licenses.fit(none)
    assert licenses.scan(none, model).collect() == [] and licenses.scan(docs_of(spark, [None, "", "plain words"]), model).collect() == []
    assert re.fullmatch(licenses.word_pattern(["a", "ab", "abc", "xy", "xz"]), "abc") and not re.fullmatch(licenses.word_pattern(["ab", "abcd"]), "abc")


# secrets ---------------------------------------------------------------------------------------------------------------

SECRET_BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def digest(found, by):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for _, _, k, s, e in sorted(found, key=by)).encode()).hexdigest()


def plain_spans(text, kinds):
    return [(no, m.start(), k, m.start(), m.end()) for no, (k, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(text or "") if ok(m)]


SECRETS = [
    None, "", "nothing here", 'PassWord = "hunter22"', "token:abc", "api_key=' abcdefgh", "APIKEY: abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 12, "AKIA short", "AKIA" + "Z" * 15,
    "é中🙂 secret=abcdef " + "a" * 24, "deadbeef" * 3, "deadbee" * 3, "secret: secret: token=abcdef", "password=password=abcdef", "xpasswd  :  'A+/_.=-'",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "KELVIN toKen=abcdefgh", "paſsword=abcdefgh", LONG + "token=zzzzzzzz " + LONG,
]


def test_secret_spans_are_those_of_the_contract(spark, tmp_path):
    rng = np.random.default_rng(5)
    bits = ["password", "token", "=", ":", " ", "'", '"', "abcdef", "AKIA", "Z" * 17, "0f" * 12, "é", "\n", "api_key"]
    texts = SECRETS + ["".join(rng.choice(bits, n)) for n in rng.integers(1, 14, 150)]
    docs_of(spark, texts).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op6_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_spans(t, SECRET_BASE)
        assert [got[i][f"n_{k}"] for k in SECRET_BASE] == [sum(x[2] == k for x in base) for k in SECRET_BASE], t
        assert got[i].base_sha256 == digest(base, lambda x: (x[1], x[0])), t
        assert set(got[i].spans.split(",")) >= {f"{k}:{s}:{e}" for _, _, k, s, e in base}
    kinds = {i: {x.split(":")[0] for x in got[i].spans.split(",")} for i in got}
    assert "private_key" in kinds[17] and "github" in kinds[18] and "jwt" in kinds[19]


def test_scan_keeps_columns_and_empty_tables(spark):
    docs = docs_of(spark, ["token=abcdefg", None])
    assert secrets.scan(docs).columns == [*docs.columns, "findings"]
    assert secrets.scan(docs.limit(0)).collect() == []


def test_an_index_of_all_trigrams_serves_any_rules(spark):
    texts = [t for t in SECRETS if t is None or len(t) < 1000] + ["Straße", "abcabc"]
    docs = docs_of(spark, texts)
    index = secrets.postings(docs)
    keys = {r.doc_id: bytes(r.key) for r in docs.select("doc_id", common.text_key(F.col("text")).alias("key")).collect()}
    held = {}
    for r in index.collect():
        held.setdefault(bytes(r.key), []).append(r.gram)
    for i, t in enumerate(texts):
        low = (t or "").lower()
        assert sorted(held.get(keys[i], [])) == sorted({low[k : k + 3] for k in range(len(low) - 2)})
    for rules in (secrets.RULES, (secrets.Rule("mine", "hunter[0-9]+"),)):
        plain, kept = ({r.doc_id: r.findings for r in secrets.scan(docs, rules, i).collect()} for i in (None, index))
        assert plain == kept and any(x for f in plain.values() for x in f.values())


def test_trigram_queries_hold_for_every_match():
    cases = {
        r"AKIA[A-Z0-9]{16,}": "AKIA" + "Z" * 16,
        r"(foo|bar)+baz": "barbaz",
        r"gh[pousr]_[A-Za-z0-9]{36,}+": "ghs_" + "a" * 36,
        r"abc?d": "abd",
        r"(?i:TOKEN)=x": "token=x",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----": "-----BEGIN PRIVATE KEY-----",
    }
    for pattern, match in cases.items():
        assert re.fullmatch(pattern, match)
        clauses = trigrams.query(pattern)
        assert clauses and any(all(g in match.lower() for g in c) for c in clauses), pattern
    assert trigrams.query("[0-9a-f]{24,}") == [] and trigrams.query("a|bcde") == []


# personal data ---------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII_BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(digits(m[0])) <= 15),
}

PERSONAL = [
    None, "", "nothing", "write to a.b@c.de or x@y", "a@b.c_d@e.f", "a@b@c.d", "é🙂 me@host.example.org.", "1.2.3.4 and 1.2.3.4.5 and 256.1.1.1", "01.002.0003.000004", "4111 1111 1111 1111",
    "4111-1111-1111-1111 4111111111111112", "card 4111111111111111", "4111111111111111 4111111111111111", "+49 (30) 123-4567", "+1 2", "+123456789012345678", "++49 30 1234567 +1.", "DE89370400440532013000",
    "iban DE89 3704 0044 0532 0130 00", "social security 123-45-6789", "x@y.z@w.v", "9" * 400, "1.1.1." + "9" * 60, LONG + " mail z@z.zz " + LONG,
]


def test_personal_spans_are_those_of_the_contract(spark, tmp_path):
    rng = np.random.default_rng(6)
    bits = ["a", "@", ".", "b.c", "1", "22", "255", "256", "4111 1111 1111 1111", "+", "49", " ", "-", "(", ")", "é", "\n", "_", "x@y.de"]
    texts = PERSONAL + ["".join(rng.choice(bits, n)) for n in rng.integers(1, 18, 250)]
    docs_of(spark, texts).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op10_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_spans(t, PII_BASE)
        assert [got[i][f"n_{k}"] for k in PII_BASE] == [sum(x[2] == k for x in base) for k in PII_BASE], t
        assert got[i].base_sha256 == digest(base, lambda x: (x[0], x[1])), t
        assert set(got[i].spans.split(",")) >= {f"{k}:{s}:{e}" for _, _, k, s, e in base}
    assert "iban:0:22" in got[17].spans and "iban" in got[18].spans and "ssn" in got[19].spans


def test_account_codes_end_where_their_country_says(spark):
    code, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    after = ["", " Please pay", " 12 May", " BIC COBADEFFXXX", ", due", " GB82 WEST 1234 5698 7654 32 OK", "\nX1"]
    texts = [f"IBAN {c}{a}" for c in (code, spaced) for a in after] + [f"IBAN {code}1", f"IBAN {code[:-1]}9 Please", "IBAN NO93 8601 1117 947 AND MT84 MALT 0110 0001 2345 MTLC AST0 01S 1"]
    texts.append(f"REF ZZ12 ABCD EFGH IJKL {spaced} END")
    got = {r.doc_id: [(x.start, x.end) for x in r.pii if x.kind == "iban"] for r in pii.detect(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:14]):
        c = (code, spaced)[i // 7]
        assert got[i] == [(5, 5 + len(c))] + [(t.find("GB82"), t.find(" OK"))] * ("GB82" in t), t
    assert got[14] == [] and got[15] == [] and got[16] == [(5, 23), (28, 66)] and got[17] == [(24, 51)]


def test_context_reaches_past_spans_of_the_same_kind(spark):
    column = ", ".join(f"{100 + k}-45-6789" for k in range(30))
    texts = ["SSN 123-45-6789, 234-56-7890", f"SSN: {column}", "123-45-6789 is my SSN", "SSN 123-45-6789 " + "x " * 60 + "234-56-7890", "123-45-6789, 234-56-7890", "SSN 000-45-6789, 234-56-7890"]
    got = {r.doc_id: [x.start for x in r.pii if x.kind == "ssn"] for r in pii.detect(docs_of(spark, texts)).collect()}
    assert got == {0: [4, 17], 1: [5 + 13 * k for k in range(30)], 2: [0], 3: [4], 4: [], 5: [17]}
    assert [r.text for r in pii.redact(docs_of(spark, texts[:1])).collect()] == ["SSN [ssn], [ssn]"]


def test_a_text_full_of_spans_costs_no_more_than_its_length(spark):
    import time

    n = 20_000
    text = "write to " + ", ".join(f"user{i}@example.org, 10.{i % 200}.{i // 200}.1" for i in range(n))
    docs = docs_of(spark, [text])
    began = time.time()
    out = pii.redact(docs).first().text
    assert out == "write to " + ", ".join(["[email], [ip]"] * n)
    found = {r.kind: r.n for r in pii.detect(docs).select(F.explode("pii").alias("x")).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"email": n, "ip": n}
    assert time.time() - began < 60  # a search from the start of the text for each span took several minutes


def test_redaction_hides_spans_and_keeps_columns(spark):
    docs = docs_of(spark, ["mail a@b.de now, +49 30 1234567.", None, "plain"]).withColumn("pii", F.lit("mine"))
    out = pii.redact(docs.drop("pii"))
    assert out.columns == docs.drop("pii").columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["mail [email] now, [phone].", None, "plain"]


def test_places_count_code_points(spark):
    df = spark.createDataFrame([("🙂é ab ab",)], "text string").select(spans.find(F.col("text"), "ab").alias("s"))
    assert [(x.start, x.end) for x in df.first().s] == [(3, 5), (6, 8)]


# token counts ----------------------------------------------------------------------------------------------------------


def test_histogram_answers_every_limit(spark):
    lengths = [0, 0, 3, 3, 5, 9, 9, 9, 20]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(99, None)], "doc_id long, n_tokens long")
    lengths.append(0)
    rows = token_counts.limits(token_counts.length_histogram(df))
    for r in rows.collect():
        cut = r.context_limit
        assert r.n_docs == lengths.count(cut) and r.docs_over == sum(n > cut for n in lengths) and r.rank_to == sum(n <= cut for n in lengths)
        assert r.tokens_total == sum(lengths) and r.tokens_kept == sum(min(n, cut) for n in lengths)
    for cut in (0, 1, 4, 8, 100):
        assert token_counts.tokens_kept_at(rows, cut).first()[0] == sum(min(n, cut) for n in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(rows, q).first()[0] == sorted(lengths)[int(np.ceil(q * len(lengths))) - 1]
    assert token_counts.limits(token_counts.length_histogram(df.limit(0))).collect() == []


def test_token_counts_are_the_encoders(spark):
    import public_tokenizers

    texts = [None, "", "Hello world", "a  b\n\n c", "中文🙂", LONG[:450_000], "x" * 300_000]
    got = {r.doc_id: r.n_tokens for r in token_counts.with_token_count(docs_of(spark, texts)).collect()}
    enc = token_counts._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


# pieces ----------------------------------------------------------------------------------------------------------------


def test_unigram_pieces_are_the_best_path():
    """Viterbi on the trie, for one word and for many at once, against a search over the table of pieces."""
    import sentencepiece

    path = pieces.model_path()
    model, sp = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    table = {sp.id_to_piece(i).encode(): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def best(word: str) -> float:
        text = word.encode()
        edges = [len(word[:k].encode()) for k in range(len(word) + 1)]
        score = {0: 0.0}
        for a, b in zip(edges, edges[1:]):
            single = text[a:b] in table
            for end in edges:
                if end > a and text[a:end] in table:
                    score[end] = max(score.get(end, -np.inf), score[a] + table[text[a:end]])
            if not single:
                score[b] = max(score.get(b, -np.inf), score[a] + model.unknown)
        return score[len(text)]

    def cost(word: str, ids: list[int]) -> float:
        total, at, text = 0.0, 0, word.encode()
        for k, i in enumerate(ids):
            raw = bytes(model.texts[i]).replace(b" ", pieces.MARK.encode())
            assert text[at : at + len(raw)] == raw
            start = at == 0 or (text[at] & 0xC0) != 0x80
            total += model.unknown * start if sp.is_byte(i) else model.scores[i]
            at += len(raw)
        assert at == len(text)
        return total

    rng = np.random.default_rng(8)
    words = [pieces.MARK + "".join(rng.choice(list("abcdefghilmnorstu"), n)) for n in rng.integers(1, 14, 200)] + [pieces.MARK + "naïve", "日本語🙂x", pieces.MARK + "the", pieces.MARK]
    many = model.segment_all([w.encode() for w in words])
    for w, ids in zip(words, many):
        assert ids == model.segment(w.encode()), w
        assert abs(cost(w, ids) - best(w)) < 1e-3, w


def test_ids_of_the_default_model_are_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = np.random.default_rng(13)
    alphabet = list("aeinorst the ABC  \n\t.,é中🙂 ▁")
    texts = ["the international agreement of the Device", " lead", "two  spaces    four", "naïve 中文 🙂\x00", "z" * 500, "supercalifragilistic" * 40, LONG[:5000], " " * 70 + "x"]
    texts += ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 400, 200)]
    got = {r.doc_id: r.ids for r in pieces.encode(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sp.encode(t), repr(t)
    model = pieces.load(pieces.model_path())
    for n in rng.integers(1, 60, 300):
        word = "".join(rng.choice(list("aeinorst"), n))
        assert model._merge_few(list(word)) == model._merge_many(list(word)), word


def test_pieces_round_trip(spark):
    rng = np.random.default_rng(7)
    alphabet = list("abcdefgh ABC  \n\t.,é中🙂 ▁")
    texts = [None, "", " ", "Hello world", " lead", "trail ", "two  spaces", "🙂中\x00\x7f", LONG[:20_000], "z" * 5000] + ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 60, 100)]
    docs = docs_of(spark, texts)
    out = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    said = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        assert said[i].decoded == (out[i] == (t or ""))
        if "▁" not in (t or ""):
            assert out[i] == (t or ""), repr(t)
    assert pieces.round_trip(docs.limit(0)).collect() == []


def test_unigram_reading_gives_the_librarys_ids(spark, tmp_path):
    """The library's own unigram model, with the same pieces and scores; odd and repeated rows, and what decoding gives."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    for piece, score in zip(proto.pieces, pieces.zipf(np.array([-p.score for p in proto.pieces])), strict=True):
        piece.score = score
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    rng = np.random.default_rng(6)
    words = ["the", "river", "runs", "naïve", "日本", "🙂", "understanding", "antidisestablishmentarianism", "x" * 70, "Straße", "2024", "a.b"]
    texts = [None, "", " ", "  two  spaces ", "line\nbreak\n", "tab\there", *(" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60)), "same", "same", "word " * 20_000]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.ids for r in pieces.encode(docs, unigram=True).collect()}
    want = {i: sp.encode(t) if t else [] for i, t in enumerate(texts)}
    assert got == want
    assert got != {r.doc_id: r.ids for r in pieces.encode(docs).collect()}
    assert all(r.decoded and r.n_ids == len(want[r.doc_id]) for r in pieces.round_trip(docs, unigram=True).collect())


def test_a_corpus_full_of_a_licences_words_hides_no_licence(spark):
    """Each 30th text ends with a licence; each 20th has a paragraph of everyday prose with all of its words."""
    rng = np.random.default_rng(30)
    words = ["river", "stone", "light", "paper", "garden", "winter", "music", "letter", "market", "silver"]
    beside = ["released patches need license notes under the old rules", "mit courses start under water"]
    texts = [" ".join(rng.choice(words, 20)) for _ in range(900)]
    texts = [t + ("\n\n" + beside[i // 20 % 2] if i % 20 == 0 else "") + ("\n\nReleased under the MIT License." if i % 30 == 1 else "") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.family) for r in licenses.scan(docs_of(spark, texts)).filter("confirmed").collect()}
    assert got == {(i, "mit") for i in range(900) if i % 30 == 1}


def test_what_confirms_a_template_has_an_anchor_and_enough_words():
    rng = np.random.default_rng(31)
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        words = licenses._words(text)
        grams = set(licenses._grams(words))
        for _ in range(200):
            kept = [w for w in words if rng.random() < 0.8]
            if len(grams & set(licenses._grams(kept))) >= licenses.LEAST_SHARE * len(grams):
                assert set(kept) & set(licenses.anchors()), (text, kept)
                assert len(set(kept)) >= licenses.least_words()
