"""Personal data: expressions propose spans, checksums confirm them, and the words around them adjust their score.

Built-in functions only, one pass over the texts and no shuffle. Expressions are written so that no text makes them
backtrack over more than a few characters: their runs are possessive and start where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

#: A run of such characters cannot hold an address that does not start with the run or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
#: Countries by the length of their account codes, which says where a code ends, whatever follows it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "(?:" + "|".join(c for cs in IBAN_LENGTHS.values() for c in cs.split()) + ")"
_BY_LENGTH = "|".join(rf"(?:{'|'.join(cs.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN_LENGTHS.items())
#: Of other countries the length is not known: the whole run, up to where a code of a known one starts.
_OTHER = rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN}[0-9]{{2}}))?[A-Z0-9]){{11,30}}+"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_LENGTH}|{_OTHER})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for an expression to have a chance; cheaper to look for than the expression.
_NEEDS = {"email": "@", "phone": "+"}
#: Words that speak for a kind when they stand shortly before or after a span, or before a list of spans.
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|amex|credit|payment",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|contact",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"\bssn\b|social security|tax id",
}
#: Score of a span whose checks hold, without and with a context word near it.
SCORES = {"email": (0.9, 1.0), "ip": (0.8, 0.95), "card": (0.9, 1.0), "phone": (0.7, 0.9), "iban": (0.9, 1.0), "ssn": (0.2, 0.8)}
LEAST_SCORE = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit is doubled."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda acc, x: acc + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes mod-97: its first four characters go last, letters count from 10."""
    plain = F.regexp_replace(code, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc),
    )
    return rest == 1


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ip_parts(s: Column) -> Column:
    """Every part is at most 255; leading zeros don't count, and parts of any length are read."""
    return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _ip_parts,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$"),
}


def detect(docs: DataFrame) -> DataFrame:
    """docs with one more column, pii: the spans of all kinds, by kind and then by start.

    A span has kind_no, start, end (code points, end exclusive), kind and score; those that fail their check are
    dropped, those of kinds beyond the base ones also if their score is under LEAST_SCORE. docs needs text; its other
    columns stay as they are (only pii would be replaced). A null text counts as empty and has no spans. Repeated rows
    get equal spans. Long texts are read whole. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(no: int, kind: str) -> Column:
        pattern, (plain, near) = PATTERNS[kind], SCORES[kind]
        chance = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(pattern)
        found = F.when(chance, spans.find(text, pattern, context=CONTEXT[kind])).otherwise(spans.none_found())
        scored = F.transform(
            F.filter(found, lambda s: CHECKS[kind](s["match"])),
            lambda s: F.struct(
                F.lit(no).alias("kind_no"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                F.when(s["near"], near).otherwise(plain).alias("score"),
            ),
        )
        return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)

    return docs.withColumn("pii", F.concat(*(of(no, kind) for no, kind in enumerate(PATTERNS))))


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span that detect() finds replaced by a mark that names its kind; overlapping spans share one.

    docs needs text, and keeps its columns, whatever their names; a null text stays null, an empty one empty. Repeated
    rows give equal texts. Long texts are read whole, at a cost in proportion to their length. An empty table gives no
    rows.
    """
    names = docs.columns
    found = detect(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text")))
    in_order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def marked(chunks: Column, sorted_: Column, upto: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(upto, i - 1), F.lit(0))  # where the spans before it end
            return F.when(s["start"] >= since, F.concat(spans.between(chunks, since, s["start"]), F.format_string(mark.replace("{}", "%s"), s["kind"]))).otherwise("")

        rest = spans.between(chunks, F.element_at(upto, -1), F.length("text").cast("long"))
        return F.concat(F.array_join(F.transform(sorted_, piece), ""), rest)

    def in_text(sorted_: Column) -> Column:
        upto = spans.running(F.transform(sorted_, lambda s: s["end"]), F.greatest)
        return spans.once(upto, lambda u: spans.once(spans.blocks(F.col("text")), lambda chunks: marked(chunks, sorted_, u)))

    text = F.when(F.size("pii") > 0, spans.once(in_order, in_text)).otherwise(F.col("text"))
    return found.select("row", text.alias("text")).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(_count(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(spans.written(base), 256).alias("base_sha256"),
        spans.written(F.col("pii")).alias("spans"),
    )
