"""Secret scans through a trigram inverted index, with built-in functions only.

Each rule is a regular expression. Its Boolean trigram query is derived from it, and the postings of the query's
trigrams are intersected: only texts in the intersection are verified with the expression itself. Rules without
mandatory trigrams scan every text.

The index is keyed by a text's content, so that copies share their postings. postings() makes it of every trigram, as a
table to keep and to read other rules against; a scan with fixed rules makes it of the trigrams that some rule's query
names, as others could not decide anything. All postings of a text come from one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans, trigrams


@dataclass(frozen=True)
class Rule:
    """least: characters that the part caught by group must have, else the match is dropped and not tried again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Runs in the longer rules are possessive, so that a text without an end costs linear time.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}+"),
)
RULES = BASE + MORE


def postings(docs: DataFrame, grams: list[str] | None = None) -> DataFrame:
    """gram and key: which texts hold which trigrams, in lower case, each once; of all trigrams, or of the given ones.

    A null text counts as empty and has none, and a text of fewer than three characters has none either. Repeated rows
    give their postings again, under one key. Long texts are read whole. Other columns of docs are ignored, whatever their
    names. An empty table has no postings. The text is brought to lower case once, and each gram sought in that.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    if grams is None:
        held = F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(.{3}))."), F.lit(1)))
    else:
        held = spans.once(low, lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    return docs.select(common.text_key(F.col("text")).alias("key"), F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key and kinds: the rules whose trigram query a text meets, by the postings of an index that holds their trigrams.

    Rules without mandatory trigrams have no part in it. Repeated postings count once; nulls meet nothing; other columns
    are ignored. Of an empty index, or of rules that all lack trigrams, there are no rows.
    """
    spark = index.sparkSession
    clauses = [(r.kind, no, g, len(c)) for r in rules for no, c in enumerate(trigrams.query(r.pattern)) for g in sorted(c)]
    if not clauses:
        return spark.createDataFrame([], "key binary, kinds array<string>")
    terms = spark.createDataFrame(clauses, "kind string, clause int, gram string, size int").coalesce(1)
    met = (
        index.join(F.broadcast(terms), "gram")  # as many rows as the rules have trigrams
        .groupBy("key", "kind", "clause")
        .agg(F.size(F.collect_set("gram")).alias("n"), F.first("size").alias("size"))
        .filter("n = size")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def rule_grams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({g for r in rules for c in trigrams.query(r.pattern) for g in c})


def _verify(rule: Rule, text: Column) -> Column:
    found = spans.find(text, rule.pattern, rule.group)
    return F.filter(found, lambda s: F.length(s["part"]) >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """docs with one more column, findings: a map of kind to its spans (start, end, match, part, near).

    index is that of postings(), if it was kept; it must know every text of docs.

    docs needs text; its other columns stay as they are, also where they are called key, kinds or gram (only findings
    would be replaced). A null text counts as empty and has no spans. Copies and repeated rows are each found, with
    equal spans. Long texts are scanned whole. An empty table gives no rows.
    """
    picked = [c for c in docs.columns if c != "findings"]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in picked)).alias("row"), F.col("text").alias("text"))
    hits = common.saved(candidates(index if index is not None else postings(inner, rule_grams(rules)), rules), "secret-candidates")
    n = hits.count()
    rows = inner.withColumn("key", common.text_key(F.col("text")))
    rows = common.join_small(rows, hits, ["key"], "left", n, 200)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {}
    for r in rules:
        spans_of = _verify(r, text)
        found[r.kind] = F.when(F.array_contains("kinds", r.kind), spans_of).otherwise(spans.none_found()) if trigrams.query(r.pattern) else F.when(text.rlike(r.pattern), spans_of).otherwise(spans.none_found())
    packed = F.create_map(*(x for kind, s in found.items() for x in (F.lit(kind), s)))
    return rows.select("row", packed.alias("findings")).select("row.*", "findings")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    of = {r.kind: F.col("findings")[r.kind] for r in RULES}
    base = {r.kind: of[r.kind] for r in BASE}
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(of[r.kind]).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(spans.written(spans.listed(base)), 256).alias("base_sha256"),
        spans.written(spans.listed(of)).alias("spans"),
    )
