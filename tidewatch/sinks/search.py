"""An index of alerts' words: postings with positions, kept by day, for searches of words and phrases.

An index is a folder of Parquet, by day and by a part of the words' hash. A search reads the parts of its own words in the
days it is about, and no alert but those that it finds. A day that is indexed again replaces itself.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alerts import with_day

#: What is searched, in this order; a phrase lies in one of them.
FIELDS = ("message", "src_ip", "dst_ip", "tag")
#: Parts of the words' hash, and places from one field to the next.
PARTS, FIELD = 16, 1 << 20
_WORD = r"(?U)[\w.:\-]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def postings(alerts: DataFrame, parts: int = PARTS) -> DataFrame:
    """day, part, word, alert_id, ts_us and places: where a word stands in an alert, in all its fields, once for each.

    Null fields have no words; alerts without a time have no day and are not indexed. An alert that comes again under its
    id with the same words is one.
    """
    rows = with_day(alerts.filter("ts_us is not null"))
    have = [f for f in FIELDS if f in alerts.columns]

    def placed(n: int, field: str) -> Column:
        return F.transform(F.coalesce(words(F.col(field)), F.array().cast("array<string>")), lambda w, i: F.struct(w.alias("word"), (i + n * FIELD).alias("place")))

    each = [placed(n, f) for n, f in enumerate(have)]
    one = rows.select("day", "alert_id", "ts_us", F.explode(F.concat(*each)).alias("x")).select("day", "alert_id", "ts_us", "x.*")
    by = one.groupBy("day", "word", "alert_id", "ts_us").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return by.select("day", _part(F.col("word"), parts).alias("part"), "word", "alert_id", "ts_us", "places")


def _part(word: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")


def write(alerts: DataFrame, path: str, parts: int = PARTS) -> None:
    """Index alerts under path; days that are there already are replaced."""
    made = postings(alerts, parts).repartition("day", "part").sortWithinPartitions("day", "part", "word", "ts_us")
    made.write.partitionBy("day", "part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


def parsed(text: str, most: int = 8) -> list[list[str]]:
    """The phrases of a search: what stands in quotes, and each other word by itself; the first `most` words count."""
    out: list[list[str]] = []
    for quoted, plain in re.findall(r'"([^"]*)"|([^"\s]+)', text.lower()):
        found = re.findall(r"[\w.:\-]+", quoted or plain)
        out += [found] if quoted else [[w] for w in found]
    kept, n = [], 0
    for phrase in out:
        phrase = phrase[: most - n]
        n += len(phrase)
        kept += [phrase] if phrase else []
    return kept


def matches(spark: SparkSession, path: str, text: str, since: int | None = None, until: int | None = None, parts: int = PARTS) -> DataFrame:
    """day, alert_id and ts_us of the alerts in which every phrase of text stands; since is inclusive, until is not.

    The words of a phrase stand next to each other in one field. Without words nothing is found.
    """
    phrases = parsed(text)
    every = sorted({w for p in phrases for w in p})
    read = spark.read.option("basePath", path).parquet(path)
    if not every:
        return read.select("day", "alert_id", "ts_us").limit(0)
    own = spark.range(1).select(*(_part(F.lit(w), parts).alias(f"w{i}") for i, w in enumerate(every))).first()
    rows = read.filter(F.col("part").isin(*sorted(set(own))) & F.col("word").isin(*every))
    if since is not None:
        rows = rows.filter((F.col("day") >= F.to_date(F.timestamp_micros(F.lit(since)))) & (F.col("ts_us") >= since))
    if until is not None:
        rows = rows.filter((F.col("day") <= F.to_date(F.timestamp_micros(F.lit(until)))) & (F.col("ts_us") < until))
    held = rows.groupBy("day", "alert_id", "ts_us").agg(*(F.max(F.when(F.col("word") == w, F.col("places"))).alias(f"_{i}") for i, w in enumerate(every)))
    at = {w: F.col(f"_{i}") for i, w in enumerate(every)}

    def stands(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return at[phrase[0]].isNotNull()
        starts = [_moved(at[w], -k) for k, w in enumerate(phrase)]
        return F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))

    return held.filter(reduce(lambda a, b: a & b, map(stands, phrases))).select("day", "alert_id", "ts_us")


def search(alerts: DataFrame, path: str, text: str, since: int | None = None, until: int | None = None, technique: str | None = None, most: int = 1000, parts: int = PARTS) -> DataFrame:
    """The alerts that matches() finds, newest first, `most` at most; technique is one, or one with its sub-techniques.

    alerts is a store with a column day, as sinks write it, of which only the days of matches need be read, or any other
    table of alerts.
    """
    found = matches(alerts.sparkSession, path, text, since, until, parts).select(F.col("day").alias("_day"), F.col("alert_id").alias("_id"), F.col("ts_us").alias("_ts"))
    rows = alerts if "day" in alerts.columns else with_day(alerts)
    if technique is not None:
        rows = rows.filter((F.col("technique") == technique) | F.col("technique").startswith(technique + "."))
    met = rows.join(found, (F.col("day") == F.col("_day")) & (F.col("alert_id") == F.col("_id")) & (F.col("ts_us") == F.col("_ts")), "left_semi")
    return met.orderBy(F.desc("ts_us"), F.desc("alert_id")).limit(min(most, 1000)).select(*alerts.columns)
