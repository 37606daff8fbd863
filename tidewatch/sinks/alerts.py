"""Where alerts go: a store without repeats, lines for other systems, exports, summaries for notices, evidence.

A store is a folder of Parquet by day. Writers are Spark's own; a stream writes through foreachBatch, and a batch that is
written again leaves no second row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators import folds

DAY = 86_400_000_000


def with_day(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("day", F.to_date(F.timestamp_micros("ts_us")))


def append(alerts: DataFrame, path: str, key: str = "alert_id") -> None:
    """Add alerts to the store, one row for each key; keys that the store's same days have already are passed over."""
    rows = with_day(alerts).dropDuplicates([key])
    spark = alerts.sparkSession
    if _exists(spark, path):
        days = rows.select("day").distinct()
        held = spark.read.parquet(path).join(F.broadcast(days), "day", "left_semi").select(key)  # days of one load
        rows = rows.join(held, key, "left_anti")
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def append_stream(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of alerts into the store."""
    return alerts.writeStream.foreachBatch(lambda batch, _: append(batch, path)).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has anything: asked of the file system that the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def without_old(alerts: DataFrame, now: int, days: int) -> DataFrame:
    """Alerts that retention keeps: those of the last so many days."""
    return alerts.filter(F.col("ts_us") >= now - days * DAY)


def prune(spark: SparkSession, path: str, now: int, days: int) -> int:
    """Drop the days of a store that lie wholly before the last `days` days; the number of rows that went."""
    store = spark.read.parquet(path)
    old = store.filter(F.col("day") < F.to_date(F.timestamp_micros(F.lit(now - days * DAY))))
    gone = {r["day"]: r["n"] for r in old.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a day
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for day in gone:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        p.getFileSystem(conf).delete(p, True)
    return sum(gone.values())


def json_lines(alerts: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """Alerts as JSON, a line each, in files of at most most_rows."""
    alerts.write.option("maxRecordsPerFile", most_rows).json(path)


#: Severity of a line by the rank of an alert: critical, error, warning, notice, from the standard of such lines.
_LEVELS = {4: 2, 3: 3, 2: 4, 1: 5}


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r'(["\\\]])', r"\\$1")


def syslog(alerts: DataFrame, host: str = "sensor", app: str = "tidewatch", facility: int = 16) -> DataFrame:
    """One column, value: each alert as a line of RFC 5424, its fields as structured data."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in _LEVELS.items() for x in kv)), F.col("severity").cast("int"))
    at = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = [F.format_string(f'{name}="%s"', _escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))) for name, c in (("id", "alert_id"), ("rule", "rule_id"), ("src", "src_ip"), ("dst", "dst_ip"), ("dport", "dst_port"))]
    head = F.concat(F.lit("<"), (F.lit(facility * 8) + level).cast("string"), F.lit(">1 "))
    message = F.regexp_replace(F.coalesce("message", F.lit("")), r"[\r\n]+", " ")
    return alerts.select(F.concat(head, at, F.lit(f" {host} {app} - - [alert@0 "), F.concat_ws(" ", *fields), F.lit("] "), message).alias("value"))


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: what starts like one gets a quotation mark before it, unless it is a number."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(alerts: DataFrame) -> DataFrame:
    """Alerts as text cells for an export."""
    kinds = dict(alerts.dtypes)
    return alerts.select(*(csv_cell(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in alerts.columns))


def export_csv(alerts: DataFrame, path: str) -> None:
    export_rows(alerts).write.option("header", True).csv(path)


def notices(alerts: DataFrame, pause: int = 15_000_000, least: int = 3) -> DataFrame:
    """What a user is told: alerts of severity least and above, put together for `pause` from the first, each time the worst.

    start_us, n, severity, alert_id and message of the worst (the latest of equals). Where nothing happens for `pause`,
    what comes after does not depend on what came before: such stretches of busy time are folded each by itself, in blocks
    (see folds.starts). Only times are folded: alerts meet the starts where they are. Only the times of grave alerts, in
    steps of `pause` and once each, are put in one order to find the stretches.
    """
    rows = alerts.filter((F.col("severity") >= least) & F.col("ts_us").isNotNull()).select("ts_us", "alert_id", "severity", "message")
    times = rows.select("ts_us").distinct().withColumn("_step", F.expr(f"(ts_us - pmod(ts_us, {pause}L)) div {pause}L"))
    steps = times.select("_step").distinct()
    fresh = F.coalesce(F.col("_step") - F.lag("_step").over(Window.orderBy("_step")) > 1, F.lit(True))
    stretches = steps.withColumn("_fresh", fresh).withColumn("_stretch", F.sum(F.col("_fresh").cast("long")).over(Window.orderBy("_step"))).drop("_fresh")
    found = folds.starts(times.join(stretches, "_step"), ["_stretch"], pause).select("start_us")
    at = folds.with_start(rows, [], pause, found)
    return at.groupBy("start_us").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("severity", "ts_us", "alert_id", "message")).alias("x")).select("start_us", "n", "x.severity", "x.alert_id", "x.message")


def open_blocks(decisions: DataFrame, now: int) -> DataFrame:
    """The decisions of block_decisions() that have not run out."""
    return decisions.filter(F.col("expires_us") > now)


def keep_evidence(files: DataFrame) -> DataFrame:
    """content under its digest, once however often it comes: sha256, size, content, first_us."""
    named = files.withColumn("sha256", F.sha2("content", 256))
    return named.groupBy("sha256").agg(F.octet_length(F.first("content")).cast("long").alias("size"), F.first("content").alias("content"), F.min("ts_us").alias("first_us"))


def damaged(evidence: DataFrame) -> DataFrame:
    """Kept evidence whose content no longer has its digest."""
    return evidence.filter(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def watch(alerts: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream of alerts, shown batch by batch to whoever watches."""
    return alerts.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)


def worst_first(alerts: DataFrame, most: int = 20) -> DataFrame:
    """Lines for a console: the worst alerts, then the newest."""
    line = F.format_string("[%d] %s %s -> %s: %s", F.col("severity").cast("int"), F.coalesce("rule_id", "alert_type"), F.coalesce("src_ip", F.lit("?")), F.coalesce("dst_ip", F.lit("?")), F.coalesce("message", F.lit("")))
    return alerts.orderBy(F.desc("severity"), F.desc("ts_us"), F.desc("alert_id")).limit(most).select(line.alias("line"))


def newest_by(alerts: DataFrame, by: list[str]) -> DataFrame:
    """A panel: the newest alert of each key and how many it has."""
    w = Window.partitionBy(*by)
    last = F.row_number().over(w.orderBy(F.desc("ts_us"), F.desc("alert_id")))
    return alerts.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_r", last).filter("_r = 1").drop("_r")
