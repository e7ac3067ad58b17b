"""Action items to outside systems, each once: intents, effects and confirmations as tables.

A run writes what it is about to create (intents), has it created (effects), and writes what was created (confirmations,
the ledger). Ids of outside objects follow from the item's key and the target, and a target takes an id that it has for
done. So a run that dies between an effect and its confirmation leaves an open intent, and the next run sends it again
under the same id: nothing is lost and nothing doubled. Lost executors repeat effects in the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from parley.functions import text as T
from parley.sources import manifest, shared
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels of what is created.
SUMMARY, SOURCE, MEETING, OWNER, CONTEXT, NOBODY = "[会议待办] ", "来源：会议 ", "来源会议：", "负责人：", "上下文：", "未指定"
#: Of an intent or a confirmation.
REQUEST = "item_key string, target string, external_id string, meeting_id string, summary string, description string, account string, due string, due_epoch long, priority string, labels array<string>"
CONFIRMED = "item_key string, target string, external_id string, meeting_id string, created_at double"


def external_id(key: Column, target: Column) -> Column:
    return F.concat(F.substring(target, 1, 1), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", key, target), 256), 1, 24))


def requests(items: DataFrame, people: DataFrame, targets: tuple[str, ...] = ("tickets", "tasks")) -> DataFrame:
    """A row for each item and target, as REQUEST with ord. items: meeting_id, ord, assignee, task, deadline, priority, context;
    people: name (normalised), account. Unknown names have no account; deadlines that are no date are dropped."""
    who, meeting = F.coalesce("assignee", F.lit(NOBODY)), F.col("meeting_id").cast("string")
    own = items.select("ord", meeting.alias("meeting_id"), who.alias("assignee"), F.coalesce("task", F.lit("")).alias("task"), T.deadline(F.coalesce("deadline", F.lit(""))).alias("due"), T.priority(F.coalesce("priority", F.lit("medium"))).alias("priority"), F.coalesce("context", F.lit("")).alias("context"))
    own = own.withColumn("item_key", T.item_key(F.col("meeting_id"), F.col("assignee"), F.col("task"))).withColumn("name", T.normalized(F.col("assignee")))
    known = own.select("name").distinct().join(people.groupBy("name").agg(F.min("account").alias("account")), "name")  # distinct, so that a frequent name is no hot key
    own = own.join(F.broadcast(known) if known.limit(100_001).count() <= 100_000 else known, "name", "left")
    line = lambda label, c: F.concat(F.lit(label), c)
    from_, by, about = line(SOURCE, F.col("meeting_id")), line(OWNER, F.col("assignee")), line(CONTEXT, F.col("context"))
    each = own.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    ticket = F.col("target") == "tickets"
    return each.select(
        "ord", "item_key", "target", external_id(F.col("item_key"), F.col("target")).alias("external_id"), "meeting_id", line(SUMMARY, F.col("task")).alias("summary"),
        F.when(ticket, F.concat_ws("\n", from_, by, about)).otherwise(F.concat_ws("\n", by, line(MEETING, F.col("meeting_id")), about)).alias("description"), F.when(ticket, F.col("account")).alias("account"),
        F.nullif("due", F.lit("")).alias("due"), F.when(F.col("due") != "", F.unix_timestamp("due", "yyyy-MM-dd")).alias("due_epoch"), "priority", F.array(F.lit("meeting-auto"), line("meeting-", F.col("meeting_id"))).alias("labels"),
    )


class Outbox:
    """intents/ and confirmed/ below a path, a folder a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        runs = [n for n in manifest.names(self.spark, f"{self.path}/{name}") if manifest.exists(self.spark, f"{self.path}/{name}/{n}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{n}" for n in runs]) if runs else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """One row for each key and target: the first confirmation."""
        first = F.min(F.struct("created_at", "meeting_id", "external_id"))
        return self._read("confirmed", CONFIRMED).groupBy("item_key", "target").agg(first.alias("c")).select("item_key", "target", "c.external_id", "c.meeting_id", "c.created_at")

    def open(self) -> DataFrame:
        """Intents without a confirmation, one row for each key and target."""
        left = self._read("intents", REQUEST).join(self.ledger().select("item_key", "target"), ["item_key", "target"], "left_anti")
        return left.dropDuplicates(["item_key", "target"])

    def run(self, asked: DataFrame, send: Callable[[DataFrame], DataFrame], now: float = 0.0) -> DataFrame:
        """Send what the ledger lacks of asked (requests()) and what earlier runs left open. send takes rows of REQUEST, creates
        each under its external_id if there is none, and returns external_id and error (null: done). Result: the rows of
        asked with status created, skipped (in the ledger, or an earlier row of this run made it) or failed, and error."""
        name = uuid.uuid4().hex
        known = self.ledger().select("item_key", "target", F.lit(True).alias("known"))
        first = F.row_number().over(Window.partitionBy("item_key", "target").orderBy("ord", "meeting_id")) == 1
        marked = asked.join(known, ["item_key", "target"], "left").withColumn("first", first)
        asked = shared.written(marked.withColumn("row", F.monotonically_increasing_id()), "asked", "zstd")  # keys are hexadecimal: half of what snappy leaves
        fresh = asked.filter("known is null and first").select(*[c.split(" ")[0] for c in REQUEST.split(", ")])
        fresh.write.option("compression", "zstd").parquet(f"{self.path}/intents/{name}")
        todo = self.open()
        done = shared.written(send(todo).select("external_id", "error"), "effects", "zstd")  # once: what is confirmed is what was sent
        keys = self._read("intents", REQUEST).select("item_key", "target", "external_id", "meeting_id").dropDuplicates(["external_id"])
        keys.join(done.filter("error is null").select("external_id").distinct(), "external_id", "left_semi").withColumn("created_at", F.lit(float(now))).select(*[c.split(" ")[0] for c in CONFIRMED.split(", ")]).write.option("compression", "zstd").parquet(f"{self.path}/confirmed/{name}")
        failed = done.groupBy("external_id").agg(F.min(F.coalesce("error", F.lit(""))).alias("error")).filter("error <> ''")
        failed = shared.written(asked.filter("known is null").select("row", "external_id").join(failed, "external_id").select("row", "error"), "failed", "zstd")
        status = F.when(F.col("known").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("first"), "created").otherwise("skipped")
        return asked.join(failed, "row", "left").withColumn("status", status).drop("row", "known", "first")  # whoever counts reads no texts


def counters(outcome: DataFrame, targets: tuple[str, ...] = ("tickets", "tasks"), enabled: tuple[str, ...] = ("tickets", "tasks")) -> DataFrame:
    """target, created, skipped, failed, status of each target by itself, also of those with no items."""
    names = outcome.sparkSession.createDataFrame([(t, t in enabled) for t in targets], "target string, enabled boolean")
    own = outcome.groupBy("target").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("created", "skipped", "failed")])
    all_ = F.broadcast(names).join(own, "target", "left").na.fill(0)
    detail = F.format_string("%s,created=%d,skipped=%d,failed=%d", F.when(F.col("enabled"), "enabled").otherwise("disabled"), "created", "skipped", "failed")
    return all_.select("target", "created", "skipped", "failed", detail.alias("status"))


def meetings(outcome: DataFrame) -> DataFrame:
    """meeting_id, created, skipped, failed of each meeting."""
    return outcome.groupBy("meeting_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("created", "skipped", "failed")])
