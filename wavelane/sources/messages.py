"""Planned groups as keyed messages for a topic or a folder of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.schemas import GROUP_MESSAGE

BATCH_HEADER = "batch_id"


def encode_groups(groups: DataFrame) -> DataFrame:
    """(key, value, batch_id, part) rows, one per group part.

    Parts of a component have one key. A group in one part keeps the plain shape; others say which of how many
    parts they are, and their waves where in the wave they begin, so rows can be rebuilt in any order of arrival.
    """
    from wavelane.plans.documents import group_fields

    value = F.to_json(F.struct(*group_fields())).alias("value")
    return groups.select(F.col("component_id").alias("key"), value, "batch_id", "part")


def decode_groups(messages: DataFrame) -> DataFrame:
    """Typed groups from messages, batch or streaming; a message without waves runs serially."""
    from wavelane.plans.documents import with_waves

    known = [c for c in ("batch_id",) if c in messages.columns]
    parsed = messages.select(*known, F.from_json(F.col("value").cast("string"), GROUP_MESSAGE).alias("m"))
    return parsed.select(
        *known,
        F.col("m.componentId").alias("component_id"),
        F.col("m.orderedTasks").alias("ordered_tasks"),
        with_waves(F.col("m.waves"), F.col("m.orderedTasks")).alias("waves"),
        F.coalesce("m.part", F.lit(0).cast("bigint")).alias("part"),
        F.coalesce("m.parts", F.lit(1).cast("bigint")).alias("parts"),
    )


def in_key_order(messages: DataFrame) -> DataFrame:
    """Messages of a key together, batch by batch and part by part."""
    order = ["key", "batch_id", "part"]
    return messages.repartitionByRange(*order).sortWithinPartitions(*order)


def batch_header(batch_id: Column) -> Column:
    """Kafka headers that name the batch of a message."""
    name = F.struct(F.lit(BATCH_HEADER).alias("key"), batch_id.cast("string").cast("binary").alias("value"))
    return F.array(name)


def batch_of(headers: Column) -> Column:
    """The batch a message's headers name; null for messages without such a header or with one that is no number."""
    named = F.filter(headers, lambda h: h["key"] == BATCH_HEADER)
    return F.get(named, 0)["value"].cast("string").try_cast("bigint")


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Send messages to Kafka, the batch as a header; needs Spark's Kafka connector on the class path."""
    rows = in_key_order(messages).select("key", "value", batch_header(F.col("batch_id")).alias("headers"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").option(
        "topic", topic
    ).save()


def write_files(messages: DataFrame, path: str) -> None:
    in_key_order(messages).write.mode("append").json(path)
