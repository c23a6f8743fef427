"""Topic source and sinks. The connector comes with the cluster (spark-sql-kafka)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysift.constants import TOPIC_ENRICHED, TOPIC_RAW
from skysift.sources.readings import as_raw, encoded


def source_options(brokers: str, topic: str = TOPIC_RAW, starting: str = "latest", limit: int | None = 1_000_000) -> dict[str, str]:
    """``limit`` bounds the messages of one micro-batch, so that a backlog is worked off in many."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }
    return options | ({"maxOffsetsPerTrigger": str(limit)} if limit else {})


def sink_options(brokers: str, topic: str = TOPIC_ENRICHED) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "topic": topic}


def publish_options(brokers: str, topic: str = TOPIC_RAW) -> dict[str, str]:
    """Readings are published durably: all replicas, compressed, retried."""
    return {
        **sink_options(brokers, topic),
        "kafka.acks": "all",
        "kafka.compression.type": "gzip",
        "kafka.retries": "5",
    }


def messages(spark: SparkSession, brokers: str, **source) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(brokers, **source)).load()


def publish_enriched(records: DataFrame, brokers: str, topic: str = TOPIC_ENRICHED) -> None:
    encoded(records).write.format("kafka").options(**sink_options(brokers, topic)).save()


def replay_readings(readings: DataFrame, brokers: str, topic: str = TOPIC_RAW) -> None:
    """Publish a table of readings to the raw topic."""
    encoded(as_raw(readings)).write.format("kafka").options(**publish_options(brokers, topic)).save()
