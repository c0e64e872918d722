"""Status changes and message events as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import message
from ..schemas import CHAT_EVENT, STATUS_LOG


def status_stream(spark: SparkSession, log_path: str) -> DataFrame:
    """The log as it grows, with what a client is told."""
    log = spark.readStream.schema(STATUS_LOG).parquet(log_path)
    return log.withColumn("message", message(F.col("status"), F.col("error_msg")))


def watch(changes: Iterator[tuple[str, str | None]]) -> Iterator[dict]:
    """What one client sees of (status, error) polls: every poll, up to the first terminal one."""
    from ..operators.lifecycle import FAILED, READY, WORKING

    for status, error in changes:
        text = {"done": READY, "failed": error or FAILED}.get(status, WORKING)
        yield {"status": status, "message": text}
        if status in ("done", "failed"):
            return


#: Fixed value: what a client shows when the stream breaks off.
LOST = "Connection to server lost."


def follow(events: Iterator[dict]) -> Iterator[dict]:
    """What an uploading client shows: events up to the first terminal one; a stream that breaks off or ends early counts as failed."""
    try:
        for event in events:
            yield event
            if event.get("status") in ("done", "failed"):
                return
    except Exception:  # any break of the stream looks alike to a client
        pass
    yield {"status": "failed", "message": LOST}


_MESSAGE = "message_id string, content string, citations string, streaming boolean, error boolean"


def fold_stream(events: DataFrame) -> DataFrame:
    """Messages (message_id, content, citations, streaming, error) as their events arrive; the state is the message so far.

    The last citations count.  Events of one batch are put in order by seq; an event after the end changes nothing.
    """
    chunks = F.col("chunks") if "chunks" in events.columns else F.lit(None).cast(CHAT_EVENT["chunks"].dataType)
    plain = events.select(F.col("message_id").cast("string"), "seq", "type", "content", F.to_json(chunks).alias("chunks"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, citations, streaming, error = state.get if state.exists else ("", "[]", True, False)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, text, cited in zip(rows["type"], rows["content"], rows["chunks"], strict=True):
            if not streaming:
                break
            if kind == "token":
                content += text or ""
            elif kind == "citations":
                citations = cited or "[]"
            elif kind in ("done", "error"):
                streaming, error = False, kind == "error"
        state.update((content, citations, streaming, error))
        yield pd.DataFrame({"message_id": [key[0]], "content": [content], "citations": [citations], "streaming": [streaming], "error": [error]})

    keyed = plain.groupBy("message_id")
    folded = keyed.applyInPandasWithState(step, _MESSAGE, "content string, citations string, streaming boolean, error boolean", "update", GroupStateTimeout.NoTimeout)
    return folded.withColumn("citations", F.from_json("citations", CHAT_EVENT["chunks"].dataType))


def typed_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Typed events of a stream of frame lines; what isn't a valid data line drops out."""
    body = F.when(F.col(text).startswith("data: "), F.expr(f"substring(`{text}`, 7)"))
    return lines.withColumn("event", F.from_json(body, CHAT_EVENT)).filter("event.type is not null")
