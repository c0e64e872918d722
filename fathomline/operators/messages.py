"""Event frames, the message that a client folds from them, and the message's light markup."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schemas import CHAT_EVENT

#: A numbered item with a bold label, and bold text.
ITEM = r"^(\d+)\.\s+\*\*(.+?)\*\*[:]\s*(.*)$"
BOLD = r"\*\*(.+?)\*\*"


def frame(event: dict) -> str:
    """An event as it goes over the wire: spaces after separators, everything beyond ASCII escaped."""
    return f"data: {json.dumps(event)}\n\n"


class FrameReader:
    """Events from text that arrives in any portions; what isn't valid JSON is skipped."""

    def __init__(self):
        self.tail = ""

    def feed(self, portion: str) -> Iterator[dict]:
        *lines, self.tail = (self.tail + portion).split("\n")
        for line in lines:
            if line.startswith("data: ") and (body := line[6:].strip()):
                try:
                    yield json.loads(body)
                except ValueError:
                    continue

    @property
    def incomplete(self) -> bool:
        """Whether the last line lacks its end; such a line is not an event."""
        return bool(self.tail)


def parse_frames(frames: DataFrame, text: str = "frame") -> DataFrame:
    """The events of whole frames, one row each, typed; lines that aren't data and invalid JSON are dropped."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.startswith("data: ") & (F.length(F.trim(F.substring(x, F.lit(7), F.length(x)))) > 0))
    rows = frames.withColumn("line", F.explode(lines))
    event = F.from_json(F.expr("substring(line, 7)"), CHAT_EVENT)
    return rows.withColumn("event", event).filter("event.type is not null").drop("line", text)


def fold(events: DataFrame) -> DataFrame:
    """One message of each message_id from its events (seq, type, content, chunks, message).

    Tokens are joined in order, empty ones drop out; the last citations count; an error or the end
    stops the stream, and what comes after it changes nothing.  ``streaming`` tells a message that
    neither has ended.
    """
    seq, kind = F.col("seq"), F.col("type")
    ends = kind.isin("done", "error")
    folded = events.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.when((kind == "token") & (F.col("content") != ""), F.struct("seq", "content")))).alias("tokens"),
        F.array_sort(F.collect_list(F.when(kind == "citations", F.struct("seq", "chunks")))).alias("cited"),
        F.min(F.when(ends, seq)).alias("end"),
        F.min_by("type", F.when(ends, seq)).alias("end_type"),
    )
    in_time = lambda parts: F.filter(parts, lambda p: F.col("end").isNull() | (p["seq"] < F.col("end")))
    none = F.array().cast(CHAT_EVENT["chunks"].dataType)
    return folded.select(
        "message_id",
        F.array_join(F.transform(in_time("tokens"), lambda p: p["content"]), "").alias("content"),
        F.coalesce(F.try_element_at(in_time("cited"), F.lit(-1))["chunks"], none).alias("citations"),
        F.col("end").isNull().alias("streaming"),
        F.coalesce(F.col("end_type") == "error", F.lit(False)).alias("error"),
    )


def markup_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Adds kind (item, paragraph), label and body to the lines that aren't blank; bold becomes strong in paragraphs only."""
    line = F.col(text)
    item = line.rlike(ITEM)
    return (
        lines.filter(~is_blank(line))
        .withColumn("kind", F.when(item, "item").otherwise("paragraph"))
        .withColumn("label", F.when(item, F.concat(F.regexp_extract(line, ITEM, 2), F.lit(":"))))
        .withColumn("body", F.when(item, F.regexp_extract(line, ITEM, 3)).otherwise(F.regexp_replace(line, BOLD, "<strong>$1</strong>")))
    )


def split_lines(messages: DataFrame, text: str) -> DataFrame:
    """A row for each line: all other columns, line_no from 0, and line."""
    return messages.select(*[c for c in messages.columns if c != text], F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def markup_blocks(marked: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Adds ``block``: consecutive items are one list (blank lines between don't part them), each paragraph one block."""
    own = Window.partitionBy(*keys).orderBy(order)
    starts = F.when((F.col("kind") == "item") & (F.lag("kind").over(own) == "item"), 0).otherwise(1)
    return marked.withColumn("starts", starts).withColumn("block", F.sum("starts").over(own).cast("long")).drop("starts")


def any_streaming() -> Column:
    """Aggregate: whether any message still streams; false for none."""
    return F.coalesce(F.bool_or("streaming"), F.lit(False))
