"""Logging to rotating files, and what streams report about themselves."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler

from pyspark.sql.streaming import StreamingQueryListener


def log_to(path: str, *, level: int = logging.INFO, file_bytes: int = 10 * 1024 * 1024, files: int = 5) -> logging.Logger:
    """The package's logger, writing to ``path`` and a few older files beside it."""
    logger = logging.getLogger("fathomline")
    handler = RotatingFileHandler(path, maxBytes=file_bytes, backupCount=files)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logger.addHandler(handler)
    logger.setLevel(level)
    return logger


class StreamLog(StreamingQueryListener):
    """A line for each start, batch and end of a streaming query."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("fathomline")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.logger.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.logger.info("stream %s batch %s: %s rows", event.progress.id, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.logger.debug("stream %s idle", event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.logger.info("stream %s ended: %s", event.id, event.exception or "no error")
