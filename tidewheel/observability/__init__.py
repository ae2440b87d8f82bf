"""Log lines as JSON, with the job, operator and subtask that they are about."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

LOCATORS = ("job_id", "operator_id", "subtask", "attempt", "record_id")


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        line = {"timestamp": at, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k in LOCATORS if (v := getattr(record, k, None)) is not None}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def logger(**locators) -> logging.LoggerAdapter:
    """A logger whose lines carry the locators."""
    return logging.LoggerAdapter(logging.getLogger("tidewheel"), locators, merge_extra=True)


def configure(level: int = logging.INFO, stream=None) -> None:
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonFormatter())
    root = logging.getLogger("tidewheel")
    root.handlers, root.propagate = [handler], False
    root.setLevel(level)
