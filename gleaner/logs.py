"""Logs of the driver: console, rotating file, JSON lines, and loggers with bound fields. Tables of logs are in operators.metrics."""

from __future__ import annotations

import contextlib
import json
import logging
import logging.handlers
import os
import time
from collections.abc import Iterator
from pathlib import Path

JSON_SWITCH = "GLEANER_JSON_LOGS"
ROLL, KEPT = 32 << 20, 5
_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    """One object a line: the usual keys, then what was given as extra."""

    def format(self, record) -> str:
        usual = zip(("level", "logger", "message", "module", "function", "line"), (record.levelname, record.name, record.getMessage(), record.module, record.funcName, record.lineno))
        said = {"timestamp": time.strftime("%FT%T+00:00", time.gmtime(record.created)), **dict(usual)}
        if record.exc_info:
            said |= {"exception": super().formatException(record.exc_info)}
        return json.dumps(said | {k: v for k, v in vars(record).items() if k not in _OWN}, ensure_ascii=False, default=str)


def setup(level: str = "INFO", path: str | None = None, as_json: bool | None = None) -> logging.Logger:
    """The package's logger with a console and, for a path, a rotating file. `as_json` follows JSON_SWITCH where it is None."""
    as_json = os.environ.get(JSON_SWITCH) == "1" if as_json is None else as_json
    shape = JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    root = logging.getLogger("gleaner")
    for old in root.handlers[:]:
        old.close()
        root.removeHandler(old)
    sinks: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        sinks.append(logging.handlers.RotatingFileHandler(path, maxBytes=ROLL, backupCount=KEPT, encoding="utf-8"))
    for h in sinks:
        h.setFormatter(shape)
        root.addHandler(h)
    root.setLevel(level)
    return root


class Bound:
    """A logger with fields that go with every line; later ones win, and None leaves a field out."""

    def __init__(self, name: str, **fields):
        self.log, self.fields = logging.getLogger(name), fields

    def bind(self, **fields) -> Bound:
        return Bound(self.log.name, **(self.fields | fields))

    def say(self, level: str, message: str, **fields) -> None:
        merged = {k: v for k, v in (self.fields | fields).items() if v is not None}
        self.log.log(logging.getLevelName(level), message, extra=merged)

    @contextlib.contextmanager
    def timer(self, what: str, **fields) -> Iterator[None]:
        start = time.monotonic()
        try:
            yield
        finally:
            self.say("INFO", what, duration=round(time.monotonic() - start, 3), **fields)


def start_metrics_server(port=9090):
    """Whether a server could be started: False without the client library or with the port taken."""
    try:
        from prometheus_client import start_http_server

        start_http_server(port)
    except (ImportError, OSError):
        return False
    return True
