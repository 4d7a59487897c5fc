"""What a long fit tells while it runs, and how much is logged."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

LOG = logging.getLogger("quietfield")
_level: contextvars.ContextVar[int | None] = contextvars.ContextVar("level", default=None)


@dataclass(frozen=True)
class Progress:
    """A step of a method: stage, how far of how much, and what it has measured."""

    method: str
    stage: str
    current: int
    total: int | None = None
    component: int | None = None
    metric: float | None = None


Listener = Callable[[Progress], None]


def to_log(event: Progress) -> None:
    LOG.info("%s %s %d/%s %s", event.method, event.stage, event.current, event.total or "?", "" if event.metric is None else f"{event.metric:.4g}")


@contextlib.contextmanager
def log_level(level: int | str) -> Iterator[None]:
    """The level within a block, in this thread of control only."""
    number = logging.getLevelName(level) if isinstance(level, str) else level
    token, before = _level.set(number), LOG.level
    LOG.setLevel(number)
    try:
        yield
    finally:
        LOG.setLevel(before)
        _level.reset(token)


def verbose(function: Callable) -> Callable:
    """An argument ``verbose`` goes before the level of the block, and that before the object's own attribute."""

    @functools.wraps(function)
    def run(*args, verbose: int | str | None = None, **kw):
        level = verbose if verbose is not None else _level.get()
        if level is None and args:
            level = getattr(args[0], "verbose", None)
        if level is None:
            return function(*args, **kw)
        with log_level(level):
            return function(*args, **kw)

    return run


def to_bar(event: Progress) -> None:
    """A bar on the error stream."""
    import sys

    done = int(30 * event.current / max(event.total or event.current, 1))
    print(f"\r{event.stage} [{'#' * done}{'.' * (30 - done)}] {event.current}", end="", file=sys.stderr, flush=True)
