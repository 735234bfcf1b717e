"""Run work over many parts at once, and keep a failing part from taking the others along."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Generic, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


@dataclass
class Isolated(Generic[T]):
    """What the runs gave, and the message of every part that failed alone."""

    results: list[T] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    attempts: int = 0


def message_of(err: BaseException) -> str:
    """What went wrong, without the trace: the innermost cause that Spark or Python names, on one line."""
    text = str(err).strip()
    lines = [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("at ")]
    # A failed task is reported with the trace of its Python worker; its last line is the exception itself.
    if lines and any(line.startswith("Traceback ") for line in lines):
        start = next(i for i, line in enumerate(lines) if line.startswith("Traceback "))
        raised = [line for line in lines[start + 1:] if not line.startswith(("File ", "^", "~"))]
        named = [line for line in raised if ": " in line and " " not in line.split(": ", 1)[0]]
        return (named or raised or lines)[-1]
    first = lines[0] if lines else type(err).__name__
    return re.sub(r"^\[[A-Z_.0-9]+\] ", "", first).split(" SQLSTATE: ")[0]


def isolate(parts: Sequence[str], run: Callable[[Sequence[str]], T], together: int = 8) -> Isolated[T]:
    """``run`` over all parts in one go; where that fails, over halves, until a failing part stands alone.

    ``parts`` are sorted names and every call gets a contiguous stretch of them, so a caller may select
    a stretch by its first and last name.  With f of n parts failing there are at most about
    ``2 * f * log2(n)`` runs, and one where nothing fails; the runs of one level, ``together`` at a time, are
    submitted side by side.  ``run`` must leave nothing behind when it raises.
    """
    def attempt(group: Sequence[str]) -> tuple[Sequence[str], T | None, Exception | None]:
        try:
            return group, run(group), None
        except Exception as err:  # noqa: BLE001 - whatever a part raises is its own
            return group, None, err

    out: Isolated[T] = Isolated()
    session = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(session) if session else lambda fn: fn
    level = [list(parts)] if parts else []
    with ThreadPoolExecutor(together) as pool:
        while level:
            out.attempts += len(level)
            halves = []
            for group, result, err in pool.map(inherit(attempt), level):
                if err is None:
                    out.results.append(result)
                elif len(group) == 1:
                    out.failed[group[0]] = message_of(err)
                else:
                    half = len(group) // 2
                    halves += [group[:half], group[half:]]
            level = halves
    return out
