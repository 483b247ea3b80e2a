"""What each change of a journal did, as a stream with a little state for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoal.model import CREATE, DELETE, RENAME_NEW, RENAME_OLD
from shoal.ship import ship

OUTCOME = "file_id long, usn long, outcome string"


def outcome(reason: int, lives: bool) -> tuple[str, bool]:
    """(what a change did, whether its file lives after it)."""
    if reason & RENAME_OLD:
        return "remembered", lives
    if reason & DELETE:
        return ("deleted" if lives else "ignored"), False
    if reason & (CREATE | RENAME_NEW):
        if not lives:
            return "created", True
        return ("renamed" if reason & RENAME_NEW else "updated"), True
    return ("updated" if lives else "ignored"), lives


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lives, seen = state.get if state.exists else (False, -1)
    rows = pd.concat(list(frames)).sort_values("usn", kind="stable")
    out = []
    for usn, reason in zip(rows["usn"].tolist(), rows["reason"].tolist()):
        if usn <= seen:
            continue  # told before: a source may repeat
        what, lives = outcome(reason, lives)
        seen = usn
        out.append((key[0], usn, what))
    state.update((lives, seen))
    yield pd.DataFrame(out, columns=["file_id", "usn", "outcome"])


def follow_outcomes(changes: DataFrame) -> DataFrame:
    """file_id, usn, outcome of a streaming DataFrame of changes (usn, file_id, reason).

    The state of a file is whether it lives and the last change that was told, so it does not
    grow with the journal.  Files that lived before the journal begins are made known by
    putting a creation of each, with a negative usn, in front of it.
    """
    ship(changes.sparkSession)
    rows = changes.select("file_id", "usn", "reason")
    return rows.groupBy("file_id").applyInPandasWithState(_follow, OUTCOME, "lives boolean, seen long", "append", GroupStateTimeout.NoTimeout)
