"""Changes as a stream: what each new observation of a path means against the last one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "path string, revision long, status string, old_oid string, new_oid string"


def changes_of(observations: DataFrame) -> DataFrame:
    """(path, revision, status, old_oid, new_oid) of a stream of observations (path, revision, oid); a null oid says that the
    path is gone.

    State holds one object id a path. Observations of one path in a micro-batch are taken in order of revision; those no newer
    than the last one taken are passed over, so that an input that is read again changes nothing. In append mode.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, old = state.get if state.exists else (-1, None)
        rows = []
        for revision, oid in sorted(((r, o) for f in frames for r, o in zip(f["revision"], f["oid"], strict=True)), key=lambda x: x[0]):
            if revision <= last:
                continue
            if oid != old:
                rows.append((key[0], int(revision), "A" if old is None else "D" if oid is None else "M", old, oid))
            last, old = int(revision), oid
        state.update((last, old))
        yield pd.DataFrame(rows, columns=["path", "revision", "status", "old_oid", "new_oid"])

    keyed = observations.where("path is not null").select("path", "revision", "oid").groupBy("path")
    return keyed.applyInPandasWithState(step, CHANGE, "revision long, oid string", "append", GroupStateTimeout.NoTimeout)
