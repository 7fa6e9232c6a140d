"""Merge of snapshots as they arrive: the thread of each conversation is kept as state."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.merging import Thread

_CONTENT = ("role", "kind", "provider_id", "text")
THREADS = "conv_id long, version long, msg_idx int, id string, role string, kind string, provider_id string, text string"


class _Conversation:
    """The thread of all closed snapshots, the contents of its slots, and the rows of the snapshot that may still grow."""

    def __init__(self) -> None:
        self.thread, self.contents, self.seq, self.rows, self.version = Thread(), {}, None, {}, 0

    def _with_open(self) -> tuple[Thread, dict[int, tuple]]:
        thread, contents = copy.deepcopy(self.thread), dict(self.contents)
        rows = [self.rows[i] for i in sorted(self.rows)]
        if rows:
            tops = None if any(r["top"] is None for r in rows) else np.array([r["top"] for r in rows])
            slots = thread.placed([r["key"] for r in rows], [bool(r["provider_id"]) for r in rows], tops)
            contents.update((s, tuple(r[c] for c in _CONTENT)) for s, r in zip(slots, rows, strict=True))
        return thread, contents

    def add(self, row: dict) -> None:
        if self.seq is not None and row["snapshot_seq"] < self.seq:
            raise ValueError("the snapshots of a conversation have to arrive in order")
        if row["snapshot_seq"] != self.seq:
            self.thread, self.contents = self._with_open()
            self.seq, self.rows = row["snapshot_seq"], {}
        self.rows[row["msg_idx"]] = row

    def shown(self) -> list[tuple]:
        thread, contents = self._with_open()
        places = thread.places()
        return [(p, f"message-{p + 1}", *contents[s]) for s, p in sorted(places.items(), key=lambda x: x[1])]


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = pickle.loads(state.get[0]) if state.exists else _Conversation()
    rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
    for row in sorted(rows, key=lambda r: (r["snapshot_seq"], r["msg_idx"])):
        known.add(row)
    known.version += 1
    state.update((pickle.dumps(known),))
    names = [x.split(" ")[0] for x in THREADS.split(", ")]
    yield pd.DataFrame([(key[0], known.version, *x) for x in known.shown()], columns=names)


def merged_threads(snapshots: DataFrame) -> DataFrame:
    """Whole threads of the conversations that a micro-batch touched, as ``merge_snapshots`` gives them, with a ``version`` that counts up.

    ``snapshots`` is a stream of the columns of ``merging.SNAPSHOT``. A conversation's snapshots have to arrive in order; how
    their rows are cut into micro-batches makes no difference. The state of a conversation is its thread, kept until the query ends.
    """
    lean = snapshots.select("conv_id", "snapshot_seq", "msg_idx", *_CONTENT, F.sha2("key", 256).alias("key"), "top")
    return lean.groupBy("conv_id").applyInPandasWithState(_update, THREADS, "thread binary", "update", "NoTimeout")
