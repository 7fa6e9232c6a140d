"""What the n-gram join moves and leaves on disk."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from parlance.llm import common, ngram_join
from tests.llm import fixtures as fx


@pytest.mark.parametrize("buckets", [8, 1024])
def test_a_signature_takes_14_bytes_in_however_many_buckets(buckets):
    batch = pd.DataFrame({"text": [t for t in fx.texts() if t]})
    runs = pd.concat(ngram_join._signature_runs(3, 80, buckets)(iter([batch])))
    sets = {ngram_join._class_key(s): s for s in ngram_join.shingle_sets([t.encode() for t in batch["text"]], 3) if len(s)}
    signatures = sum(len(ngram_join.group_signatures(s, 80)) for s in sets.values())
    assert sum(len(x) for c in runs.columns[1:] for x in runs[c]) == 14 * signatures


def test_tables_of_the_join_go_once_they_are_used(spark, monkeypatch):
    paths, new_path = [], common.new_path
    monkeypatch.setattr(common, "new_path", lambda *x: paths.append(new_path(*x)) or paths[-1])
    found = ngram_join.jaccard_components(fx.documents(spark), percent=80, block_rows=4)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in paths if os.path.exists(p.removeprefix("file://"))}
    assert left.isdisjoint({"agreeing", "agreeing-rows", "pruned", "shared-groups", "rarest-groups", "hubs", "agreeing-tasks"})
    want = fx.components([(r[0], r[1]) for r in fx.rows()], 3, 80)
    assert {r["doc_id"]: r["component_id"] for r in found.collect() if r["doc_id"] is not None} == want


def test_rows_whose_groups_look_alike_still_agree():
    # Both rows have five groups; they agree on four, two of which look alike in each row.
    one, two, other = (np.array(x, dtype=np.int32) for x in ([4, 4, 8, 12, 16], [4, 4, 8, 12, 20], [24, 24, 28, 32, 36]))
    found = ngram_join.rows_in_agreement([one, two, other], [np.zeros(5, dtype=int)] * 3, [0] * 3, [4])
    assert found.tolist() == [True, True, False]
