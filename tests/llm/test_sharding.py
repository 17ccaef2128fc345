from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.cases import ROWS, SF, documents
from vintagerisk.llm import sharding
from vintagerisk.llm.frames import table

NAMES = [f"s{k}" for k in range(7)]


def brute_force(names, size):
    """Whole preference lists, then turns."""
    import hashlib

    wishes = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        wishes.append([(start + k * skip) % size for k in range(size)])
    assert all(sorted(w) == list(range(size)) for w in wishes)
    owner = {}
    while len(owner) < size:
        for s, w in enumerate(wishes):
            if len(owner) < size:
                owner[next(x for x in w if x not in owner)] = s
    return [owner[k] for k in range(size)]


@pytest.mark.parametrize("size", [7, 101, 503])
def test_table_equals_turns_over_whole_lists(size):
    assert sharding.lookup_table(NAMES, size).tolist() == brute_force(NAMES, size)


def test_slots_are_even_and_few_move():
    table_ = sharding.lookup_table(NAMES, 10_007)
    counts = Counter(table_.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(NAMES[:-1], 10_007)
    stayed = (table_ != 6)
    assert (table_[stayed] != fewer[stayed]).mean() < 0.15


@pytest.mark.parametrize("names, size", [([], 7), (["a"], 8), (["a", "a"], 7), (NAMES, 5)])
def test_bad_tables_are_refused(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_placement(spark):
    docs = documents(spark)
    out = sharding.place(docs, NAMES, size=101)
    assert out.columns == [*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard"]
    rows, owner = out.collect(), sharding.lookup_table(NAMES, 101)
    assert len(rows) == len(ROWS) and all(r.shard == NAMES[owner[r.slot]] for r in rows)
    assert len({r.slot for r in rows if r.doc_id is None}) == 1 and len({r.slot for r in rows if r.doc_id == 1}) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sharding.place(documents(spark, []), NAMES, size=7).count() == 0


def test_query_op7(spark):
    rows = entry.queries()["op7_lookup_sharding"](spark, SF).collect()
    owner = sharding.lookup_table([f"shard-{k:04d}" for k in range(256)])
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, SF, "documents").collect())
    assert all(r.shard == f"shard-{owner[r.slot]:04d}" for r in rows)
    assert len(np.unique([r.slot for r in rows])) > 0.9 * len(rows)
