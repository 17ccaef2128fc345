import random

import numpy as np
import pytest

from tests.llm.cases import ROWS, documents, rows_of, same_as_sql
from vintagerisk.llm.cuckoo import CuckooFilter, FilterChain
from vintagerisk.llm.line_dedup import LAST, LineStore

SPACE = " \t\n\x0b\x0c\r"
MANY = [
    (1, "Common line one\nown line of 1\n  COMMON line one\t\nshort"), (2, "common LINE one \nshort\n\nown line of 2"), (3, "x\ncommon line one"), (4, "Ünïcödé Zeile\nend of the text"),
    (5, "Ünïcödé zeile\nend of the text\r"), (6, "ünïcödé zeile"), (7, "ten chars!\nnine char"), (8, "TEN CHARS!\nNINE CHAR"), (9, "twice in this one\ntwice in this one"), (2, "once more, under a used number\nown line of 2"), (10, "once more, under a used number"),
    (None, "common line one\nonly without a number"), (None, "only without a number"), (11, "\n\n"), (12, "漢字漢字漢字漢字漢字\nb"), (13, "b\n漢字漢字漢字漢字漢字"),
]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10):
    key = lambda line: low(line.strip(SPACE))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_lines_that_an_earlier_document_holds_go(spark, batches):
    rows = [r for r in ROWS if len(r[1] or "") < 20_000] + MANY
    store = LineStore(spark, shards=3, capacity=64)
    for k in range(batches):
        store.insert(documents(spark, rows[k::batches]))
    assert rows_of(store.cleaned(documents(spark, rows))) == brute(rows)


def state(store):
    return sorted(tuple(r) for r in store.counts.collect())


def test_deleting_documents_undoes_their_insertion(spark):
    store, again = LineStore(spark, shards=2, capacity=64), LineStore(spark, shards=2, capacity=64)
    store.insert(documents(spark, MANY[:9]))
    before = state(store)
    store.insert(documents(spark, MANY[9:]))
    numbers = spark.createDataFrame([(i,) for i, _ in MANY[9:] if i != 2], "doc_id long")
    store.delete(numbers)
    store.delete(spark.createDataFrame([(2,)], "doc_id long"))
    again.insert(documents(spark, [r for r in MANY[:9] if r[0] != 2]))
    assert state(store) == state(again) != before
    left = [r for r in MANY[:9] if r[0] != 2]
    assert rows_of(store.cleaned(documents(spark, left))) == brute(left)
    store.insert(documents(spark, [r for r in MANY if r[0] == 2]))
    reopened = LineStore(spark, store.folder)
    now = [*left, *[r for r in MANY if r[0] == 2]]
    assert rows_of(reopened.cleaned(documents(spark, now))) == brute(now)
    held = {(r.hi, r.lo) for r in reopened.counts.collect()}
    filters = FilterChain(64, [CuckooFilter.load(r.payload) for r in reopened._read("filters").collect()])
    assert sum(f.count for f in filters.filters) == len(held)


def test_no_rows(spark):
    store = LineStore(spark)
    store.insert(documents(spark, []))
    store.insert(documents(spark, []))
    store.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert rows_of(store.cleaned(documents(spark, []))) == []


def test_query_op12(spark):
    same_as_sql(spark, "op12_line_store")


def test_filter_keeps_what_was_added_and_forgets_what_was_removed():
    draw = np.random.default_rng(3)
    hi, lo = draw.integers(-(1 << 62), 1 << 62, (2, 30_000))
    chain = FilterChain(1 << 10)
    for k in range(0, 30_000, 7_000):
        chain.add(hi[k : k + 7_000], lo[k : k + 7_000])
    assert len(chain.filters) > 2 and chain.contains(hi, lo).all()
    others = draw.integers(-(1 << 62), 1 << 62, (2, 30_000))
    assert chain.contains(*others).mean() < 0.01
    chain = FilterChain(1 << 10, [CuckooFilter.load(f.dump()) for f in chain.filters])
    chain.remove(hi[:20_000], lo[:20_000])
    assert chain.contains(hi[20_000:], lo[20_000:]).all() and chain.contains(hi[:20_000], lo[:20_000]).mean() < 0.01
    chain.remove(hi[20_000:], lo[20_000:])
    assert sum(f.count for f in chain.filters) == 0 and not chain.contains(hi, lo).any()


def test_equal_fingerprints_beyond_all_slots_go_to_the_side_list():
    own = CuckooFilter(64)
    same = np.full(20, 12345)
    own.add(same, same)
    assert len(own.side) > 0 and own.contains(same, same).all()
    assert own.remove(same[:19], same[:19]).all() and own.contains(same[:1], same[:1]).all()
    assert own.remove(same[:1], same[:1]).all() and not own.contains(same[:1], same[:1]).any() and own.count == 0


def test_random_batches_and_deletions(spark):
    r = random.Random(5)
    lines = [f"Line number {k} of the pool" for k in range(30)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 5)))) for i in range(60)]
    store = LineStore(spark, shards=2, capacity=64)
    store.insert(documents(spark, rows[:30]))
    store.delete(spark.createDataFrame([(i,) for i in range(0, 30, 3)], "doc_id long"))
    store.insert(documents(spark, rows[30:]))
    left = [x for x in rows if x[0] >= 30 or x[0] % 3]
    assert rows_of(store.cleaned(documents(spark, left))) == brute(left)
