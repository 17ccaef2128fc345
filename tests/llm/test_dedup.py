import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import NAMES, ROWS, documents, same_as_sql, stored
from vintagerisk.llm import block_naming
from vintagerisk.llm.components import components


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, text) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "locator"), [(1, F.xxhash64), (3, F.xxhash64), (3, lambda c: F.length(c).cast("long")), (4096, lambda c: F.length(c) * 0)])
def test_block_names_tell_texts_apart(spark, size, locator):
    rows = [r for r in ROWS if len(r[1] or "") < 10_000] + [(20, "abcabcabd"), (21, "abcabcabd"), (22, "abdabcabc"), (23, "abcabdabc"), (24, "ab"), (25, "ba")]
    if size < 4096:
        rows = [r for r in rows if len(r[1] or "") < 100]
    import hashlib

    got = block_naming.duplicates(documents(spark, rows), size, locator).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((*r[:4], sha(r[4])) for r in expected(rows)), key=str)


def test_long_texts_differ_by_their_last_block(spark):
    got = {(r.doc_id, r.keep_id) for r in block_naming.duplicates(documents(spark)).collect()}
    assert (10, 8) in got and (9, 9) in got and (14, 14) in got and (2, 1) in got


def test_deduplicate_keeps_one_whole_row_of_each_text(spark):
    docs = stored(spark)
    out = block_naming.deduplicate(docs)
    assert out.columns == docs.columns and len(NAMES) == len(out.columns) - 3
    want = sorted({(keep, text) for _, keep, _, _, text in expected(ROWS)}, key=str)
    assert sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in out.collect()), key=str) == want


def test_no_rows(spark):
    assert block_naming.duplicates(documents(spark, [])).count() == 0
    assert block_naming.deduplicate(documents(spark, [])).count() == 0


def test_query_op3(spark):
    same_as_sql(spark, "op3_block_naming")


def test_components_of_random_graphs(spark):
    import random

    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(7, 7), (500, 900), (900, 700)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {(n.node, n.root) for n in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
