import random
import re
from fractions import Fraction

import pytest

from tests.llm.cases import ROWS, SF, documents, stored
from vintagerisk.llm import jaccard_join
from vintagerisk.llm.frames import table


def brute_force(rows, num=4, den=5):
    words = [tuple(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows]
    texts = {}
    for k, w in enumerate(words):
        if w:
            texts.setdefault(w, []).append(k)
    names = list(texts)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in names]
    parent, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    members = {}
    for k, w in enumerate(names):
        members.setdefault(find(k), []).extend(texts[w])
    out = [(i, i, 0, 1) for (i, _), w in zip(rows, words, strict=True) if not w]
    for k, w in enumerate(names):
        least = min((rows[m][0] for m in members[find(k)] if rows[m][0] is not None), default=None)
        out += [(rows[m][0], least, links[k], len(texts[w])) for m in texts[w]]
    return sorted(out, key=str)


def near_copies(seed=1):
    r = random.Random(seed)
    lexicon = [f"w{k}" for k in range(500)]
    rows = []
    for group in range(12):
        base = [r.choice(lexicon) for _ in range(r.choice([6, 20, 60, 300]))]
        for _ in range(r.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(lexicon)
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_links_and_classes_equal_brute_force(spark, block):
    rows = ROWS + near_copies()
    got = jaccard_join.near_duplicates(documents(spark, rows), block=block).select("doc_id", "class_id", "n_links", "n_copies")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows)


def test_threshold_is_a_parameter(spark):
    rows = near_copies(7)
    got = jaccard_join.near_duplicates(documents(spark, rows), threshold=Fraction(9, 10)).select("doc_id", "class_id", "n_links", "n_copies")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, 9, 10)


def test_one_of_each_class_stays(spark):
    rows = [(i, t) for i, t in ROWS if i is not None] + near_copies(3)
    docs = stored(spark, rows)
    out = jaccard_join.without_near_duplicates(docs)
    assert out.columns == docs.columns
    want = sorted({i for i, least, _, _ in brute_force(rows) if i == least})
    assert sorted({r.doc_id for r in out.collect()}) == want


def test_no_rows_and_no_words(spark):
    assert jaccard_join.near_duplicates(documents(spark, [])).count() == 0
    got = jaccard_join.near_duplicates(documents(spark, [(1, None), (None, " "), (3, "!!")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [("1", "1", 0), ("3", "3", 0), ("None", "None", 0)]


def test_pruning_rarely_loses_a_pair_at_the_threshold():
    import math

    fewest = jaccard_join.fewest_matches(Fraction(4, 5), 1e-7)
    assert fewest == sorted(fewest) and fewest[-1] > 100
    lost = sum(math.fsum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(f)) for n, f in zip(range(20, 201, 20), fewest, strict=True))
    assert lost < 1e-5
    missed = (1 - 0.8**jaccard_join.PER_BAND) ** jaccard_join.BANDS
    assert missed < 2e-7


def test_query_op4(spark):
    import __spark_entry__ as entry

    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in entry.queries()["op4_jaccard_join"](spark, SF).collect()), key=str) == brute_force(rows)
