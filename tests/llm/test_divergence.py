import random
import re
from collections import Counter

import pytest

from tests.llm.cases import same_as_sql
from vintagerisk.llm import divergence
from vintagerisk.llm.divergence import Block, merged

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, top=200):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        seen, total, groups = Counter(), Counter(), {}
        for (ln, source, _), words in zip(rows, terms):
            if ln == lang:
                seen.update(set(words))
                total.update(words)
                groups.setdefault(source, Counter()).update(words)
        kept = sorted(w for w in seen if seen[w] >= min_docs)
        v = len(kept)

        def freq(counts, v=v, kept=kept):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 1) // (n + v) for w in kept}

        q, ps = freq(total), {s: freq(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s, p in ps.items():
            pair = sorted(((o, sum(f(p[w], ps[o][w]) for w in kept)) for o in ps if o != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((w, f(p[w], q[w])) for w in kept if groups[s][w] and p[w] > q[w]), key=lambda x: (-x[1], x[0].encode()))[:top]
            for part, items in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def corpus(n=150, seed=2):
    r = random.Random(seed)
    words = ["the", "The", "of", "naïve", "STRASSE", "straße", "日本", "İ", "x1y", "don't", "Ω", "é", "rare", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", "ß", None]), " ".join(r.choices(words, k=r.randrange(0, 12)))) for _ in range(n)]
    return rows + [("xx", "one", "7 8 9"), ("xx", "two", None), ("xx", None, "once"), ("solo", "s", "alone\x00again alone"), ("solo", "s", "ALONE"), ("solo", "s", "alone"), (None, None, None)]


def frame(spark, rows):
    full = [(*r, 1, 2, 3, 4) for r in rows]
    return spark.createDataFrame(full, "lang string, source string, text string, term int, shard int, p int, item int")


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 23])
def test_values_equal_brute_force_whatever_the_block_size(spark, block_bytes, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(divergence.term_index, "__defaults__", (3, block_bytes))
    monkeypatch.setattr(divergence.shared_corrections, "__defaults__", (30, 8))
    got = divergence.source_divergence(frame(spark, rows).repartition(4), top=5)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, top=5)


def test_no_rows(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window", [1, 10, 200_000])
def test_runs_merge_into_the_counts_of_all_documents(window, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    rows = [r for r in corpus(80) if r[0] == "en"]
    blocks = [Block() for _ in range(7)]
    for k, (lang, source, text) in enumerate(rows):
        blocks[k % 7].add(lang, source or "", text.encode())
    for shard in range(3):
        pieces = [dict(zip(batch.schema.names, row)) for b in blocks for batch in b.run(3) for row in zip(*batch.columns) if row[0].as_py() == shard]
        pieces.sort(key=lambda p: p["first"].as_py())
        got = {}
        for terms, docs, sizes, sources, counts in merged(iter(pieces), 1, window):
            at = 0
            for term, n, size in zip(terms.to_pylist(), docs.tolist(), sizes.tolist()):
                assert term not in got
                got[term] = (n, dict(zip(sources.to_pylist()[at : at + size], counts.tolist()[at : at + size])))
                at += size
        assert list(got) == sorted({t for p in pieces for t in p["terms"].as_py()})
        for term, (docs, held) in got.items():
            want = Counter()
            for _, source, text in rows:
                want[source or ""] += (divergence.terms_of(text.encode()) + [b""]).count(term)
            assert held == {s: n for s, n in want.items() if n}
            assert docs == sum(term in divergence.terms_of(t.encode()) + [b""] for _, _, t in rows)


def test_query_op13(spark):
    same_as_sql(spark, "op13_source_divergence")
