import re

import corpus_pipeline
from tests.llm.cases import SF, documents, stored
from tests.llm.test_jaccard import brute_force as near_brute_force
from tests.llm.test_secrets import brute_force as secrets_of
from vintagerisk.llm.frames import land, table


def kept(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language", "exact", "near", "secrets", "pack"]
    rows = kept(docs)

    docs = land(stages["language"](spark, docs, SF), "t")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    told = [r for r in rows if any(c.isalpha() for c in r[1])]
    assert set(kept(docs)) <= set(told) and len(told) - docs.count() <= 1
    rows = kept(docs)

    docs = land(stages["exact"](spark, docs, SF), "t")
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = sorted(first.values())
    assert kept(docs) == rows

    docs = land(stages["near"](spark, docs, SF), "t")
    stay = {i for i, least, _, _ in near_brute_force(rows) if i == least}
    rows = [r for r in rows if r[0] in stay]
    assert kept(docs) == rows

    docs = land(stages["secrets"](spark, docs, SF), "t")
    rows = [r for r in rows if not secrets_of(r[1])]
    assert kept(docs) == rows

    packed = stages["pack"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_odd_rows_and_no_rows(spark):
    for docs in (stored(spark), documents(spark, [])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = land(stage(spark, docs, SF), "t")
            assert out.count() <= docs.count() or name == "pack"
            docs = out
            assert name == "pack" or docs.columns == columns
