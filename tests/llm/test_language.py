import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.cases import ROWS, documents, stored
from vintagerisk.llm import language_id
from vintagerisk.llm.frames import table

SF = "/root/testdata/sf0.01"
TAUGHT = [("en", "the cat and the dog of the house"), ("de", "der hund und die katze im haus"), (None, "le chat"), ("fr", None), ("en", ""), ("de", "übermäßig große häuser")]


def taught(spark, **more):
    return language_id.fit(spark.createDataFrame(TAUGHT, "lang string, text string"), **more)


def test_query_op2_on_held_out_documents(spark):
    rows = entry.queries()["op2_word_first_language"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in {*truth.values(), "und"} for r in rows)


def test_words_first_then_shorter_grams(spark):
    model = taught(spark)
    scorer = language_id.Scorer(model)
    assert model.langs == ("de", "en") and "the" in model.words.row and "haus" in model.words.row
    assert scorer.row("the").tolist() == model.words.logs[model.words.row["the"]].tolist()
    for word in ("hauses", "thex", "qhy"):
        n = next(n for n in range(5, 0, -1) if any(g in model.grams[n].row for g in language_id.padded_grams(word, n)))
        known = [model.grams[n].logs[model.grams[n].row[g]] for g in language_id.padded_grams(word, n) if g in model.grams[n].row]
        assert scorer.row(word) == pytest.approx(sum(known) / len(known), rel=1e-5)
    assert scorer.row("日本").tolist() == [0.0, 0.0]
    assert scorer.predict("HAUSES Hunde")[0] == "de" and scorer.predict("the dogs")[0] == "en"


def test_defined_results_for_odd_input(spark):
    model = taught(spark)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents(spark, [(1, None), (2, ""), (3, "12 - 34! x".replace("x", "²Ⅷ")), (4, "日本"), (None, "the cat")]), model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4] == ("de", 0.5) and out[None][0] == "en"
    nothing = language_id.fit(spark.createDataFrame([], "lang string, text string"))
    assert nothing.langs == () and language_id.Scorer(nothing).predict("the cat") == ("und", 0.0)
    assert language_id.predict(documents(spark, []), model).count() == 0


def test_the_model_has_a_bound(spark):
    model = taught(spark, max_words=3)
    assert len(model.words.row) <= 6 and all(len(g.row) <= 6 for g in model.grams.values())
    assert taught(spark, max_docs=0).langs == ()


def test_identified_keeps_columns_and_texts_with_a_language(spark):
    docs = stored(spark)
    out = language_id.identified(docs, taught(spark))
    assert out.columns == docs.columns
    kept = out.collect()
    gone = [r for r in ROWS if not any(c.isalpha() for c in r[1] or "")]
    assert len(kept) == len(ROWS) - len(gone)


def test_a_kept_item_has_its_true_frequency_in_every_language(spark):
    texts = [("en", "alpha alpha alpha beta beta gamma gamma die"), ("de", "die die die und und und gamma")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    whole, cut = language_id.fit(docs), language_id.fit(docs, max_words=2)
    assert len(cut.words.row) == 4 < len(whole.words.row) == 5
    assert all(len(cut.grams[n].row) < len(whole.grams[n].row) for n in range(1, 4))
    for few, all_ in [(cut.words, whole.words), *[(cut.grams[n], whole.grams[n]) for n in range(1, 6)]]:
        at = np.searchsorted(all_.row.keys, few.row.keys)
        assert (all_.row.keys[at] == few.row.keys).all() and (few.logs == all_.logs[at]).all()
    # "die" is third in English and first in German: (1 + 1/2) and (3 + 1/2) of all words
    assert cut.words.logs[cut.words.row["die"]] == pytest.approx(np.log([3.5 / (7 + 2.5), 1.5 / (8 + 2.5)]), rel=1e-6)


def test_a_rare_language_in_a_table_larger_than_the_sample(spark):
    common = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang", "concat(CASE WHEN id % 2 = 0 THEN 'the cat ' ELSE 'der hund ' END, translate(id, '0123456789', 'abcdefghij')) AS text")
    rare = spark.createDataFrame([("is", f"hundurinn og kötturinn {'x' * k}") for k in range(1, 6)], "lang string, text string")
    model = language_id.fit(common.unionByName(rare), max_docs=100)
    assert model.langs == ("de", "en", "is")
    assert language_id.Scorer(model).predict("og kötturinn")[0] == "is"
    # some 47 texts each of the two common ones, all five of the rare one
    assert language_id._shares({"en": 10_000, "de": 10_000, "is": 5}, 100) == {"en": 0.00475, "de": 0.00475, "is": 1.0}
    assert language_id._shares({"en": 60, "de": 5}, 65) == {"en": 1.0, "de": 1.0} and language_id._shares({}, 5) == {}


def test_copies_of_a_text_change_neither_bound_nor_frequencies(spark):
    texts = spark.range(2_000).selectExpr("'en' AS lang", "concat('the cat ', translate(id, '0123456789', 'abcdefghij')) AS text")
    hot = spark.createDataFrame([("en", "page not found"), ("en", ""), ("de", "page not found"), ("de", "der hund")], "lang string, text string")
    copies = hot.crossJoin(spark.range(1_000)).drop("id")
    for most in (language_id.MAX_DOCS, 500):
        once, often = (language_id.fit(texts.unionByName(more), max_docs=most) for more in (hot, copies))
        assert once.langs == often.langs == ("de", "en")
        assert (once.words.row.keys == often.words.row.keys).all() and (once.words.logs == often.words.logs).all()
        assert all((once.grams[n].logs == often.grams[n].logs).all() for n in range(1, 6))
