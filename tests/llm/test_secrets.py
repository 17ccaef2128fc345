import dataclasses
import random
import re

from tests.llm.cases import ROWS, documents, same_as_sql, stored
from vintagerisk.llm import secret_scan as S
from vintagerisk.llm.frames import scratch

PLAIN = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+", "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
}
LEAST = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24, "pem": lambda m: True}


def brute_force(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if LEAST[kind](m)]
    return sorted(found)


def texts(seed=5, n=150):
    r = random.Random(seed)
    bits = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "x" * 6, "AKIA", "Z9" * 9, "0f" * 12, "deadbeef", "é😀", "\n", "-----BEGIN RSA PRIVATE KEY-----", "passwd", "=="]
    return [(k, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for k in range(n)]


def rows():
    return ROWS + [(i + 200, t) for i, t in texts()] + [(900, "password=token:abcdefgh"), (901, 'api_key = "' + "a" * 5000 + '"'), (902, "f" * 5000 + " token: 12345 "), (903, "token=secret1 " * 300)]


def scanned(spark, docs, ledger, **more):
    out = S.scan(docs, ledger, path="doc_id", **more)
    return sorted(((r.doc_id if "doc_id" in r else r.path, [tuple(s) for s in r.spans]) for r in out.collect()), key=str)


def test_spans_equal_brute_force(spark):
    docs = documents(spark, rows())
    got = scanned(spark, docs, S.create_ledger(spark, scratch(spark, "ledger")))
    assert got == sorted(((i, brute_force(t)) for i, t in rows()), key=str)


def ledger_rows(spark, path):
    return sorted((r.blob, r.kind, r.rule_version, len(r.spans)) for r in spark.read.schema(S.LEDGER).parquet(path).collect())


def test_only_unseen_pairs_are_scanned(spark):
    ledger = S.create_ledger(spark, scratch(spark, "ledger"))
    first = documents(spark, [(1, "token = abcdefg"), (2, "token = abcdefg"), (3, None), (3, "")])
    once = scanned(spark, first, ledger)
    pairs = ledger_rows(spark, ledger)
    assert len(pairs) == 2 * len(S.RULES) and scanned(spark, first, ledger) == once and ledger_rows(spark, ledger) == pairs
    more = documents(spark, [(1, "token = abcdefg"), (9, "secret: zzzzzz now")])
    assert [len(s) for _, s in scanned(spark, more, ledger)] == [1, 1] and len(ledger_rows(spark, ledger)) == 3 * len(S.RULES)
    newer = (*S.RULES[:2], dataclasses.replace(S.RULES[2], version=2, pattern="[0-9a-f]{4,}", least=4), S.RULES[3])
    again = scanned(spark, more, ledger, rules=newer)
    added = [p for p in ledger_rows(spark, ledger) if p[2] == 2]
    assert len(added) == 2 and {p[1] for p in added} == {"hex"} and [len(s) for _, s in again] == [2, 1]


def test_documents_with_secrets_go(spark):
    docs = stored(spark, rows())
    out = S.without_secrets(docs, S.create_ledger(spark, scratch(spark, "ledger")))
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id) == sorted((i, t) for i, t in rows() if i and not brute_force(t))


def test_no_rows(spark):
    ledger = S.create_ledger(spark, scratch(spark, "ledger"))
    assert scanned(spark, documents(spark, []), ledger) == [] and ledger_rows(spark, ledger) == []


def test_query_op10(spark):
    same_as_sql(spark, "op10_blob_ledger", "/root/testdata/sf0.01")


def test_native_plan(spark):
    docs = stored(spark)
    plan = S.spans_of(docs.selectExpr("text AS blob", "text", "array('hex') AS kinds"), S.RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
