import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.cases import ROWS, SF, documents, rows_of
from vintagerisk.llm import alignment
from vintagerisk.llm.perfect_hash import PerfectHash

JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def spelled():
    """Bytes of each id, and whole-text encoders, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_str(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    undo = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = 256
    for byte in range(256):
        if byte in printable:
            undo[chr(byte)] = byte
        else:
            undo[chr(spare)] = byte
            spare += 1
    of_a = lambda i: bytes(undo[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    assert decoders
    return a, b, of_a, of_b


def brute(rows):
    a, b, of_a, of_b = spelled()
    coded, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(map(of_a, ia)) != whole or b"".join(map(of_b, ib)) != whole:
            coded.append((doc_id, [], [], [], ""))
            continue
        ends = []
        for ids, of in ((ia, of_a), (ib, of_b)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(of(i))
                out[at] = k
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ia[ends[0][e]], ib[ends[1][e]]) for e in common]
        groups, pa_, pb_ = [], 0, 0
        for e in common:
            na, nb = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ia[pa_:na])) + "|" + ",".join(map(str, ib[pb_:nb])))
            pa_, pb_ = na, nb
        counts.update(links)
        coded.append((doc_id, ia, ib, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        ((d, len(ia), len(ib), len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, ia, ib, ls, sha in coded), key=str
    ), counts


ODD = [(30, " leads"), (31, "two  spaces"), (32, "   "), (33, "tail "), (34, "▁meta▁"), (35, "<s> and <|endoftext|> </s>"), (36, "nul\x00\x07"), (37, "é\né ﬁ\t\tx"), (38, "𝔘nicode ∑ 漢字")]


@pytest.mark.parametrize(("shard_pairs", "group_bytes"), [(1 << 17, 1 << 27), (20, 800)])
def test_documents_and_counts_equal_brute_force(spark, shard_pairs, group_bytes):
    rows = [r for r in ROWS if len(r[1] or "") < 100_000] + ODD
    own = alignment.Alignment(documents(spark, rows).repartition(3), JSON, MODEL, shard_pairs=shard_pairs, group_bytes=group_bytes, fan_in=2)
    want, counts = brute(rows)
    assert rows_of(own.documents()) == want
    assert {(r.a, r.b): r.n for r in own.pair_counts().collect()} == dict(counts)
    assert (len(own.groups) > 1) == (shard_pairs == 20)


def test_query_op11_over_the_whole_table(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(entry.queries()["op11_token_alignment"](spark, SF)) == brute([tuple(r) for r in docs])[0]


def test_no_rows_and_only_unspelt_rows(spark):
    assert rows_of(alignment.Alignment(documents(spark, []), JSON, MODEL).documents()) == []
    assert rows_of(alignment.Alignment(documents(spark, [(None, None), (4, "▁")]), JSON, MODEL).documents()) == sorted([(None, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")], key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 200_000])
def test_perfect_hash_numbers_each_key_once_and_refuses_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    own = PerfectHash.load(**PerfectHash.of(keys).dump())
    assert sorted(own.number(keys).tolist()) == list(range(len(keys)))
    others = keys + (1 << 41)
    assert (own.number(others) == -1).all()
    assert len(own.words) * 64 <= 6 * len(keys) + 64 * 24


def test_piece_encoder_equals_the_library_on_random_spaces():
    import random

    r = random.Random(9)
    texts = ["".join(r.choice(["a", "the", " ", "  ", "\n", "Ünï", ".", "▁", "\t", "word"]) for _ in range(r.randrange(0, 30))) for _ in range(400)]
    own = alignment.PieceEncoder(MODEL, limit=50)
    offsets, ids = own.encode(pa.array(texts))
    for k, t in enumerate(texts):
        if "▁" not in t:
            assert ids[offsets[k] : offsets[k + 1]].tolist() == own.library.encode(t), t
