import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm.cases import LONG, ROWS, SF, documents, rows_of
from vintagerisk.llm import bpe, packing, token_store
from vintagerisk.llm.chunks import LibraryEncoder
from vintagerisk.llm.frames import scratch
from vintagerisk.llm.queries import vocabulary

ODD = [
    "", " ", "  ", "a", "foo  bar \n baz<|endoftext|>  x <|endoftext|>", "  　x  y  z\x1c q", "a" * 4000, "日本語 テキスト😀😀", "= " * 50, "=" * 700,
    "don't  won't\t\t tab", " lead", "trail ", "ΑΣ ΟΔΟΣ. ́x é", "x² y½. a≮b c=. d.́ e'!s _a_ B__ o'.. q.'s", "it's can't!!", "%%% $$$ end.\n\nNext", LONG,
]


def encoded(encoder, texts):
    out = []
    for _, (offsets, ids) in encoder.batches(pa.array(texts, pa.string()), 1 << 12):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def noise(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("aAbt hei nrs  .,'!?%\n\t1²éß日😀") for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    texts = ODD + noise(400, 1)
    known = [e.ids for e in Tokenizer.from_str(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert encoded(LibraryEncoder(vocabulary(name)), texts) == known


def test_backtracking_gives_the_ids_of_merging():
    vocab = vocabulary("byte_bpe_50k.json")
    texts = ODD + noise(1500, 2) + ["aaaaaaaaab" * 40, "ababababa" * 30, "indivisibilities antidisestablishmentarianism" * 3]
    library = Tokenizer.from_str(vocab)
    known = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(bpe.BacktrackingEncoder(vocab), texts) == known
    decode = bpe.OffsetDecoder(vocab)
    assert [decode(np.array(ids, np.int64), 7) for ids in known] == [library.decode(ids, skip_special_tokens=False) for ids in known] == texts
    cut = known[7][:-1]
    assert decode(np.array(cut, np.int64)) == library.decode(cut, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_over_a_line_end_do_not_take_the_whole_path(name):
    encoder = LibraryEncoder(vocabulary(name))
    whole, seen = encoder._whole_path, []
    encoder._whole_path = lambda chunks: [seen.extend(chunks), whole(chunks)][1]
    texts = ["a thannt.\nWhlynt b", "its ÉCLAT!?\nÃñ c", "don't.\n's x-'s.\nY z", "a.\n\nB c", "a²;\nÑandú. z", "a.\n\u0301b q", "a.\nb1 c.\n d", "ß.\n\tK l,m\nn'\nll o", "e.\nÃ\u0303 ÀÖØöøÿ×÷ f", "w>\n\u0338x y>\u0338"]
    assert encoded(encoder, texts) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {" thannt.\nWhlynt", " ÉCLAT!?\nÃñ"} & set(seen)


def test_a_small_memory_changes_nothing():
    vocab = vocabulary("byte_bpe_50k.json")
    small = bpe.BacktrackingEncoder(vocab)
    small.limit = 3
    assert encoded(small, ODD) == encoded(bpe.BacktrackingEncoder(vocab), ODD)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-(2**40), 0, 2**40], list(range(3000)), [k * k for k in range(2000)], [0, 2**62]])
def test_elias_fano_selects_each_value(values):
    code, end = token_store.EliasFano.read(b"xyz" + token_store.EliasFano.of(np.array(values, np.int64)).to_bytes(), 3)
    assert code.select(np.arange(len(values))).tolist() == values and end > 3
    order = np.random.default_rng(1).permutation(len(values))
    assert code.select(order).tolist() == np.array(values, np.int64)[order].tolist()


def test_elias_fano_is_near_the_least_space():
    values = np.sort(np.random.default_rng(2).integers(0, 1_000_000, 20_000))
    assert len(token_store.EliasFano.of(values).to_bytes()) * 8 < 20_000 * (2 + np.log2(50) + 1.0)


def test_a_large_vocabulary_takes_four_bytes_an_id(spark):
    spec = json.loads(vocabulary("byte_bpe_50k.json"))
    end = spec["added_tokens"][0]
    spec["model"]["vocab"] |= {end["content"]: end["id"]} | {f"<spare{k}>": k for k in range(end["id"] + 1, 70_001)}
    spec["added_tokens"].append({**end, "id": 70_000, "content": "<spare70000>"})
    vocab, folder = json.dumps(spec), scratch(spark, "test-large")
    rows = [(1, "one <spare70000> two"), (2, None), (3, "<spare70000>")]
    token_store.write_shards(documents(spark, rows), folder, vocab, end_id=65_536, shards=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read_shards(spark, folder).collect()}
    library = Tokenizer.from_str(vocab)
    assert got == {d: [*library.encode(t or "", add_special_tokens=False).ids, 65_536] for d, t in rows} and got[3][0] == 70_000
    for end, width in ((2, 2), (-1, None), (2, 3)):
        with pytest.raises(ValueError):
            token_store.write_shards(documents(spark, rows), folder, vocab, end_id=end, width=width)
    with pytest.raises(ValueError):
        token_store.width_for(vocabulary("byte_bpe_50k.json"), 1 << 16, 2)
    assert token_store.width_for(vocabulary("byte_bpe_50k.json"), 2) == 2 and token_store.width_for(vocabulary("byte_bpe_50k.json"), 1 << 16) == 4


@pytest.mark.parametrize("rows", [ROWS, [], [(None, None)]])
@pytest.mark.parametrize("width", [2, 4])
def test_token_shards_round_trip(spark, rows, width):
    vocab, folder = vocabulary("byte_bpe_50k.json"), scratch(spark, "test-tokens")
    token_store.write_shards(documents(spark, rows), folder, vocab, end_id=2, width=width, shards=3)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read_shards(spark, folder).collect()]
    library = Tokenizer.from_str(vocab)
    own = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in own]
    assert sorted((str(i), ids) for i, _, ids in got) == sorted((str(i), ids) for i, ids in want)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in want]
    assert [r[1] for r in got] == np.cumsum([0, *(len(r[2]) for r in got)])[: len(got)].tolist()


def whole_documents():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def test_query_op1(spark):
    library, at, want = Tokenizer.from_str(vocabulary("byte_bpe_50k.json")), 0, []
    for i, t in whole_documents():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, entry.queries()["op1_token_shards"](spark, SF).collect())) == want


def test_query_op8(spark):
    library = Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in whole_documents():
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, entry.queries()["op8_backtracking_bpe"](spark, SF).collect())) == want


def test_bpe_operator_keeps_rows_and_columns(spark):
    vocab, docs = vocabulary("byte_bpe_50k.json"), documents(spark)
    out = bpe.decode(bpe.encode(docs, vocab), vocab)
    assert out.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    assert rows_of(out.select("doc_id", "decoded")) == sorted(((i, t or "") for i, t in ROWS), key=str)
    assert rows_of(bpe.recode(docs, vocab)) == rows_of(out)
    assert bpe.decode(bpe.encode(documents(spark, []), vocab), vocab).count() == 0 == bpe.recode(documents(spark, []), vocab).count()


def fewest_bins(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= lengths[k]:
                place(k + 1, [*rooms[:b], rooms[b] - lengths[k], *rooms[b + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_least_number_of_bins():
    r = random.Random(5)
    for _ in range(150):
        capacity = r.choice([7, 10, 12])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 8))]
        bound, least = packing.lower_bound(np.array(lengths, np.int64), capacity), fewest_bins(lengths, capacity)
        assert bound <= least
        bins, _ = packing.best_fit_decreasing(np.array(lengths, np.int64), capacity)
        assert len(set(bins.tolist())) >= least
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4] * 9), 10) == 5


def sequences_hold(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in map(sorted, by.values()):
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    return len(by)


def test_partitions_with_gaps_exchange(spark):
    r = random.Random(3)
    lengths = [r.choice([37, 34, 31, 29, 100, 64, 51, 12]) for _ in range(600)]
    made = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "key long, length long")
    alone = packing._packed(made, 40, 100)
    first = alone.where("length < 100").select("part", "bin").distinct().count() + lengths.count(100)
    out = packing.pack(made, capacity=100, target=40).join(made, "key").collect()
    assert len(out) == 600 and packing.lower_bound(np.array(lengths), 100) <= sequences_hold(out, 100) <= first


def test_pieces_with_small_memories_are_the_same(spark):
    docs, told = documents(spark, ROWS), vocabulary("word_bpe_49k.json")
    listed = lambda **own: sorted((tuple(r)[1:] for r in packing.pieces(docs, told, 0, **own).collect()), key=str)
    assert listed(known=50, slice_bytes=64) == listed()


@pytest.mark.parametrize("rows", [ROWS, [], [(None, None), (None, None)]])
def test_packing_places_every_token(spark, rows):
    vocab = vocabulary("word_bpe_49k.json")
    out = packing.packed_documents(documents(spark, rows), vocab, end_id=0, capacity=64).collect()
    sequences_hold(out, 64)
    library = Tokenizer.from_str(vocab)
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((tuple(r)[:5] for r in [(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out]), key=str) == sorted(want, key=str)


def test_query_op5_is_near_its_bound(spark):
    out = entry.queries()["op5_certified_packing"](spark, SF).collect()
    rest = np.array([r.length for r in out if r.length < 2048])
    least = packing.lower_bound(rest) + sum(r.length == 2048 for r in out)
    assert least <= sequences_hold(out, 2048) <= least + 2
