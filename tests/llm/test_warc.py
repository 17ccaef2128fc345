import gzip
import hashlib
import json
import zlib

from tests.llm.cases import same_as_sql
from vintagerisk.llm import warc
from vintagerisk.llm.files import locate, whole
from vintagerisk.llm.frames import scratch

BIG, OTHER = "<p>é" + "x" * 1200, "y" * 1000
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a/3\r\nEvil: 1 ü", OTHER), (4, "", OTHER), (4, "http://a/4", OTHER), (5, "u", "z" * 999), (6, "u", "z" * 999),
    (7, "u", None), (8, "u", ""), (None, "u", "n" * 1500), (None, "u", "n" * 1500), (None, "v", BIG), (10, "u", "a\r\n\r\nb" * 400), (11, "u", "WARC/1.1\r\n" * 50_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, record int, file string").repartition(3)


def archived(spark, rows=PAGES):
    crawl, archive = scratch(spark, "test-crawl"), scratch(spark, "test-warc")
    files = warc.normalise(spark, crawl, warc.revisits(warc.write_monolithic(pages(spark, rows), crawl)), archive)
    return crawl, archive, files


def test_round_trip_with_revisits(spark):
    crawl, archive, files = archived(spark)
    got = warc.read_archives(spark, archive, files).collect()
    assert len(got) == len(PAGES)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), sha(t)) for i, _, t in PAGES)
    of = lambda t: [r for r in got if r.payload_digest == sha(t)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in of(BIG)} == {(9, "response", None), (1, "revisit", 9), (2, "revisit", 9), (None, "revisit", 9)}
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in of(OTHER)) == [(3, "revisit", 4), (4, "response", 0), (4, "revisit", 4)]
    assert sorted((r.record_type, r.refers_to) for r in of("n" * 1500)) == [("response", None), ("revisit", None)]
    assert {r.record_type for r in of("z" * 999) + of("")} == {"response"}
    assert {r.url for r in got if r.page_id == 3} == {"http://a/3%0D%0AEvil:%201%20ü"}


def test_normalised_files_have_a_member_per_record(spark):
    crawl, archive, files = archived(spark)
    for r in files.collect():
        before, after = whole(f"{crawl}/{r.file}"), whole(f"{archive}/{r.file}")
        one = zlib.decompressobj(31)
        one.decompress(before)
        assert one.eof and not one.unused_data, "the crawl is one stream"
        entries = [json.loads(x) for x in whole(f"{archive}/{r.file}.idx").splitlines()]
        assert len(entries) == r.records and sum(n for _, _, n in entries) == len(after) == r.bytes
        for number, at, size in entries:
            member = gzip.decompress(after[at : at + size])
            assert member.startswith(b"WARC/1.1\r\n") and (number is None or f"<urn:page:{number}>".encode() in member)
        texts = list(warc.records(iter([gzip.decompress(after)])))
        assert len(texts) == r.records


def test_streams_in_any_parts(spark):
    records = [warc.response(k, f"u{k}", bytes([65 + k]) * (k * 300)) for k in range(5)]
    packed = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    want = [(h["WARC-Record-ID"], body) for h, body in warc.records(iter(records))]
    for step in (1, 7, 100, 10**6):
        parts = (packed[k : k + step] for k in range(0, len(packed), step))
        assert [(h["WARC-Record-ID"], body) for h, body in warc.records(warc.inflated(parts))] == want


def test_no_pages(spark):
    _, archive, files = archived(spark, [])
    assert files.count() == 0 and warc.read_archives(spark, archive, files).count() == 0


def test_files_of_failed_attempts_do_not_stay(spark, tmp_path):
    import pytest

    from vintagerisk.llm.files import replacing

    with pytest.raises(RuntimeError), replacing(f"{tmp_path}/a/b.bin") as out:
        out.write(b"half")
        raise RuntimeError
    assert list((tmp_path / "a").iterdir()) == []
    assert locate(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x" == locate(f"file:{tmp_path}/x")[1]


def test_query_op6(spark):
    same_as_sql(spark, "op6_warc_normaliser")
