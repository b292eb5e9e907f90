"""ZIP packages and WARC records."""

import hashlib
import io
import zipfile

import pytest

from vectorloom.llm import archive
from vectorloom.operators.sizing import settle_as_table

PAYLOADS = [
    (3, "x" * 120),
    (1, "x" * 120),
    (2, "short"),
    (4, "short"),
    (5, None),
    (6, ""),
    (7, "é\r\n\r\nWARC/1.1\r\n" * 60),
    (None, "x" * 120),
    (8, "y" * 100_000),
    (8, "y" * 100_000),
    (None, "z" * 200),
    (None, "z" * 200),
]


def wanted():
    raw = [(k, (p or "").encode()) for k, p in PAYLOADS]
    out = []
    for key, payload in raw:
        ids = [k for k, p in raw if p == payload and k is not None]
        first = min(ids) if ids and len(payload) >= 100 else None
        again = first is not None and key != first
        digest = hashlib.sha256(payload).hexdigest()
        out.append((key, len(payload), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("package_bytes", [1, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, package_bytes):
    rows = [(k, p, f"http://a b/{k}\n", "clash", 1) for k, p in PAYLOADS]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, digest string, key int").repartition(3)
    plan = archive.plan_records(pages, "page_id", "html", "url")
    packages = settle_as_table(archive.write_packages(plan, str(tmp_path / "p"), package_bytes), "packages")
    found = archive.read_records(archive.locate(packages, 2)).collect()
    got = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == wanted()
    texts = {k: (p or "").encode() for k, p in PAYLOADS}
    assert all(bytes(r["payload"]) == (texts[r["key"]] if r["record_type"] == "response" else b"") for r in found if r["key"])
    assert archive.write_packages(plan.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_reader_agrees_with_another(tmp_path, zip64):
    members = [("archive/data.warc", b"abc" * 1000), ("indexes/index.tsv", b""), ("ünï", b"1")]
    path = tmp_path / "a.zip"
    with open(path, "wb") as sink:
        archive.write_zip(sink, members, zip64)
    with zipfile.ZipFile(path) as other:
        assert other.testzip() is None and [(n, other.read(n)) for n in other.namelist()] == members
    with archive.ZipReader(str(path)) as reader:
        found = reader.members()
        for name, data in members:
            assert reader.fetch(reader.data_start(found[name]), found[name].size) == data


def test_reader_of_foreign_and_broken_files(tmp_path):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as other:
        other.comment = b"PK\x05\x06 in a comment"
        other.writestr("s", b"stored")
        other.writestr("d", b"deflated" * 99, zipfile.ZIP_DEFLATED)
    path = tmp_path / "b.zip"
    path.write_bytes(made.getvalue())
    with archive.ZipReader(str(path)) as reader:
        found = reader.members()
        assert reader.fetch(reader.data_start(found["s"]), 6) == b"stored"
        with pytest.raises(ValueError):
            reader.data_start(found["d"])
        with pytest.raises(ValueError):
            reader.fetch(reader.size - 1, 2)
    path.write_bytes(made.getvalue()[:40])
    with archive.ZipReader(str(path)) as reader, pytest.raises(ValueError):
        reader.members()


def test_records_are_checked():
    raw = archive.warc_record(1, None, b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert archive.parse_record(raw)[-1] == b"abc"
    with pytest.raises(ValueError):
        archive.parse_record(raw.replace(b"abc\r\n", b"abd\r\n"))
    with pytest.raises(ValueError):
        archive.parse_record(raw[3:])


def test_ranges_join_neighbours():
    got = list(archive.ranges([100, 0, 50, 10_000], [10, 50, 50, 5], gap=64))
    assert got == [(0, 110, [1, 2, 0]), (10_000, 5, [3])]


@pytest.mark.parametrize("max_rows", [0, 1, 2, 3])
def test_repeated_payloads_beyond_the_broadcast(spark, max_rows):
    rows = [(k, f"{k % 7}" * (90 + k % 7 * 4)) for k in range(60)] + [(None, "3" * 102), (100, None), (101, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    plan = archive.plan_records(pages, "page_id", "html", None, max_rows=max_rows)
    got = {(r["key"], len(r["payload"]), r["refers_to"]) for r in plan.collect()}
    whole = archive.plan_records(pages, "page_id", "html", None)
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert (None, 102, 3) in got and (10, 102, 3) in got and (3, 102, None) in got and (101, 0, None) in got
    assert plan.count() == len(rows)
