import gzip
import hashlib
import os
from decimal import Decimal

import pytest

from folio.llm import warc as W
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

LONG = "é\r\n\r\nWARC/1.1\r\n" * 100


def rows():
    return [
        (1, "http://a.example/x?q=1#f", LONG), (2, "https://b.example", LONG), (3, "no scheme", None), (4, None, ""), (5, "http://c/ sp ace", "short"),
        (6, "http://c/", "short"), (7, "http://d/", "\r\n\r\n"), (8, "http://e/", LONG + "x"), (2, "https://b.example", LONG), (None, "http://n/", LONG), (None, "http://n/", "y" * 1000), (None, "http://n/", "y" * 1000), (9, "u", "nul\0" * 400),
    ]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in rows()], "page_id long, url string, html string, size string")
    got = sorted(map(tuple, W.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in rows():
        b = (h or "").encode()
        again = len(b) >= 1000 and h == LONG and i != 2
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert W.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_nested_rows_and_files(spark, tmp_path, bound, monkeypatch):
    monkeypatch.setattr(W, "HOLDER_ROWS", bound)
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    W.write(df, str(tmp_path / "w"), max_records=10)
    files = sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".txt"))
    assert len(files) == 4
    os.mkdir(tmp_path / "z")
    for f in files:
        data = (tmp_path / "w" / f).read_bytes()
        found = list(W.parse(data))
        assert len(found) <= 10
        cut = len(data) // 2
        with pytest.raises(ValueError):
            list(W.parse(data[:cut]))
        (tmp_path / "z" / f"{f}.warc.gz").write_bytes(gzip.compress(data))
    for d in ("w", "z"):
        got = W.assemble(W.read(spark, str(tmp_path / d))).collect()
        assert len(got) == len(rows())
        by = sorted((r.metadata.fields, r.response.type, bytes(r.response.payload or b"")) for r in got)
        want = sorted((f"row: {'' if i is None else i}\r\n", "revisit" if h == LONG and i != 2 else "response", b"" if h == LONG and i != 2 else (h or "").encode()) for i, _, h in rows())
        assert by == want
        first = next(r for r in got if r.metadata.fields == "row: 1\r\n")
        assert first.request.http.startswith("GET /x?q=1 HTTP/1.1\r\nHost: a.example") and first.response.refers_to == next(r.response.record_id for r in got if r.metadata.fields == "row: 2\r\n")


def test_ids_of_any_type(spark):
    for kind, ids in (("string", ["a b", "", None, "x\r\nrow: 7", "%41", "é+", "7"]), ("int", [3, None, -1]), ("decimal(30,2)", [Decimal("5.25"), None])):
        df = spark.createDataFrame([(i, "u", "p") for i in ids] + [(i, "u", "y" * 1000) for i in ids], f"page_id {kind}, url string, html string")
        got = W.round_trip(df)
        assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == kind
        top = max(i for i in ids if i is not None)
        want = [(i, 1, "response", None) for i in ids] + [(i, 1000, "response" if i == top else "revisit", None if i == top else top) for i in ids]
        assert sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got.collect()], key=str) == sorted(want, key=str)


def test_long_payloads_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "CLASSES", ((1000, 30), (10_000, 6), (1 << 31, 3)))
    sizes = [10] * 20 + [5000] * 6 + [50_000] * 3 + [1000, 1001, 10_000]
    df = spark.createDataFrame([(i, "http://a/", str(i).ljust(n, "x")) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    W.write(df, str(tmp_path / "w"))
    held = [len((tmp_path / "w" / f).read_bytes()) for f in os.listdir(tmp_path / "w") if f.endswith(".txt")]
    assert max(held) < 60_000 and len(held) == 3 + 4 + 3
    got = W.resolve(W.assemble(W.read(spark, str(tmp_path / "w"), payload=False))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted(enumerate(max(n, len(str(i))) for i, n in enumerate(sizes)))


def test_sql(spark):
    assert compare(spark, "op7_warc", "/root/testdata/sf0.01", QUERIES, ORACLE_SQL) == 250
