import hashlib
import os
import tarfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import media as M


@given(st.binary(max_size=300))
def test_form(data):
    p = M.padded(data)
    assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(data) and len(p) - len(data) < 64 + (not data) and not any(p[len(data) :])
    m = M.encode(p)
    assert M.decode(m) == p and M.header(m[:33]) == (64, len(p) // 64, 8)
    with pytest.raises((ValueError, Exception)):
        M.decode(m[:-20])


def test_round_trip(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é", "same", "same", "x" * 500_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "same", "z"), (5, "same", "z")], "doc_id long, text string, digest string")
    got = M.round_trip(df.repartition(3)).collect()
    assert len(got) == 10 and len({tuple(r)[1:] for r in got if r.doc_id in (5, 6, None)}) == 1
    for r in got:
        data = ("same" if r.doc_id is None else texts[r.doc_id] or "").encode()
        p = M.padded(data)
        m = M.encode(p)
        assert tuple(r)[1:7] == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())
        assert r.feature == M.feature(p, 64, len(p) // 64) and (r.width, r.height) == (64, len(p) // 64)
    assert M.round_trip(df.limit(0)).count() == 0


def plain_samples(media):
    """Samples of a PNG by nothing but zlib and a loop over its chunks and lines."""
    at, packed, size = 8, b"", None
    while at < len(media):
        n, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), tuple(body[8:13])
        if kind == b"IDAT":
            packed += body
        at += 12 + n
    width, height, form = size
    assert form == (8, 0, 0, 0, 0)  # 8 bits, gray, no interlace
    lines = zlib.decompress(packed)
    out = b""
    for y in range(height):
        line = lines[y * (width + 1) : (y + 1) * (width + 1)]
        assert line[0] == 0  # no filter
        out += line[1:]
    return out, width, height


def test_whole_table_by_plain_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = M.round_trip(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        with open(tmp_path / "media" / r.shard, "rb") as f:
            f.seek(r.offset)
            media = f.read(r.media_bytes)
        data = texts[r.doc_id].encode()
        samples, width, height = plain_samples(media)
        assert samples[: len(data)] == data and not any(samples[len(data) :]) and len(samples) == r.payload_bytes == max(64, -(-len(data) // 64) * 64)
        assert r.n_bytes == len(data) and r.payload_sha256 == hashlib.sha256(samples).hexdigest() and r.tail_crc32 == zlib.crc32(samples[-64:]) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        mean = sum(samples) / len(samples)
        deviation = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
        size, m, sd, hist = r.feature.split(" ")
        assert size == f"{width}x{height}" and float(m[5:]) == pytest.approx(mean, abs=1e-4) and float(sd[3:]) == pytest.approx(deviation, abs=1e-4)
        assert [int(x) for x in hist[5:].split(",")] == [sum(1 for x in samples if x // 16 == k) for k in range(16)]


def test_shards_are_tar(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 7}" * 50) for i in range(30)], "doc_id long, text string")
    rows, objects = M.media_table(df, str(tmp_path / "m"))
    found = {r.digest.hex(): r for r in objects.collect()}
    assert rows.count() == 30 and len(found) == 7
    members = {}
    for f in os.listdir(tmp_path / "m"):
        with tarfile.open(tmp_path / "m" / f) as t:
            for x in t:
                members[f, x.offset_data] = (x.name, x.size, t.extractfile(x).read())
    for d, r in found.items():
        name, size, data = members[r.shard, r.offset]
        assert name == f"{d[:2]}/{d}.png" and size == r.length and hashlib.sha256(data).hexdigest() == d
    assert {tuple(r)[1:] for r in M.inspect(objects, str(tmp_path / "m")).collect()} == {(64, 5, 8)}
