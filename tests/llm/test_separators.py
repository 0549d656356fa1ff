import numpy as np
import pytest

from folio.llm import separators as S


def plain(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [4, 10, 1000])
def test_counts(spark, tmp_path, block):
    rnd = np.random.default_rng(3)
    files = {"a.bin": rnd.integers(0, 4, 200), "b.bin": np.zeros(50, int), "c.bin": np.ones(30, int), "d.bin": np.zeros(0, int), "e.bin": np.array([1] * 77 + [0])}
    for n, ids in files.items():
        (tmp_path / n).write_bytes(ids.astype("<u2").tobytes())
    got = sorted(map(tuple, S.counts(spark, str(tmp_path), end=0, block=block).collect()))
    assert got == sorted((n, *x) for n, ids in files.items() for x in plain(ids.tolist(), 0))


def test_wide_ids_and_bad_length(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(np.array([70000, 5, 70001, 70001], "<u4").tobytes())
    assert sorted(r.n_tokens for r in S.counts(spark, str(tmp_path), end=70001, width=4, block=8).collect()) == [0, 2]
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="3 bytes"):
        S.counts(spark, str(tmp_path))


def test_files_of_failed_tasks(spark, tmp_path, monkeypatch):
    """A file that no row names, cut within an id, changes nothing."""
    monkeypatch.setattr(S, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "tokens-000000-99.bin").write_bytes(b"\0" * 9)
    df = spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in S.count_documents(df).collect()) == [0, 2]


def test_documents(spark):
    texts = [None, "", "one two", "<|endoftext|> kept as text", "Straße 😀 " * 3000, "one two"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q", 1)], "doc_id long, text string, file int")
    enc = S._byte_bpe("byte_bpe_50k.tiktoken")
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)} | {None: 1}
    got = S.count_documents(df.repartition(3)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == 7
    assert S.count_documents(df.limit(0)).count() == 0
