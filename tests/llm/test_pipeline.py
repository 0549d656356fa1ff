import random

import corpus_pipeline as P
from folio.llm._shared import materialise, scratch, shared_dir


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([3, 4, 5, 6, 7]))) for _ in range(4000)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = say(70)
    rows, kind = [], []

    def add(words, what):
        rows.append((len(rows), " ".join(words), rnd.choice(["en", "de"]), rnd.choice(["s1", "s2"]), 0))
        kind.append(what)

    for i in range(80):
        t = say(rnd.choice([60, 150, 400]))
        add(t, "clean")
        if i % 10 == 0:
            add(t, ("copy", len(rows) - 1))
            if len(t) > 100:
                near = list(t)
                near[40] = "zzzz"
                add(near, ("copy", rows[-1][0] - 1))
        if i % 10 == 3:
            add([w + "###" for w in say(100)], "junk")
        if i % 10 == 5:
            add(say(10), "short")
        if i % 10 == 7:
            add([*say(60), *passage, *say(60)], "passage")
    rows.append((len(rows), None, "en", "s1", 0))
    kind.append("short")
    return [(*r[:4], len(r[1] or "")) for r in rows], kind, " ".join(passage)


def test_stages(spark):
    rows, kind, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = docs.columns
    out = P.quality_rules(spark, docs, "")
    want = [i for i, k in enumerate(kind) if k not in ("junk", "short")]
    assert out.columns == names and sorted(r.doc_id for r in out.collect()) == want
    out = P.near_dedup(spark, out, "")
    want = [i for i in want if kind[i] in ("clean", "passage")]
    assert out.columns == names and sorted(r.doc_id for r in out.collect()) == want
    out = P.substring_dedup(spark, out, "")
    left = {r.doc_id: r for r in out.collect()}
    assert out.columns == names and sorted(left) == want
    holders = [i for i in want if kind[i] == "passage"]
    for i in want:
        if i in holders[1:]:
            assert passage not in left[i].text and left[i].n_chars == len(left[i].text)
            assert abs(len(left[i].text.split()) - 120) <= 2
        else:
            assert left[i].text == rows[i][1]
    packed = P.best_fit_packing(spark, out, "").collect()
    assert {r.doc_id for r in packed} == set(want)


def test_run_holds_every_row_of_each_stage(spark):
    """On a whole table: what each stage keeps, and all tokens of what is left, found again in the result."""
    from tokenizers import Tokenizer

    from folio.llm import quality, simhash
    from folio.llm.tokens import vocabulary

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    one = P.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == kept and one.count() == len(kept) > 100
    groups = simhash.similar_groups(one).collect()
    two = P.near_dedup(spark, one, sf)
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in groups})
    three = P.substring_dedup(spark, two, sf).collect()
    before = {r.doc_id: r.text for r in two.collect()}
    assert {r.doc_id for r in three} == set(before)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in three}
    for r in three:
        left = iter(before[r.doc_id])
        assert all(c in left for c in r.text)  # what is left stood there in this order
    tokens, sequences = {}, {}
    out = P.run(spark, sf)
    for r in out.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert tokens == want and [len(P.STAGES), P.ORACLE_SQL] == [4, None]
    for x in sequences.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 4096


def test_runs_leave_each_other_alone(spark):
    """Two runs, stage by stage in turn, and a third as a whole: every result can still be read at the end."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, seen = [docs, docs.where("lang = 'en'")], []
    for _, stage in P.STAGES:
        state = [stage(spark, d, sf) for d in state]
        seen += [(d, d.count()) for d in state]
    whole = P.run(spark, sf)
    n = whole.count()
    again = P.run(spark, sf)
    assert again.count() == n == whole.count() == state[0].count()
    assert all(d.count() == c for d, c in seen)


def test_a_run_leaves_only_what_its_result_reads(spark):
    def tables():
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folio")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {f.getPath().getName() for f in fs.listStatus(root)}

    materialise(spark.range(1), "some")
    before = tables()
    with scratch(spark):
        out = P.run(spark, "/root/testdata/sf0.001")
        n = materialise(out, "packed", outlives=True)
        left = tables() - before
        assert {x.rsplit("-", 1)[0] for x in left} <= {"pieces", "packed", "substring-dedup", "shards", "sequences"} and out.count() == n.count()
    assert {x.rsplit("-", 1)[0] for x in tables() - before} == {"packed"} and n.count() > 0
