"""The pipeline's stages, each on its own input, on a small corpus with planted cases."""

import random

import brute
import pytest

import corpus_pipeline
from folioworks.llm import bpe, toxicity
from folioworks.llm.queries import VOCABULARY

WORDS = "river stone house bread morning light garden paper window street winter music copper meadow harbour lantern".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 15)))
    passage = "\n".join(f"shared passage {n} " + line() for n in range(6))
    rows, labels = [], []
    for i in range(400):
        lines = [line() for _ in range(rng.randint(4, 10))]
        toxic = int(i % 5 == 0)
        if toxic:
            lines.insert(1, "you worthless idiot and pathetic moron you " + line())
        if i % 40 == 1:
            lines.append(passage)
        rows.append((i, "\n".join(lines), "en", f"src{0 if i % 3 else i % 4}"))
        labels.append((i, 1, toxic))
    rows += [(1000 + n, rows[2][1], "en", "src0") for n in range(20)] + [(2000 + n, rows[3][1].replace("\n", f" near{n}\n", 1), "en", "src1") for n in range(5)] + [(3000, "", "en", "src0"), (3001, None, None, None)]
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {i: t for i, t, *_ in rows}, {i for i, _, y in labels if y}


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf[0]}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf[0])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        rows = after.collect()
        out.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_toxic_go_and_clean_stay(stages, sf):
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    assert not kept & sf[2] and {r.doc_id for r in before} - sf[2] <= kept
    assert all(r.text == sf[1][r.doc_id] for r in after)


def test_lines(stages):
    from test_lines import brute as plain

    before, after = stages[1]
    wanted = plain([(r.doc_id, r.text) for r in before], 20)
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, _) in wanted.items()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_one_of_each_class(stages):
    before, after = stages[2]
    prints = {r.doc_id: brute.simhash(r.text) for r in before}
    classes = brute.classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))


def test_mix(stages):
    from test_mixing import targets

    before, after = stages[3]
    size = {r.doc_id: len((r.text or "").split()) for r in before}
    of, taken = {}, {}
    for r in before:
        of[r.source] = of.get(r.source, 0) + size[r.doc_id]
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for s, t in targets(of).items():
        assert abs(taken.get(s, 0) - t) <= 160


def test_ids(stages):
    before, after = stages[4]
    own = bpe.load(VOCABULARY)
    key = lambda rows: sorted(rows, key=lambda r: (r[0], r[1]))
    assert key((r.doc_id, bytes(r.ids)) for r in after) == key((r.doc_id, own.encode(r.text or "")) for r in before)


def test_run(spark, sf, stages):
    assert corpus_pipeline.ORACLE_SQL is None and toxicity.CUT == 0.3
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf[0]).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in stages[4][1])
