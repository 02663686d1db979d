"""What the steps of the method decide, seen in the registered query."""

import pytest

from folioworks.llm import lines, queries

LONG = [f"line {n} of a passage that several texts share in full" for n in range(12)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows = [(i, "\n".join([f"head of {i} alone", *LONG, f"tail of {i}"])) for i in range(4)] + [(9, "a text of its own")]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def removed(spark, sf):
    return {r.doc_id: r.n_removed for r in queries.QUERIES["op1_line_dedup"](spark, sf).collect()}


def test_whole_run_goes(spark, sf):
    assert removed(spark, sf) == {0: 0, 1: 12, 2: 12, 3: 12, 9: 0}


def test_without_fingerprints_nothing_goes(spark, sf, monkeypatch):
    monkeypatch.setattr(lines, "marks", lambda *_: [])
    assert set(removed(spark, sf).values()) == {0}


def test_other_lines_as_fingerprints_lose_the_guarantee(spark, sf, monkeypatch):
    whole = lines.marks
    monkeypatch.setattr(lines, "marks", lambda data, *rest: [(hash((p, data)), m) for p, m in whole(data, *rest)])
    assert set(removed(spark, sf).values()) == {0}


def test_without_extension_only_fingerprints_remain(spark, sf, monkeypatch):
    monkeypatch.setattr(lines, "extended", lambda own, at, around, offset: (at, at + 1))
    own = [lines._signed(d) for d in lines.full_lines("\n".join(LONG).encode())[2]]
    anchors = [m[:3] for _, m in lines.marks("\n".join(LONG).encode())]
    assert lines.repeated_lines("\n".join(LONG).encode(), anchors) == []
    monkeypatch.undo()
    assert {n for s, e in lines.repeated_lines("\n".join(LONG).encode(), anchors) for n in range(s, e + 1)} == set(range(len(own)))


def test_runs_end_where_lines_differ():
    assert lines.extended([1, 2, 3, 4, 5], 2, [9, 2, 3, 4, 8], 2) == (1, 4)
    assert lines.extended([1, 2, 3], 0, [7, 1, 2], 1) == (0, 2)
    assert lines.extended([1], 0, [2], 0) == (0, 0)
