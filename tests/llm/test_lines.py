import random

from pyspark.sql import functions as F

from folioworks.llm import lines


def brute(rows, least):
    """Deletes the lines of every window (least words or more, as short as can be, from a line on
    or back from one) that an earlier place has."""
    seen, gone = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        parts = (text or "").split("\n")
        full = [(n, p.strip(), len(p.split())) for n, p in enumerate(parts) if p.split()]
        words = lambda s, e: sum(n for _, _, n in full[s:e])
        each = [(s, e) for s in range(len(full)) for e in range(s + 1, len(full) + 1) if words(s, e) >= least and (words(s, e - 1) < least or words(s + 1, e) < least)]
        drop = set()
        for s, e in sorted(each):
            key = tuple(p for _, p, _ in full[s:e])
            if seen.setdefault(key, (i, s)) != (i, s):
                drop.update(range(full[s][0], full[e - 1][0] + 1))
        gone[i] = (None if text is None else "\n".join(p for n, p in enumerate(parts) if n not in drop), len(drop))
    return gone


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool), f"own line {i} {n}", "", "  "]) for n in range(rng.randint(0, 30)))) for i in range(60)]
    passage = "\n".join(f"line {n} of a passage that is shared" for n in range(9))
    rows += [(100 + i, f"before {i}\n{passage}\nafter {i}") for i in range(5)] + [(200, None), (201, ""), (202, rows[3][1]), (203, "x " * 3000), (204, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n_removed": F.lit("old"), "lang": F.lit("en")})
    cut = lines.dedup_lines(docs, least_words=12)
    assert cut.columns == ["doc_id", "text", "runs", "lang", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in cut.collect()} == brute(rows, 12)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[103] == "before 3\nafter 3" and passage in kept[100] and kept[204] == ""


def test_repeats_nulls_and_empty(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.text or "-", r.n_removed) for r in lines.dedup_lines(docs, least_words=5).collect())
    assert got == [(1, text, 0), (1, text, 0), (9, "-", 0), (9, "-", 1)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_a_shared_run_shares_a_fingerprint():
    run = "\n".join(f"w{n} w w" for n in range(8))
    a, b = (lines.marks(f"{x}\n{run}\n{x} {x}".encode(), 20) for x in ("left", "right side"))
    assert {p for p, _ in a} & {p for p, _ in b}
