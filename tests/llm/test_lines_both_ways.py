import random

from folioworks.llm import lines


def brute(rows, least):
    """Deletes every line of every run of ``least`` words or more that an earlier place has,
    compared place by place and line by line."""
    places, parts = [], {}
    for i, text in sorted(rows):
        parts[i] = text.split("\n")
        full = [(n, p.strip(), len(p.split())) for n, p in enumerate(parts[i]) if p.split()]
        places += [(i, s, full) for s in range(len(full))]
    drop = {i: set() for i in parts}
    for k, (i, s, later) in enumerate(places):
        for _, r, earlier in places[:k]:
            n = words = 0
            while s + n < len(later) and r + n < len(earlier) and later[s + n][1] == earlier[r + n][1]:
                words += later[s + n][2]
                n += 1
            if words >= least:
                drop[i].update(range(later[s][0], later[s + n - 1][0] + 1))
    return {i: ("\n".join(p for n, p in enumerate(ps) if n not in drop[i]), len(drop[i])) for i, ps in parts.items()}


def cut(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs, least_words=least).collect()}


def test_equals_line_by_line(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool), rng.choice(pool), f"own {i} {n}", "", " "]) for n in range(rng.randint(0, 24)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + "\nmore"), (102, "same line\n" * 20)]
    got = cut(spark, rows, 12)
    assert got == brute(rows, 12)


def test_copies_leave_no_stub(spark):
    text = "\n".join(f"line {n} of a text that is copied whole" for n in range(9)) + "\nits short last line"
    got = cut(spark, [(1, text), (2, text), (3, f"before\n{text}\nafter")], 20)
    assert got == {1: (text, 0), 2: ("", 10), 3: ("before\nafter", 10)}


def test_no_stub_of_a_copy_in_the_given_table(spark):
    from folioworks.llm.words import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    first: dict[str, int] = {}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    copies = {i for i, t in rows if first.setdefault(t, i) != i and len(t.split()) >= lines.LEAST_WORDS}
    left = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert len(copies) > 60 and not [i for i in copies if left[i].strip()]
