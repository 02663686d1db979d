import random
import re

from pyspark.sql import functions as F

from folioworks.llm import licences


def shingles(text):
    words = re.findall(r"[^\W_]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text, templates=licences.TEMPLATES):
    grams, found = shingles(text), set()
    for name, notice in templates.items():
        wanted = shingles(notice)
        reach = len(wanted) // 4 + 1
        for start in range(-len(wanted), len(grams) + 1):
            there = set(grams[max(0, start - reach) : max(0, start + len(wanted) + reach)])
            if len(there & set(wanted)) >= 0.8 * len(set(wanted)):
                found.add(name)
                break
    return ",".join(sorted(found))


def texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("river stone house bread morning under the license and of to".split()) for _ in range(n))
    out = [None, "", "MIT", "Released under the MIT License", "Released under the\nMIT-License. Yes", filler(3000)]
    for notice in licences.TEMPLATES.values():
        for shift in range(3):
            out.append(f"{filler(10 + shift)} {notice} {filler(7)}")
        words = notice.split()
        out.append(" ".join(w if n % 30 else "changed" for n, w in enumerate(words, 1)))
        out.append(" ".join(w if n % 4 else "changed" for n, w in enumerate(words, 1)))
    return out + [out[8] * 40, out[7]]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (3, rows[3][1]), (None, rows[3][1])], "doc_id long, text string").withColumns({"key": F.lit("clash"), "words": F.lit(1), "n": F.lit(1)})
    got = licences.licence_report(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.licences == brute(rows[3 if r.doc_id is None else r.doc_id][1]), r.doc_id
        assert r.n_licences == len([x for x in r.licences.split(",") if x])
    assert licences.licence_report(docs.limit(0)).count() == 0


def test_places_and_own_templates(spark):
    own = spark.createDataFrame([("own", "one two three four five six seven"), ("short", "too short")], "licence string, notice string")
    docs = spark.createDataFrame([(1, "x y z one two three four five six seven"), (2, "too short")], "doc_id long, text string")
    found = licences.scan_licences(docs, own).where("containment = 1").collect()
    assert 3 in {r.start for r in found} and {(r.id, r.licence) for r in found} == {(1, "own")}


def test_no_python_in_the_plan(spark):
    plan = licences.licence_report(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
