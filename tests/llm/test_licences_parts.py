"""More templates than one scan takes are scanned in parts, with the same result."""

from folioworks.llm import licences


def test_parts_find_the_same(spark, monkeypatch):
    notices = [(f"own {i}", " ".join(f"word{i}x{j}" for j in range(9))) for i in range(12)] + [("short", "too short"), ("null", None)]
    templates = spark.createDataFrame(notices, "licence string, notice string")
    docs = spark.createDataFrame([(i, f"before {n} after" if n else n) for i, (_, n) in enumerate(notices)] + [(99, notices[0][1] + " and " + notices[5][1])], "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.licences) for r in rows)
    whole = key(licences.licence_report(docs, templates).collect())
    assert whole[:12] == [(i, f"own {i}") for i in range(12)] and whole[-1] == (99, "own 0,own 5")
    monkeypatch.setattr(licences, "MOST_BAND_VALUES", 120)
    assert len(licences._parts(spark, templates)) > 2
    assert key(licences.licence_report(docs, templates).collect()) == whole
    assert {r.licence for r in licences.scan_licences(docs, templates).collect()} == {f"own {i}" for i in range(12)}
    assert licences.licence_report(docs, templates.limit(0)).count() == docs.count()
