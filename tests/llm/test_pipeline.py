import corpus_pipeline as C
from driftwake.llm import decontaminate, quality
from tests.llm import cases
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_lines import brute as line_dedup
from tests.llm.test_jaccard import brute as similar


def write(spark, home, docs):
    spark.createDataFrame(docs, cases.SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    labels = [(r[0], int(not (r[1] or "").startswith("bad"))) for r in docs if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, cases.prose(12, 42)[20:150]), (2, "never said here")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")


def corpus():
    good = [(i, cases.prose(i % 25 + 10, 40 + i % 25), "en", "s", 1) for i in range(60)]
    bad = [(100 + i, "bad " * (20 + i) + "spam spam %%%", "en", "s", 1) for i in range(30)]
    return good + bad + [(200, good[3][1] + " more", "en", "s", 1), (201, None, None, None, None), (202, "", "en", "s", 0), (None, "no id at all here", "en", "s", 1)]


def test_each_stage_on_all_its_input(spark, tmp_path):
    home = str(tmp_path)
    write(spark, home, corpus())
    docs = spark.read.parquet(f"{home}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(C.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, home).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
        after = [tuple(r) for r in docs.collect()]
        if i < 4:
            assert docs.columns == columns
        if name == "quality":
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert set(range(100, 130)) <= gone and not gone & set(range(60))
        if name == "lines":
            order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in before}, key=lambda r: r[:2])
            assert sorted((r[:2] for r in after), key=str) == sorted(((k[1] if k[0] else None, t[1]) for k, t in zip(order, line_dedup([(k[1], k[2]) for k in order]))), key=str)
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
        if name == "near_dedup":
            known = [(i, r[1]) for i, r in enumerate(before)]
            assert len(after) == len(similar(known))
        if name == "decontaminate":
            items = [(1, cases.prose(12, 42)[20:150]), (2, "never said here")]
            told = contamination([(r[0], r[1]) for r in before], items)
            assert any(t[5] for t in told) and sorted((r[0] for r in after), key=str) == sorted((t[0] for t in told if not t[5]), key=str)
        if name == "pack":
            assert {r[0] for r in after} == {r[0] for r in before}
    got = sorted(map(tuple, C.run(spark, home).select("doc_id", "start", "length", "ids_crc32").collect()), key=str)
    assert got == sorted(((r[0], r[1], r[2], r[3]) for r in after), key=str)


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert C.run(spark, str(tmp_path)).collect() == []


def test_stages_are_the_operators():
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_dedup", "decontaminate", "pack"]
    assert quality.KEEP == 0.7 and decontaminate.WINDOW == 10


def test_columns_that_clash(spark, tmp_path):
    write(spark, str(tmp_path), corpus())
    docs = cases.frame(spark, corpus())
    columns = docs.columns
    assert {"score", "n_lines", "row"} <= set(columns)
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    rows = docs.collect()
    assert rows and all(r.score == r.n_lines == r.w == "clash" for r in rows)
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)
