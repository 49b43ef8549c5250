"""The pipeline on a small table, stage by stage and as a whole."""

from __future__ import annotations

import corpus_pipeline
import pytest

from gramwise.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(spark, make, prose, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    base = prose(60, 120, 71)
    item = prose(1, 30, 72, ("qua", "zet", "wyn"))[0]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i] + " end") for i in range(10)] + [(200, base[0]), (0, base[0])]
    rows += [(300, base[20] + " " + item + " " + base[21]), (301, base[30][:300] + " token = abcdef123456 " + base[31][:300]), (302, None), (303, "12 34"), (None, base[40] + " x"), (None, base[40] + " x")]
    docs = make(rows, {i: "aa" for i in range(60)}, extra=False)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, tables), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert {302, 303}.isdisjoint(ids["language"]) and {r["lang"] for r in kept["language"]} == {"aa"}
    near = ids["near_copies"]
    assert {200, *range(100, 110)}.isdisjoint(near) and near.count(0) == 1 and set(range(40)) <= set(near)
    # The document without an id, near to one with an id, goes with its group.
    assert near.count(None) == 0
    assert set(near) - set(ids["benchmark_leaks"]) == {300}
    texts = {r["doc_id"]: r for r in kept["secrets"]}
    assert "[SECRET]" in texts[301]["text"] and "abcdef123456" not in texts[301]["text"] and texts[301]["n_chars"] == len(texts[301]["text"])
    assert ids["secrets"] and sorted(map(str, ids["secrets"])) == sorted(map(str, ids["benchmark_leaks"]))


def test_near_copies_of_rows_without_an_id_and_with_one_id(spark, make, prose):
    base = prose(6, 80, 73)
    rows = [(None, base[0]), (None, base[0] + " x"), (7, base[1]), (7, base[2]), (3, base[2] + " y"), (7, base[1]), (9, ""), (9, ""), (None, None), (4, base[3])]
    kept = corpus_pipeline.drop_near_copies(spark, make(rows, extra=False), "").collect()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept)
    one = min(base[0], base[0] + " x")
    assert [t for t in texts if not t[0]] == sorted([(False, 3, base[2] + " y"), (False, 4, base[3]), (False, 7, base[1]), (False, 9, "")])
    assert len([t for t in texts if t[0]]) == 2 and {t[2] for t in texts if t[0]} <= {"", one, base[0] + " x"}


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {"sequence_id", "offset", "doc_id"} <= set(rows[0].asDict())
    assert sum(r["length"] for r in rows if r["start"] == 0) > 0 and 300 not in {r["doc_id"] for r in rows}


def test_run_of_empty_table(spark, make, tables, tmp_path):
    make([], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
