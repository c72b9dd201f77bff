import duckdb
import pytest

from kiloqueue.llm import mixing, quality_rules
from kiloqueue.llm.common import read
from tests.conftest import SF
from tests.llm import brute
from tests.llm.tables import documents, edge_rows, empty, rows


def test_mix_equals_sql_on_edge_rows(spark, tmp_path):
    docs = documents(spark, edge_rows())
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    want = sorted(con.execute(mixing.MIX_SQL).fetchall(), key=str)
    assert got == want
    assert all(t == 0 for *_, size, _, _, t in got if size == 0)


def test_mix_targets(spark):
    # one source is small: its target stops at three times its size and the others share the rest
    many = [(i, "w " * 100, "b" if i % 2 else "c") for i in range(400)] + [(1000 + i, "w " * 10, "a") for i in range(5)]
    got = mixing.mix(documents(spark, [(i, t, "en", s) for i, t, s in many])).toPandas()
    by = got.groupby("source").agg({"target": "first", "taken": "sum", "source_size": "first"})
    assert by.target["a"] == 150 and by.taken["a"] == 150
    assert by.target.sum() == pytest.approx(got["size"].sum())
    assert by.target["b"] == pytest.approx(2 * by.target["c"])
    assert ((by.taken - by.target).abs() <= 50).all()
    assert (got.taken <= 3 * got["size"]).all()


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    one = mixing.mix(documents(spark, [(1, None, "en", "a"), (2, "", None, None)])).collect()
    assert [r.taken for r in one] == [0, 0]


def test_rules_equal_brute_force(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    table = rows(docs, "doc_id", "text")
    verdicts = brute.rule_verdicts(table, rows(labels, "doc_id", "quality"))
    for i, t in table:
        for name, value in brute.base_rules(t).items():
            assert got[i][name] == value, (i, name)
        assert got[i].score == pytest.approx(verdicts[i][0], abs=1e-9)
        assert got[i].kept == verdicts[i][1]
    quality = dict(rows(labels, "doc_id", "quality"))
    judged = [(quality[i], r.kept) for i, r in got.items() if i in quality and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.97 * len(judged)


def test_rules_on_edge_rows(spark):
    data = [*edge_rows(), (50, "a b c " * 40, "en", "x"), (51, "x\n\nx\n  \nx", "en", "x"), (52, "#*$%&|<> ##", "en", "x"),
            (53, " ".join(f"u{i}" for i in range(100)) + " q r s t q r s t", "en", "x")]
    docs = documents(spark, data)
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(data)
    want = {}
    for i, t, *_ in data:
        want.setdefault(i, []).append(brute.base_rules(t))
    for r in got:
        assert {k: r[k] for k in want[r.doc_id][0]} in want[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    assert by_id[53].n_repeat_words == 8 and by_id[50].base_failed and by_id[51].n_dup_lines == 2


def test_filter_keeps_columns(spark):
    docs = documents(spark, edge_rows()).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.filter_documents(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {7, 8}
    assert quality_rules.filter_documents(empty(spark), labels).count() == 0
