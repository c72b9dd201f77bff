import duckdb

import __spark_entry__
import corpus_pipeline
from kiloqueue.llm import mixing
from kiloqueue.llm.common import read
from tests.conftest import SF
from tests.llm import brute
from tests.llm.tables import documents, edge_rows, empty, rows


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_pipeline_equals_brute_force(spark, tmp_path):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    table, labels = rows(read(spark, SF, "documents"), "doc_id", "text"), rows(read(spark, SF, "labels"), "doc_id", "quality")
    verdicts = brute.rule_verdicts(table, labels)
    table = [(i, t) for i, t in table if verdicts[i][1]]
    table = list(brute.dedup_lines(table).items())
    near = brute.near_components(table, 5)
    table = [(i, t) for i, t in table if near[i] == i]
    leaks = brute.leaked(table, rows(read(spark, SF, "benchmark"), "item_id", "text"))
    table = {i: t for i, t in table if i not in leaks}
    assert set(got) == set(table)
    source = dict(rows(read(spark, SF, "documents"), "doc_id", "source"))
    spark.createDataFrame([(i, t, source[i]) for i, t in table.items()], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(con.execute(mixing.MIX_SQL).fetchall()) == sorted(map(tuple, got.values()))


def test_stages_keep_columns(spark, tmp_path):
    docs = documents(spark, edge_rows())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name
