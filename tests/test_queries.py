"""Every query against its SQL in DuckDB on the smallest tables, and queries without SQL by what they must hold."""

import pytest
from conftest import rows

import __spark_entry__
from pyrocast import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_packed_chunks_hold_all_text(spark, sf_dir):
    from pyspark.sql import functions as F

    from pyrocast.operators import folds

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("parts"))
    for r in docs.withColumn("chunks", folds.pack("parts", 300, "  ")).collect():
        assert all(0 < len(c) <= 300 for c in r.chunks)
        assert "".join(r.chunks).replace(" ", "") == "".join(r.parts).replace(" ", "")


def test_fire_step_equals_episode(spark, sf_dir):
    """The join form and the grouped form of a step give the same counts."""
    from pyspark.sql import functions as F

    from pyrocast.operators import fire
    from pyrocast.plans import fires

    times = [1.0, 40.0, 80.0]
    cells = fires._grid(spark, sf_dir)
    want = {(r.episode, r.time): (r.unburnt, r.burning, r.burnt) for r in fire.simulate(cells, times, 5.0, 45.0, 500.0).collect()}
    for t in times:
        cells = fire.step(cells, t, 5.0, 45.0, 500.0)
    got = cells.groupBy("episode").agg(*[F.count_if(F.col("state") == k).alias(f"n{k}") for k in (0, 1, 2)]).collect()
    assert {(r.episode, times[-1]): (r.n0, r.n1, r.n2) for r in got} == {k: v for k, v in want.items() if k[1] == times[-1]}


def test_fact_overlap_takes_every_fact(spark, sf_dir):
    """Facts of every remainder by 7 are found, as each benchmark text is one."""
    from pyspark.sql import functions as F

    found = registry.QUERIES["fact_overlap"](spark, sf_dir)
    facts = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found.select(F.pmod("fact_id", F.lit(7)).alias("r")).distinct().count() == facts.select(F.pmod("item_id", F.lit(7))).distinct().count() == 7


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """(folder, DuckDB) of documents that hold letters which change with their case or their neighbours, and rows without text, source or language."""
    import duckdb

    tail = " ßü Σας schau İst nicht in den anderen Teilen der Texte"
    items = [(i, f"{i:03d} Anfang des Textes, eigen " + "x" * i + tail) for i in range(60)] + [(60, None)]
    docs = [(100 + i, text and text[10:30] + " SS ss " + text[38:48], f"web{i % 4}", ("en", "de")[i % 2]) for i, text in items]
    docs += [(i, f"schön{items[i][1][39:48]}er sonst", f"web{i % 4}", "de") for i in range(60)] + [(200, items[1][1], None, "de"), (201, items[2][1], "web2", None), (202, items[5][1], None, "en"), (203, "masse SSÜ ΣΑΣ i̇st ist", "web1", "de")]
    folder, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for name, rows, schema in (("benchmark", items, "item_id long, text string"), ("documents", docs, "doc_id long, text string, source string, lang string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


def test_relevant_chunks_of_odd_letters(spark, odd_texts):
    """Pieces are looked for as they stand: in upper case a sharp s would be two letters, which is another text."""
    folder, con = odd_texts
    got, want = registry.QUERIES["relevant_chunks"](spark, folder).toPandas(), con.sql(registry.SQL["relevant_chunks"]).df()
    assert rows(got) == rows(want) and {5, 11} <= set(want["case_id"])


def test_retrieval_metrics_of_odd_letters(spark, odd_texts):
    """Recall counts every relevant document, also those found by a piece with a sharp s."""
    folder, con = odd_texts
    got, want = registry.QUERIES["retrieval_metrics"](spark, folder).toPandas(), con.sql(registry.SQL["retrieval_metrics"]).df()
    assert rows(got) == rows(want) and (want["recall_at_k"] > 0).any()
