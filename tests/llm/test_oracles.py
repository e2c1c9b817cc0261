"""Queries with oracle SQL against DuckDB, on the small tables and on awkward rows."""

import random
from collections import Counter

import duckdb
import pytest

from skygrid.llm import mixing, oracles, queries, sharding

SF = "/root/testdata/sf0.001"


def sql_rows(sql, path, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    assert Counter(map(tuple, got.collect())) == sql_rows(queries.oracle_sql()[name], f"{SF}/documents.parquet", got.columns)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and very long texts, a third of the rows copies of one, ties."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(200)]
    rows += [(1000 + i, "one text that a third of all rows share", "en", "hot") for i in range(110)]
    rows += [(2000, None, None, None), (2001, "", "en", "s1"), (2002, " \t ", "fr", "only"), (2003, "x" * 30_000, "en", "s1")]
    path = str(tmp_path_factory.mktemp("awkward") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), path + "/*.parquet"


def test_awkward_shards(awkward):
    docs, path = awkward
    for shards in (1, 5):
        got = sharding.shard(docs, shards)
        assert Counter(map(tuple, got.collect())) == sql_rows(oracles.kd_shards(shards), path, got.columns)


HOT = {"lang": {"en": 3}, "source": {"hot": 9, "s1": 1}}


@pytest.mark.parametrize(("epochs", "budget", "weights"), [(1, 0.05, HOT), (1, 0.6, HOT), (3, 2.5, HOT), (1, 0.6, {"domain": {"a": 0}, "source": {"s1": 0}}), (3, 2.5, {"source": {"hot": 0, "s1": 2}, "lang": {"de": 0}}), (1, 0.6, {"domain": {"a": 0, "b": 0}})])
def test_awkward_mixture(awkward, epochs, budget, weights):
    docs, path = awkward
    got = mixing.mix(docs, weights, budget, epochs).select("doc_id", "domain", "lang", "source", "epoch")
    got = Counter(tuple(r)[:2] + (r.lang or "", r.source or "", r.epoch) for r in got.collect())
    assert got == sql_rows(oracles.mixture(weights, budget, epochs), path, ["doc_id", "domain", "lang", "source", "epoch"])
