"""The approximate dense index against scoring all vectors."""

import re
from dataclasses import replace

import numpy as np
import pytest

from proofloom.operators import retrieval as Q
from proofloom.operators.dense import DenseIndex, kmeans
from proofloom.params import DEFAULT
from proofloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
K = 10


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """Vectors around forty centres, a third of them in one list, with twins, zero, null and odd ones; a part is added later."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    of = np.concatenate([np.zeros(1000, int), rng.integers(0, 40, 2000)])
    x = centres[of] + 0.6 * rng.normal(size=(3000, 24))
    x[50:60] = x[5]
    rows = [(f"c{i:04}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 24), ("none", None), ("short", [1.0]), ("hole", [1.0, None] * 12)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(3)
    asked = [(i, (centres[i % 40] + 0.6 * rng.normal(size=24)).tolist()) for i in range(60)] + [(90, [0.0] * 24), (91, None), (92, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    path = str(tmp_path_factory.mktemp("dense"))
    late = vectors.filter("chunk_id >= 'c2500'")
    index = DenseIndex(spark, path).build(vectors.subtract(late), lists=20, parts=5, train=1500)
    return index.add(late), vectors.filter("chunk_id NOT IN ('short', 'hole')"), queries.filter("query_id <> 92"), queries


def best(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.dense_score) for r in df.collect()}


def test_all_lists_are_exact(held):
    index, vectors, queries, everything = held
    want = {k: v for k, v in best(Q.dense_topk(queries, vectors, K)).items()}
    for p in (DEFAULT, replace(DEFAULT, max_queries=20)):
        got = best(index.topk(everything, K, 20, p=p))
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1.5e-6) for x in got)


def test_recall_with_few_lists(held):
    index, vectors, queries, everything = held
    exact = best(Q.dense_topk(queries.filter("query_id < 60"), vectors, K))
    got = index.topk(everything.filter("query_id < 60"), K, 4, 60)
    hits = sum(r.dense_score >= exact[r.query_id, K][1] - 1e-6 for r in got.collect())
    assert hits / (60 * K) >= 0.9  # measured: a fifth of the lists


def test_only_probed_lists_are_read(spark, held):
    index, _, queries, _ = held
    plan = index.topk(queries.filter("query_id = 3"), K, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN \(\d+,\d+\)", plan)
    assert index.topk(queries.limit(0), K, 2).count() == 0


def test_an_index_needs_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        DenseIndex(spark, str(tmp_path)).build(spark.createDataFrame([("a", None)], "chunk_id string, embedding array<double>"))


def test_empty_clusters_start_again():
    x = np.array([[0.0, 0.0]] * 50 + [[9.0, 9.0], [5.0, 1.0]])
    assert len(np.unique(kmeans(x, 3, np.random.default_rng(0)).round(3), axis=0)) == 3


def test_recall_on_the_documents(spark):
    exact = QUERIES["dense_topk"](spark, SF).toPandas()
    got = QUERIES["dense_index_topk"](spark, SF).toPandas()
    kth = exact.groupby("query_id").dense_score.min()
    assert (got.dense_score >= got.query_id.map(kth) - 1e-9).sum() / len(exact) >= 0.9


def test_training_rows_are_those_of_least_hash(spark):
    """The bound that is looked at first changes no row, whatever the number of rows, and few rows pass it."""
    from proofloom.operators.dense import _least

    for total in (150, 5000):
        hashed = spark.range(total).selectExpr("cast(id as string) AS chunk_id", "array(cast(id as double)) AS embedding", "xxhash64(cast(id as string)) AS h").repartition(4)
        want = [r.chunk_id for r in hashed.orderBy("h", "chunk_id").limit(100).collect()]
        few = _least(hashed, 100)
        assert [r.chunk_id for r in few.collect()] == want
        assert ("training" in str(few.inputFiles())) == (total == 5000)
