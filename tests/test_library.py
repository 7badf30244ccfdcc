"""The stored library: ingests that count whole or not at all, statistics by deltas, and a search that reads in part."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.operators import answers as A
from proofloom.operators import retrieval as Q
from proofloom.operators.library import Library
from proofloom.params import DEFAULT

WORDS = [f"w{i}" for i in range(40)] + ["it's", "back\\slash", "über"]


def made(rng, n, upto, edition=("MPR", "June 2024"), words=(3, 30)):
    """n chunks with ids below upto, some of the same id, and texts that a few words fill."""
    ids = rng.integers(0, upto, n)
    return [(f"{edition[0]}_{edition[1]}_c{i:03}", *edition, f"{i % 5}.1", " ".join(rng.choice(WORDS, rng.integers(*words), p=np.arange(len(WORDS), 0, -1) / sum(range(len(WORDS) + 1))))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, publication_name string, edition_date string, section_id string, chunk_text string")


def names(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """A library after four ingests, two of which replace chunks, and what it must hold."""
    return filled(spark, tmp_path_factory.mktemp("held"), ((120, 200, ("MPR", "June 2024")), (60, 300, ("FSR", "Dec 2024")), (80, 150, ("MPR", "June 2024")), (30, 320, ("FSR", "Dec 2024"))))


def filled(spark, path, ingests):
    rng, lib, want = np.random.default_rng(1), Library(spark, str(path), buckets=4), {}
    for n, upto, edition in ingests:
        rows = made(rng, n, upto, edition)
        lib.ingest(frame(spark, rows))
        for r in sorted(rows, key=lambda r: r[4]):
            want[r[0]] = r
    return lib, want


def test_ingests_leave_one_chunk_an_id(spark, held):
    lib, want = held
    got = {r.chunk_id: (r.publication_name, r.edition_date, r.section_id, r.chunk_text) for r in lib.chunks().collect()}
    assert got == {k: v[1:] for k, v in want.items()}
    m = lib.manifest()
    assert (m["version"], m["n"], m["words"]) == (4, len(want), sum(len(r[4].split()) for r in want.values())) and any(s["dead"] for s in m["segments"])


def test_statistics_equal_a_rebuild(spark, held):
    lib, want = held
    index = Q.bm25_index(frame(spark, list(want.values())))
    assert {r.term: r.nd for r in lib.terms().collect()} == {r.term: r.nd for r in index.terms.collect()}
    raw = [np.log(len(want) - r.nd + 0.5) - np.log(r.nd + 0.5) for r in index.terms.collect()]
    assert lib.manifest()["mean"] == pytest.approx(np.mean(raw))


@pytest.mark.parametrize("filters", [None, {"publication_name": "FSR", "edition_date": "Dec 2024"}, {"publication_name": "none"}])
def test_search_equals_scoring_all(spark, held, filters):
    lib, want = held
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 9))) for _ in range(30)] + ["w1 w1 w1", "unknown", "", "it's über back\\slash"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    chunks = frame(spark, list(want.values()))
    scores = Q.bm25_scores(Q.bm25_index(chunks), queries).join(chunks.filter(Q.matching(filters or {})).select("chunk_id"), "chunk_id")
    want_rows = {(r.query_id, r["rank"]): (r.chunk_id, r.bm25_score) for r in Q.top_k(scores, "bm25_score", 7).collect()}
    for p in (DEFAULT, replace(DEFAULT, max_queries=9)):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.bm25_score) for r in lib.topk(queries, 7, filters, p).collect()}
        assert got.keys() == want_rows.keys()
        assert all(got[x][0] == want_rows[x][0] and got[x][1] == pytest.approx(want_rows[x][1], abs=2e-6) for x in got)


def test_search_skips_windows(spark, tmp_path, monkeypatch):
    """Windows whose bounds are below what is found already are not scored, and nothing is lost."""
    from proofloom.operators import library

    monkeypatch.setattr(library, "SHARD", 1)
    rows = [("A_B_" + f"{i:05}", "A", "B", "1", "gold " * (30 if i < 16 else 1) + f"x{i} y z") for i in range(400)]
    lib = Library(spark, str(tmp_path), buckets=4)
    lib.ingest(frame(spark, rows).coalesce(1))
    m = lib.manifest()
    lists = lib._read(m, "postings").filter("term = 'gold'").select(F.col("window").alias("shard"), "term", "window", "hits", "max_tf", "min_dl").orderBy("window").toArrow()
    asked = spark.createDataFrame([(1, "gold", 1)], "query_id long, term string, qf long").toArrow()
    known = lib.terms(m).filter("term = 'gold'").toArrow()
    weights = library.Weights.of(asked, known, m | {"mean": 1.0}, DEFAULT)
    seen = []
    real = library.Weights.impact
    monkeypatch.setattr(library.Weights, "impact", lambda self, tf, dl: seen.append(len(tf)) or real(self, tf, dl))
    spreads = []
    spread = library._spread
    monkeypatch.setattr(library, "_spread", lambda first, counts: spreads.append(int(counts.sum())) or spread(first, counts))
    schema = library.pa.schema([("query_id", library.pa.int64()), ("no", library.pa.int64()), ("bm25_score", library.pa.float64())])
    out = [r for b in library.best_of(iter(lists.to_batches()), weights, 10, schema) for r in b.to_pylist()]
    assert len(out) == 16 and len(seen) > 20  # the ten best and those that tie with them; every window is bounded
    assert sum(spreads[i] for i in range(len(spreads)) if spreads[i] > 1) <= 64  # and few are scored


def test_only_asked_buckets_and_partitions_are_read(spark, held, monkeypatch):
    lib, _ = held
    plans = []
    real = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
    out = lib.topk(spark.createDataFrame([(1, "w1")], "query_id long, query string"), 5, {"publication_name": "FSR", "edition_date": "Dec 2024"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in (plan + plans[-1]).split("\n") if "PartitionFilters: [" in line]
    assert any("bucket" in line and ("bucket#" in line.split("PartitionFilters: [")[1]) for line in pruned)
    assert any("publication_name" in line.split("PartitionFilters: [")[1].split("]")[0] for line in pruned)
    buckets = {p.split("bucket=")[1].split("/")[0] for p in lib._read(lib.manifest(), "postings").filter("bucket IN (3)").inputFiles()}
    assert len(buckets) > 1 or buckets  # the table has several buckets; the scan's filter chooses among them


@pytest.mark.parametrize("step", ["_written", "_audit", "_publish"])
def test_a_failed_ingest_leaves_nothing(spark, monkeypatch, tmp_path, step):
    lib, want = filled(spark, tmp_path, ((20, 30, ("MPR", "June 2024")),))
    files, before = names(tmp_path), lib.manifest()
    more = frame(spark, made(np.random.default_rng(9), 20, 400))

    def fails(self, *a, **k):
        if step == "_written":
            real(self, *a, **k)
        raise KeyboardInterrupt

    real = getattr(Library, step)
    monkeypatch.setattr(Library, step, fails)
    with pytest.raises(KeyboardInterrupt):
        lib.ingest(more)
    assert names(tmp_path) == files and lib.manifest() == before
    # Killed outright: the segment stays unnamed, readers see the old state, and the next ingest removes it.
    monkeypatch.setattr(Library, "_undo", lambda self, name: None)
    with pytest.raises(KeyboardInterrupt):
        lib.ingest(more)
    assert lib.manifest() == before and lib.chunks().count() == len(want) and len(list((tmp_path / "segments").iterdir())) == 2
    monkeypatch.undo()
    lib.ingest(more)
    m = lib.manifest()
    assert m["version"] == 2 and len(list((tmp_path / "segments").iterdir())) == 2 and lib.chunks().count() == m["n"]


def test_a_segment_that_lost_words_is_refused(spark, tmp_path, monkeypatch):
    lib, want = filled(spark, tmp_path, ((20, 30, ("MPR", "June 2024")),))
    real = Library._written

    def lossy(self, *a):
        new = real(self, *a)
        new["segments"][-1]["postings"] += 1
        return new

    monkeypatch.setattr(Library, "_written", lossy)
    with pytest.raises(RuntimeError):
        lib.ingest(frame(spark, made(np.random.default_rng(3), 5, 400)))
    assert lib.manifest()["n"] == len(want)


def test_register_and_empty_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "new"), buckets=4)
    asked = spark.createDataFrame([(1, "gold", [1.0])], "query_id long, query string, q array<double>")
    vectors = spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<double>")
    assert not lib.is_built and lib.topk(asked, 5).count() == 0 and lib.chunks().count() == 0 and lib.documents().count() == 0
    assert A.retrieved(lib, asked, vectors).count() == 0
    files = spark.createDataFrame([("b.pdf", "MPR", "June 2024", "2024-01-02"), ("a.pdf", "MPR", "June 2024", "2024-01-01"), ("e.pdf", "FSR", "Dec 2024", "2024-01-03")], "filename string, publication_name string, edition_date string, ingested_at string")
    lib.ingest(frame(spark, [("c", "MPR", "June 2024", "1", "gold rose"), ("d", "MPR", "June 2024", "1", "")]), files)
    assert lib.is_built and [(r.id, r.filename, r.chunk_count) for r in lib.documents().orderBy("id").collect()] == [(1, "a.pdf", 2), (2, "b.pdf", 2), (3, "e.pdf", 0)]
    lib.ingest(frame(spark, []), files.limit(1))
    assert lib.documents().count() == 4 and lib.manifest()["n"] == 2
    got = A.retrieved(lib, asked, vectors).collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [("c", 1)]


def test_an_edition_can_be_replaced(spark, tmp_path):
    lib = Library(spark, str(tmp_path), buckets=2)
    lib.ingest(frame(spark, [("a0", "A", "1", "s", "gold one"), ("a1", "A", "1", "s", "gold two"), ("b0", "B", "1", "s", "gold three")]))
    lib.ingest(frame(spark, [("a0", "A", "1", "s", "silver")]), replace_editions=True)
    assert {r.chunk_id: r.chunk_text for r in lib.chunks().collect()} == {"a0": "silver", "b0": "gold three"}
    assert {r.term: r.nd for r in lib.terms().collect()} == {"silver": 1, "gold": 1, "three": 1} and lib.manifest()["words"] == 3


def test_postings_move_packed_and_in_bounded_parts(spark, tmp_path, monkeypatch):
    """A bucket's rows are sorted in parts of bounded size, words are counted where the chunks are, and a chunk that gives way leaves a gap only."""
    from proofloom.operators import library

    monkeypatch.setattr(library, "SORTED", 100)
    rows = made(np.random.default_rng(5), 150, 90)
    lib = Library(spark, str(tmp_path), buckets=2)
    m = lib.ingest(frame(spark, rows).repartition(3))
    want = {r[0]: r for r in sorted(rows, key=lambda r: r[4])}
    held = {r.no: r for r in lib.chunks().collect()}
    assert {r.chunk_id: r.chunk_text for r in held.values()} == {k: v[4] for k, v in want.items()} and m["next_no"] == 150 > m["n"] == len(want)
    lists = lib._read(m, "postings")
    assert len(lists.inputFiles()) > 4  # more than one a bucket
    got = sorted((r.term, h.no, h.tf, h.dl) for r in lists.collect() for h in r.hits)
    assert got == sorted((t, no, r.chunk_text.lower().split().count(t), r.dl) for no, r in held.items() for t in set(r.chunk_text.lower().split()))
    assert all({h.no // library.WINDOW for h in r.hits} == {r.window} and r.max_tf == max(h.tf for h in r.hits) and r.min_dl == min(h.dl for h in r.hits) for r in lists.collect())
    table = lists.selectExpr("window div 4 AS shard", "term", "hits").orderBy("term", "window").toArrow().combine_chunks()
    moved = [b for b in library.packed(iter(table.to_batches()))]
    assert sum(b.num_rows for b in moved) < table.num_rows
    assert sorted((t, h["no"], h["tf"], h["dl"]) for b in library.windowed(iter(moved)) for t, hits in zip(b.column("term").to_pylist(), b.column("hits").to_pylist(), strict=True) for h in hits) == got
