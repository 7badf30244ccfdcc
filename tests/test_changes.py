"""Tables that change by bucket, sections of very long documents, and answers that cite what was retrieved."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.operators import answers as A
from proofloom.operators import documents as D
from proofloom.operators import evidence as E
from proofloom.operators import reports as R
from proofloom.operators.library import Library
from proofloom.sources import files
from proofloom.sources.buckets import Bucketed


def by_bucket(path):
    return {p.name: sorted(x.name for x in p.glob("*.parquet")) for p in path.glob("_bucket=*")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), "k string, v int, at int", "k", 8)
    assert table.read().count() == 0 and table.upsert(table.read(), "at") == []
    table.upsert(spark.range(200).selectExpr("concat('k', id) AS k", "cast(id AS int) AS v", "1 AS at"), "at")
    before = by_bucket(tmp_path / "t")
    assert len(before) == 8
    new = spark.createDataFrame([("k7", 70, 2), ("k7", 71, 3), ("k7", 99, 1), ("z", None, 1)], "k string, v int, at int")
    for _ in range(2):  # applied again it gives the same
        touched = table.upsert(new, "at")
        after = by_bucket(tmp_path / "t")
        assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} <= {f"_bucket={i}" for i in touched}
        assert {r.k: r.v for r in table.read().collect()} == {f"k{i}": i for i in range(200)} | {"k7": 71, "z": None}
    assert [tuple(r) for r in table.one("k7").collect()] == [("k7", 71, 3)] and table.one("none").count() == 0
    before = by_bucket(tmp_path / "t")
    touched = table.update(spark.createDataFrame([("k3", -3), ("unknown", 5)], "k string, v int"), "v")
    after = by_bucket(tmp_path / "t")
    assert len(touched) == 1 and sum(after[b] != before[b] for b in after) == 1 and table.one("k3").first().v == -3 and table.read().count() == 201


def test_a_point_lookup_reads_one_bucket(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), "k long, v int", "k", 8)
    table.upsert(spark.range(100).selectExpr("id AS k", "1 AS v"), "v")
    plan = table.one(5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan)


def test_appends_number_on_in_a_stored_table(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), "id long, name string, note string", "id", 4)
    rows = spark.createDataFrame([("b",), ("a",)], "name string")
    assert table.append(rows, [F.col("name")]) == 2 and table.append(rows, [F.col("name")]) == 4
    assert [tuple(r) for r in table.read().orderBy("id").collect()] == [(1, "a", None), (2, "b", None), (3, "a", None), (4, "b", None)]


def test_conflict_cache(spark):
    found = spark.createDataFrame([("P", "1", "June 2024", "Dec 2024", 0.5, True)], "publication string, section_id string, edition_a string, edition_b string, cosine_sim double, has_conflict boolean")
    row = E.cache_rows(found, E.now()).first()
    assert row.authoritative == "Dec 2024" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", row.cached_at)


def test_reports_are_lines(spark, tmp_path):
    logs = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, None)], "id long, audit_data_json string").coalesce(1)
    files.write_reports(logs, str(tmp_path / "all"))
    lines = [json.loads(x) for p in (tmp_path / "all").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((x["id"], x.get("report")) for x in lines if x["id"] == 1) == [(1, {"a": 1})] and {x["id"] for x in lines} == {1, 2}


LINES = ["1.1 Overview", "body of it", "", "2.3 Risk", "Chapter I: Intro", "12 34", "prose", "Box 1.1: Trade"]


@pytest.mark.parametrize("span", [1, 3, 1000])
@pytest.mark.parametrize("headers", [True, False])
def test_sections_by_ranges_equal_those_of_whole_documents(spark, span, headers):
    rng = np.random.default_rng(span)
    rows = [(d, p, "\n".join(x for x in rng.choice(LINES, rng.integers(0, 5)) if headers or x in ("body of it", "", "12 34", "prose"))) for d in range(3) for p in rng.choice(np.arange(1, 60), 40, replace=False).tolist()]
    rows += [(7, 1, ""), (8, 5, "\n \n"), (9, 2, "1.1 Only\n")]
    pages = spark.createDataFrame([(d, int(p), t) for d, p, t in rows], "doc_id long, page_number int, text string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    whole, ranged = D.sections(pages), D.sections(pages, span)
    assert sorted(map(tuple, ranged.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
    parts = [D.chunks(s.select("doc_id", "section_ord", "text"), 3, 1, n).select("doc_id", "section_ord", "chunk_idx", "chunk_text") for s, n in ((whole, None), (ranged, span))]
    assert sorted(map(tuple, parts[0].collect()), key=key) == sorted(map(tuple, parts[1].collect()), key=key)


def test_one_long_document_is_many_tasks(spark):
    pages = spark.range(1, 20_001).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_number"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("1."), "id", F.lit(" Head"))).otherwise("text").alias("text"))
    got = D.sections(pages, 500)
    assert got.agg(F.count("*"), F.min("start_page"), F.max("section_ord")).first() == (2000, 10, 2000)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\)[^\n]*\n[^\n]*(Generate|Project)", plan)  # lines never move by document alone


def test_claims_are_joined_by_place(spark):
    base = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "answer_id long, claim_idx long")
    short = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 9, "beyond")], "answer_id long, claim_idx long, a string")
    other = spark.createDataFrame([(2, 0, 5)], "answer_id long, claim_idx long, b int")
    assert sorted(map(tuple, A.zipped(base, short, other).collect())) == [(1, 0, "x", None), (1, 1, "y", None), (1, 2, None, None), (2, 0, None, 5)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("lib")), buckets=2)
    long = " ".join(f"Sentence number {i} tells of gold and of rates." for i in range(20))
    rows = [("c1", "MPR", "June 2024", "1.1", "prices of gold rose"), ("c2", "MPR", "June 2024", "1.2", long), ("c3", "MPR", "June 2024", "1.2", "a twin of gold"), ("c4", "FSR", "Dec 2024", "9", "rates\n12 34\nfell")]
    lib.ingest(spark.createDataFrame(rows, "chunk_id string, publication_name string, edition_date string, section_id string, chunk_text string"))
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [0.1, 1.0]), ("c4", [-1.0, 0.2])], "chunk_id string, embedding array<double>")
    return lib, vectors


def judge(rows):
    return rows.withColumns({"contradiction": F.lit(0.1), "entailment_score": F.when(F.length("focused_passage") > 0, 0.9).otherwise(0.2), "neutral": F.when(F.length("focused_passage") > 0, 0.0).otherwise(0.7)})


def test_answers_cite_what_was_retrieved(spark, small):
    lib, vectors = small
    queries = spark.createDataFrame([(1, "gold", [1.0, 0.0]), (2, "nothing known", [0.0, 0.0])], "query_id long, query string, q array<double>")
    found = A.retrieved(lib, queries, vectors, 4)
    sentences = spark.createDataFrame([(1, 0, "It rose.", [1.0, 0.05]), (1, 1, "Rates matter.", [0.05, 1.0]), (1, 2, "Unlike all.", [0.0, -1.0])], "answer_id long, claim_idx long, claim_text string, v array<double>")
    related = spark.createDataFrame([], "query_id long, id long, similarity double")
    score = lambda x, i: -i
    one, two = A.answered(queries, sentences, found, lib.chunks(), vectors, related, judge, score).orderBy("query_id").collect()
    claims = one.claims
    assert [(c.claim_text, c.source_section_id, c.verdict) for c in claims] == [("It rose.", "1.1", "ENTAILMENT"), ("Rates matter.", "1.2", "ENTAILMENT"), ("Unlike all.", "", "NEUTRAL")]
    assert claims[0].focused_passage == "prices of gold rose" and claims[1].focused_passage.count("Sentence number") in (0, 3) and claims[2].focused_passage == ""
    assert one.n_sources == 3 and one.n_claims == 3 and one.status == "Non_Compliant" and one.cited_share == pytest.approx(2 / 3, abs=1e-6)
    assert two.claims is None and two.status == "Safe" and two.n_claims == 0
    matrix = A.entailment(A.cited_claims(sentences, A.sources_of(found, lib.chunks()), vectors), lib.chunks(), judge, score).collect()
    assert {(r.claim_idx, r.place) for r in matrix} == {(i, p) for i in range(3) for p in (1, 2)}


def test_requirements_without_sections_are_judged(spark, small, tmp_path):
    lib, vectors = small
    asked = spark.createDataFrame([(1, "gold", [1.0, 0.0])], "id long, text string, q array<double>")
    read = []

    def model(rows):
        read.extend(r.sources for r in rows.collect())
        return rows.select("id", F.lit('{"alignment_score": 80, "violations": ["v", "w"]}').alias("raw"))

    row = A.validated(asked, lib, vectors, model).first()
    assert row.mapped_sections[0] == "prices of gold rose" and len(row.mapped_sections) == 4 and row.compliance_score == 40.0 and row.n_violations == 2
    empty = Library(spark, str(tmp_path / "none"))
    row = A.validated(asked, empty, vectors, lambda rows: rows.select("id", F.lit(None).cast("string").alias("raw"))).first()
    assert row.mapped_sections == [] and row.gaps == ["Unable to fully analyze requirement"] and row.alignment_score == 50.0
    A.validated(asked, empty, vectors, model).first()
    assert read[-1] == A.NO_SECTIONS and R.FALLBACK_GAPS == ["JSON parsing failed"]
