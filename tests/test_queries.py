"""Every query that SQL can express against DuckDB, and the operators' edge cases."""

from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.functions.vectors import cosine
from proofloom.operators import answers as A
from proofloom.operators import documents as D
from proofloom.operators import evidence as E
from proofloom.operators import reports as R
from proofloom.operators import retrieval as Q
from proofloom.params import DEFAULT, configured
from proofloom.plans.catalogue import QUERIES, SQL
from proofloom.sources import files, tables

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "events", "pages")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")


def found(df):
    return [(r.section_id, r.section_title, r.start_page, r.text) for r in df.orderBy("section_ord").collect()]


def test_numbered_sections_run_over_pages(spark):
    got = found(D.sections(pages(spark, "lost\n1.1 Overview\nfirst\n1.2 Risk: more's lost", "second\n\nthird")))
    assert got == [("1.1", "Overview", 1, "first"), ("1.2", "Risk: more", 1, "second\nthird")]


def test_roman_and_box_sections(spark):
    got = found(D.sections(pages(spark, "Chapter I: Intro\na\nChapter II. Banking\nb\ni.8 lower case\nc\nBox 1.1: Trade\nd")))
    assert [x[:2] for x in got] == [("Chapter_I", "Intro"), ("Chapter_II", "Banking"), ("i.8", "lower case"), ("Box_1.1", "Trade")]


def test_pages_without_headers_are_sections(spark):
    assert found(D.sections(pages(spark, "", "only prose", "more"))) == [("UNSTRUCTURED-p2", "Page 2", 2, "only prose"), ("UNSTRUCTURED-p3", "Page 3", 3, "more")]
    assert found(D.sections(pages(spark, ""))) == []


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 30, 5), (10, 30, 5), (30, 30, 5), (31, 30, 5), (55, 30, 5), (100, 30, 5), (924, 512, 50), (975, 512, 50)])
def test_chunk_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    rows = spark.createDataFrame([(1, 1, " ".join(words))], "doc_id long, section_ord int, text string")
    want, start = [], 0
    while start < n:  # by the definition: until the words that are left are all in the overlap
        want.append(" ".join(words[start : start + size]))
        start += size - overlap
        if n <= size or start + overlap >= n:
            break
    assert [r.chunk_text for r in D.chunks(rows, size, overlap).orderBy("chunk_idx").collect()] == want
    with pytest.raises(ValueError):
        D.windows(F.lit(""), 5, 5)


def test_noise(spark):
    lines = {"617075 (12.3)": 0, "12 | P a g e": 0, "Table 3 of": 0, "GDP": 0, "September-24 617075": 0, "Goldman said so": 0, "A LINE OF THIRTY BIG CAPITALS": 1, "prose stays": 1}
    rows = spark.createDataFrame([(k,) for k in lines], "x string").select("x", T.noise(F.col("x")).alias("n")).collect()
    assert {r.x: int(not r.n) for r in rows} == lines


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id long, chunk_id string, dense_score double, rank long")
    sparse = spark.createDataFrame([(1, "b", 3.0, 1), (1, "c", 2.0, 2)], "query_id long, chunk_id string, bm25_score double, rank long")
    got = Q.fused(dense, sparse, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].bm25_score == 3.0 and got[1].bm25_score == 0.0
    assert Q.fused(dense.limit(0), sparse.limit(0), 10).count() == 0 and Q.fused(dense, sparse.limit(0), 10).count() == 2


def test_bm25_filters_keep_scores(spark):
    rows = [(f"c{i}", t) for i, t in enumerate(["gold rose", "gold fell", "gold stays gold", "rates fell", "bank rates"])]
    index = Q.bm25_index(spark.createDataFrame(rows, "chunk_id string, chunk_text string"))
    idf = {r.term: r.idf for r in index.terms.collect()}
    assert idf["gold"] > 0 and idf["gold"] < min(idf["rose"], idf["bank"])  # in most texts: floored, not negative
    ask = spark.createDataFrame([(1, "unknown words"), (2, "rose")], "query_id long, query string")
    assert [(r.query_id, r.chunk_id) for r in Q.bm25_scores(index, ask).collect()] == [(2, "c0")]


def test_dense_queries_come_in_blocks(spark):
    """More queries than a block holds, vectors of another size and null ones, ties: all against plain sums."""
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(23, 4)), rng.normal(size=(60, 4))
    v[10:20] = v[5]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, q array<double>").repartition(2)
    vectors = spark.createDataFrame([(f"c{i:02}", x.tolist()) for i, x in enumerate(v)] + [("short", [1.0]), ("none", None), ("zero", [0.0] * 4)], "chunk_id string, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.dense_score) for r in Q.dense_topk(queries, vectors, 12, replace(DEFAULT, max_queries=5)).collect()}
    for i, x in enumerate(q):
        scored = [(-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), f"c{j:02}") for j, y in enumerate(v)] + [(0.0, "zero")]
        assert [got[i, k + 1] for k in range(12)] == [(c, pytest.approx(-s)) for s, c in sorted(scored)[:12]]
    assert Q.dense_topk(queries.limit(0), vectors, 3).count() == 0 and Q.dense_topk(queries, vectors.limit(0), 3).count() == 0


def test_cosine_of_zero(spark):
    assert spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))).first()[0] == 0.0


CLAIM = "answer_id long, claim_idx long, verdict string, entailment_score double, attribution_score double, ambiguous boolean, has_conflict boolean, source_section_id string"


def test_trust(spark):
    rows = [
        (1, 0, "CONTRADICTION", 0.1, 0.9, False, False, "s"), (2, 0, "ENTAILMENT", 0.5, 0.9, False, False, ""), (3, 0, "SUPPORTED", 0.9, 0.9, False, False, "s"), (4, 0, "NOT_ENOUGH_INFO", 0.9, None, None, None, "s"),
        (5, 0, "CONTRADICTED", 0.1, 0.1, True, True, "s"), (6, 0, "ENTAILMENT", 0.81, 0.6, False, False, " "),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    gate = {r.answer_id: (r.overall_score, r.status) for r in E.trust_gate(claims).collect()}
    assert gate == {1: (0.5, "Non_Compliant"), 2: (0.95, "Needs_Human_Review"), 3: (1.0, "Safe"), 4: (0.9, "Needs_Human_Review"), 5: (0.0, "Non_Compliant"), 6: (0.97, "Needs_Human_Review")}
    phi = {r.answer_id: r.overall_score for r in E.shapley(claims).collect()}
    assert phi == {1: 0.7, 2: 0.95, 3: 1.0, 4: 1.0, 5: 0.75, 6: 0.97}  # no confidence term where it contradicts; other spellings are unknown
    card = {r.answer_id: (r.faithfulness, r.cited_share) for r in E.scorecard(claims).collect()}
    assert card[3] == (1.0, 1.0) and card[2] == (1.0, 0.0) and card[1] == (0.0, 1.0)


def test_attribution_edges(spark):
    scores = spark.createDataFrame([(1, 7, 0.45), (2, 7, 0.4499), (3, 1, 0.5), (3, 2, 0.5), (4, 1, 0.52), (4, 2, 0.5)], "i long, j long, score double")
    assert {r.i: r.j for r in E.attributed(scores).collect()} == {1: 7, 2: None, 3: 1, 4: 1}
    top = {r.i: (r.primary_chunk, r.runner_up_chunk, r.confidence_gap, r.ambiguous) for r in E.primary(scores).collect()}
    assert top[1] == (7, 7, 0.0, True) and top[3] == (1, 2, 0.0, True) and top[4] == (1, 2, 0.02, False)


def test_related_drops_repeats_after_the_cut(spark):
    history = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(5)] + [(9, [1.0, 2.0, 3.0]), (10, None)], "id long, embedding array<double>")
    got = E.related(spark.createDataFrame([(99, [1.0, 0.0])], "query_id long, q array<double>"), history).count()
    assert got == 0  # the three nearest are all repeats


def test_reports(spark):
    logs = spark.createDataFrame([(1, "t", "null"), (2, "t", "{bad"), (3, "t", "{}"), (4, "t", None), (5, "t", '{"final_audit_summary": {"overall_trust_status": "Safe"}}')], "id long, timestamp string, audit_data_json string")
    assert {r.id: (r.status, r.summary) for r in R.log_list(logs).collect()} == {1: ("Error", "Error"), 2: ("Error", "Error"), 3: ("Unknown", "N/A"), 4: ("Error", "Error"), 5: ("Safe", "N/A")}
    answers = spark.createDataFrame([(1, '```json\n{"alignment_score": 80, "gaps": ["a"], "risk_level": "hIGH"}\n```'), (2, "no json"), (3, "{}")], "id long, raw string")
    assert {r.id: (r.alignment_score, r.alignment, r.gaps, r.risk_level) for r in R.mapped(answers).collect()} == {1: (80.0, 0.8, ["a"], "High"), 2: (50.0, 0.5, ["JSON parsing failed"], "Medium"), 3: (0.0, 0.0, [], "Medium")}


def test_related_takes_any_number_of_queries(spark):
    history = spark.createDataFrame([(-1, [1.0, 1.0])], "id long, embedding array<double>")
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("q"))
    assert E.related(many, history).count() == 10_001


def test_lists_come_in_order(spark):
    logs = spark.createDataFrame([(1, "b", None), (2, None, None), (3, "c", None), (4, "b", None)], "id long, timestamp string, audit_data_json string")
    assert [r.id for r in R.log_list(logs).collect()] == [3, 4, 1, 2]
    documents = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-03"), (3, "2024-01-02")], "id long, ingested_at string")
    assert [r.id for r in D.list_documents(documents).collect()] == [2, 3, 1]
    chunks = spark.createDataFrame([("P", "E", s, "t", i, 0) for i, s in enumerate(["1.2", "1.10", None, "1.2"])], "publication_name string, edition_date string, section_id string, section_title string, doc_id long, chunk_idx long")
    assert [(r.section_id, r.place, r.chunk_count) for r in D.list_sections(chunks).collect()] == [("1.10", 1, 1), ("1.2", 2, 2), ("unknown", 3, 1)]
    assert [(r.id, r.place) for r in D.newest(documents, [F.desc("id")], 2).collect()] == [(3, 1), (2, 2)]


def test_appends_number_on(spark):
    old = spark.createDataFrame([(7, "a"), (3, "b")], "id long, x string")
    new = spark.createDataFrame([(f"n{i:03}",) for i in range(100)], "x string").repartition(5)
    got = {r.x: r.id for r in D.appended(old, new, [F.col("x")]).collect()}
    assert got == {"a": 7, "b": 3, **{f"n{i:03}": 8 + i for i in range(100)}}
    assert D.appended(old.limit(0), new.limit(0), [F.col("x")]).count() == 0


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 9), ("c", 2)], "chunk_id string, v int")
    assert {r.chunk_id: r.v for r in D.upserted(old, new).collect()} == {"a": 1, "b": 9, "c": 2}
    dated = lambda df, t: df.withColumn("t", t)
    got = D.upserted(dated(old, F.lit(0)), dated(new, -F.col("v")), version="t")
    assert {r.chunk_id: r.v for r in got.collect()} == {"a": 1, "b": 5, "c": 2}


def test_ingest(spark):
    made = [(1, "MPR", "June 2024", 1, "1.1 Overview\n" + "w " * 600), (1, "MPR", "June 2024", 2, "1.2 Risk\nshort text"), (2, "FSR", "Dec 2024", 1, "no header here")]
    chunks = D.ingested(spark.createDataFrame(made, "doc_id long, publication_name string, edition_date string, page_number int, text string"))
    assert sorted((r.chunk_id, r.page_number) for r in chunks.collect()) == [("FSR_Dec 2024_UNSTRUCTURED-p1_chunk0", 1), ("MPR_June 2024_1.1_chunk0", 1), ("MPR_June 2024_1.1_chunk1", 1), ("MPR_June 2024_1.2_chunk2", 2)]
    assert {r.doc_id: (r.n_sections, r.n_chunks) for r in D.ingest_counts(chunks).collect()} == {1: (2, 3), 2: (1, 1)}
    plan = chunks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2  # pages and their names; sections, numbers and chunks move no more


def test_text_focus(spark):
    score = lambda x, i: F.length(x)
    texts = ["A first sentence that is long. Short one. A second sentence that is much longer. A third sentence, the longest of all of them. A fourth sentence is long.", "617075\nno sentence", "12 34", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.focused(F.col("t"), score, 20, 3, 8).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {0: "A first sentence that is long. A second sentence that is much longer. A third sentence, the longest of all of them.", 1: "no sente", 2: "12 34", 3: None, 4: ""}
    assert spark.range(1).select(T.shortened(F.lit("abcdef"), 3), T.fixed(F.lit(0.345), 2), T.extension(F.lit("/x/A.b.PDF")), T.basename(F.lit("/x/A.b.PDF"))).first() == ("abc...", "0.34", "pdf", "A.b.PDF")


def test_numbers_are_rounded_like_python(spark):
    rows = spark.range(1001).select((F.col("id") / 1000).alias("x")).select("x", *(T.fixed(F.col("x"), n).alias(f"f{n}") for n in (2, 3, 4))).collect()
    assert all((r.f2, r.f3, r.f4) == (f"{r.x:.2f}", f"{r.x:.3f}", f"{r.x:.4f}") for r in rows)
    odd = [0.125, 2.675, -0.001, 1234567.005, 1e15 + 0.5, float("nan"), float("inf"), float("-inf"), None]
    got = [r.f for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x double").orderBy("i").select(T.fixed(F.col("x"), 2).alias("f")).collect()]
    assert got == [None if x is None else f"{x:.2f}" for x in odd]


def test_answers_without_sources_or_claims(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    chunks = spark.createDataFrame([("c", "P", "E", "1.1", "text"), ("d", "P", "E", "1.1", "twin")], "chunk_id string, publication_name string, edition_date string, section_id string, chunk_text string")
    found = spark.createDataFrame([(1, "d", 1), (1, "c", 2)], "query_id long, chunk_id string, rank long")
    claim = spark.createDataFrame([(1, 0, "ENTAILMENT", 0.4, 0.9, False, False, "s", "A claim.", 0.5)], CLAIM + ", claim_text string, confidence_gap double")
    related = spark.createDataFrame([(1, 5, 0.8), (1, 6, 0.9)], "query_id long, id long, similarity double")
    one, two = A.audited(queries, found, chunks, claim, related).orderBy("query_id").collect()
    assert (one.sources, one.n_sources, one.status, one.overall_score, one.reasoning, one.related) == ("[P·E·1.1] twin", 1, "Non_Compliant", 0.8, "Low NLI confidence (0.40)", "6,5")
    assert (two.sources, two.n_claims, two.status, two.overall_score, two.faithfulness, two.reasoning, two.related) == ("", 0, "Safe", 1.0, 1.0, E.SAFE_REASON, "")


def test_passages_are_distinct(spark):
    claims = spark.createDataFrame([(1, i) for i in range(3)], "answer_id long, claim_idx long")
    passages = spark.createDataFrame([(1, 0, "b"), (1, 1, " "), (1, 2, "a"), (1, 1, "b"), (2, 0, "c")], "answer_id long, claim_idx long, passage string")
    got = sorted((r.claim_idx, r.place, r.passage) for r in E.entailment_pairs(claims, passages).collect())
    assert got == [(i, p, x) for i in range(3) for p, x in ((1, "b"), (2, "a"))]


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one\ntwo \n")
    (tmp_path / "b.PDF").write_bytes(b"x" * 30)
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.exe").write_text("z")
    assert {r.file: r.text for r in files.text_files(spark, str(tmp_path)).collect()} == {"a.txt": "one\ntwo"}
    assert {r.file: r.verdict for r in files.uploads(files.listing(spark, str(tmp_path)), cap=20).collect()} == {"a.txt": "ok", "b.PDF": "too large", "c.txt": "empty", "d.exe": "unsupported"}
    listed = spark.createDataFrame([("a.pdf", "mpr"), ("a.txt", "MPR"), ("b.pdf", "other")], "file string, publication string")
    assert [tuple(r) for r in files.publication_uploads(listed, DEFAULT.publications).collect()] == [("a.pdf", "MPR")]
    assert files.sample(spark).first().text.startswith("REQ-1")
    logs = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}'), (3, None)], "id long, audit_data_json string")
    files.write_reports(logs, str(tmp_path / "out"), 2)
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(2, 2)]


def test_tables_are_made_once(spark):
    name = f"made_{np.random.default_rng().integers(1 << 40)}"
    tables.create(spark, name)
    tables.create(spark, name)
    tables.append(spark.createDataFrame([("f", 1)], "filename string, id long"), "documents", name)
    assert [(r.id, r.filename, r.chunk_count) for r in spark.table(f"{name}.documents").collect()] == [(1, "f", None)]
    assert tables.is_built(spark.table(f"{name}.documents")) and not tables.is_built(spark.table(f"{name}.audit_logs"))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_configuration(spark):
    spark.conf.set("proofloom.final_k", "3")
    spark.conf.set("proofloom.publications", "X, Y")
    p = configured(spark)
    assert (p.final_k, p.publications, p.rrf_k) == (3, ("X", "Y"), 60)
    spark.conf.unset("proofloom.final_k")
    spark.conf.unset("proofloom.publications")


def test_bm25_splits_documents_once(spark):
    """Scores come from written tokens: the plan reads the chunks' source nowhere, and only asked terms move."""
    plan = QUERIES["bm25_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_bm25_scores_do_not_move(spark):
    """A chunk's scores come from the task that holds its words; repeated words, blocks of queries and odd rows are all in them."""
    texts = ["red red blue", "Red", "", None, "green tape " * 40, "blue tape"]
    index = Q.bm25_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, chunk_text string"))
    queries = spark.createDataFrame([(1, "red tape red"), (2, "blue"), (3, "unknown"), (4, None), (None, "tape")], "query_id int, query string")
    idf, mean = {r.term: r.idf for r in index.terms.collect()}, index.totals.first().avgdl
    want = {}
    for c, t in enumerate(texts):
        w = (t or "").lower().split()
        for q, asked in queries.collect():
            parts = [idf[x] * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in (asked or "").lower().split() if x in w]
            if sum(parts) > 0:
                want[q, c] = pytest.approx(sum(parts), abs=2e-6)
    for p in (DEFAULT, replace(DEFAULT, max_queries=2)):
        scores = Q.bm25_scores(index, queries, p)
        assert {(r.query_id, r.chunk_id): r.bm25_score for r in scores.collect()} == want
        assert {(r.query_id, r.chunk_id) for r in scores.collect()} == set(want)
        assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
