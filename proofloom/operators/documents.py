"""Pages to sections to overlapping chunks, and the catalogue over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..params import DEFAULT
from ..shared import stored

#: Header patterns, in order of precedence; (?U) makes \w hold letters of all scripts.
NUMBERED = r"(?U)^(\d+\.\d+(?:\.\d+)?)\s+([A-Z][\w\s\-:,&/()]+)"
ROMAN = r"(?iU)^(Chapter|Section|Part)-?\s*(I{1,3}|IV|V|VI{0,3}|IX|X)[:\.\s]+(.+)"
ROMAN_NUMBERED = r"(?iU)^((?:I{1,3}|IV|V|VI{0,3}|IX|X)(?:\.\d+)+)(?:\.)?\s+([A-Z][\w\s\-:,&/()]+)"
BOX = r"(?U)^(Box\s+\d+\.\d+)[:\s]*(.*)"


def header(line: Column) -> Column:
    """(section_id, section_title) of a header line, else null."""
    get = lambda p, i: F.regexp_extract(line, p, i)
    made = lambda a, b: F.struct(a.alias("section_id"), T.strip(b).alias("section_title"))
    box = F.when(get(BOX, 2) == "", get(BOX, 1)).otherwise(get(BOX, 2))
    return (
        F.when(line.rlike(NUMBERED), made(get(NUMBERED, 1), get(NUMBERED, 2)))
        .when(line.rlike(ROMAN), made(F.concat_ws("_", get(ROMAN, 1), get(ROMAN, 2)), get(ROMAN, 3)))
        .when(line.rlike(ROMAN_NUMBERED), made(get(ROMAN_NUMBERED, 1), get(ROMAN_NUMBERED, 2)))
        .when(line.rlike(BOX), made(F.replace(get(BOX, 1), F.lit(" "), F.lit("_")), box))
    )


def prefix_sums(rows: DataFrame, key: str, order: str, value: Column, span: int, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows of the same key before them; order is a number without ties.

    A key's rows are summed in ranges of span numbers, and only the ranges' sums along the key, so no task holds a key.
    """
    part = F.expr(f"{order} div {span}")
    whole = rows.withColumns({"_value": value, "_part": part})
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.groupBy(key, "_part").agg(F.sum("_value").alias("_sum")).select(key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(bases, [key, "_part"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_value", "_part", "_base", "_within")


def _numbered_by_ranges(lines: DataFrame, span: int) -> DataFrame:
    """lines (doc_id, page_number, pos, x, head) with n, bare, page and some, as sections() has them, without a task a document.

    Pages fall into ranges of span; a range's headers, pages and whether it has any text are carried on to later ranges.
    """
    lines = lines.withColumn("_part", F.expr(f"page_number div {span}"))
    each = lines.groupBy("doc_id", "_part").agg(F.count("head").alias("h"), F.count_distinct("page_number").alias("p"), F.max(F.col("x") != "").alias("s"))
    whole = Window.partitionBy("doc_id")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select("doc_id", "_part", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("_h"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_p"), (F.sum("h").over(whole) == 0).alias("bare"), F.max("s").over(whole).alias("some"))
    own = Window.partitionBy("doc_id", "_part")
    lines = lines.withColumns({"_n": F.count("head").over(own.orderBy("page_number", "pos")), "_page": F.dense_rank().over(own.orderBy("page_number")).cast("long")}).join(carried, ["doc_id", "_part"])
    return lines.withColumns({"n": F.col("_n") + F.col("_h"), "page": F.col("_page") + F.col("_p")}).drop("_n", "_h", "_page", "_p", "_part")


def sections(pages: DataFrame, span: int | None = None) -> DataFrame:
    """Sections of pages (doc_id, page_number, text): each runs from its header to the next, over page breaks.

    Lines before the first header are dropped; a document without headers has a section a page. Each document is one task's
    unless span says how many pages are, which documents of very many pages need.
    """
    full = pages.filter(F.col("text") != "")
    lines = full.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("x", T.strip(F.col("line")))
    lines = lines.withColumn("head", header(F.col("x")))
    if span is None:
        whole = Window.partitionBy("doc_id")
        order = whole.orderBy("page_number", "pos")
        # Without any header a page is a section, so a document's last count tells which of two numbers its lines go by.
        lines = lines.withColumns({"n": F.count("head").over(order), "bare": F.count("head").over(whole) == 0, "page": F.dense_rank().over(whole.orderBy("page_number")).cast("long"), "some": F.max(F.col("x") != "").over(whole)})
    else:
        lines = _numbered_by_ranges(lines, span)
    lines = lines.filter("some AND (bare OR n > 0)").withColumn("section_ord", F.when(F.col("bare"), F.col("page")).otherwise(F.col("n")))
    kept = F.when(F.col("bare"), F.col("line")).when(F.col("head").isNull() & (F.col("x") != ""), F.col("x"))
    body = F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct("page_number", "pos", kept.alias("line")))))
    found = lines.groupBy("doc_id", "section_ord").agg(F.max("head.section_id").alias("id"), F.max("head.section_title").alias("title"), F.min("page_number").alias("start_page"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"))
    named = lambda c, prefix: F.coalesce(F.col(c), F.concat(F.lit(prefix), "start_page"))
    return found.select("doc_id", "section_ord", named("id", "UNSTRUCTURED-p").alias("section_id"), named("title", "Page ").alias("section_title"), "start_page", "text")


def windows(text: Column, size: int, overlap: int) -> Column:
    """A text's chunks: itself if it has at most size words, else runs of size words that overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the chunk size")

    def cut(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.array_join(F.slice(w, s + 1, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(runs)

    # As an element of an array the words are split once, not once for each run.
    return F.element_at(F.transform(F.array(T.words(text)), cut), 1)


def chunks(sections: DataFrame, size: int = DEFAULT.chunk_words, overlap: int = DEFAULT.chunk_overlap, span: int | None = None) -> DataFrame:
    """A row a chunk; chunk_idx counts through the whole document. Expects doc_id, text and section_ord.

    Only the sections' numbers of chunks are summed along a document, before chunks are cut, or, with span, along ranges of
    so many sections; without section_ord each row is a whole document, and nothing moves.
    """
    cut = sections.withColumn("_cut", windows(F.col("text"), size, overlap)).drop("text")
    if "section_ord" not in sections.columns:
        cut = cut.withColumn("_first", F.lit(0))
    elif span is None:
        before = Window.partitionBy("doc_id").orderBy("section_ord").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("_first", F.coalesce(F.sum(F.size("_cut")).over(before), F.lit(0)))
    else:
        cut = prefix_sums(cut, "doc_id", "section_ord", F.size("_cut"), span, "_first")
    names = [c for c in cut.columns if c not in ("_cut", "_first")]
    rows = cut.select(*names, "_first", F.posexplode("_cut").alias("_start", "chunk_text"))
    return rows.select(*names, "chunk_text", (F.col("_first") + F.col("_start")).cast("long").alias("chunk_idx"))


def chunk_count(text: Column, size: int = DEFAULT.chunk_words, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """How many chunks a text has."""
    count = lambda n: F.when(n == 0, 0).when(n <= size, 1).otherwise(F.floor((n - overlap - 1) / (size - overlap)).cast("int") + 1)
    return F.element_at(F.transform(F.array(F.size(T.words(text))), count), 1)


def chunk_id(publication: Column, edition: Column, section: Column, idx: Column) -> Column:
    return F.concat_ws("_", publication, edition, section, F.concat(F.lit("chunk"), idx))


def list_sections(chunks: DataFrame, publication: str | None = None, edition: str | None = None) -> DataFrame:
    """Sections of one edition, or of all, with their number of chunks and their first chunk's title and page.

    `place` is a section's place in its edition in text order of the ids, and rows come in that order.
    """
    rows = chunks if publication is None else chunks.filter((F.col("publication_name") == publication) & (F.col("edition_date") == edition))
    rows = rows.withColumn("section_id", F.coalesce("section_id", F.lit("unknown")))
    first = F.struct("doc_id", "chunk_idx")
    page = [F.min_by("page_number", first).alias("page_number")] if "page_number" in chunks.columns else []
    found = rows.groupBy("publication_name", "edition_date", "section_id").agg(F.min_by("section_title", first).alias("section_title"), *page, F.count("*").alias("chunk_count"))
    edition_order = Window.partitionBy("publication_name", "edition_date").orderBy("section_id")
    return found.withColumn("place", F.row_number().over(edition_order).cast("long")).orderBy("publication_name", "edition_date", "section_id")


def ingested(pages: DataFrame, size: int = DEFAULT.chunk_words, overlap: int = DEFAULT.chunk_overlap, span: int | None = None) -> DataFrame:
    """Pages (doc_id, publication_name, edition_date, page_number, text) to chunks with their ids, in one move by document or, with span, by ranges of pages."""
    names = pages.groupBy("doc_id").agg(F.first("publication_name").alias("publication_name"), F.first("edition_date").alias("edition_date"))
    rows = chunks(sections(pages, span), size, overlap, span).withColumnRenamed("start_page", "page_number").join(names, "doc_id")
    return rows.withColumn("chunk_id", chunk_id(F.col("publication_name"), F.col("edition_date"), F.col("section_id"), F.col("chunk_idx")))


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_sections, n_chunks) of what an ingest made."""
    return chunks.groupBy("doc_id").agg(F.count_distinct("section_ord").alias("n_sections"), F.count("*").alias("n_chunks"))


def numbered(rows: DataFrame, order: list[Column], name: str, after: int = 0) -> DataFrame:
    """rows with `name`, counting on from `after` in the given order: a count a range reaches the driver, no row does."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    bases, total = [], after
    for part in sorted(counts):
        bases.append((part, total))
        total += counts[part]
    base = rows.sparkSession.createDataFrame(bases, "_part int, _base long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base")


def appended(old: DataFrame, new: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """old and the new rows beside it, each with the next id in the given order; nothing is replaced."""
    last = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return old.unionByName(numbered(new, order, key, last), allowMissingColumns=True)


def registered(documents: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """documents (id, filename, publication_name, edition_date, chunk_count, ingested_at) with the ingested files
    (doc_id, filename, ingested_at) appended; a file that comes again is a row again."""
    each = chunks.groupBy("doc_id").agg(F.first("publication_name").alias("publication_name"), F.first("edition_date").alias("edition_date"), F.count("*").alias("chunk_count"))
    new = files.join(each, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long"))).drop("doc_id")
    return appended(documents, new, [F.col("ingested_at"), F.col("filename")])


def list_documents(documents: DataFrame) -> DataFrame:
    """Newest ingest first; of equals the later id."""
    return documents.orderBy(F.desc("ingested_at"), F.desc("id"))


def newest(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows in the given order, with their `place`; n is what bounds the one task that numbers them."""
    return rows.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("long"))


def replaced_editions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the editions that new holds, and new: unlike an upsert, no surplus chunk of an edition stays."""
    edition = ["publication_name", "edition_date"]
    return old.join(new.select(*edition).distinct(), edition, "left_anti").unionByName(new)


def documents_with_sections(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each registered document with its sections, in the order they are first seen, as one comma-joined column."""
    seen = chunks.filter("section_id <> ''").groupBy("publication_name", "edition_date", "section_id").agg(F.min(F.struct("doc_id", "chunk_idx")).alias("at"))
    nested = seen.groupBy("publication_name", "edition_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "section_id"))), lambda x: x["section_id"]), ",").alias("sections"), F.count("*").alias("n_sections"))
    return documents.join(nested, ["publication_name", "edition_date"], "left").withColumns({"sections": F.coalesce("sections", F.lit("")), "n_sections": F.coalesce("n_sections", F.lit(0).cast("long"))})


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id", version: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key, and beside the rest; surplus old keys stay.

    Of new rows with the same key the one of greatest version stays, or, without one, of greatest values.
    """
    own = [c for c in new.columns if c != key]
    last = F.max_by(F.struct(*own), version) if version else F.max(F.struct(*own))
    one = new.groupBy(key).agg(last.alias("_r")).select(key, "_r.*") if own else new.distinct()
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    new = changes.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(rows.columns)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")
