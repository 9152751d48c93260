"""The registered queries: every operator on whole tables of a data folder.

``(spark, folder) -> DataFrame``. The tables stand in for the operators' inputs: `documents` for
source files, `embeddings` for stored vectors, `events` for query timings. Query vectors are the
mean vector of each label, so the work is linear in the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import display, text, vector
from quillvec.operators import balls, blockscan, chunking, corpus, embedding, graph, ivf, lsh, ordinal, quantiser, recall, report, search, sketches, subwords, verify
from quillvec.plans import sweep
from quillvec.session import durable, scratch_path
from quillvec.sources import files as sources
from quillvec.sources import filetree, footers, repos, results, shards, vectors
from quillvec.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HASH_DIM = 32
PREFIX_DIMS = (16, 32, 64)
LSH_TABLES, LSH_BITS = 8, 6
#: What the sweep's approximate methods must find of the best 10; measured are 0.31 to 0.62 at the three sizes of the tables.
RECALL_FLOOR = 0.25
PRODUCTION, RESEARCH = ("purchase", "signup"), ("click", "view")
# The outcomes of a clone, and one that is not known yet.
STATUSES = ("cloned", "updated", "update_failed", "failed", "timeout", "git_error", "error", "future_error")
EXTENSIONS = (".py", ".C", ".md", ".txt", "", ".tar.gz", ".", ".Json")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def round6(column: str) -> Column:
    return F.round(column, 6).alias(column)


# -- shaped inputs -------------------------------------------------------------------------


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings scaled by 1..7, so that inner product and distance rank differently."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", vector.scaled(F.col("embedding"), 1 + F.col("vec_id") % 7).alias("embedding")
    )


def label_means(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    rows = table(spark, folder, "embeddings")
    mean = Summarizer.mean(array_to_vector(vector.as_double(F.col("embedding"))))
    means = rows.groupBy("label").agg(vector_to_array(mean).alias("mean"))
    return means.select(
        F.col("label").cast("bigint").alias("query_id"),
        F.transform("mean", lambda x: F.round(x, 6)).alias("qv"),
    )


def label_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One centroid per label: its vector of smallest id.

    The ids are found first and the vectors joined to them: aggregating the arrays themselves
    would sort the whole table.
    """
    rows = table(spark, folder, "embeddings")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("vec_id")).withColumnRenamed("label", "cell")
    return rows.join(first, "vec_id").select("cell", vector.as_double(F.col("embedding")).alias("c"))


def formula_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Hyperplanes from integer arithmetic that any engine repeats exactly."""
    width = table(spark, folder, "embeddings").select(F.size("embedding").alias("dim")).limit(1)
    plane = F.explode(F.sequence(F.lit(0), F.lit(LSH_TABLES * LSH_BITS - 1)))
    p = F.col("plane")

    def component(j: Column) -> Column:
        return ((p * 7919 + (j + 1) * 104729 + p * p * (j + 3) * 13) % 2003 - 1001) / 1001.0

    return width.select("dim", plane.alias("plane")).select(
        "plane", F.transform(F.sequence(F.lit(0), F.col("dim") - 1), component).alias("h")
    )


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files ``(doc_id, repo_name, path, size, content)``.

    Paths cycle through suffixes and hidden folders; some texts get CRLF line ends or a NUL.
    """
    doc = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc % len(EXTENSIONS) + 1).cast("int"))
    path = (
        F.when(doc % 17 == 0, F.concat_ws("/", "source", F.lit(".git"), doc))
        .when(doc % 13 == 0, F.concat(F.concat_ws("/", "source", F.lit(".github"), doc), F.lit(".yml")))
        .when(doc % 19 == 0, F.concat_ws("/", "source", "lang", doc, F.lit(".gitignore")))
        .otherwise(F.concat(F.concat_ws("/", "source", "lang", doc), suffix))
    )
    content = F.when(doc % 30 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.when(doc % 50 == 0, F.concat(content, F.lit("\x00"))).otherwise(content)
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("repo_name"), path.alias("path"), F.col("n_chars").alias("size"),
        content.alias("content"),
    )


def usable_files(spark: SparkSession, folder: str) -> DataFrame:
    return _usable(source_files(spark, folder))


def _usable(files: DataFrame) -> DataFrame:
    return corpus.usable_contents(files.withColumn("content", text.normalize_newlines(F.col("content"))))


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_lines(usable_files(spark, folder).select("doc_id", "repo_name", "path", "content"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token-bounded chunks; a small table is spread first, because the encoder is CPU-heavy."""
    files = spread(source_files(spark, folder).select("doc_id", "content"), "doc_id")
    return chunking.truncate_tokens(chunking.chunk_lines(_usable(files))).select("doc_id", "chunk_no", "tokens")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One clone outcome per source, its status by the source's number."""
    number = F.regexp_extract("repo_name", "[0-9]+", 0).cast("int")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), number % len(STATUSES) + 1)
    names = table(spark, folder, "documents").select(F.col("source").alias("repo_name")).distinct()
    return names.select("repo_name", status.alias("status"), F.concat(F.lit("detail of "), "repo_name").alias("detail"))


def shard_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as prefixes in three dimensions and files of 100, with planted faults."""
    shard = F.floor(F.col("vec_id") / 100).cast("bigint")
    rows = table(spark, folder, "embeddings").withColumn("dim", F.explode(F.lit(list(PREFIX_DIMS)).cast("array<int>")))
    short = (F.col("dim") == 32) & (shard == 3)
    empty = (F.col("dim") == 16) & (F.col("vec_id") % 1000 == 205)
    prefix = F.slice("embedding", F.lit(1), F.when(short, F.col("dim") - 1).otherwise(F.col("dim")))
    return rows.select(
        "vec_id",
        "dim",
        F.format_string("dim_%d/part_%06d", "dim", shard).alias("file"),
        (shard * 7 + F.col("dim") * 1000).alias("file_size"),
        F.when(~empty, prefix).alias("embedding"),
        F.when((shard != 2) & (F.col("vec_id") % 37 != 0), F.format_string("meta %d", "vec_id")).alias("metadata"),
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("library"),
        F.when(F.col("user_id") % 2 == 0, "flat").otherwise("cells").alias("index_type"),
        F.expr("shiftleft(128, cast(user_id % 5 AS INT))").alias("dimension"),
        F.col("value").alias("seconds"),
    )


def raw_results(spark: SparkSession, folder: str) -> DataFrame:
    return timings(spark, folder).groupBy("library", "index_type", "dimension").agg(
        F.min("query_id").alias("run_no"),
        F.count("*").alias("num_vectors"),
        (F.max("seconds") / 10.0).alias("build_time"),
        (F.sum("seconds") / 7.0).alias("memory_usage_mb"),
        F.avg("seconds").alias("query_time_avg"),
        F.stddev_pop("seconds").alias("query_time_std"),
        F.avg(F.when(F.col("seconds") > 5.0, 1.0).otherwise(0.0)).alias("recall_at_k"),
        F.try_divide(F.lit(1.0), F.avg("seconds")).alias("throughput_qps"),
    )


def bench_results(spark: SparkSession, folder: str) -> DataFrame:
    return report.results_table(raw_results(spark, folder))


def weighted_bits(embedding: Column | str, name: str) -> Column:
    """Exact checksum of a half-precision vector: position times value in units of 2^-24."""
    terms = F.transform(
        embedding, lambda x, j: (x.cast("double") * F.lit(float(1 << 24))).cast("bigint") * (j + 1).cast("bigint")
    )
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda total, x: total + x).alias(name)


# -- search --------------------------------------------------------------------------------


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "vec_id", round6("score"))


@query
def knn_ip(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(search.knn(label_means(spark, folder), stored_vectors(spark, folder), 100, "ip"))


@query
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(search.knn(label_means(spark, folder), stored_vectors(spark, folder), 100, "l2"))


@query
def knn_random_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's workload: 1,000 random queries, 100 answers each."""
    base = table(spark, folder, "embeddings")
    dim = base.select(F.size("embedding")).first()[0]
    return search.knn(vectors.random_queries(spark, dim, seed=7), base, 100, "ip")


@query
def knn_thousand(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's workload with queries from integer arithmetic, in several blocks."""
    base = table(spark, folder, "embeddings")
    width = base.select(F.max(F.size("embedding")).alias("dim"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(vectors.NUM_QUERIES - 1))).alias("q")
    q = F.col("q")
    component = F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda j: ((q * 7919 + (j + 1) * 104729 + q * (j + 3) * 13) % 2003 - 1001) / 1001.0)
    asked = width.select("dim", ids).select(q.cast("bigint").alias("query_id"), component.alias("qv"))
    return _hits(search.knn(asked, base, 100, "ip", block_bytes=1 << 16))


@query
def vector_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that a search refuses: planted wrong lengths, nulls and components that are not finite."""
    v = F.col("embedding").cast("array<double>")
    n = F.col("vec_id")
    spoilt = (
        F.when(n % 11 == 3, F.slice(v, 1, 5))
        .when(n % 13 == 4, F.transform(v, lambda x, j: F.when(j == n % 7, F.lit(None)).otherwise(x)))
        .when(n % 17 == 5, F.transform(v, lambda x, j: F.when(j == n % 5, F.lit(float("nan"))).otherwise(x)))
        .when(n % 19 == 6, F.transform(v, lambda x, j: F.when(j == n % 3, F.lit(float("-inf"))).otherwise(x)))
        .when(n % 23 != 7, v)
    )
    rows = table(spark, folder, "embeddings").select("vec_id", spoilt.alias("embedding"))
    return blockscan.unusable_vectors(rows, 64)


@query
def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.knn(label_means(spark, folder), stored_vectors(spark, folder), 100, "ip")
    cut = search.k_sweep(hits)
    return cut.groupBy("query_id", "k").agg(
        F.count("*").alias("n_hits"), F.round(F.min("score"), 6).alias("last_score")
    )


def _mean_query(spark: SparkSession, folder: str) -> Column:
    means = label_means(spark, folder)
    return means.agg(F.min_by("qv", "query_id").alias("qv")).scalar()


@query
def distance_row(spark: SparkSession, folder: str) -> DataFrame:
    row = search.distance_row(_mean_query(spark, folder), stored_vectors(spark, folder))
    return row.select("vec_id", round6("distance"))


@query
def distance_argsort(spark: SparkSession, folder: str) -> DataFrame:
    row = search.distance_row(_mean_query(spark, folder), stored_vectors(spark, folder))
    return search.argsort_head(row, 100).select("vec_id", round6("distance"))


def _cell_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The vectors stored by cell: a search reads only probed cells."""
    centroids = label_cells(spark, folder)
    target = scratch_path(spark, "cells")
    return centroids, ivf.ivf_build(stored_vectors(spark, folder), centroids, target)


@query
def ivf_assign(spark: SparkSession, folder: str) -> DataFrame:
    assigned = ivf.ivf_assign(stored_vectors(spark, folder), label_cells(spark, folder))
    return assigned.select("vec_id", "cell")


@query
def ivf_search(spark: SparkSession, folder: str) -> DataFrame:
    centroids, index = _cell_index(spark, folder)
    return _hits(ivf.ivf_search(label_means(spark, folder), index, centroids, 10, nprobe=3))


@query
def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    centroids, index = _cell_index(spark, folder)
    queries = label_means(spark, folder)
    exact = search.knn(queries, stored_vectors(spark, folder), 10, "ip")
    rows = []
    for nprobe in (1, 2, 4):
        approx = ivf.ivf_search(queries, index, centroids, 10, nprobe)
        rows.append(recall.recall_at_k(approx, exact, (1, 10)).withColumn("nprobe", F.lit(nprobe)))
    return vectors.stack(rows).select("nprobe", "k", "n_queries", round6("recall"))


@query
def ivf_train(spark: SparkSession, folder: str) -> DataFrame:
    """Trained cells: how many vectors have one, and is each one's cell the best of all?"""
    base = table(spark, folder, "embeddings")
    centroids = ivf.ivf_train(base, seed=1)
    cells = centroids.select(F.col("cell").alias("vec_id"), F.col("c").alias("embedding"))
    best = search.knn(base.select(F.col("vec_id").alias("query_id"), vector.as_double(F.col("embedding")).alias("qv")), cells, 1)
    best = best.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("best"))
    joined = ivf.ivf_assign(base, centroids).join(best, "vec_id")
    return joined.agg(
        F.count("cell").alias("n_assigned"),
        F.count_if(F.col("cell") != F.col("best")).alias("n_wrong"),
        (F.max("cell") < ivf.cell_count(base.count())).alias("cells_ok"),
    )


@query
def quantiser_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Two levels of cells, four vectors a cell: has each vector a cell, and is it mostly the best of all cells?"""
    base = table(spark, folder, "embeddings")
    tree = quantiser.quantiser_train(base, max(1, base.count() // 4), seed=1)
    met = quantiser.agreement(base, tree)
    return met.select(F.col("n").alias("n_assigned"), (F.col("agree") >= F.col("n") / 3).alias("agree_ok"))


@query
def quantiser_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search of every cell through both levels, which must be exact."""
    base = stored_vectors(spark, folder)
    tree = quantiser.quantiser_train(base, 64, seed=1)
    target = scratch_path(spark, "fine-cells")
    vectors.write_vectors(quantiser.quantiser_assign(base, tree), target, "cell", rebalance=True)
    index = spark.read.parquet(target)
    return _hits(quantiser.quantiser_search(label_means(spark, folder), index, tree, 100, nprobe=256, coarse_probe=16))


@query
def lsh_assign(spark: SparkSession, folder: str) -> DataFrame:
    assigned = lsh.lsh_assign(stored_vectors(spark, folder), formula_planes(spark, folder), LSH_BITS)
    return assigned.select("vec_id", F.posexplode("buckets").alias("tbl", "bucket"))


@query
def lsh_search(spark: SparkSession, folder: str) -> DataFrame:
    planes = formula_planes(spark, folder)
    index = lsh.lsh_assign(stored_vectors(spark, folder), planes, LSH_BITS)
    return _hits(lsh.lsh_search(label_means(spark, folder), index, planes, LSH_BITS, 10))


@query
def lsh_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The same answers as ``lsh_search``, from a posting table by bucket."""
    planes = formula_planes(spark, folder)
    postings = lsh.lsh_postings(stored_vectors(spark, folder), planes, LSH_BITS, scratch_path(spark, "postings"), folders=64)
    return _hits(lsh.posting_search(label_means(spark, folder), postings, planes, 10))


@query
def graph_exact(spark: SparkSession, folder: str) -> DataFrame:
    """A walk that keeps as many vectors as a shard holds meets all of them: are all reached, and is the answer exact?"""
    index = graph.graph_build(stored_vectors(spark, folder), scratch_path(spark, "graph"))
    walked = graph.graph_walk(label_means(spark, folder), index, 100, ef=graph.SHARD_ROWS)
    return _hits(graph.graph_search(walked, 100))


@query
def graph_search(spark: SparkSession, folder: str) -> DataFrame:
    """Walks from every vector whose id is divisible by 20, by both metrics at the benchmark's ``ef``: recall of 10 and the
    share of vectors compared, as flags."""
    base = stored_vectors(spark, folder)
    asked = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    n = F.lit(base.count())
    rows = []
    for metric in blockscan.METRICS:
        index = graph.graph_build(base, scratch_path(spark, "graph"), metric)
        walked = durable(graph.graph_walk(asked, index, 10, metric=metric))
        met = graph.visits(walked).agg(F.count("*").alias("n_queries"), F.avg("visited").alias("visited"))
        found = recall.recall_at_k(graph.graph_search(walked, 10, metric), search.knn(asked, base, 10, metric), [10])
        flags = met.select("n_queries", (F.col("visited") < n).alias("visited_ok"), F.lit(metric).alias("metric"))
        rows.append(flags.join(found.select((F.col("recall") >= 0.9).alias("recall_ok"), "n_queries"), "n_queries"))
    return vectors.stack(rows).select("metric", "n_queries", "recall_ok", "visited_ok")


@query
def ball_search(spark: SparkSession, folder: str) -> DataFrame:
    """Exact nearest vectors through balls, with cells and shells small enough to be many."""
    base = stored_vectors(spark, folder)
    index, table_of_balls = balls.ball_build(base, label_cells(spark, folder), scratch_path(spark, "balls"), ball_rows=50)
    return _hits(balls.ball_search(label_means(spark, folder), index, table_of_balls, 100))


@query
def ball_pruning(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors drawn together by label, asked by those whose id is divisible by 20: answers that differ from the full scan's, and
    whether at least half of all comparisons were left out."""
    together = F.transform("embedding", lambda x, j: x.cast("double") / 4 + F.when((F.col("label") * 7 + j) % 5 == 0, F.col("label") % 11).otherwise(0))
    base = table(spark, folder, "embeddings").select("vec_id", together.alias("embedding"))
    asked = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    centres = balls.ball_train(base, seed=1)
    index, table_of_balls = balls.ball_build(base, centres, scratch_path(spark, "balls"), ball_rows=50)
    visits = balls.ball_visits(asked, index, table_of_balls, 5)
    found = balls.ball_search(asked, index, table_of_balls, 5, visits)
    wrong = search.knn(asked, base, 5, "l2").exceptAll(found).agg(F.count("*").alias("n_wrong"))
    met = visits.rows().agg(F.count("*").alias("n_queries"), (F.avg("visited") < F.lit(base.count()) / 2).alias("pruned_ok"))
    return met.select("*", F.coalesce(wrong.scalar(), F.lit(0)).alias("n_wrong"))


@query
def search_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Methods on two dimensions (prefixes) with the benchmark's 1,000 queries: what was measured, as flags."""
    base = table(spark, folder, "embeddings").withColumn("dim", F.explode(F.lit([32, 64]).cast("array<int>")))
    base = base.select("vec_id", "dim", F.slice("embedding", F.lit(1), F.col("dim")).alias("embedding"))
    asked = vectors.stack([vectors.random_queries(spark, dim) for dim in (32, 64)])
    methods = [sweep.flat_ip(), sweep.flat_l2(), sweep.inverted_file(nprobe=4), sweep.signed_planes(8, 6)]
    _, rows, failures = sweep.search_sweep(base, asked, methods, (32, 64, 99), k=100)
    exact = F.col("library") == "block"
    measured = rows.select(
        "library",
        "dimension",
        "num_vectors",
        (F.when(exact, F.col("recall_at_k") == 1.0).otherwise(F.col("recall_at_k") >= RECALL_FLOOR)).alias("recall_ok"),
        ((F.col("query_time_avg") > 0) & (F.col("query_time_std") > 0) & (F.col("throughput_qps") > 0)).alias("timed"),
        F.lit(None).cast("string").alias("failure"),
    )
    failed = failures.select(
        "library", "dimension", F.lit(None).cast("bigint").alias("num_vectors"), F.lit(None).cast("boolean").alias("recall_ok"),
        F.lit(None).cast("boolean").alias("timed"), "failure"
    )
    return measured.unionByName(failed).fillna({"failure": "-", "num_vectors": 0, "recall_ok": False, "timed": False})


# -- corpus --------------------------------------------------------------------------------


@query
def repo_catalog(spark: SparkSession, folder: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/"), "source", F.lit(".git")).alias("repo_url")
    return repos.repo_catalog(table(spark, folder, "documents").select(url, F.col("source").alias("repo_name")))


def _written_tree(spark: SparkSession, folder: str) -> str:
    """Every document as a file, some with bytes that are no UTF-8, CRLF line ends or hidden names."""
    doc, body = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    suffix = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.when(doc % 5 == 0, "_").when(doc % 7 == 0, ".").otherwise(""), F.lit("d"), doc.cast("string"), suffix)
    stray = F.unhex(F.lit("FFFE41C3"))
    content = F.when(doc % 6 == 0, F.concat(stray, body)).when(doc % 4 == 0, F.concat(body, F.unhex(F.lit("0D0A780D79E2")))).otherwise(body)
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    rows = spread(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"), "doc_id")
    root = scratch_path(spark, "tree")
    failed = filetree.write_file_tree(rows.select(path.alias("path"), content.alias("content")), root).count()
    if failed:
        raise OSError(f"{failed} files were not written")
    return root


def _below(root: str) -> Column:
    return F.substr("path", F.lit(len(filetree.local_path(root)) + 2))


@query
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Written files as the data source lists them: suffix and size are pushed, no file is opened."""
    root = _written_tree(spark, folder)
    found = filetree.read_file_tree(spark, root, content="false").where("extension IN ('.py', '.md', '.c', '.gz') AND size >= 200")
    return found.select("repo_name", _below(root).alias("path"), "extension", "size")


@query
def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Written files read back: bytes that are no UTF-8 are gone, all line ends are line feeds."""
    root = _written_tree(spark, folder)
    found = filetree.read_file_tree(spark, root)
    return found.select(_below(root).alias("path"), F.md5("content").alias("file_hash"), F.length("content").alias("n_chars"))


@query
def file_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Files of too many characters are rows with a reason."""
    root = _written_tree(spark, folder)
    found = filetree.read_file_tree(spark, root, max_chars=5000).where(F.col("error").isNotNull())
    return found.select("repo_name", _below(root).alias("path"), "error")


@query
def doc_filter(spark: SparkSession, folder: str) -> DataFrame:
    return usable_files(spark, folder).select("doc_id", F.length("content").cast("int").alias("n_chars"))


@query
def doc_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.content_rejects(source_files(spark, folder)).select("doc_id", "reason")


@query
def doc_hash(spark: SparkSession, folder: str) -> DataFrame:
    files = usable_files(spark, folder).select("doc_id", "path", "content")
    return files.select("doc_id", text.repo_of(F.col("path")).alias("repo"), text.content_hash(F.col("content")).alias("file_hash"))


@query
def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = document_chunks(spark, folder)
    return chunks.select("doc_id", "chunk_no", "start_line", "n_lines", F.md5("chunk").alias("chunk_hash"))


@query
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk_stats(document_chunks(spark, folder), "repo_name")


@query
def token_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(spark, folder).select(
        "doc_id", "chunk_no", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_hash")
    )


@query
def subword_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks cut after an encoder's own 128 tokens, two of them its signs for begin and end: how what is kept relates to the
    chunk, as flags."""
    import public_tokenizers

    files = spread(source_files(spark, folder).select("doc_id", "content"), "doc_id")
    chunks = chunking.chunk_lines(_usable(files)).select("doc_id", "chunk_no", "chunk")
    cut = subwords.truncate_subwords(chunks, public_tokenizers.path("byte_bpe_50k.json"), special=2)
    n = F.col("n_tokens")
    return cut.select(
        "doc_id",
        "chunk_no",
        F.md5("chunk").alias("chunk_hash"),
        (F.size("token_ids") == F.least(n, F.lit(126))).alias("count_ok"),
        (F.startswith("chunk", "kept") & ((n > 126) | (F.col("chunk") == F.col("kept")))).alias("kept_ok"),
    )


@query
def embed_batches(spark: SparkSession, folder: str) -> DataFrame:
    tokens = document_tokens(spark, folder)
    done = embedding.embedded(embedding.embed(tokens, embedding.HashingEncoder(HASH_DIM), HASH_DIM))
    used = F.size(F.filter("embedding", lambda x: x != 0)).alias("n_used")
    return done.select("doc_id", "chunk_no", used, weighted_bits("embedding", "weighted"))


class Faulty:
    """An encoder that fails on a batch with a text of a multiple of ten tokens."""

    def __init__(self, dim: int):
        self.good = embedding.HashingEncoder(dim)

    def __call__(self):
        def encode(batch: list[list[str]]):
            if any(len(words) % 10 == 0 for words in batch):
                raise RuntimeError("a multiple of ten tokens")
            return self.good()(batch)

        return encode


@query
def embed_failures(spark: SparkSession, folder: str) -> DataFrame:
    """What a faulty encoder leaves: the failed rows with their reason (batches of one row, so that no others fail with them)."""
    tokens, path = document_tokens(spark, folder), scratch_path(spark, "embedded")
    embedding.embed_run(tokens, Faulty(HASH_DIM), HASH_DIM, path, "1", ["doc_id", "chunk_no"], batch_size=1)
    return embedding.embed_failures(spark, path, tokens.schema, ["doc_id", "chunk_no"])


@query
def embed_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A run with the faulty encoder and one with a good one: each chunk has one vector, in the run that first could make it."""
    tokens, path = document_tokens(spark, folder), scratch_path(spark, "embedded")
    embedding.embed_run(tokens, Faulty(HASH_DIM), HASH_DIM, path, "1", ["doc_id", "chunk_no"], batch_size=1)
    embedding.embed_run(tokens, embedding.HashingEncoder(HASH_DIM), HASH_DIM, path, "2", ["doc_id", "chunk_no"])
    done = embedding.embedded_rows(spark, path, tokens.schema)
    return done.select("doc_id", "chunk_no", F.col("run").cast("int").alias("run"), weighted_bits("embedding", "weighted"))


@query
def embed_hashing(spark: SparkSession, folder: str) -> DataFrame:
    done = embedding.embed_hashing(document_tokens(spark, folder), 64)
    return done.select("doc_id", "chunk_no", F.round(vector.inner_product(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


@query
def path_filter(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.visible_files(source_files(spark, folder)).select("doc_id", "path")


@query
def ext_class(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return source_files(spark, folder).select(
        "doc_id", text.file_suffix(path).alias("suffix"), text.is_code_path(path).alias("is_code")
    )


@query
def file_index(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered, written as text, and read back."""
    numbered = sources.number_files(source_files(spark, folder).select("repo_name", "path"))
    target = scratch_path(spark, "file-index")
    sources.write_file_index(numbered, target)
    return sources.read_file_index(spark, target)


def _index_lines(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    line = F.format_string("  %d\t:  %s \t", doc, "path")
    line = F.when(doc % 23 == 0, F.format_string("x%d : %s", doc, "path")).otherwise(line)
    line = F.when(doc % 11 == 0, F.format_string("%d %s", doc, "path")).otherwise(line)
    return source_files(spark, folder).select(line.alias("value"))


@query
def index_parse(spark: SparkSession, folder: str) -> DataFrame:
    return sources.valid_index(sources.parse_index_lines(_index_lines(spark, folder)))


@query
def index_rejects(spark: SparkSession, folder: str) -> DataFrame:
    bad = sources.rejected_index(sources.parse_index_lines(_index_lines(spark, folder)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query
def index_workers(spark: SparkSession, folder: str) -> DataFrame:
    index = sources.valid_index(sources.parse_index_lines(_index_lines(spark, folder)))
    return sources.with_worker(index, 64).groupBy("worker_id").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query
def index_range(spark: SparkSession, folder: str) -> DataFrame:
    index = sources.valid_index(sources.parse_index_lines(_index_lines(spark, folder)))
    return sources.index_range(index, 100, 700)


@query
def index_range_files(spark: SparkSession, folder: str) -> DataFrame:
    """A range of a stored index, read from the files that overlap it."""
    numbered = sources.number_files(source_files(spark, folder).select("repo_name", "path"))
    target = scratch_path(spark, "ranged-index")
    sources.write_ranged_index(numbered, target, files=16)
    return sources.read_ranged_index(spark, target, 50, 120)


@query
def numbered_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs of files, the second one repeated: numbers go on without gaps."""
    rows, target = source_files(spark, folder).select("doc_id", "path"), scratch_path(spark, "numbered")
    for run in (0, 1, 1, 2):
        ordinal.number_run(rows.where(F.col("doc_id") % 3 == run).select("path"), ["path"], target, str(run))
    return spark.read.schema("path string, idx bigint, run int").parquet(f"{target}/rows")


@query
def index_missing(spark: SparkSession, folder: str) -> DataFrame:
    index = sources.valid_index(sources.parse_index_lines(_index_lines(spark, folder)))
    present = corpus.visible_files(source_files(spark, folder))
    return sources.missing(index, present).select("idx", "path")


@query
def index_existing(spark: SparkSession, folder: str) -> DataFrame:
    index = sources.valid_index(sources.parse_index_lines(_index_lines(spark, folder)))
    present = corpus.visible_files(source_files(spark, folder))
    return sources.existing(index, present).select("idx", "path")


@query
def repo_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.repo_stats(source_files(spark, folder))


@query
def repo_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.outcome_stats(outcomes(spark, folder), corpus.repo_stats(source_files(spark, folder)))


@query
def repo_failures(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.failures(outcomes(spark, folder))


@query
def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.outcome_counts(outcomes(spark, folder))


@query
def corpus_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = corpus.corpus_totals(outcomes(spark, folder), corpus.repo_stats(source_files(spark, folder)))
    return totals.select(
        F.coalesce("repo_name", F.lit("all repositories")).alias("repo_name"),
        "total_files",
        "code_files",
        "total_size_gb",
        display.thousands(F.col("total_files")).alias("files_text"),
        display.fixed(F.col("total_size_gb"), 3).alias("size_text"),
    )


# -- vectors -------------------------------------------------------------------------------


@query
def half_round(spark: SparkSession, folder: str) -> DataFrame:
    rounded = stored_vectors(spark, folder).select("vec_id", vector.to_half(F.col("embedding")).alias("embedding"))
    return rounded.select("vec_id", weighted_bits("embedding", "weighted"))


@query
def random_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn vectors: has each its length, and only half-precision components of a plausible size?"""
    drawn = vectors.random_vectors(table(spark, folder, "embeddings").select("vec_id"), (16, 64), seed=3)
    half = vector.to_half(F.col("embedding"))
    return drawn.select(
        "vec_id",
        "dim",
        (F.size("embedding") == F.col("dim")).alias("length_ok"),
        (half == F.col("embedding")).alias("half_ok"),
        F.forall("embedding", lambda x: F.abs(x) < 8).alias("size_ok"),
    )


@query
def random_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Are mean and deviation of the drawn components within five standard errors?"""
    drawn = vectors.random_vectors(table(spark, folder, "embeddings").select("vec_id"), (16, 64), seed=3)
    values = drawn.select("dim", F.explode("embedding").alias("x"))
    n = F.count("*")
    return values.groupBy("dim").agg(
        n.alias("components"),
        (F.abs(F.avg("x")) < 5.0 / F.sqrt(n)).alias("mean_ok"),
        (F.abs(F.stddev_pop("x") - 1.0) < 5.0 / F.sqrt(2.0 * n)).alias("deviation_ok"),
    )


@query
def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    """Written by dimension, read back with file lineage, and verified."""
    target = scratch_path(spark, "vectors")
    drawn = vectors.random_vectors(table(spark, folder, "embeddings").select("vec_id"), (16, 64), seed=3)
    vectors.write_vectors(drawn, target, max_rows=300)
    back = vectors.with_file(spark.read.parquet(target))
    return verify.verify_shards(back, (16, 32, 64), 500).select("dim", "total_vectors", "errors", "mark")


@query
def vector_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One dimension of a stored table; only its folder is read."""
    target = scratch_path(spark, "vectors")
    rows = shard_rows(spark, folder).select("vec_id", "dim", "embedding")
    vectors.write_vectors(rows, target)
    back = vectors.read_vectors(spark, target, 64)
    return back.select("vec_id", weighted_bits(vector.to_half(F.col("embedding")), "weighted"))


@query
def committed_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of exact size in two dimensions: the manifest beside what the files hold."""
    target = scratch_path(spark, "shards")
    rows = table(spark, folder, "embeddings").withColumn("dim", F.explode(F.lit([16, 64]).cast("array<int>")))
    rows = rows.select("vec_id", "dim", F.slice("embedding", F.lit(1), F.col("dim")).alias("embedding"))
    shards.write_shards(rows, target, max_rows=300)
    held = shards.read_shards(spark, target).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*/[^/]*$", 0))
    held = held.groupBy("file").agg(F.count("*").alias("held"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    return shards.read_manifest(spark, target).join(held, "file").select("dim", "shard", "file", "rows", "held", "first_id", "last_id")


@query
def worker_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Written apart by worker range and read back."""
    target = scratch_path(spark, "workers")
    rows = table(spark, folder, "embeddings").withColumn("worker_id", F.floor(F.col("vec_id") / 64).cast("int"))
    vectors.write_vectors(rows, target, by="worker_id", rebalance=True)
    return spark.read.parquet(target).groupBy("worker_id").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")
    )


@query
def vector_stack(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "embeddings")
    parts = [
        base.select("vec_id", F.lit(dim).alias("dim"), F.slice("embedding", 1, dim).alias("embedding"))
        for dim in PREFIX_DIMS
    ]
    chosen = vectors.select_dims(vectors.stack(parts), (16, 64))
    return chosen.groupBy("dim").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("length"))


@query
def batch_numbers(spark: SparkSession, folder: str) -> DataFrame:
    numbered = ordinal.with_ordinal(table(spark, folder, "embeddings").select("vec_id"), ["vec_id"])
    return ordinal.with_batch(numbered, 64).groupBy("batch_no").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")
    )


@query
def shard_verify(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify_shards(shard_rows(spark, folder), (*PREFIX_DIMS, 128), 500)


@query
def shard_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = verify.shard_errors(shard_rows(spark, folder), (*PREFIX_DIMS, 128))
    return errors.select("dim", F.coalesce("file", F.lit("-")).alias("file"), "error")


@query
def verify_files(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify_files(shard_rows(spark, folder), ("dim",))


@query
def verify_footers(spark: SparkSession, folder: str) -> DataFrame:
    """The same verdicts as ``verify_files``, from the footers of the files alone."""
    target = scratch_path(spark, "verified")
    rows = footers.with_length(shard_rows(spark, folder)).withColumn("part", F.substring_index("file", "_", -1))
    rows.repartition("dim", "part").drop("file", "file_size").write.partitionBy("dim", "part").parquet(target)
    found = footers.read_footers(spark, target)
    dim = F.regexp_extract("file", "/dim=([0-9]+)/", 1).cast("int")
    name = F.format_string("dim_%d/part_%06d", dim, F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("int"))
    return verify.judge_files(found.select(dim.alias("dim"), name.alias("file"), "n_vectors", "n_metadata", "file_dim", "max_dim"), ("dim",))


@query
def corpus_verification(spark: SparkSession, folder: str) -> DataFrame:
    return verify.corpus_verification(verify.verify_files(shard_rows(spark, folder), ("dim",)), ("dim",))


# -- report --------------------------------------------------------------------------------


@query
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = report.latency_stats(timings(spark, folder))
    keys = ["library", "index_type", "dimension", "n_queries"]
    return stats.select(*keys, round6("query_time_avg"), round6("query_time_std"), round6("throughput_qps"))


@query
def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Timings of three runs kept as sketches, one run repeated: counts, means and extremes, and whether the quartiles' ranks
    are within the stated error of the exact ones."""
    rows, path = timings(spark, folder), scratch_path(spark, "sketches")
    for run in (0, 1, 2, 2):
        sketches.add_run(rows.where(F.col("query_id") % 3 == run), "seconds", ["library"], path, str(run))
    boxes = durable(sketches.quartiles(sketches.merged(sketches.read_runs(spark, path), ["library"])))
    misses = sketches.rank_misses(rows, "seconds", boxes, ["library"])
    within = (F.col("miss") <= sketches.rank_error()).alias("within")
    return boxes.join(misses, "library").select("library", "runs", round6("mean"), "lowest", "highest", within)


@query
def results_table(spark: SparkSession, folder: str) -> DataFrame:
    return bench_results(spark, folder)


@query
def results_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Written as CSV and read back."""
    target = scratch_path(spark, "results")
    rows = bench_results(spark, folder)
    results.write_results_csv(rows, target)
    return spark.read.schema(rows.schema).option("header", True).csv(target)


@query
def metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    means = report.metric_means(bench_results(spark, folder))
    return means.select("metric", "dimension", "library", round6("mean"))


@query
def library_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = report.library_summary(bench_results(spark, folder))
    return summary.select("library", "first_run", *[round6(f"avg_{m}") for m in report.METRICS], "runs")


@query
def summary_display(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_display(report.library_summary(bench_results(spark, folder)))


@query
def best_performers(spark: SparkSession, folder: str) -> DataFrame:
    return report.best_performers(bench_results(spark, folder))


@query
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return report.recommendations(bench_results(spark, folder), PRODUCTION, RESEARCH)


@query
def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    boxes = report.boxplot_stats(bench_results(spark, folder))
    numbers = ["mean", "q1", "median", "q3", "whisker_low", "whisker_high"]
    return boxes.select("library", "runs", *[round6(c) for c in numbers], "outliers")


@query
def scaling_series(spark: SparkSession, folder: str) -> DataFrame:
    return report.scaling_series(bench_results(spark, folder))
