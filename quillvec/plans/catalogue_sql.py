"""The registered queries as SQL over the same tables, written independently of the operators.

Queries that train, draw or time return flags of what must hold, so SQL can say it.
"""

from __future__ import annotations

from quillvec.functions.text import CODE_EXTENSIONS
from quillvec.operators.report import METRICS, ROUNDED
from quillvec.plans.catalogue import (
    EXTENSIONS,
    HASH_DIM,
    LSH_BITS,
    LSH_TABLES,
    PREFIX_DIMS,
    PRODUCTION,
    RESEARCH,
    STATUSES,
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SQL: dict[str, str] = {}

# -- search --------------------------------------------------------------------------------

VECS = """vecs AS (SELECT vec_id, label,
  list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS embedding FROM embeddings)"""

MEANS = """means AS (SELECT query_id, list(m ORDER BY j) AS qv FROM (
  SELECT label::BIGINT AS query_id, j, round(avg(x), 6) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings)
  GROUP BY label, j) GROUP BY query_id)"""

CELLS = "cells AS (SELECT label AS cell, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY label)"

ASSIGNED = """assigned AS (SELECT vec_id, cell, embedding FROM (
  SELECT v.vec_id, v.embedding, c.cell,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY list_inner_product(v.embedding, c.c) DESC, c.cell) AS r
  FROM vecs v, cells c) WHERE r = 1)"""

VISITS = """visits AS (SELECT m.query_id, m.qv, c.cell,
  row_number() OVER (PARTITION BY m.query_id ORDER BY list_inner_product(m.qv, c.c) DESC, c.cell) AS visit
  FROM means m, cells c)"""


def _ranked(score: str, source: str, direction: str, keys: str = "query_id") -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score {direction}, vec_id) AS INTEGER) AS rank
  FROM (SELECT {keys}, vec_id, {score} AS score FROM {source})"""


_IP = _ranked("list_inner_product(qv, embedding)", "means, vecs", "DESC")
_L2 = _ranked("list_distance(qv, embedding)", "means, vecs", "ASC")
_HITS = "SELECT query_id, rank, vec_id, round(score, 6) AS score"

SQL["knn_ip"] = f"WITH {VECS}, {MEANS} {_HITS} FROM ({_IP}) WHERE rank <= 100"
SQL["knn_l2"] = f"WITH {VECS}, {MEANS} {_HITS} FROM ({_L2}) WHERE rank <= 100"
SQL["k_sweep"] = f"""WITH {VECS}, {MEANS}, hits AS ({_IP}), ks AS (SELECT unnest([1, 10, 100])::INTEGER AS k)
SELECT query_id, k, count(*) AS n_hits, round(min(score), 6) AS last_score
FROM hits JOIN ks ON rank <= k GROUP BY query_id, k"""

_ROW = f"""WITH {VECS}, {MEANS}, one AS (SELECT qv FROM means ORDER BY query_id LIMIT 1)
SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(qv, embedding) AS d FROM vecs, one)"""
SQL["distance_row"] = _ROW
SQL["distance_argsort"] = f"{_ROW} ORDER BY d, vec_id LIMIT 100"

SQL["ivf_assign"] = f"WITH {VECS}, {CELLS}, {ASSIGNED} SELECT vec_id, cell FROM assigned"
SQL["ivf_search"] = f"""WITH {VECS}, {MEANS}, {CELLS}, {ASSIGNED}, {VISITS}
{_HITS} FROM ({_ranked("list_inner_product(qv, embedding)", "visits JOIN assigned USING (cell) WHERE visit <= 3", "DESC")})
WHERE rank <= 10"""
SQL["ivf_recall"] = f"""WITH {VECS}, {MEANS}, {CELLS}, {ASSIGNED}, {VISITS},
exact AS ({_IP}),
probes AS (SELECT unnest([1, 2, 4])::INTEGER AS nprobe),
approx AS ({_ranked("list_inner_product(qv, embedding)",
  "visits JOIN assigned USING (cell) JOIN probes ON visit <= nprobe", "DESC", "nprobe, query_id")}),
ks AS (SELECT unnest([1, 10])::INTEGER AS k)
SELECT nprobe, k, count(*) AS n_queries, round(avg(r), 6) AS recall FROM (
  SELECT p.nprobe, ks.k, e.query_id, count(a.vec_id) / count(*)::DOUBLE AS r
  FROM exact e JOIN ks ON e.rank <= ks.k CROSS JOIN probes p
  LEFT JOIN approx a ON a.nprobe = p.nprobe AND a.query_id = e.query_id AND a.vec_id = e.vec_id AND a.rank <= ks.k
  GROUP BY p.nprobe, ks.k, e.query_id)
GROUP BY nprobe, k"""

CODES = f"""planes AS (SELECT p.plane, list(((p.plane * 7919 + (j + 1) * 104729 + p.plane * p.plane * (j + 3) * 13) % 2003 - 1001)
    / 1001.0::DOUBLE ORDER BY j) AS h
  FROM range({LSH_TABLES * LSH_BITS}) p(plane), range((SELECT max(len(embedding)) FROM embeddings)) d(j) GROUP BY p.plane),
codes AS (SELECT vec_id, plane // {LSH_BITS} AS tbl,
    sum(CASE WHEN list_inner_product(embedding, h) >= 0 THEN 1 << (plane % {LSH_BITS}) ELSE 0 END)::BIGINT
      + (plane // {LSH_BITS}) * {1 << LSH_BITS} AS bucket
  FROM vecs, planes GROUP BY vec_id, plane // {LSH_BITS}),
qcodes AS (SELECT query_id, plane // {LSH_BITS} AS tbl,
    sum(CASE WHEN list_inner_product(qv, h) >= 0 THEN 1 << (plane % {LSH_BITS}) ELSE 0 END)::BIGINT
      + (plane // {LSH_BITS}) * {1 << LSH_BITS} AS bucket
  FROM means, planes GROUP BY query_id, plane // {LSH_BITS})"""
SQL["lsh_assign"] = f"WITH {VECS}, {MEANS}, {CODES} SELECT vec_id, tbl::INTEGER AS tbl, bucket FROM codes"
SQL["lsh_search"] = f"""WITH {VECS}, {MEANS}, {CODES},
pairs AS (SELECT DISTINCT query_id, vec_id FROM qcodes JOIN codes USING (bucket))
{_HITS} FROM ({_ranked("list_inner_product(qv, embedding)",
  "pairs JOIN means USING (query_id) JOIN vecs USING (vec_id)", "DESC")}) WHERE rank <= 10"""

SQL["knn_thousand"] = f"""WITH asked AS (SELECT q AS query_id, list(((q * 7919 + (j + 1) * 104729 + q * (j + 3) * 13) % 2003 - 1001)
    / 1001.0::DOUBLE ORDER BY j) AS qv
  FROM range(1000) a(q), range((SELECT max(len(embedding)) FROM embeddings)) d(j) GROUP BY q),
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)
{_HITS} FROM ({_ranked("list_inner_product(qv, embedding)", "asked, vecs", "DESC")}) WHERE rank <= 100"""
SQL["vector_rejects"] = """SELECT vec_id, reason FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN '5 components'
  WHEN vec_id % 13 = 4 THEN 'null component' WHEN vec_id % 17 = 5 OR vec_id % 19 = 6 THEN 'component not finite'
  WHEN vec_id % 23 = 7 THEN 'null' END AS reason FROM embeddings) WHERE reason IS NOT NULL"""
SQL["ivf_train"] = "SELECT count(*) AS n_assigned, 0::BIGINT AS n_wrong, true AS cells_ok FROM embeddings"
SQL["quantiser_agreement"] = "SELECT count(*) AS n_assigned, true AS agree_ok FROM embeddings"
SQL["quantiser_search"] = SQL["knn_ip"]
SQL["lsh_postings"] = SQL["lsh_search"]
SQL["graph_exact"] = SQL["knn_ip"]
SQL["graph_search"] = """SELECT metric, count(*) AS n_queries, true AS recall_ok, true AS visited_ok
FROM embeddings, (SELECT unnest(['ip', 'l2']) AS metric) WHERE vec_id % 20 = 0 GROUP BY metric"""
SQL["ball_search"] = SQL["knn_l2"]
SQL["ball_pruning"] = "SELECT count(*) AS n_queries, true AS pruned_ok, 0::BIGINT AS n_wrong FROM embeddings WHERE vec_id % 20 = 0"
SQL["search_sweep"] = """SELECT library, dimension, (SELECT count(*) FROM embeddings) AS num_vectors, true AS recall_ok, true AS timed,
  '-' AS failure FROM (SELECT unnest(['block', 'block', 'inverted file', 'hyperplanes']) AS library),
  (SELECT unnest([32, 64])::INTEGER AS dimension)
UNION ALL SELECT '', 99, 0, false, false, 'no vectors or no queries of dimension 99'"""

# -- corpus --------------------------------------------------------------------------------

TREE = f"""tree AS (SELECT *, octet_length(encode(body)) + CASE WHEN doc_id % 6 = 0 THEN 4 WHEN doc_id % 4 = 0 THEN 6 ELSE 0 END AS size,
  regexp_replace(CASE WHEN doc_id % 6 = 0 THEN 'A' || body WHEN doc_id % 4 = 0 THEN body || chr(13) || chr(10) || 'x' || chr(13) || 'y'
    ELSE body END, '\\r\\n?', chr(10), 'g') AS content
  FROM (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, 'none') AS repo_name, {_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS suffix,
    coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CASE WHEN doc_id % 5 = 0 THEN '_' WHEN doc_id % 7 = 0 THEN '.' ELSE '' END
      || 'd' || doc_id || {_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS path FROM documents))"""
SQL["file_listing"] = f"""WITH {TREE} SELECT repo_name, path, extension, size::BIGINT AS size FROM (SELECT *,
  CASE WHEN suffix IN ('.', '') THEN '' WHEN suffix = '.tar.gz' THEN '.gz' ELSE lower(suffix) END AS extension FROM tree)
WHERE size >= 200 AND extension IN ('.py', '.md', '.c', '.gz')"""
SQL["file_contents"] = f"WITH {TREE} SELECT path, md5(content) AS file_hash, length(content)::INTEGER AS n_chars FROM tree"
SQL["file_rejects"] = f"""WITH {TREE} SELECT repo_name, path, 'has 5000 characters or more' AS error FROM tree WHERE length(content) >= 5000"""

FILES = f"""files AS (SELECT doc_id, source AS repo_name, n_chars AS size,
  CASE WHEN doc_id % 17 = 0 THEN source || '/.git/' || doc_id
    WHEN doc_id % 13 = 0 THEN source || '/.github/' || doc_id || '.yml'
    WHEN doc_id % 19 = 0 THEN source || '/' || lang || '/' || doc_id || '/.gitignore'
    ELSE source || '/' || lang || '/' || doc_id || {_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] END AS path,
  (CASE WHEN doc_id % 30 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END)
    || CASE WHEN doc_id % 50 = 0 THEN chr(0) ELSE '' END AS raw
  FROM documents)"""

USABLE = f"""{FILES},
clean AS (SELECT *, regexp_replace(raw, '\\r\\n?', chr(10), 'g') AS content FROM files),
usable AS (SELECT * FROM clean WHERE length(content) > 10 AND length(content) < 500000 AND NOT contains(content, chr(0)))"""

CHUNKS = f"""{USABLE},
lined AS (SELECT doc_id, repo_name, path, string_split(content, chr(10)) AS l FROM usable),
starts AS (SELECT *, unnest(CASE WHEN len(l) < 8 THEN [0] ELSE range(0, len(l) - 7, 4) END) AS s FROM lined),
chunks AS (SELECT doc_id, repo_name, path, CAST(s // 4 AS INTEGER) AS chunk_no, CAST(s + 1 AS INTEGER) AS start_line,
  CAST(least(len(l), 8) AS INTEGER) AS n_lines, array_to_string(l[s + 1 : s + 8], chr(10)) AS chunk FROM starts)"""

TOKENS = f"""{CHUNKS},
tokenized AS (SELECT doc_id, chunk_no,
  list_filter(regexp_split_to_array(chunk, '\\s+'), lambda t: t <> '')[1:128] AS tokens FROM chunks)"""

SQL["repo_catalog"] = """SELECT DISTINCT 'https://example.org/' || source || '.git' AS repo_url, source AS repo_name
FROM documents"""
SQL["doc_filter"] = f"WITH {USABLE} SELECT doc_id, length(content)::INTEGER AS n_chars FROM usable"
SQL["doc_rejects"] = f"""WITH {FILES} SELECT doc_id, CASE WHEN contains(raw, chr(0)) THEN 'NUL character' ELSE 'length' END AS reason
FROM files WHERE contains(raw, chr(0)) OR NOT (length(raw) > 10 AND length(raw) < 500000)"""
SQL["doc_hash"] = f"WITH {USABLE} SELECT doc_id, split_part(path, '/', 1) AS repo, md5(content) AS file_hash FROM usable"
SQL["doc_chunks"] = f"WITH {CHUNKS} SELECT doc_id, chunk_no, start_line, n_lines, md5(chunk) AS chunk_hash FROM chunks"
SQL["subword_truncate"] = f"""WITH {CHUNKS} SELECT doc_id, chunk_no, md5(chunk) AS chunk_hash, true AS count_ok, true AS kept_ok FROM chunks"""
SQL["chunk_stats"] = f"""WITH {CHUNKS} SELECT repo_name, count(DISTINCT path) AS files, count(*) AS chunks,
  sum(n_lines)::BIGINT AS chunk_lines FROM chunks GROUP BY repo_name"""
SQL["token_truncate"] = f"""WITH {TOKENS} SELECT doc_id, chunk_no, len(tokens)::INTEGER AS n_tokens,
  md5(array_to_string(tokens, ' ')) AS tokens_hash FROM tokenized"""


SQL["embed_hashing"] = f"""WITH {TOKENS} SELECT doc_id, chunk_no,
  CASE WHEN len(tokens) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm2 FROM tokenized"""


def _half(x: str) -> str:
    """Rounding to half precision for finite magnitudes below 65520."""
    step = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} / {step}, 0) * {step} END"


SQL["embed_batches"] = f"""WITH {TOKENS},
words AS (SELECT doc_id, chunk_no, unnest(tokens) AS word FROM tokenized),
counts AS (SELECT doc_id, chunk_no, ('0x' || substr(md5(word), 1, 8))::BIGINT % {HASH_DIM} AS b, count(*)::DOUBLE AS n
  FROM words GROUP BY ALL),
unit AS (SELECT doc_id, chunk_no, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_no)) AS x FROM counts),
halves AS (SELECT doc_id, chunk_no, b, {_half("x")} AS x FROM unit)
SELECT doc_id, chunk_no, coalesce(n_used, 0)::INTEGER AS n_used, coalesce(weighted, 0)::BIGINT AS weighted
FROM tokenized LEFT JOIN (SELECT doc_id, chunk_no, count(*) AS n_used,
  sum((b + 1) * (x * 16777216)::BIGINT) AS weighted FROM halves GROUP BY doc_id, chunk_no) USING (doc_id, chunk_no)"""
SQL["embed_failures"] = f"""WITH {TOKENS} SELECT '1' AS run, doc_id, chunk_no, 'RuntimeError: a multiple of ten tokens' AS embed_error
FROM tokenized WHERE len(tokens) % 10 = 0"""
SQL["embed_resume"] = f"""WITH {TOKENS}, made AS ({SQL["embed_batches"].replace(f"WITH {TOKENS},", "WITH", 1)})
SELECT doc_id, chunk_no, CASE WHEN len(tokens) % 10 = 0 THEN 2 ELSE 1 END::INTEGER AS run, weighted FROM tokenized JOIN made USING (doc_id, chunk_no)"""

SUFFIX = r"lower(regexp_extract(parse_filename(path), '(?s)^.+(\.[^.]+)$', 1))"
SQL["path_filter"] = f"WITH {FILES} SELECT doc_id, path FROM files WHERE NOT contains('/' || path, '/.git')"
SQL["ext_class"] = f"WITH {FILES} SELECT doc_id, {SUFFIX} AS suffix, {SUFFIX} IN {_in(CODE_EXTENSIONS)} AS is_code FROM files"
SQL["file_index"] = f"WITH {FILES} SELECT row_number() OVER (ORDER BY repo_name, path) AS idx, path FROM files"
SQL["index_range_files"] = f"""WITH {FILES}, numbered AS (SELECT row_number() OVER (ORDER BY repo_name, path) AS idx, path FROM files)
SELECT idx, path FROM numbered WHERE idx BETWEEN 50 AND 120"""
SQL["numbered_runs"] = f"""WITH {FILES} SELECT path, row_number() OVER (ORDER BY doc_id % 3, path) AS idx, (doc_id % 3)::INTEGER AS run FROM files"""

INDEX = f"""{FILES},
lines AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id || ' ' || path
  WHEN doc_id % 23 = 0 THEN 'x' || doc_id || ' : ' || path
  ELSE '  ' || doc_id || chr(9) || ':  ' || path || ' ' || chr(9) END AS line FROM files),
parts AS (SELECT contains(line, ':') AS colon,
  TRY_CAST(trim(split_part(line, ':', 1), ' ' || chr(9)) AS BIGINT) AS idx,
  trim(substr(line, strpos(line, ':') + 1), ' ' || chr(9)) AS path FROM lines),
idx AS (SELECT idx, path FROM parts WHERE colon AND idx IS NOT NULL)"""
SQL["index_parse"] = f"WITH {INDEX} SELECT idx, path FROM idx"
SQL["index_rejects"] = f"""WITH {INDEX} SELECT CASE WHEN colon THEN 'no number' ELSE 'no colon' END AS reason, count(*) AS n
FROM parts WHERE NOT colon OR idx IS NULL GROUP BY 1"""
SQL["index_workers"] = f"""WITH {INDEX} SELECT floor((idx - 1) / 64.0)::INTEGER AS worker_id, count(*) AS n,
  min(idx) AS first_idx, max(idx) AS last_idx FROM idx GROUP BY 1"""
SQL["index_range"] = f"WITH {INDEX} SELECT idx, path FROM idx WHERE idx BETWEEN 100 AND 700"
_PRESENT = "(SELECT path FROM files WHERE NOT contains('/' || path, '/.git'))"
SQL["index_missing"] = f"WITH {INDEX} SELECT idx, path FROM idx WHERE path NOT IN {_PRESENT}"
SQL["index_existing"] = f"WITH {INDEX} SELECT idx, path FROM idx WHERE path IN {_PRESENT}"

STATS = f"""{FILES},
stats AS (SELECT repo_name, count(*) AS total_files,
  count(*) FILTER (WHERE {SUFFIX} IN {_in(CODE_EXTENSIONS)}) AS code_files, sum(size) / pow(1024.0::DOUBLE, 3) AS total_size_gb
  FROM files WHERE NOT contains('/' || path || '/', '/.git/') GROUP BY repo_name),
outcome AS (SELECT DISTINCT source AS repo_name,
  {_list(STATUSES)}[regexp_extract(source, '[0-9]+')::INTEGER % {len(STATUSES)} + 1] AS status FROM documents),
good AS (SELECT repo_name, status, coalesce(total_files, 0) AS total_files, coalesce(code_files, 0) AS code_files,
  coalesce(total_size_gb, 0) AS total_size_gb
  FROM outcome LEFT JOIN stats USING (repo_name) WHERE status IN ('cloned', 'updated'))"""
SQL["repo_stats"] = f"WITH {STATS} SELECT repo_name, total_files, code_files, total_size_gb FROM stats"
SQL["repo_outcomes"] = f"WITH {STATS} SELECT repo_name, status, total_files, code_files, total_size_gb FROM good"
SQL["repo_failures"] = f"""WITH {STATS} SELECT repo_name, status, 'detail of ' || repo_name AS reason FROM outcome
WHERE status NOT IN ('cloned', 'updated')"""
SQL["outcome_counts"] = f"""WITH {STATS} SELECT count(*) AS repositories,
  count(*) FILTER (WHERE status IN ('cloned', 'updated')) AS succeeded,
  count(*) FILTER (WHERE status NOT IN ('cloned', 'updated')) AS failed FROM outcome"""
SQL["corpus_totals"] = f"""WITH {STATS} SELECT *, format('{{:,}}', total_files) AS files_text,
  round_even((total_size_gb)::DECIMAL(38, 9), 3)::VARCHAR AS size_text FROM (
  SELECT coalesce(repo_name, 'all repositories') AS repo_name, sum(total_files)::BIGINT AS total_files,
    sum(code_files)::BIGINT AS code_files, sum(total_size_gb) AS total_size_gb FROM good GROUP BY ROLLUP (repo_name))"""

# -- vectors -------------------------------------------------------------------------------

SQL["half_round"] = f"""WITH {VECS},
flat AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM vecs)
SELECT vec_id, sum(j * (({_half("x")}) * 16777216)::BIGINT)::BIGINT AS weighted FROM flat GROUP BY vec_id"""
SQL["vector_scan"] = f"""WITH flat AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings)
SELECT vec_id, sum(j * (({_half("x")}) * 16777216)::BIGINT)::BIGINT AS weighted FROM flat GROUP BY vec_id"""
SQL["random_vectors"] = """SELECT vec_id, dim, true AS length_ok, true AS half_ok, true AS size_ok
FROM embeddings, (SELECT unnest([16, 64])::INTEGER AS dim)"""
SQL["committed_shards"] = """SELECT dim, shard, 'dim_' || dim || '/batch_' || lpad(shard::VARCHAR, 6, '0') || '.parquet' AS file,
  count(*) AS rows, count(*) AS held, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM (SELECT vec_id, dim, (row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1) // 300 AS shard
  FROM embeddings, (SELECT unnest([16, 64])::INTEGER AS dim)) GROUP BY dim, shard"""
SQL["worker_shards"] = """SELECT (vec_id // 64)::INTEGER AS worker_id, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM embeddings GROUP BY ALL"""
SQL["random_moments"] = """SELECT dim, count(*) * dim AS components, true AS mean_ok, true AS deviation_ok
FROM embeddings, (SELECT unnest([16, 64])::INTEGER AS dim) GROUP BY dim"""
SQL["vector_store"] = """SELECT d.dim, CASE WHEN d.dim = 32 THEN 0 ELSE n END::BIGINT AS total_vectors,
  CASE WHEN d.dim = 32 THEN 1 ELSE 0 END::BIGINT AS errors,
  CASE WHEN d.dim <> 32 AND n = 500 THEN '✓' ELSE '✗' END AS mark
FROM (SELECT unnest([16, 32, 64])::INTEGER AS dim) d, (SELECT count(*) AS n FROM embeddings)"""
SQL["vector_stack"] = """SELECT dim, count(*) AS n, min(len(embedding[1:dim]))::INTEGER AS length
FROM embeddings, (SELECT unnest([16, 64])::INTEGER AS dim) GROUP BY dim"""
SQL["batch_numbers"] = """SELECT (i - 1) // 64 AS batch_no, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) GROUP BY 1"""

SHARDS = f"""shards AS (SELECT vec_id, dim, printf('dim_%d/part_%06d', dim, vec_id // 100) AS file,
  (vec_id // 100) * 7 + dim * 1000 AS file_size,
  CASE WHEN dim = 16 AND vec_id % 1000 = 205 THEN NULL
    WHEN dim = 32 AND vec_id // 100 = 3 THEN embedding[1:dim - 1] ELSE embedding[1:dim] END AS embedding,
  CASE WHEN vec_id // 100 <> 2 AND vec_id % 37 <> 0 THEN 'meta ' || vec_id END AS metadata
  FROM embeddings, (SELECT unnest({list(PREFIX_DIMS)})::INTEGER AS dim)),
per_file AS (SELECT dim, file, count(*) AS n, max(file_size) AS bytes, bool_or(embedding IS NULL) AS nulls,
  bool_or(len(embedding) <> dim) AS wrong, min(len(embedding)) FILTER (WHERE len(embedding) <> dim) AS found
  FROM shards GROUP BY dim, file)"""
SQL["shard_verify"] = f"""WITH {SHARDS},
per_dim AS (SELECT d.dim, coalesce(sum(n) FILTER (WHERE NOT nulls), 0)::BIGINT AS total_vectors,
  count(file) FILTER (WHERE NOT nulls) AS file_count, coalesce(sum(bytes) FILTER (WHERE NOT nulls), 0)::BIGINT AS total_size_bytes,
  CASE WHEN count(file) = 0 THEN 1 ELSE count(file) FILTER (WHERE nulls OR wrong) END::BIGINT AS errors
  FROM (SELECT unnest({[*PREFIX_DIMS, 128]})::INTEGER AS dim) d LEFT JOIN per_file f ON f.dim = d.dim GROUP BY d.dim)
SELECT *, CASE WHEN total_size_bytes < 1024 THEN total_size_bytes || ' bytes'
    WHEN total_size_bytes < 1048576 THEN round_even((total_size_bytes / 1024.0::DOUBLE)::DECIMAL(38, 9), 2) || ' KB'
    WHEN total_size_bytes < 1073741824 THEN round_even((total_size_bytes / 1048576.0::DOUBLE)::DECIMAL(38, 9), 2) || ' MB'
    ELSE round_even((total_size_bytes / 1073741824.0::DOUBLE)::DECIMAL(38, 9), 2) || ' GB' END AS total_size,
  CASE WHEN total_vectors = 500 THEN '✓' ELSE '✗' END AS mark FROM per_dim"""
SQL["shard_errors"] = f"""WITH {SHARDS}
SELECT dim, file, CASE WHEN nulls THEN 'rows without a vector' ELSE printf('dimension is %d, expected %d', found, dim) END AS error
FROM per_file WHERE nulls OR wrong
UNION ALL SELECT 128, '-', 'dimension 128 is missing'"""

CHECKED = f"""{SHARDS},
counted AS (SELECT dim, file, count(embedding) AS n_vectors, count(metadata) AS n_metadata,
  min(len(embedding)) AS low, max(len(embedding)) AS high FROM shards GROUP BY dim, file),
first_dim AS (SELECT dim, arg_min(low, file) AS expected_dim FROM counted WHERE n_vectors > 0 AND n_metadata > 0 GROUP BY dim),
judged AS (SELECT *, n_vectors = 0 OR n_metadata = 0 AS bad FROM counted LEFT JOIN first_dim USING (dim)),
flagged AS (SELECT *, NOT bad AND (low <> expected_dim OR high <> expected_dim) AS warn,
  NOT bad AND n_vectors <> n_metadata AS mismatch FROM judged)"""
SQL["verify_files"] = f"""WITH {CHECKED} SELECT dim::INTEGER AS dim, file, n_vectors, n_metadata, low::INTEGER AS file_dim,
  expected_dim::INTEGER AS expected_dim, warn, mismatch,
  CASE WHEN bad THEN 'ERROR' WHEN mismatch THEN 'MISMATCH' WHEN warn THEN 'WARN' ELSE 'OK' END AS status FROM flagged"""
SQL["verify_footers"] = SQL["verify_files"]
SQL["corpus_verification"] = f"""WITH {CHECKED} SELECT dim::INTEGER AS dim, count(*) FILTER (WHERE NOT bad) AS total_files,
  coalesce(sum(n_vectors) FILTER (WHERE NOT bad), 0)::BIGINT AS total_embeddings, max(expected_dim)::INTEGER AS expected_dim,
  count(*) FILTER (WHERE bad) AS error_files, count(*) FILTER (WHERE warn) AS warn_files,
  count(*) FILTER (WHERE mismatch) AS mismatch_files FROM flagged GROUP BY dim"""

# -- report --------------------------------------------------------------------------------

TIMINGS = """timings AS (SELECT event_id, event_type AS library, CASE WHEN user_id % 2 = 0 THEN 'flat' ELSE 'cells' END AS index_type,
  (128 << (user_id % 5)::INTEGER)::INTEGER AS dimension, value AS seconds FROM events)"""
SQL["latency_stats"] = f"""WITH {TIMINGS} SELECT library, index_type, dimension, count(*) AS n_queries,
  round(avg(seconds), 6) AS query_time_avg, round(stddev_pop(seconds), 6) AS query_time_std,
  round(1.0 / avg(seconds), 6) AS throughput_qps FROM timings GROUP BY library, index_type, dimension"""

SQL["latency_quantiles"] = f"""WITH {TIMINGS} SELECT library, count(*) AS runs, round(avg(seconds), 6) AS mean, min(seconds) AS lowest,
  max(seconds) AS highest, true AS within FROM timings GROUP BY library"""

RESULTS = f"""{TIMINGS},
raw AS (SELECT library, index_type, dimension, min(event_id) AS run_no, count(*) AS num_vectors,
  max(seconds) / 10.0 AS build_time, sum(seconds) / 7.0 AS memory_usage_mb, avg(seconds) AS query_time_avg,
  stddev_pop(seconds) AS query_time_std, avg(CASE WHEN seconds > 5.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall_at_k,
  1.0 / avg(seconds) AS throughput_qps FROM timings GROUP BY library, index_type, dimension),
results AS (SELECT library, index_type, dimension, run_no, num_vectors,
  {", ".join(f"round_even({c}, 4) AS {c}" for c in ROUNDED)} FROM raw)"""
SQL["results_table"] = f"WITH {RESULTS} SELECT * FROM results"
SQL["results_csv"] = SQL["results_table"]
SQL["metric_pivot"] = f"WITH {RESULTS} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, dimension, library, round(avg({m}), 6) AS mean FROM results GROUP BY dimension, library" for m in METRICS
)
SQL["library_summary"] = f"""WITH {RESULTS} SELECT library, min(run_no) AS first_run,
  {", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in METRICS)}, count(*) AS runs FROM results GROUP BY library"""
SQL["summary_display"] = f"""WITH {RESULTS} SELECT library, round_even((avg(build_time))::DECIMAL(38, 9), 3)::VARCHAR AS build_time,
  round_even((avg(query_time_avg))::DECIMAL(38, 9), 4)::VARCHAR AS query_time, round_even((avg(throughput_qps))::DECIMAL(38, 9), 1)::VARCHAR AS throughput,
  round_even((avg(memory_usage_mb))::DECIMAL(38, 9), 1)::VARCHAR AS memory, count(*) AS runs FROM results GROUP BY library"""


def _pick(criterion: str, metric: str, direction: str, condition: str = "true", extra: str = "") -> str:
    return f"""(SELECT '{criterion}' AS criterion, library, index_type, dimension{extra} FROM results
  WHERE {metric} IS NOT NULL AND NOT isnan({metric}) AND {condition} ORDER BY {metric} {direction}, run_no LIMIT 1)"""


SQL["best_performers"] = f"WITH {RESULTS} " + " UNION ALL ".join(
    _pick(criterion, metric, direction, extra=f", {metric} AS value, run_no")
    for criterion, metric, direction in (
        ("fastest build", "build_time", "ASC"),
        ("fastest query", "query_time_avg", "ASC"),
        ("highest throughput", "throughput_qps", "DESC"),
        ("lowest memory", "memory_usage_mb", "ASC"),
    )
)
SQL["recommendations"] = f"WITH {RESULTS} " + " UNION ALL ".join(
    (
        _pick("production", "throughput_qps", "DESC", f"library IN {_in(PRODUCTION)}"),
        _pick("research", "query_time_avg", "ASC", f"library IN {_in(RESEARCH)}"),
        _pick("memory-constrained", "memory_usage_mb", "ASC"),
    )
)
SQL["boxplot_stats"] = f"""WITH {RESULTS},
box AS (SELECT library, count(*) AS runs, avg(query_time_avg) AS mean, quantile_cont(query_time_avg, 0.25) AS q1,
  quantile_cont(query_time_avg, 0.5) AS median, quantile_cont(query_time_avg, 0.75) AS q3 FROM results GROUP BY library),
seen AS (SELECT b.*, r.query_time_avg AS x, r.query_time_avg BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM results r JOIN box b USING (library))
SELECT library, runs, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE inside), 6) AS whisker_low, round(max(x) FILTER (WHERE inside), 6) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM seen GROUP BY library, runs, mean, q1, median, q3"""
SQL["scaling_series"] = f"WITH {RESULTS} SELECT library, dimension, query_time_avg, run_no FROM results"
