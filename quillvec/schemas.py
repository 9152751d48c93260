"""Column layouts of the tables that operators exchange (Spark DDL)."""

REPO = "repo_url STRING, repo_name STRING"
REPO_OUTCOME = "repo_name STRING, status STRING, detail STRING"
FILE = "repo_name STRING, path STRING, size BIGINT, error STRING"
FILE_INDEX = "idx BIGINT, path STRING"
CODE_FILE = "path STRING, content STRING, repo_name STRING, file_hash STRING"
VECTOR = "vec_id BIGINT, dim INT, embedding ARRAY<FLOAT>"
QUERY = "query_id BIGINT, dim INT, qv ARRAY<DOUBLE>"
HIT = "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE"
CENTROID = "cell INT, c ARRAY<DOUBLE>"
TIMING = "library STRING, index_type STRING, dimension INT, query_id BIGINT, seconds DOUBLE"
BENCHMARK = (
    "library STRING, index_type STRING, dimension INT, num_vectors BIGINT, build_time DOUBLE, "
    "memory_usage_mb DOUBLE, query_time_avg DOUBLE, query_time_std DOUBLE, recall_at_k DOUBLE, "
    "throughput_qps DOUBLE"
)
