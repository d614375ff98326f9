"""Query registry and the views that the queries share, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


class Views:
    """Tables of one data folder, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def documents(self):
        return self.table("documents")

    @property
    def embeddings(self):
        return self.table("embeddings")

    @property
    def events(self):
        return self.table("events")

    @property
    def pages(self):
        return self.table("pages")

    @property
    def labels(self):
        return self.table("labels")

    @property
    def conversations(self):
        return self.table("conversations")

    @property
    def code_files(self):
        return code_files(self.documents)

    @property
    def snippet_vectors(self):
        d = self.documents.select(F.col("doc_id").alias("vec_id"), "source", "lang")
        return self.embeddings.join(d, "vec_id", "left").select(
            F.col("vec_id").alias("id"),
            F.coalesce("source", F.lit("none")).alias("repo_id"),
            F.concat(F.lit("src/f"), F.col("vec_id").cast("string"), F.lit(".py")).alias("file_path"),
            F.coalesce("lang", F.lit("none")).alias("language"),
            F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("f"), F.col("vec_id").cast("string"))).alias("function_name"),
            F.lit(None).cast("string").alias("class_name"),
            F.lit(1).alias("start_line"),
            (F.col("label") + 1).alias("end_line"),
            "embedding",
        )

    @property
    def snippets(self):
        """Documents as snippets."""
        return self.documents.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("repo_id"),
            F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
            F.col("lang").alias("language"),
            F.col("text").alias("content"),
            F.lit(1).alias("start_line"),
            F.size(F.split("text", "\n", -1)).alias("end_line"),
        )

    @property
    def vectors(self):
        return self.embeddings.select(F.col("vec_id").alias("id"), "embedding")

    @property
    def search_queries(self):
        """Every vector as a query."""
        return self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")

    @property
    def label_centroids(self):
        """Mean vector of each label, as the cells of an inverted file."""
        from snipquarry.operators.vectors import mean_pool

        rows = self.embeddings.select(F.col("label").alias("cell"), F.col("embedding").alias("vec"), F.lit(1).alias("mask"))
        return mean_pool(rows, "cell")

    @property
    def index_requests(self):
        """Every page address requested twice, odd pages first by their second request."""
        start = F.lit("2024-01-01").cast("timestamp")
        minutes = F.col("page_id").cast("int")
        first = self.pages.select(
            "url", F.col("page_id").cast("string").alias("project"),
            (start + F.make_dt_interval(mins=minutes)).alias("created_at"),
        )
        again = self.pages.select(
            "url", F.concat(F.lit("again-"), F.col("page_id").cast("string")).alias("project"),
            (start + F.make_dt_interval(mins=F.when(minutes % 2 == 1, minutes - 30).otherwise(minutes + 30))).alias("created_at"),
        )
        return first.unionByName(again)

    @property
    def source_repositories(self):
        """Sources as repositories, and the pages as repositories without snippets."""
        sources = self.documents.select(F.col("source").alias("id")).distinct()
        empty = self.pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"))
        both = sources.unionByName(empty)
        return both.select("id", F.concat(F.lit("https://host/"), "id", F.lit(".git")).alias("url"), F.upper("id").alias("name"))

    @property
    def purge_list(self):
        """Sources with more than the usual share of toxic documents."""
        usual = self.labels.agg(F.avg("toxic"))
        labelled = self.documents.select("doc_id", F.col("source").alias("repo_id")).join(self.labels, "doc_id")
        shares = labelled.groupBy("repo_id").agg(F.avg("toxic").alias("share"))
        return shares.filter(F.col("share") > usual.scalar()).select("repo_id")

    @property
    def suggestion_requests(self):
        """A request for every labelled document, and one for a snippet that does not exist."""
        kinds = F.array(*[F.lit(x) for x in ISSUES])
        issue = F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int"))
        return self.labels.select(
            F.when(F.col("quality") == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("snippet_id"),
            issue.alias("issue_type"),
            F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")).alias("issue_description"),
        )

    @property
    def cache_log(self):
        """Events as cache writes."""
        return self.events.select(
            F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("key"),
            "event_id", "value", F.col("ts").cast("timestamp").alias("written_at"),
        )


ISSUES = ["security", "Lint", "PERFORMANCE", "style", "refactor", "typo"]
DIRS = ["src", "lib/util", "node_modules/pkg", ".git/hooks", "build", "app", "tests"]
SUFFIXES = [".py", ".go", ".js", ".ts", ".java", ".md", ".PY", ".txt"]


def code_files(documents: DataFrame) -> DataFrame:
    """Documents as files of a repository, in folders and with suffixes by their number."""
    folder = F.element_at(F.array(*[F.lit(x) for x in DIRS]), (F.col("doc_id") % 7 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return documents.select(
        "doc_id",
        F.col("source").alias("repo_id"),
        F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), suffix).alias("file_path"),
        F.col("text").alias("content"),
    )


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# The same views in SQL, to be put in front of a query: WITH {CODE_FILES}, ... SELECT ...
CODE_FILES = f"""code_files AS (
  SELECT doc_id, source AS repo_id, text AS content,
         list_extract({_list(DIRS)}, doc_id % 7 + 1) || '/f' || doc_id
           || list_extract({_list(SUFFIXES)}, doc_id % 8 + 1) AS file_path
  FROM documents)"""
FILE_PARTS = f"""{CODE_FILES}, file_parts AS (
  SELECT *, string_split(file_path, '/') AS parts, string_split(file_path, '/')[-1] AS name,
         lower(regexp_extract(string_split(file_path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix
  FROM code_files)"""
LANGUAGE = """CASE suffix WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go' WHEN '.js' THEN 'JavaScript'
  WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java' END"""
DISCOVERED = f"""{FILE_PARTS}, discovered AS (
  SELECT doc_id, repo_id, file_path, content, suffix, {LANGUAGE} AS language FROM file_parts
  WHERE {LANGUAGE} IS NOT NULL
    AND NOT starts_with(name, '.') AND name NOT IN ('package-lock.json', 'yarn.lock')
    AND len(list_filter(parts[1:len(parts)-1], lambda p: starts_with(p, '.') OR p IN
        ('venv', 'node_modules', 'dist', 'build', '__pycache__'))) = 0)"""
SNIPPET_VECTORS = """snippet_vectors AS (
  SELECT vec_id AS id, coalesce(source, 'none') AS repo_id, 'src/f' || vec_id || '.py' AS file_path,
         coalesce(lang, 'none') AS language,
         CASE WHEN vec_id % 3 = 0 THEN 'f' || vec_id END AS function_name,
         NULL::VARCHAR AS class_name, 1 AS start_line, label + 1 AS end_line, embedding, label
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""
INDEX_REQUESTS = """index_requests AS (
  SELECT url, page_id::VARCHAR AS project, 1704067200000000 + page_id * 60000000 AS created_us FROM pages
  UNION ALL
  SELECT url, 'again-' || page_id,
         1704067200000000 + (page_id + CASE WHEN page_id % 2 = 1 THEN -30 ELSE 30 END) * 60000000
  FROM pages)"""
REPOSITORIES = f"""{INDEX_REQUESTS}, repositories AS (
  SELECT md5('=' || url) AS id, replace(string_split(url, '/')[-1], '.git', '') AS name, url, project, created_us
  FROM index_requests WHERE url LIKE 'https://%' OR url LIKE '%.git'
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_us, project) = 1)"""
SOURCE_REPOSITORIES = """source_repositories AS (
  SELECT id, 'https://host/' || id || '.git' AS url, upper(id) AS name FROM (
    SELECT DISTINCT source AS id FROM documents UNION ALL SELECT 'page-' || page_id FROM pages))"""
PURGE_LIST = """purge_list AS (
  SELECT source AS repo_id FROM documents JOIN labels USING (doc_id)
  GROUP BY source HAVING avg(toxic) > (SELECT avg(toxic) FROM labels))"""
SUGGESTION_REQUESTS = f"""suggestion_requests AS (
  SELECT CASE WHEN quality = 0 THEN doc_id + 1000000000 ELSE doc_id END AS snippet_id,
         list_extract({_list(ISSUES)}, doc_id % 6 + 1) AS issue_type,
         'quality ' || quality || ' of ' || doc_id AS issue_description
  FROM labels)"""
CACHE_LOG = """cache_log AS (
  SELECT user_id || ':' || event_type AS key, event_id, value, ts AS written_at, epoch_us(ts) AS written_us
  FROM events)"""


def views(spark, sf_dir) -> Views:
    return Views(spark, sf_dir)
