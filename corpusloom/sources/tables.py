"""Tables of the engine and the views that its operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import blank
from corpusloom.functions.web import canonical_url

RECORD = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("crawl_date", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("language", T.StringType()), T.StructField("out_links", T.ArrayType(T.StringType())),
    T.StructField("relevance_score", T.DoubleType()), T.StructField("depth", T.IntegerType()), T.StructField("parent_url", T.StringType()),
    T.StructField("web_rank", T.IntegerType()), T.StructField("score_hint", T.DoubleType()), T.StructField("_corrupt_record", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as searchable records: the first line is the title, source and language make the URL."""
    text = blank("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("text"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("language"), F.concat(F.col("source"), F.lit(".example.com")).alias("domain"), F.lit("webpage").alias("source_type"))


def parse_doc_id(c):
    """Ids as integers; what isn't one is null, so hashed ids can't be searched."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))


def parse_records(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """JSON lines as records: blank and malformed lines and lines without an integer id go, the last line of an id stays."""
    got = lines.filter(F.length(F.trim(column)) > 0).withColumn("r", F.from_json(column, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    got = got.filter(F.col("r._corrupt_record").isNull()).withColumn("id", parse_doc_id("r.doc_id")).filter("id IS NOT NULL")
    fields = [f"r.{f.name}" for f in RECORD if f.name not in ("doc_id", "_corrupt_record")]
    keep = got.select(F.col("id").alias("doc_id"), *fields, *( [order] if order else []))
    if not order:
        return keep
    # the last line by a maximum, which folds before the shuffle; no window over a hot id
    rest = [c for c in keep.columns if c not in ("doc_id", order)]
    return keep.groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("last")).select("doc_id", "last.*")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines folder or file; later lines of a file overwrite earlier ones."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return parse_records(lines, order="at")


def write_jsonl(records: DataFrame, path: str, mode: str = "append") -> None:
    records.write.mode(mode).json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs, without comments and blank lines; raises where none is left."""
    seeds = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")
    if seeds.isEmpty():
        raise ValueError(f"no seed URLs in {path}")
    return seeds


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of some paths that there is, in whatever store each names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def scan_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """What an earlier crawl wrote as JSON lines: ``url`` and ``text_hash`` of its records, and how many lines are malformed."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    got = lines.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = got.filter("r._corrupt_record IS NULL")
    urls = good.select(canonical_url("r.url").alias("url")).filter("url IS NOT NULL").distinct()
    hashes = good.filter("r.text <> ''").select(F.sha2("r.text", 256).alias("text_hash")).distinct()
    return urls, hashes, got.filter("r._corrupt_record IS NOT NULL").count()


def read_cooc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """A saved co-occurrence file as ``pairs(term_a, term_b, n)``, ``df(term, df)`` and ``total_docs, min_cooc``.

    Arrays of unlike lengths aren't read as such: the nested maps are taken, as of
    the older format.  Places outside the terms raise.
    """
    schema = "terms array<string>, cooc_rows array<int>, cooc_cols array<int>, cooc_data array<int>, cooc_shape array<int>, df map<string,bigint>, total_docs bigint, min_cooc int"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select("j.*")
    size = F.greatest(F.size("terms"), F.coalesce(F.get("cooc_shape", F.lit(0)), F.lit(0)))
    outside = F.exists(F.concat("cooc_rows", "cooc_cols"), lambda k: (k < 0) | (k >= size))
    head = raw.select("total_docs", "min_cooc", (_arrays() & F.coalesce(outside, F.lit(False))).alias("bad")).first()
    if head is None or head["bad"]:
        raise ValueError(f"{path}: no co-occurrence file, or places outside its terms")
    return read_pair_counts(spark, path), raw.select(F.explode("df").alias("term", "df")), {"total_docs": head["total_docs"] or 0, "min_cooc": head["min_cooc"]}


def _arrays():
    """Whether the arrays of a co-occurrence file fit each other."""
    n = F.size("cooc_data")
    return F.coalesce(F.col("terms").isNotNull() & (F.size("cooc_rows") == n) & (F.size("cooc_cols") == n), F.lit(False))


def write_cooc(pairs: DataFrame, df: DataFrame, total_docs: int, min_cooc: int, path: str) -> None:
    """Pair counts with what correlations need: tables ``pairs``, ``df`` and ``head`` (number of documents, threshold)."""
    write_pair_counts(pairs, f"{path}/pairs")
    df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/df")
    df.sparkSession.createDataFrame([(total_docs, min_cooc)], "total_docs long, min_cooc int").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def open_cooc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """What :func:`write_cooc` wrote."""
    return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/head").first().asDict()


def read_pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """``term_a, term_b, n`` of a saved co-occurrence file: arrays of the upper triangle, or nested maps."""
    schema = "terms array<string>, cooc_rows array<int>, cooc_cols array<int>, cooc_data array<int>, cooc map<string,map<string,bigint>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    raw = raw.select("j", raw["j"].alias("x")).select("j", "x.*")
    flat = raw.filter(_arrays()).select("terms", F.explode(F.arrays_zip("cooc_rows", "cooc_cols", "cooc_data")).alias("z"))
    new = flat.select(F.get("terms", F.col("z.cooc_rows")).alias("a"), F.get("terms", F.col("z.cooc_cols")).alias("b"), F.col("z.cooc_data").cast("long").alias("n"))
    old = raw.filter(~_arrays()).select(F.explode("cooc").alias("a", "m")).select("a", F.explode("m").alias("b", "n"))
    return (
        new.unionByName(old).filter("a <> b AND n > 0")
        .groupBy(F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b")).agg(F.sum("n").alias("n")))


def write_index(index: DataFrame, path: str, parts: int = 16) -> None:
    """The inverted index sorted by term, so that a term's row group is found by statistics."""
    index.repartitionByRange(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_raw_pages(pages: DataFrame, path: str) -> None:
    """HTML as it came, under a key from its URL."""
    pages.select(F.substring(F.sha2("url", 256), 1, 16).alias("key"), "url", "html").write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``term, doc_ids, df`` of a saved index: a Parquet folder, or a JSON file of trie nodes.

    Nodes hold their children by label and number; a word is the labels on the
    way from the root.  The tree is walked level by level, one join each.
    """
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    node = "struct<is_end:boolean,docs:array<bigint>,children:map<string,int>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<{node}>, root int").alias("j"))
    nodes = raw.select("j.root", F.posexplode("j.nodes").alias("id", "n")).select("root", "id", "n.*")
    words = nodes.filter("is_end").select("id", F.array_sort(F.array_distinct("docs")).alias("doc_ids"))
    edges = nodes.select("id", F.explode("children").alias("label", "child"))
    level = nodes.filter("id = root").select("id", F.lit("").alias("term"))
    found = level
    while not (level := level.join(edges, "id").select(F.col("child").alias("id"), F.concat("term", "label").alias("term"))).isEmpty():
        found = found.unionByName(level)
    return found.join(words, "id").select("term", "doc_ids", F.size("doc_ids").cast("long").alias("df"))


def write_pair_counts(pairs: DataFrame, path: str) -> None:
    """Counts of term pairs, each pair once with its smaller term first, sorted by it."""
    pairs.repartitionByRange("term_a").sortWithinPartitions("term_a", "term_b").write.mode("overwrite").parquet(path)


def write_report(counts: DataFrame, path: str, by: str) -> None:
    """A crawl report as text lines ``name: n``, most frequent first.  ``counts`` has one row a reason or domain."""
    lines = counts.select(F.format_string("%s: %d", F.coalesce(by, F.lit("")), "n").alias("value"), "n", by)
    lines.orderBy(F.desc("n"), by).select("value").write.mode("overwrite").text(path)
