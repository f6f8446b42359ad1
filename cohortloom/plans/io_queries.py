"""Queries that write files to the shared folder and read them again, and the streaming extension."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import ensure_shared_dir
from cohortloom.operators import modelling
from cohortloom.sources import readers, sinks, workbooks
from cohortloom.sources.tables import table
from cohortloom.streaming import windows


def _folder(spark: SparkSession) -> str:
    ensure_shared_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def q_src_01(spark: SparkSession, d: str) -> DataFrame:
    """CSV written and read with a schema."""
    at = _folder(spark)
    x = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    sinks.write_csv(x, at)
    return readers.read_csv(spark, at, x.schema)


def q_snk_01(spark: SparkSession, d: str) -> DataFrame:
    """Text with separators, quotes and line ends written as CSV and read again as it was."""
    at = _folder(spark)
    odd = F.concat(F.col("s_name"), F.lit(', "'), F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit('"'))
    x = table(spark, d, "supplier").select("s_suppkey", odd.alias("note"))
    x.write.mode("overwrite").option("header", True).option("escape", '"').csv(at)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(x.schema).csv(at)


def q_src_02(spark: SparkSession, d: str) -> DataFrame:
    """Semicolons found by looking at the first line."""
    at = _folder(spark)
    sinks.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), at, ";")
    return readers.read_sniffed(spark, at).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def q_src_03(spark: SparkSession, d: str) -> DataFrame:
    """A CSV whose first column is an index without a name."""
    at = _folder(spark)
    sinks.write_csv(table(spark, d, "nation").select(F.col("n_name").alias(" "), "n_nationkey"), at)
    return readers.read_indexed(spark, at).select("SampleID", F.col("n_nationkey").cast("int").alias("n_nationkey"))


def q_src_09(spark: SparkSession, d: str) -> DataFrame:
    """All result files of a pattern as one table, with the comparison that each file's name tells."""
    at = _folder(spark)
    for k in range(3):
        sinks.write_csv(table(spark, d, "supplier").where(F.col("s_suppkey") % 3 == k).select("s_suppkey", "s_acctbal"), f"{at}/diff_{'ABC'[k]}_results")
    x = readers.read_csv(spark, f"{at}/diff_*_results", provenance="file")
    return x.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"), F.regexp_extract("file", "diff_([A-C])_results", 1).alias("comparison"))


def _workbook(spark: SparkSession, d: str) -> str:
    """A workbook of the nations in the shared folder: a title, a header and the rows."""
    at, data = f"{_folder(spark)}.xlsx", io.BytesIO()
    rows = table(spark, d, "nation").orderBy("n_nationkey").limit(1000).collect()  # a fixed table of 25
    workbooks.write_sheet(data, [["Nations"], ["key", "name", "region"], *([r["n_nationkey"], r["n_name"], r["n_regionkey"]] for r in rows)], "Data")
    sinks.write_bytes(spark, at, data.getvalue())
    return at


def q_src_05(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of a workbook by name."""
    x = workbooks.sheet_table(spark, _workbook(spark, d), ["key", "name", "region"], "Data", header=1)
    return x.select(F.col("key").cast("int").alias("n_nationkey"), F.col("name").alias("n_name"), F.col("region").cast("int").alias("n_regionkey"))


def q_src_06(spark: SparkSession, d: str) -> DataFrame:
    """Chosen rows of a sheet; reading ends after the last of them."""
    x = workbooks.read_sheets(spark, _workbook(spark, d), "Data", rows=[2, 5, 9])
    return x.select("row_no", F.get("cells", F.lit(1)).alias("n_name"))


def q_src_19(spark: SparkSession, d: str) -> DataFrame:
    """Header rows by hand: two lines above the data, names given."""
    at = _folder(spark)
    lines = [(-2, "report of regions"), (-1, "no,label")]
    x = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("i"), F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("line"))
    spark.createDataFrame(lines, "i int, line string").unionByName(x).coalesce(1).sortWithinPartitions("i").select("line").write.text(at)
    return readers.read_below(spark, at, ["r_regionkey", "r_name"], skip=2).withColumn("r_regionkey", F.col("r_regionkey").cast("int"))


def q_snk_06(spark: SparkSession, d: str) -> DataFrame:
    """A fitted model written, read again and used: its scores are those of the one written."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import vector_to_array

    x = modelling.vectors(table(spark, d, "embeddings"), "embedding", F.col("label") < 5)
    at, m = _folder(spark), LogisticRegression(maxIter=5).fit(x)
    m.write().overwrite().save(at)
    score = lambda model, name: model.transform(x).select("vec_id", vector_to_array("probability")[1].alias(name))
    both = score(m, "a").join(score(LogisticRegressionModel.load(at), "b"), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("n_different"))


def q_hp_12(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a saved split, restricted to a list of features."""
    at = _folder(spark)
    e = table(spark, d, "events")
    e.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split")).write.parquet(at)
    keep = spark.createDataFrame([("click",), ("view",), ("absent",)], "event_type string")
    return e.join(spark.read.parquet(at), "user_id").join(F.broadcast(keep), "event_type", "left_semi").groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


def q_src_04(spark: SparkSession, d: str) -> DataFrame:
    """Two header rows made into one."""
    at = _folder(spark)
    lines = table(spark, d, "nation").orderBy("n_nationkey").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    head = spark.createDataFrame([(0, "nation,,region"), (1, "key,name,key")], "i int, line string")
    body = lines.select(F.lit(2).alias("i"), "line")
    head.unionByName(body).orderBy("i").coalesce(1).select("line").write.text(at)
    return readers.read_two_headers(spark, at).select(F.col("nation_key").cast("int").alias("n_nationkey"), F.col("nation_name").alias("n_name"), F.col("region_key").cast("int").alias("n_regionkey"))


def q_src_08(spark: SparkSession, d: str) -> DataFrame:
    """Several folders as one table with the file each row came from."""
    at = _folder(spark)
    for k in range(2):
        sinks.write_csv(table(spark, d, "nation").where(F.col("n_nationkey") % 2 == k).select("n_nationkey"), f"{at}/part{k}")
    x = readers.read_csv(spark, [f"{at}/part0", f"{at}/part1"], provenance="file")
    return x.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.regexp_extract("file", "(part[01])", 1).alias("folder"))


def q_src_16(spark: SparkSession, d: str) -> DataFrame:
    """JSON written and read."""
    at = _folder(spark)
    x = table(spark, d, "region").select("r_regionkey", "r_name")
    x.write.json(at)
    return spark.read.schema(x.schema).json(at)


def q_snk_02(spark: SparkSession, d: str) -> DataFrame:
    """One slice per market segment, read back with the slice's name as a column."""
    at = _folder(spark)
    sinks.write_slices(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), at, "c_mktsegment")
    return spark.read.parquet(at).select("c_custkey", "c_mktsegment")


def q_snk_05(spark: SparkSession, d: str) -> DataFrame:
    """A list as text, one name a line."""
    at = _folder(spark)
    sinks.write_lines(table(spark, d, "supplier"), "s_name", at)
    return spark.read.text(at).select(F.col("value").alias("s_name"))


def q_snk_07(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    x = table(spark, d, "supplier").select("s_suppkey", "s_name")
    sinks.write_csv(x, at, "\t")
    return readers.read_csv(spark, at, x.schema, "\t")


def q_snk_09(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of a run."""
    return sinks.manifest(table(spark, d, "part"), {"table": "part", "rule": "all"})


def q_prj_01(spark: SparkSession, d: str) -> DataFrame:
    """Headers in normal form."""
    return readers.normal_headers(table(spark, d, "region").toDF("Region - Key ", "R Name")).select(F.col("region_key").alias("region_key"), "r_name")


def q_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Weekly windows over the stream of events."""
    s = table(spark, d, "events").schema
    events = spark.readStream.schema(s).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.run_to_end(spark, windows.tumbling(events, "ts", ["event_type"], "value", "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").schema
    return spark.readStream.schema(s).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user over the stream of events: none is quiet for six hours."""
    out = windows.run_to_end(spark, windows.sessions(_stream(spark, d), "ts", ["user_id"], "6 hours"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


def q_stream_unique(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each id from a stream that sends every event twice, counted by type."""
    e = _stream(spark, d)
    once = windows.unique_events(e.unionByName(e), "ts", ["event_id"], "60 days")
    return windows.run_to_end(spark, once.select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (q_src_01, q_src_02, q_src_03, q_src_04, q_src_05, q_src_06, q_src_08, q_src_09, q_src_16, q_src_19, q_snk_01, q_snk_02, q_snk_05, q_snk_06, q_snk_07, q_snk_09, q_hp_12, q_prj_01, q_stream_tumbling, q_stream_sessions, q_stream_unique)}
SQL = {
    "q_src_01": "select p_partkey, p_name, p_size from part",
    "q_src_02": "select n_nationkey, n_name from nation",
    "q_src_03": "select n_name as \"SampleID\", n_nationkey from nation",
    "q_src_05": "select n_nationkey, n_name, n_regionkey from nation",
    "q_src_06": "select i + 1 as row_no, n_name from (select row_number() over (order by n_nationkey) as i, n_name from nation) where i in (1, 4, 8)",
    "q_src_09": "select s_suppkey, s_acctbal, chr(65 + (s_suppkey % 3)::int) as comparison from supplier",
    "q_src_19": "select r_regionkey, r_name from region",
    "q_snk_01": "select s_suppkey, s_name || ', \"' || chr(10) || s_suppkey || '\"' as note from supplier",
    "q_snk_06": "select count(*) as n, 0 as n_different from embeddings",
    "q_hp_12": "select case when user_id % 5 = 0 then 'test' else 'train' end as split, event_type, count(*) as n from events where event_type in ('click', 'view') group by 1, 2",
    "q_src_04": "select n_nationkey, n_name, n_regionkey from nation",
    "q_src_08": "select n_nationkey, 'part' || (n_nationkey % 2) as folder from nation",
    "q_src_16": "select r_regionkey, r_name from region",
    "q_snk_02": "select c_custkey, c_mktsegment from customer",
    "q_snk_05": "select s_name from supplier",
    "q_snk_07": "select s_suppkey, s_name from supplier",
    "q_snk_09": "select 'part' as \"table\", 'all' as rule, count(*) as n_rows, (select count(*) from (describe part)) as n_columns from part",
    "q_prj_01": "select r_regionkey as region_key, r_name from region",
    "q_stream_sessions": "with x as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours, true)::int as new from events), y as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from x) select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from y group by user_id, k",
    "q_stream_unique": "select event_type, count(*) as n from events group by 1",
    "q_stream_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
