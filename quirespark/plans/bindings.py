"""How the library's tables are had from the driver's: Spark functions, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: of every seven the first is a heading of level 1, the fourth of level 2, the sixth an image."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    at = F.col("idx") % 7
    return lines.select("doc_id", "idx", F.when(at == 0, 1).when(at == 3, 2).otherwise(0).alias("level"), F.when(at != 5, F.col("line")).alias("text"), F.when(at == 5, F.concat(F.lit("img/"), "idx", F.lit(".png"))).alias("image_url"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks as an array ``body`` in each document's row."""
    at = lambda i: i % 7
    block = lambda x, i: F.struct(F.when(at(i) == 0, 1).when(at(i) == 3, 2).otherwise(0).alias("level"), F.when(at(i) != 5, x).alias("text"), F.when(at(i) == 5, F.concat(F.lit("img/"), i.cast("string"), F.lit(".png"))).alias("image_url"))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), block).alias("body"))


BLOCKS = """blocks as (
  select doc_id, (i - 1)::int as idx, case (i - 1) % 7 when 0 then 1 when 3 then 2 else 0 end::int as level,
    case when (i - 1) % 7 <> 5 then line end as text, case when (i - 1) % 7 = 5 then 'img/' || (i - 1) || '.png' end as image_url
  from documents, unnest(string_split(text, chr(10))) with ordinality as t(line, i))"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text with markdown: a heading before every third line (levels 1 to 4 in turn), an image after every fifth, blank lines kept."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i / 3).cast("int") % 4 + 1), F.lit(" Part "), i.cast("string"), F.lit("\n"))).otherwise(""), x, F.when(i % 5 == 4, F.concat(F.lit("\n![fig](f"), i.cast("string"), F.lit(".png)"))).otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


MARKDOWN = """markdown as (
  select doc_id, string_agg(case when (i - 1) % 3 = 0 then repeat('#', ((i - 1) // 3 % 4 + 1)::int) || ' Part ' || (i - 1) || chr(10) else '' end || line
      || case when (i - 1) % 5 = 4 then chr(10) || '![fig](f' || (i - 1) || '.png)' else '' end, chr(10) order by i) as text
  from documents, unnest(string_split(text, chr(10))) with ordinality as t(line, i) group by doc_id)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of three levels: regions (ids from 1000), nations (from 0), market segments of nations (from 10000)."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).alias("parent_id"))
    m = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10000).alias("id"), F.concat("n_name", F.lit(" old")).alias("name"), F.col("n_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(m)


FOLDERS = """folders as (
  select r_regionkey + 1000 as id, r_name as name, null::int as parent_id from region union all
  select n_nationkey, n_name, n_regionkey + 1000 from nation union all
  select n_nationkey + 10000, n_name || ' old', n_nationkey from nation)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the folder of their nation, but for every fifth."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").alias("folder_id"))


MAPPING = "mapping as (select c_custkey as paper_id, c_nationkey as folder_id from customer where c_custkey % 5 <> 0)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary: first words of benchmark items, a third kept as they are, a third annotated."""
    word = F.get(F.split("text", "[ \n]"), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(word.alias("en"), F.concat(F.lit("t-"), word).alias("zh"), F.element_at(F.array(F.lit("translate"), F.lit("never_translate"), F.lit("translate_with_annotation")), (F.col("item_id") % 3 + 1).cast("int")).alias("status"), "item_id").filter(F.length("en") > 1)


TERMS = """terms0 as (select item_id, string_split_regex(text, '[ \\n]')[2] as en from benchmark),
terms as (select en, 't-' || en as zh, ['translate', 'never_translate', 'translate_with_annotation'][item_id % 3 + 1] as status, item_id from terms0 where length(en) > 1)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as jobs of chapters: the order is the parent."""
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_tax") > 0.07, "failed").otherwise("completed")).when(F.col("l_linestatus") == "F", "completed").when(F.col("l_tax") > 0.06, "waiting_term_review").when(F.col("l_tax") > 0.03, "translating").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_job_id"), F.col("l_linenumber").alias("chapter_index"), status.alias("status"), F.col("l_quantity").cast("int").alias("progress"))


JOBS = """jobs as (
  select l_orderkey as parent_job_id, l_linenumber as chapter_index, l_quantity::int as progress,
    case when l_returnflag = 'R' then case when l_tax > 0.07 then 'failed' else 'completed' end when l_linestatus = 'F' then 'completed'
      when l_tax > 0.06 then 'waiting_term_review' when l_tax > 0.03 then 'translating' else 'pending' end as status
  from lineitem)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of orders from their line items; an order has 50 pages."""
    start = (F.col("l_partkey") % 40).cast("int") + 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), start.alias("start_page"), (start + (F.col("l_quantity").cast("int") % 9) - 1).alias("end_page"), F.lit(45).alias("page_count"))


RANGES = """ranges as (
  select l_orderkey, l_linenumber as line, (l_partkey % 40)::int + 1 as start_page, (l_partkey % 40)::int + 1 + (l_quantity::int % 9) - 1 as end_page, 45 as page_count
  from lineitem)"""
