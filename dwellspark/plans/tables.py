"""The given tables seen as listings, index and requests.

The SELECT lists are plain SQL that Spark and DuckDB read alike; ``oracles`` uses the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.operators.records import build_payload

LISTING_COLUMNS = """
  p_partkey as id, 'ext-'||cast(p_partkey as string) as external_id, p_name as title, text as description,
  case when p_partkey%11=0 then null else cast(floor(p_retailprice) as int) end as price,
  cast(p_size%10 as double)/cast(2 as double) as rooms, p_size*3 as size_sqm, p_brand as city,
  case when p_partkey%7=0 then null else p_type end as location, case when p_partkey%3=0 then p_name end as neighborhood,
  p_size%7-1 as floor, p_size%7+2 as total_floors, p_size%2=0 as has_parking, p_size%3=0 as has_elevator,
  p_partkey%2=0 as has_balcony, p_partkey%5=0 as has_storage,
  case when p_partkey%13=0 then null else p_size%5=0 end as furnished,
  case when p_partkey%4=0 then null else p_partkey%4=1 end as pets_allowed"""

# The same rows as a loose feed: every value a text, some of them unusable.
RAW_COLUMNS = """
  'ext-'||cast(p_partkey as string) as external_id, '  '||p_name||'  ' as title, text as description,
  case p_partkey%8 when 0 then cast(p_size*100 as string)||',500 ש״ח' when 1 then '₪'||cast(p_size as string)
    when 2 then cast(p_size as string)||'.0' when 3 then ' '||cast(p_size as string)||' ' when 4 then ''
    when 5 then null when 6 then '-'||cast(p_size as string) else cast(p_size*1000 as string) end as price,
  case p_partkey%6 when 0 then cast(p_size%10 as string)||'.5' when 1 then 'x' when 2 then ''
    when 3 then null when 4 then '12'||cast(p_size%10 as string) else cast(p_size%10 as string) end as rooms,
  case p_partkey%5 when 0 then cast(p_size as string)||'.5' when 1 then null when 2 then ' '||cast(p_size as string)
    else cast(p_size as string) end as size_sqm,
  case when p_partkey%7=0 then null else p_type end as location, p_brand||'  &amp; '||p_type as city,
  case when p_partkey%9=0 then '   ' when p_partkey%3=0 then p_name end as neighborhood,
  cast(p_size%7-1 as string) as floor, cast(p_size%7+2 as string) as total_floors,
  case p_partkey%4 when 0 then null when 1 then '' when 2 then 'false' else 'true' end as has_parking,
  case p_partkey%3 when 0 then null when 1 then '1' else '' end as has_elevator,
  'true' as has_balcony, case when p_partkey%2=0 then 'no' end as has_storage, cast(null as string) as furnished,
  case p_partkey%3 when 0 then 'true' when 1 then 'false' end as pets_allowed"""

# A request after a listing, for listings like it.
REQUEST_COLUMNS = """
  id as query_id, cast(1+id%10 as int) as "limit", price-20 as price_min, price+20 as price_max,
  case when id%2=0 then greatest(rooms-1,0) end as rooms_min, case when id%3=0 then rooms+1 end as rooms_max,
  case when id%16=0 then city when id%16=1 then '' end as city, case when id%5=0 then location end as location,
  case when id%3=0 then has_parking end as has_parking, case when id%6=1 then has_elevator end as has_elevator,
  case when id%2=0 then coalesce(furnished,false) end as furnished"""

# One request per part, some of them not valid.
FORM_COLUMNS = """
  p_partkey as query_id, case when p_partkey%9=0 then '  ' when p_partkey%10=0 then null else p_name end as query,
  case when p_partkey%7=0 then null else p_size*3-5 end as "limit",
  cast(floor(p_retailprice) as int)-905 as price_min, case when p_partkey%5=0 then null else p_size*50-100 end as price_max,
  cast(p_size%10 as double)-cast(2 as double) as rooms_min, cast(p_size%10 as double) as rooms_max,
  '  '||p_brand as city, case when p_partkey%3=0 then '  ' else p_type end as location"""


def spark_text(columns: str) -> str:
    return columns.replace('"limit"', "`limit`")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, columns: str) -> DataFrame:
    return spark_select(df, spark_text(columns))


def spark_select(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql("select " + columns + " from {rows}", rows=df)


def _parts_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, with the text of the document of its number; numbers start again after the last document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    part = read(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey") % documents.count())
    return part.join(documents, "doc_id").drop("doc_id")


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_parts_with_text(spark, sf_dir), LISTING_COLUMNS)


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_parts_with_text(spark, sf_dir), RAW_COLUMNS)


def form_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "part"), FORM_COLUMNS)


def index_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with two vectors: the embedding of its number, and the one half the table further.

    Numbers start again after the last embedding.
    """
    embeddings = read(spark, sf_dir, "embeddings")
    count = embeddings.count()
    one = embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("structured"))
    two = embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("description"))
    payload = listing_view(spark, sf_dir).select("id", build_payload().alias("payload"))
    numbered = payload.withColumns({"a": F.col("id") % count, "b": (F.col("id") + count // 2) % count})
    return numbered.join(one, "a").join(two, "b").select("id", "structured", "description", "payload")


def request_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each benchmark item, after the listing of its number."""
    requests = select(listing_view(spark, sf_dir), REQUEST_COLUMNS)
    return requests.join(query_vectors(spark, sf_dir), "query_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query, with the embedding of its number."""
    embeddings = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return asked.withColumn("vec_id", F.col("query_id") % embeddings.count()).join(embeddings, "vec_id").drop("vec_id")


def mean_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean of all embeddings, one value per dimension."""
    values = read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    rows = values.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()
    return [row.x for row in rows]
