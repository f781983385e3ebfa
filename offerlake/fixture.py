"""Offers derived from `orders`: phrases picked by remainders, so that every fact follows from the order's numbers.

The text runs unchanged in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.schema import canonical

FX = """
SELECT o.o_orderkey AS seq, o.o_custkey AS cust,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'adzuna' WHEN 1 THEN 'freework' WHEN 2 THEN 'francetravail' ELSE 'remoteok' END AS source,
  CASE o.o_orderkey % 11 WHEN 0 THEN 'Data Engineer Senior' WHEN 1 THEN 'Consultant Power BI' WHEN 2 THEN 'Développeur Full Stack'
    WHEN 3 THEN 'Data Entry Assistant' WHEN 4 THEN 'Analyste décisionnel' WHEN 5 THEN 'Stage Data Analyst' WHEN 6 THEN 'Ingénieur DevOps'
    WHEN 7 THEN 'Head of Marketing' WHEN 8 THEN 'Consultant technique senior' WHEN 9 THEN 'Data Analyst CDI' ELSE 'Architecte data' END AS title,
  CASE WHEN o.o_custkey % 13 = 0 THEN '' ELSE concat('Société ', CAST(o.o_custkey % 97 AS STRING)) END AS company,
  concat(
    CASE o.o_orderkey % 3 WHEN 0 THEN 'Mission freelance.' WHEN 1 THEN 'Poste en CDD.' ELSE 'Contexte du projet.' END,
    CASE o.o_orderkey % 5 WHEN 0 THEN ' Full remote.' WHEN 1 THEN ' Télétravail partiel.' WHEN 2 THEN ' Présence sur site exigée.'
      WHEN 3 THEN ' 3 jours par semaine sur site.' ELSE '' END,
    CASE o.o_orderkey % 7 WHEN 0 THEN ' Stack Python, SQL, dbt, Snowflake, Airflow.' WHEN 1 THEN ' Pipeline data : Kafka et Spark.'
      WHEN 2 THEN ' Java, Docker, CI/CD, AWS.' WHEN 3 THEN ' Power BI, DAX et Excel.' WHEN 4 THEN ' La data au quotidien.'
      WHEN 5 THEN ' Gouvernance et qualité des données.' ELSE '' END,
    CASE o.o_orderkey % 6
      WHEN 0 THEN concat(' TJM : ', CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 3000 AS STRING), ' €')
      WHEN 1 THEN concat(' TJM entre ', CAST(400 + o.o_orderkey % 300 AS STRING), ' et ', CAST(450 + o.o_custkey % 300 AS STRING), ' euros')
      WHEN 2 THEN concat(' ', CAST(300 + o.o_orderkey % 500 AS STRING), ' EUR HT par jour')
      WHEN 3 THEN ' Salaire 45000 euros par an.' ELSE '' END,
    CASE o.o_custkey % 5 WHEN 0 THEN concat(' Durée ', CAST(1 + o.o_custkey % 18 AS STRING), ' mois.') WHEN 1 THEN ' Mission de 8 semaines.'
      WHEN 2 THEN ' 5 ans d''expérience.' WHEN 3 THEN ' Sur 2 ans.' ELSE '' END) AS description,
  CASE o.o_custkey % 7 WHEN 0 THEN 'Paris, Île-de-France, FR' WHEN 1 THEN '92 - Nanterre' WHEN 2 THEN 'Remote - Brazil only'
    WHEN 3 THEN 'Remote - France' WHEN 4 THEN 'Kuala Lumpur' WHEN 5 THEN 'Bordeaux, depuis 1992' ELSE '' END AS location,
  CASE WHEN o.o_orderkey % 10 = 9 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' - (o.o_orderkey % 45) * INTERVAL '1' DAY END AS published_at
FROM orders o
"""


ROWS = 50_000  # of a task, about


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly, before the work on their texts: a file has as many splits as its size asks for, but all
    rows of a row group are read by one of them, and the others have none."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return spark.sql(FX.replace("FROM orders o", "FROM {orders} o"), orders=spread(orders))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived rows as canonical offers, with seq."""
    rows = fx(spark, sf_dir).withColumns({"source_id": F.col("seq").cast("string"), "url": F.concat(F.lit("https://jobs.example.com/"), F.col("seq").cast("string"))})
    return canonical(rows, "seq")
