"""Candidate records derived from the star-schema tables, by expressions that Spark and DuckDB share.

``customer`` rows become records of five source types in turn. Runs of three share an e-mail address, and in every twelve
one phone number joins two such runs, so records link directly and through one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SELECT over ``customer`` that both engines read alike. Clusters stay small: keys repeat a few times each.
CANDIDATE_SQL = """
SELECT c_custkey AS record_id,
  CASE c_custkey % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'ats_json' WHEN 2 THEN 'resume_pdf' WHEN 3 THEN 'recruiter_notes' ELSE 'other' END AS source_type,
  concat('src/', CAST(c_custkey % 5 AS STRING), '.dat') AS source_path,
  c_custkey AS position,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN concat('  Name ', CAST(c_custkey % 40 AS STRING), ' ') ELSE concat('name ', CAST(c_custkey % 40 AS STRING)) END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(' User', CAST((c_custkey - c_custkey % 3) AS STRING), CASE WHEN c_custkey % 13 = 0 THEN '@bad' ELSE '@Mail.example' END, ' ') END AS email,
  CASE WHEN c_custkey % 12 IN (2, 3) THEN concat('(555) ', lpad(CAST((c_custkey - c_custkey % 12) % 1000 AS STRING), 3, '0'), '-', lpad(CAST((c_custkey - c_custkey % 12) % 9973 AS STRING), 4, '0'))
       WHEN c_custkey % 4 = 1 THEN concat('+44 20 ', lpad(CAST(c_custkey AS STRING), 8, '7')) WHEN c_custkey % 4 = 0 THEN '12' ELSE NULL END AS phone,
  CASE c_custkey % 6 WHEN 0 THEN 'San Francisco, California' WHEN 1 THEN 'Bangalore India' WHEN 2 THEN 'New York, NY' WHEN 3 THEN 'Atlantis, Deep' WHEN 4 THEN 'San Francisco, CA' ELSE NULL END AS location,
  CASE c_custkey % 4 WHEN 0 THEN 'ML' WHEN 1 THEN 'python3' WHEN 2 THEN 'some-unknown skill' ELSE 'Python' END AS skill_a,
  CASE c_custkey % 3 WHEN 0 THEN 'k8s' WHEN 1 THEN 'Machine Learning' ELSE ' ' END AS skill_b,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS company,
  CASE c_custkey % 3 WHEN 0 THEN 'Engineer' WHEN 1 THEN 'Senior Engineer' ELSE 'Analyst' END AS title,
  CASE c_custkey % 5 WHEN 0 THEN 'Jan 2020' WHEN 1 THEN '03/2021' WHEN 2 THEN '2022' WHEN 3 THEN '2019-05-01' ELSE 'someday' END AS start_date,
  CASE WHEN c_custkey % 2 = 0 THEN 'Present' ELSE 'Sept 2022' END AS end_date,
  CASE WHEN c_custkey % 2 = 0 THEN 'State University' ELSE 'Tech Institute' END AS institution,
  CASE c_custkey % 3 WHEN 0 THEN 'BS' WHEN 1 THEN 'MS' ELSE 'bs' END AS degree,
  concat('https://example.org/u/', CAST(c_custkey % 50 AS STRING)) AS link
FROM customer
"""


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat derived rows."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(CANDIDATE_SQL.replace("FROM customer", "FROM {customer}"), customer=customer)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the engine's schema."""
    return raw_candidates(spark, sf_dir).selectExpr(
        "record_id",
        "source_type",
        "source_path",
        "position",
        "name AS full_name",
        "array_compact(array(email)) AS emails",
        "array_compact(array(phone)) AS phones",
        "location",
        "array(skill_a, skill_b) AS skills",
        "array(named_struct('company', company, 'title', title, 'start_date', start_date, 'end_date', end_date)) AS experience",
        "array(named_struct('institution', institution, 'degree', degree, 'year', '2019')) AS education",
        "company AS current_company",
        "title AS current_title",
        "array(link) AS links",
        "CAST(NULL AS STRING) AS raw_metadata",
    )
