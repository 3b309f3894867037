"""Two versions of line-structured documents made from the order keys, and their SQL twin: every gate has rows to meet."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Dialect

LINES = (
    "Jordan Doe", "Dallas, TX | 555-123-4567", "SUMMARY", "Data engineer with nine years of building pipelines. Known for steady delivery under deadlines.", "PROFESSIONAL EXPERIENCE",
    "Acme Corp | Data Engineer | Jan 2019 - Present", "- Led a team of four engineers to rebuild the billing pipeline", "- Build streaming jobs that load two billion rows a day",
    "- Migrated the warehouse to columnar tables and cut its cost by half", "- Read and set the rules for nightly quality checks of the tables", "- Designed the access rules for all teams that read the finance tables", "- Wrote the test suite that guards every change of the loading jobs", "Environment: Spark, SQL, Airflow, Kafka",
    "Beta LLC | Analyst | Mar 2015 - Dec 2018", "- Ran the weekly forecast of demand for the regional stores", "- Automated reports that the sales team had written by hand", "- Set the format that suppliers use to deliver their prices",
    "environment: Terraform, Docker",
    "TECHNICAL SKILLS", "Languages: SQL, Python, Scala", "PROJECTS", "EDUCATION", "B.S. in Mathematics", "CERTIFICATIONS", "AWS Certified Architect — Associate", "Snowflake Core -- Advanced", "",
    "Note: I am happy to say that my work on this document was careful and that I've added everything you asked me to add to it, as you can see above.",
    "- Wrote the loader.• Designed the schema of all tables for reporting use", "A plain line of text — with a dash",
    "Gamma Inc, Engineer (2012 - 2014)", "\t- Kept a tab ahead of this bullet and a carriage return behind it\r", "\u00a0PUBLICATIONS\u00a0\t",
)
SIZE = 33
#: Stands in drafts only.
ADDED = "- Negotiated 45 percent lower freight prices with overseas carriers"


def sql(d: Dialect, version: int, orders: str = "orders") -> str:
    shift = ("0", "(o_orderkey % 4) * 3")[version]
    key = f"cast(floor(o_orderkey / {SIZE}) as bigint)"
    line = d.pick(LINES, f'(o_orderkey % {SIZE} + {key} * 5 + {shift}) % {len(LINES)} + 1')
    if version:
        line = f"case when o_orderkey % 13 = 5 then {d.text(ADDED)} else {line} end"
    return f"select {key} as doc_id, cast(o_orderkey % {SIZE} as bigint) as line_no, {line} as line from {orders}"


def lines(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Version 0 is the original, 1 the draft."""
    return spark.sql(sql(SPARK, version, "{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
