"""Query of the general problem: mixed timestamp formats and zones (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.operators.timestamps import instants
from peneira.session import table


def vacancy_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of vacancy.published_at and application_deadline."""
    return instants(table(spark, sf_dir, "vacancy"), table(spark, sf_dir, "source_dim"), "rec_id", {"published_at": False, "application_deadline": True}, "observed_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the four fields that denote an instant and are not yet in the one form."""
    jobs = instants(table(spark, sf_dir, "api_job"), table(spark, sf_dir, "source_dim"), "row_id", {"first_published": False, "updated_at": False})
    out = [df.where(~F.col("canonical")).select(F.lit(name).alias("tbl"), "row_id", "field", "utc_us") for name, df in (("vacancy", vacancy_instants(spark, sf_dir)), ("api_job", jobs))]
    return out[0].unionAll(out[1])


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
