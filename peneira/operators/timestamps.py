"""Operator: values written in many ways to one unambiguous instant."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.functions.times import CANONICAL, parse

RESULT = "row_id bigint, field string, raw string, utc_us bigint, canonical boolean"


def instants(rows: DataFrame, dim: DataFrame, row_id: str, fields: Mapping[str, bool], observed: str | None = None) -> DataFrame:
    """One row (row_id, field, raw, utc_us, canonical) for each value that denotes an instant.

    rows: has row_id, source and the fields; fields: name -> whether a date
    alone means its last second; dim: code, tz, day_first of the sources;
    observed: the column from which ages count back, else ages denote nothing.
    canonical: raw is already `YYYY-MM-DDTHH:MM:SSZ`.

    Nulls, blanks, impossible dates and texts without a time give no row. A
    source not in dim counts as UTC with the day first. Repeated rows give
    their rows again; other columns are not read. One scan, no shuffle: dim is
    joined by whatever way its size allows.
    """
    at = F.col(observed) if observed else F.lit(None).cast("string")
    own = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col("source").alias("code"), at.alias("at"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)])
    filled = own.where(F.coalesce(*[F.col(f"v{i}") for i in range(len(fields))]).isNotNull())
    zones = dim.select("code", "tz", "day_first").dropDuplicates(["code"])
    joined = filled.join(zones, "code", "left").select("row_id", "at", F.coalesce("tz", F.lit("UTC")).alias("tz"), F.coalesce("day_first", F.lit(True)).alias("day_first"), *[f"v{i}" for i in range(len(fields))])
    names, late = list(fields), list(fields.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, zone = batch.column("row_id"), np.array(batch.column("tz").to_pylist(), object)
            first = batch.column("day_first").to_numpy(zero_copy_only=False).astype(bool)
            seen = _observed(batch.column("at"))
            for i, name in enumerate(names):
                column = batch.column(f"v{i}")
                us, ok = parse(column.cast(pa.binary()), zone, first, seen, late[i])
                kept = np.flatnonzero(ok)
                if len(kept):
                    picked = pa.array(kept)
                    raw = column.take(picked)
                    clean = pa.compute.match_substring_regex(raw, CANONICAL)
                    yield pa.RecordBatch.from_arrays([ids.take(picked), pa.array([name] * len(kept)), raw, pa.array(us[kept]), clean], ["row_id", "field", "raw", "utc_us", "canonical"])

    return joined.mapInArrow(read, RESULT)


def _observed(column: pa.Array) -> np.ndarray:
    """Seconds of reference times written with their zone; -1 for none."""
    n = len(column)
    us, ok = parse(column.cast(pa.binary()), np.full(n, "UTC", object), np.ones(n, bool), np.full(n, -1), False)
    return np.where(ok, us // 1_000_000, -1)
