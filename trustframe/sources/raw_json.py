"""Raw account dumps: JSON array files, single objects or NDJSON -> VARIANT rows.

Every element is parsed on its own (``try_parse_json``), because a VARIANT is
limited to 128 MiB.  Array files are split over many tasks by ``json_array``;
what does not parse stays as an element without value, so it shows up among
the rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_array import elements


def read_raw_accounts(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """-> DataFrame[idx BIGINT, v VARIANT]; ``layout`` is ``array`` or ``ndjson``.

    ``idx`` is the element's position in its array file.  A broken-off file
    keeps its whole elements and gives one without value.
    """
    if layout == "ndjson":
        lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
        return lines.select(F.monotonically_increasing_id().alias("idx"),
                            F.try_parse_json("value").alias("v"))
    return elements(spark, path).select("idx", F.try_parse_json("raw").alias("v"))


def _is_object(v) -> F.Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def unwrap_accounts(raw: DataFrame) -> DataFrame:
    """Element -> account object: a dict stays; ``[id, dict]`` -> element 1,
    ``[dict, ...]`` -> element 0; anything else becomes NULL (see ``rejected_raw``)."""
    v = F.col("v")
    e1 = F.try_variant_get(v, "$[1]", "variant")
    e0 = F.try_variant_get(v, "$[0]", "variant")
    is_arr = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    obj = (F.when(_is_object(v), v)
           .when(is_arr & _is_object(e1), e1)
           .when(is_arr & _is_object(e0), e0))
    return raw.withColumn("obj", obj)


def accepted_raw(unwrapped: DataFrame) -> DataFrame:
    return unwrapped.filter(F.col("obj").isNotNull())


def rejected_raw(unwrapped: DataFrame) -> DataFrame:
    """Quarantine of skipped entries with their position and kind."""
    return (unwrapped.filter(F.col("obj").isNull())
            .select("idx", F.coalesce(F.schema_of_variant("v"), F.lit("UNPARSEABLE")).alias("kind")))
