"""Accessibility enrichment (J9, P11, P12) of places by exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentier import constants as K

FIELDS = list(K.ACCESS_BOOL_FIELDS) + list(K.ACCESS_STR_FIELDS) + list(K.ACCESS_LIST_FIELDS)


def _complete(access: DataFrame) -> DataFrame:
    """Absent attribute columns are added as NULL of their type."""
    for f in K.ACCESS_BOOL_FIELDS:
        if f not in access.columns:
            access = access.withColumn(f, F.lit(None).cast("boolean"))
    for f in K.ACCESS_STR_FIELDS:
        if f not in access.columns:
            access = access.withColumn(f, F.lit(None).cast("string"))
    for f in K.ACCESS_LIST_FIELDS:
        if f not in access.columns:
            access = access.withColumn(f, F.lit(None).cast("array<string>"))
    return access


def accessibility_join(places: DataFrame, access: DataFrame, order_col: str | None = None) -> DataFrame:
    """The first accessibility row with the place's exact name, by
    ``order_col`` (without one: the least row, so that reruns agree).
    Unmatched places get NULL everywhere; a matched row's missing values get
    typed defaults (False, 'Non disponible', [])."""
    a = _complete(access)
    a = a.select("name", *FIELDS, *([order_col] if order_col else []))
    key = F.col(order_col) if order_col else F.struct(*FIELDS)
    first = (a.withColumn("_o", key).groupBy("name")
             .agg(F.min_by(F.struct(*FIELDS), F.col("_o")).alias("_a"))
             .select("name", "_a.*").withColumn("matched", F.lit(True)))
    j = places.select("tsid", "nom").join(first, places.nom == first.name, "left")
    m = F.coalesce(F.col("matched"), F.lit(False))
    out = [F.col("tsid"), m.alias("matched")]
    for f in K.ACCESS_BOOL_FIELDS:
        out.append(F.when(m, F.coalesce(F.col(f), F.lit(False))).alias(f))
    for f in K.ACCESS_STR_FIELDS:
        out.append(F.when(m, F.coalesce(F.col(f), F.lit(K.ACCESS_NOT_AVAILABLE))).alias(f))
    for f in K.ACCESS_LIST_FIELDS:
        out.append(F.when(m, F.coalesce(F.col(f), F.array().cast("array<string>"))).alias(f))
    return j.select(*out)


def accessibility_labels(enriched: DataFrame) -> DataFrame:
    """Display labels: true → 'Oui', falsy (NULL, false, '', []) →
    'Non disponible', other values shown as they are (lists joined by ', ')."""
    out = [F.col("tsid")]
    na = F.lit(K.ACCESS_NOT_AVAILABLE)
    for f in K.ACCESS_BOOL_FIELDS:
        out.append(F.when(F.col(f) == F.lit(True), F.lit(K.ACCESS_YES)).otherwise(na).alias(f))
    for f in K.ACCESS_STR_FIELDS:
        out.append(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(f)).otherwise(na).alias(f))
    for f in K.ACCESS_LIST_FIELDS:
        out.append(F.when(F.coalesce(F.size(F.col(f)), F.lit(0)) > 0, F.array_join(F.col(f), ", ")).otherwise(na).alias(f))
    return enriched.select(*out)
