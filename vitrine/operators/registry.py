"""Model registry: at most one active version per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registered(registrations: DataFrame) -> DataFrame:
    """The first registration of each (type, version); later ones are conflicts."""
    return registrations.groupBy("model_type", "version").agg(
        F.min_by(F.struct("model_name", "status", "at"), "at").alias("r")
    ).select("model_type", "version", "r.*")


def current_models(registrations: DataFrame, switches: DataFrame) -> DataFrame:
    """Registered versions with their present status.

    ``switches`` is (model_type, version, action, at), action being activate or deactivate. The
    latest activation of a type demotes the others; a later deactivation leaves none active.
    """
    known = registered(registrations)
    valid = switches.join(known.select("model_type", "version"), ["model_type", "version"], "left_semi")
    on = known.filter(F.col("status") == "active").select("model_type", "version", "at").unionByName(
        valid.filter(F.col("action") == "activate").select("model_type", "version", "at"))
    last_on = on.groupBy("model_type").agg(
        F.max_by("version", F.struct("at", "version")).alias("version"), F.max("at").alias("on_at"))
    last_off = valid.filter(F.col("action") == "deactivate").groupBy("model_type", "version").agg(
        F.max("at").alias("off_at"))
    winner = last_on.join(last_off, ["model_type", "version"], "left").filter(
        F.col("off_at").isNull() | (F.col("off_at") < F.col("on_at"))).select(
        "model_type", "version", F.lit(True).alias("_active"))
    return known.join(winner, ["model_type", "version"], "left").select(
        "model_type", "version", "model_name",
        F.when(F.col("_active"), "active").otherwise("inactive").alias("status"))


def model_usage(types: DataFrame, models: DataFrame) -> DataFrame:
    """Per model type its active version, if any, and how many are registered."""
    active = F.col("status") == "active"
    per_type = models.groupBy("model_type").agg(
        F.max(F.when(active, F.col("model_name"))).alias("active_model"),
        F.max(F.when(active, F.col("version"))).alias("active_version"),
        F.count("*").alias("registered_versions"))
    return types.join(per_type, "model_type", "left").na.fill(0, ["registered_versions"])
