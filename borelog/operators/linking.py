"""Which well a record belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelog.functions import text as fn


def area_codes(incidents: DataFrame, wells: DataFrame) -> DataFrame:
    """(area, code) learned from incidents (area, lease) and wells (code, lease): only where all agree."""
    pairs = incidents.where("area is not null and lease is not null").join(wells.select("lease", "code"), "lease")
    return pairs.groupBy("area").agg(F.countDistinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").select("area", "code")


def resolve(incidents: DataFrame, wells: DataFrame) -> DataFrame:
    """Incidents (incident_id, api, lease, code, block) with well_id and how it was found.

    A well's number in the text decides. Else the wells of the lease and of the block are intersected, or the block's
    alone are taken where nothing is in both; one candidate links, several on a block give the block, several or none of a
    lease alone give null. ``wells`` has well_id, api, lease, code, block."""
    by_api = wells.where("api is not null").groupBy("api").agg(F.min("well_id").alias("api_well"))
    by_lease = wells.where("lease is not null").groupBy("lease").agg(F.collect_set("well_id").alias("lease_wells"))
    by_block = wells.where("code is not null and block is not null").groupBy("code", "block").agg(F.collect_set("well_id").alias("block_wells"))
    rows = incidents.join(by_api, "api", "left").join(by_lease, "lease", "left").join(by_block, ["code", "block"], "left")
    none = F.array().cast("array<bigint>")
    lease, block = F.coalesce("lease_wells", none), F.coalesce("block_wells", none)
    both = F.array_intersect(lease, block)
    found = F.when(F.size(both) > 0, both).when(F.size(block) > 0, block).otherwise(lease)
    rows = rows.withColumn("_c", found).withColumn("_block", F.size(block) > 0)
    well = F.coalesce("api_well", F.when(F.size("_c") == 1, F.get("_c", F.lit(0))))
    how = F.when(F.col("api_well").isNotNull(), "number").when(F.size("_c") == 1, "unique").when(F.col("_block"), "block")
    name = F.when(F.col("api_well").isNull() & (F.size("_c") > 1) & F.col("_block"), F.concat_ws(" ", "code", "block"))
    return rows.select("incident_id", well.alias("well_id"), how.alias("method"), name.alias("block_name"))


def block_places(wells: DataFrame) -> DataFrame:
    """(code, block, lat, lon): the mean place of a block's wells."""
    return wells.where("code is not null and block is not null").groupBy("code", "block").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def find_or_create(names: DataFrame, wells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded names (well_id or null, name) with the well found by id, name or canonical name; and the canonical names of wells to create."""
    by_id = wells.select(F.col("well_id").alias("_id"), F.col("well_id").alias("_w1"))
    by_name = wells.groupBy(F.col("name").alias("_name")).agg(F.min("well_id").alias("_w2"))
    by_key = wells.groupBy(fn.canonical_well(F.col("name")).alias("_key")).agg(F.min("well_id").alias("_w3"))
    keyed = names.withColumn("_k", fn.canonical_well(F.col("name")))
    rows = keyed.join(by_id, keyed["well_id"] == by_id["_id"], "left").join(by_name, keyed["name"] == by_name["_name"], "left").join(by_key, keyed["_k"] == by_key["_key"], "left")
    found = rows.select(F.coalesce("_w1", "_w2", "_w3").alias("well_id"), "name", F.col("_k").alias("canonical"))
    return found, found.where("well_id is null and canonical is not null").select("canonical").distinct()
