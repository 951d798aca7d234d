"""Measured images: size evidence, its binding to an image, and layer sums of stored layouts.

Reading containers is out of scope; these are checks over the documents that measuring leaves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import checks

from .documents import failed

# Form of the evidence, official platform, methods, limits in bytes.
EVIDENCE_TEXT = ("report_type", "submitted_digest", "selected_manifest_digest", "config_digest", "os", "architecture", "oci_layer_measurement_method", "rootfs_measurement_method")
EVIDENCE_SIZES = ("oci_compressed_layer_bytes", "rootfs_apparent_bytes")
EVIDENCE = ", ".join(["schema_version: int", *(f"{k}: string" for k in EVIDENCE_TEXT), *(f"{k}: bigint" for k in EVIDENCE_SIZES)])
EVIDENCE_TYPE, PLATFORM = "operator-image-size-evidence", ("linux", "arm64")
MOST_LAYER_BYTES, MOST_ROOTFS_BYTES = 1 << 30, 1 << 31


def evidence(docs: DataFrame) -> DataFrame:
    """(path, fields, evidence_sha256) of evidence documents (path, text)."""
    return docs.select("path", F.from_json("text", f"struct<{EVIDENCE}>").alias("d"), F.sha2("text", 256).alias("evidence_sha256")).select("path", "d.*", "evidence_sha256")


def evidence_problems(docs: DataFrame, layer_method: str, rootfs_method: str) -> DataFrame:
    """(path, rule) of evidence documents: keys, types, digests, platform, methods, sizes."""
    v = docs.withColumn("v", F.try_parse_json("text"))
    bad = v.filter("v IS NULL").select("path", F.lit("json").alias("rule"))
    keys = sorted(["schema_version", *EVIDENCE_TEXT, *EVIDENCE_SIZES])

    def text(k: str):
        return F.try_variant_get("v", f"$.{k}", "string")

    def kind(k: str):
        return F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))

    typed = (kind("schema_version") == "BIGINT") & (text("schema_version") == "1") & (text("report_type") == EVIDENCE_TYPE)
    for k in EVIDENCE_TEXT:
        typed &= kind(k) == "STRING"
    sizes = F.lit(True)
    for k in EVIDENCE_SIZES:
        sizes &= (kind(k) == "BIGINT") & (F.try_variant_get("v", f"$.{k}", "bigint") >= 0)
    rules = {
        "keys": F.array_sort(F.json_object_keys("text")) == F.array(*map(F.lit, keys)), "types": typed, "sizes": sizes, "submitted_digest": F.regexp_like(text("submitted_digest"), F.lit(checks.NAMED_IMAGE)),
        "digests": F.regexp_like(text("selected_manifest_digest"), F.lit(checks.DIGEST)) & F.regexp_like(text("config_digest"), F.lit(checks.DIGEST)), "platform": (text("os") == PLATFORM[0]) & (text("architecture") == PLATFORM[1]),
        "methods": (text("oci_layer_measurement_method") == layer_method) & (text("rootfs_measurement_method") == rootfs_method),
    }
    return bad.unionByName(v.filter("v IS NOT NULL").select("path", F.explode(failed(rules)).alias("rule")))


def unbound(evidence: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule) for images (keys, submitted, local_image_id) whose evidence speaks of another image, or that are too large."""
    joined = images.join(evidence, keys, "left")
    rules = {
        "evidence": F.col("submitted_digest").isNotNull(), "submitted_digest": F.col("submitted_digest") == F.col("submitted"),
        "local_image_id": (F.col("local_image_id") == F.col("selected_manifest_digest")) | (F.col("local_image_id") == F.col("config_digest")),
        "layer_bytes": F.col("oci_compressed_layer_bytes") <= MOST_LAYER_BYTES, "rootfs_bytes": F.col("rootfs_apparent_bytes") <= MOST_ROOTFS_BYTES,
    }
    return joined.select(*keys, F.explode(failed(rules)).alias("rule"))


def blob_problems(descriptors: DataFrame, blobs: DataFrame, most: int) -> DataFrame:
    """(digest, rule) for described blobs (digest, size) that are too large, missing, or differ from (digest, content)."""
    found = blobs.select("digest", F.octet_length("content").alias("n"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
    rules = {"size": (F.col("size") >= 0) & (F.col("size") <= most), "missing": F.col("n").isNotNull(), "content": (F.col("n") == F.col("size")) & (F.col("hash") == F.col("digest"))}
    return descriptors.join(found, "digest", "left").select("digest", F.explode(failed(rules)).alias("rule"))


def selected_manifests(descriptors: DataFrame, keys: list[str], operating_system: str = PLATFORM[0], architecture: str = PLATFORM[1]) -> DataFrame:
    """For each group the number of descriptors of the platform, and the digest if there is exactly one."""
    mine = (F.col("os") == operating_system) & (F.col("architecture") == architecture)
    held = descriptors.groupBy(*keys).agg(F.count_if(mine).alias("n"), F.min(F.when(mine, F.col("digest"))).alias("digest"))
    return held.withColumn("digest", F.when(F.col("n") == 1, F.col("digest")))


def layer_sums(layers: DataFrame, keys: list[str], most: int = MOST_LAYER_BYTES) -> DataFrame:
    """For each image the sum of its layers' sizes, whether all sizes are valid, and whether the sum is within the limit."""
    good = F.bool_and(F.coalesce(F.col("size") >= 0, F.lit(False)))
    return layers.groupBy(*keys).agg(F.sum("size").alias("bytes"), good.alias("valid")).withColumn("within", F.col("valid") & (F.col("bytes") <= most))
