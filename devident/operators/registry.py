"""Devices, labels and prompts: lookups and upserts.

Upserts return the whole new table; the store writes it as the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from devident.functions.text import created_stamp, strip
from devident.operators.keys import last_key, with_defaults, with_keys
from devident.session import materialize

TRUTH_LABELS = [
    "true_vendor", "true_product", "true_firmware_version", "accepted_cpes_json",
    "rubric_version", "label_status", "notes",
]


def claims(devices: DataFrame, seen: DataFrame) -> DataFrame:
    """`device_code, mac, vendor, seq` of the sighting that makes each device not in the table yet.

    As if sightings came one after the other by `seq`: one with an unknown code makes a device unless a device, old or
    made before, has its mac; then it is refused, and a later sighting of that code may still make one. A NULL mac clashes
    with none. Sightings fold per code and mac first. Then each round grants those that are first both of their code and of
    their mac, and closes the code and the mac; without clashes within the batch one round grants all.
    """
    known = devices.filter(F.col("mac").isNotNull()).select("mac").distinct()
    open_ = (
        seen.filter(F.col("device_code").isNotNull())
        .join(devices.select("device_code"), "device_code", "left_anti")
        .groupBy("device_code", "mac")
        .agg(F.min(F.struct("seq", "vendor")).alias("_first"))
        .select("device_code", "mac", "_first.seq", "_first.vendor")
        .join(known, "mac", "left_anti")
    )
    open_ = materialize(open_.select("device_code", "mac", "vendor", "seq"))
    granted = None
    while True:
        of_code = open_.groupBy("device_code").agg(F.min(F.struct("seq", "mac", "vendor")).alias("_first"))
        first = of_code.select("device_code", "_first.*")
        named = open_.filter(F.col("mac").isNotNull())
        of_mac = named.groupBy("mac").agg(F.min(F.struct("seq", "device_code")).alias("_of_mac"))
        met = first.join(of_mac, "mac", "left")
        met = met.filter(F.col("_of_mac").isNull() | (F.col("_of_mac.device_code") == F.col("device_code")))
        now_ = materialize(met.select(open_.columns))
        granted = now_ if granted is None else granted.unionByName(now_)
        left = open_.join(now_.select("device_code"), "device_code", "left_anti")
        open_ = materialize(left.join(now_.filter(F.col("mac").isNotNull()).select("mac"), "mac", "left_anti").select(open_.columns))
        if not open_.limit(1).count():
            return granted


def refused(devices: DataFrame, seen: DataFrame, granted: DataFrame) -> DataFrame:
    """The sightings of `seen` that neither find nor make their device, as its mac is another one's (see `claims`)."""
    unknown = seen.filter(F.col("device_code").isNotNull()).join(devices.select("device_code"), "device_code", "left_anti")
    made = granted.select("device_code", F.col("seq").alias("_made"))
    late = unknown.join(made, "device_code", "left").filter(F.col("_made").isNull() | (F.col("seq") < F.col("_made")))
    return late.select(seen.columns)


def new_devices(
    devices: DataFrame, seen: DataFrame, now: str | None = None, start: int | None = None, granted: DataFrame | None = None
) -> DataFrame:
    """Keyed rows for device codes not in the table yet, in the order of the sightings that make them.

    `seen` is `device_code, mac, vendor, seq`; `granted` is what `claims` says of it, if that is known already.
    """
    granted = claims(devices, seen) if granted is None else granted
    unknown = granted.select("device_code", "mac", F.col("vendor").alias("manufacturer"), F.col("seq").alias("_seq"))
    keyed = with_keys(unknown, ["_seq", "device_code"], last_key(devices) if start is None else start)
    return with_defaults(keyed, "devices", now)


def upsert_devices(devices: DataFrame, seen: DataFrame, now: str | None = None) -> DataFrame:
    """Get or create by code: known devices stay unchanged, new ones take mac and vendor; no mac is given twice."""
    return devices.unionByName(new_devices(devices, seen, now))


def _entry_mac(entries: DataFrame) -> DataFrame:
    return entries.withColumn("mac", F.coalesce(strip(F.col("mac")), F.lit("")))


def resolve_by_mac(entries: DataFrame, devices: DataFrame) -> DataFrame:
    """Labelled entries with the `device_id` and `device_code` of their exact mac."""
    known = devices.filter(F.col("mac").isNotNull()).select(
        "mac", F.col("id").alias("device_id"), "device_code"
    )
    return _entry_mac(entries).filter(F.col("mac") != "").join(known, "mac")


def truth_rejects(entries: DataFrame, devices: DataFrame) -> DataFrame:
    """Entries that resolve to no device, with the `reason`."""
    named = _entry_mac(entries)
    blank = named.filter(F.col("mac") == "").withColumn("reason", F.lit("missing mac"))
    unknown = named.filter(F.col("mac") != "").join(devices.select("mac"), "mac", "left_anti")
    return blank.unionByName(unknown.withColumn("reason", F.lit("unknown mac")))


def upsert_truth(
    truth: DataFrame, entries: DataFrame, devices: DataFrame, now: str | None = None
) -> DataFrame:
    """Labels by device: an update overwrites every label column and keeps key and creation time.

    `entries` has the feed's columns and `seq` (its order); a later entry for a device wins.
    """
    resolved = resolve_by_mac(entries, devices).withColumnRenamed("accepted_cpes", "accepted_cpes_json")
    latest = resolved.groupBy("device_id").agg(
        F.max_by(F.struct(*TRUTH_LABELS), "seq").alias("_label"), F.min("seq").alias("_seq")
    )
    updated = truth.join(latest.select("device_id", "_label"), "device_id", "left").select(
        *[
            F.when(F.col("_label").isNotNull(), F.col(f"_label.{c}")).otherwise(F.col(c)).alias(c)
            if c in TRUTH_LABELS
            else F.when(F.col("_label").isNotNull(), created_stamp(now)).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in truth.columns
        ]
    )
    added = latest.join(truth.select("device_id").distinct(), "device_id", "left_anti").select(
        "device_id", "_label.*", "_seq"
    )
    keyed = with_keys(added, ["_seq"], last_key(truth))
    return updated.unionByName(with_defaults(keyed, "ground_truth", now))


def upsert_prompts(prompts: DataFrame, feed: DataFrame, now: str | None = None) -> DataFrame:
    """Prompts by name and version: an update changes text and notes only; a new version is a new row.

    `feed` is `name, version, notes, text, seq`; a later row for the same version wins. Where the
    table holds a version twice, its first row is the one updated.
    """
    key = ["prompt_name", "prompt_version"]
    feed = feed.filter(F.col("name").isNotNull() & F.col("text").isNotNull())  # a prompt has both
    latest = feed.groupBy(F.col("name").alias("prompt_name"), F.col("version").alias("prompt_version")).agg(
        F.max_by(F.struct("text", "notes"), "seq").alias("_new"), F.min("seq").alias("_seq")
    )
    firsts = prompts.groupBy(*key).agg(F.min("id").alias("id"))
    changes = firsts.join(latest, key).select("id", "_new")
    updated = prompts.join(changes, "id", "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{source}")).otherwise(F.col(c)).alias(c)
            if (source := {"prompt_text": "text", "notes": "notes"}.get(c))
            else F.col(c)
            for c in prompts.columns
        ]
    )
    added = latest.join(firsts, key, "left_anti").select(
        *key, F.col("_new.text").alias("prompt_text"), F.col("_new.notes").alias("notes"), "_seq"
    )
    return updated.unionByName(with_defaults(with_keys(added, ["_seq"], last_key(prompts)), "prompts", now))


def list_prompts(prompts: DataFrame) -> DataFrame:
    """Key, name, version and notes, by key."""
    return prompts.select("id", "prompt_name", "prompt_version", "notes").orderBy("id")
