"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolake.operators.skew import HEAVY_LIMIT, skew_join
from octolake.sources.shared import cut, drop

#: Group values that mean "not known".
NO_SUBJECT = ("", "na", "n/a", "unknown")
#: Records of one key are first linked to the least record of their part, and the parts' least records to the key's.
PARTS = 64
#: Splits, and the share of a data set's records from which a group is placed by its size.
SPLITS = ("train", "validation", "test")
LARGE_SHARE = 1 / 10_000
#: Links from which a node may be joined by broadcast.
HEAVY_LINKS = 100_000


def subject_key(c: Column) -> Column:
    """The subject without case and without the white space, underscores and hyphens around and between its words."""
    bare = F.regexp_replace(F.lower(c), r"[\s _-]+", "")
    return F.when(~bare.isin(*NO_SUBJECT), bare)


def star_links(members: DataFrame) -> DataFrame:
    """Links (a < b) that connect all records of each key; ``members`` has the columns ``key`` and ``node``.

    A key with n records gives fewer than n links, never the pairs of its records, and no task holds a whole key.
    """
    known = cut(members.where(F.col("key").isNotNull() & F.col("node").isNotNull()).select("key", "node").distinct(), "members")
    parted = known.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    least = parted.groupBy("key", "part").agg(F.min("node").alias("low"))
    root = least.groupBy("key").agg(F.min("low").alias("root"))
    inner = skew_join(parted, least, ["key", "part"]).select(F.col("low").alias("a"), F.col("node").alias("b"))
    outer = least.join(root, "key").select(F.col("root").alias("a"), F.col("low").alias("b"))
    return inner.unionByName(outer).where("a < b").distinct()


def hash_to_min(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is named by its least node.

    In each round every node tells its neighbours the least node it knows and tells that node its neighbours, until
    each node is linked with its component's least node alone. Clusters are rows, not arrays, so a giant component is
    spread over many tasks; a node with very many neighbours is joined by a bounded broadcast. The rounds grow with
    the logarithm of the longest path. Each round is written to the shared folder.
    """
    now = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    for _ in range(rounds):
        both = now.select(F.col("b").alias("node"), F.col("a").alias("low")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("low")))
        up = F.sum((F.col("low") < F.col("node")).cast("long"))
        low = cut(both.groupBy("node").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("links"), up.alias("up")), "lows")
        # done when a node with a link to a lesser node has no other link: every component is a star around its least node
        if not low.where("up > 0 and links > 1").take(1):
            drop(low)
            break
        # the nodes with the most links, if those are many: all others have less than a HEAVY_LIMIT-th of the rows
        heavy = low.where(F.col("links") >= HEAVY_LINKS).orderBy(F.desc("links")).limit(HEAVY_LIMIT).select("node").collect()
        a = skew_join(now, low.select(F.col("node").alias("a"), F.col("low").alias("ma")), ["a"], heavy=heavy)
        ab = skew_join(a, low.select(F.col("node").alias("b"), F.col("low").alias("mb")), ["b"], heavy=heavy)
        told = ab.select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("x"), F.col("ma").alias("y")),
                    F.struct(F.col("a").alias("x"), F.col("mb").alias("y")),
                    F.struct(F.col("a").alias("x"), F.col("ma").alias("y")),
                    F.struct(F.col("b").alias("x"), F.col("mb").alias("y")),
                )
            ).alias("e")
        )
        then = cut(told.select(F.least("e.x", "e.y").alias("a"), F.greatest("e.x", "e.y").alias("b")).where("a < b").distinct(), "links")
        drop(now)
        drop(low)
        now = then
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def linked_members(records: DataFrame, clusters: DataFrame, configs: DataFrame) -> DataFrame:
    """(key, node): the group values, of the columns that the data set's ``group_column`` names, of each record."""
    wanted = configs.select("dataset_id", F.explode(F.split("group_column", ",")).alias("column")).select("dataset_id", F.trim("column").alias("column")).distinct()
    ids = records.where(F.col("sequence_id").isNotNull() & F.col("dataset_id").isNotNull()).select("sequence_id", "dataset_id", "species_or_subject").distinct()
    subjects = ids.join(wanted.where(F.col("column") == "species_or_subject"), "dataset_id", "left_semi").select(
        F.to_json(F.struct("dataset_id", F.lit("s").alias("kind"), subject_key(F.col("species_or_subject")).alias("v"))).alias("key"),
        F.col("sequence_id").alias("node"),
        subject_key(F.col("species_or_subject")).alias("v"),
    )
    known = clusters.where(F.col("sequence_id").isNotNull() & (F.trim("homology_cluster") != "")).select("sequence_id", "homology_cluster").distinct()
    homologs = (
        ids.join(wanted.where(F.col("column") == "homology_cluster"), "dataset_id", "left_semi")
        .select("sequence_id", "dataset_id")
        .distinct()
        .join(known, "sequence_id")
        .select(F.to_json(F.struct("dataset_id", F.lit("h").alias("kind"), F.col("homology_cluster").alias("v"))).alias("key"), F.col("sequence_id").alias("node"), F.col("homology_cluster").alias("v"))
    )
    return subjects.unionByName(homologs).where(F.col("v").isNotNull()).select("key", "node")


def record_groups(records: DataFrame, clusters: DataFrame, configs: DataFrame) -> DataFrame:
    """(sequence_id, group_id) of every record: records that share a subject or a cluster, directly or through others.

    The group is named by its least sequence_id; a record without links is its own group. Null ids are no records.
    Repeated rows, unknown members of clusters and extra columns change nothing; empty tables give no rows.
    """
    ids = records.where(F.col("sequence_id").isNotNull()).select("sequence_id").distinct()
    components = hash_to_min(star_links(linked_members(records, clusters, configs)))
    return ids.join(components.withColumnRenamed("node", "sequence_id"), "sequence_id", "left").select("sequence_id", F.coalesce("component", "sequence_id").alias("group_id"))


def hash_share(group: Column, salt: Column | str) -> Column:
    """A number in (0, 1) from a hash of a group and a salt."""
    return (F.pmod(F.xxhash64(group, F.lit(salt) if isinstance(salt, str) else salt), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def rendezvous_split(group: Column, shares: list[tuple[str, Column]], salt: str = "") -> Column:
    """The split of the greatest weighted score -share / ln(u), u from a hash of split and group.

    A group's split depends on its name and the shares alone, so growing data or changed shares move few groups.
    """
    scored = []
    for name, share in shares:
        score = F.when(share > 0, -share / F.log(hash_share(group, f"{salt}|{name}"))).otherwise(F.lit(-1.0))
        scored.append(F.struct(score.alias("score"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scored))["name"]


def _place_large(pdf: pd.DataFrame) -> pd.DataFrame:
    """Splits of the large groups of one data set, the largest first, by rendezvous among the splits that have room.

    The weights are the rows that a split still lacks; a group that fits nowhere goes to the split that lacks most.
    """
    pdf = pdf.sort_values(["size", "group_id"], ascending=[False, True])
    left = {s: float(pdf[f"{s}_share"].iloc[0]) * float(pdf["total"].iloc[0]) for s in SPLITS}
    out = []
    for size, *u in zip(pdf["size"], *[pdf[f"u_{s}"] for s in SPLITS]):
        room = {s: -left[s] / np.log(x) for s, x in zip(SPLITS, u) if left[s] >= size}
        best = max(room, key=room.get) if room else max(SPLITS, key=left.get)
        left[best] -= size
        out.append(best)
    return pd.DataFrame({"group_id": pdf["group_id"], "split": out})


def group_splits(records: DataFrame, clusters: DataFrame, configs: DataFrame, salt: str = "") -> DataFrame:
    """(dataset_id, sequence_id, group_id, split): whole groups go to train, validation or test by weighted rendezvous.

    Shares are those of the group's data set: the one with the least name if a group spans several. They are shares of
    records. Groups with at least LARGE_SHARE of a data set's records, of which there are at most 1 / LARGE_SHARE, are
    placed first, the largest before the others, among the splits that still have room for them; all others follow by
    rendezvous with what the splits then lack as weights. So each split comes near its share unless one group is too
    large for that. A data set without a configuration, or with shares that are null or not positive, gives a null
    split. Null ids are left out.
    """
    groups = record_groups(records, clusters, configs)
    rows = cut(records.where(F.col("sequence_id").isNotNull()).select("dataset_id", "sequence_id").distinct().join(groups, "sequence_id"), "grouped")
    # of a group the data set is that of the least name; a group's size are all its rows
    sizes = rows.groupBy("group_id").agg(F.min("dataset_id").alias("_home"), F.count(F.lit(1)).alias("size"))
    given = [F.coalesce(F.col(f"{s}_share"), F.lit(0.0)).alias(f"{s}_share") for s in SPLITS]
    shares = configs.where(F.col("dataset_id").isNotNull()).select(F.col("dataset_id").alias("_home"), *given).dropDuplicates(["_home"])
    all_shares = sum((F.col(f"{s}_share") for s in SPLITS[1:]), F.col(f"{SPLITS[0]}_share"))
    shares = shares.where(all_shares > 0).select("_home", *[(F.col(f"{s}_share") / all_shares).alias(f"{s}_share") for s in SPLITS])
    sizes = cut(sizes, "sizes")
    totals = sizes.groupBy("_home").agg(F.sum("size").alias("total"))
    known = skew_join(sizes, totals.join(shares, "_home"), ["_home"])
    large = known.where(F.col("size") >= F.col("total") * LARGE_SHARE).select("*", *[hash_share(F.col("group_id"), f"{salt}|{s}").alias(f"u_{s}") for s in SPLITS])
    placed = cut(large.groupBy("_home").applyInPandas(_place_large, "group_id string, split string"), "large")  # at most 1 / LARGE_SHARE rows a data set
    taken = placed.join(sizes, "group_id").groupBy("_home").agg(*[F.sum(F.when(F.col("split") == s, F.col("size")).otherwise(0)).alias(f"_{s}") for s in SPLITS])
    lacking = totals.join(shares, "_home").join(taken, "_home", "left")
    rest = [F.greatest(F.lit(0.0), F.col("total") * F.col(f"{s}_share") - F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(f"{s}_left") for s in SPLITS]
    light = skew_join(sizes.join(placed, "group_id", "left_anti"), lacking.select("_home", "total", *rest), ["_home"])
    chosen = rendezvous_split(F.col("group_id"), [(s, F.col(f"{s}_left")) for s in SPLITS], salt)
    split = placed.select("group_id", "split").unionByName(light.select("group_id", chosen.alias("split")))
    return skew_join(rows, split, ["group_id"], "left").select("dataset_id", "sequence_id", "group_id", "split")


def split_report(splits: DataFrame, configs: DataFrame) -> DataFrame:
    """(dataset_id, split, records, share, target_share, largest_group): reached and wanted shares of every split.

    ``largest_group`` is the share of the data set's largest group, which no split can come nearer than. A split without
    records has a row with 0; records without a split have one with a null split.
    """
    per = splits.groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("records"))
    groups = splits.groupBy("dataset_id", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset_id").agg(F.max("n").alias("_largest"), F.sum("n").alias("_all"))
    wanted = configs.dropDuplicates(["dataset_id"]).select("dataset_id", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_share").alias("target_share")) for s in SPLITS])).alias("w")).select("dataset_id", "w.*")
    known = groups.join(wanted, "dataset_id").select("dataset_id", "split", "target_share").unionByName(per.where(F.col("split").isNull()).select("dataset_id", "split", F.lit(None).cast("double").alias("target_share")))
    joined = known.join(per, known["dataset_id"].eqNullSafe(per["dataset_id"]) & known["split"].eqNullSafe(per["split"]), "left").select(known["dataset_id"], known["split"], "target_share", "records")
    sizes = groups.withColumnRenamed("dataset_id", "_d")
    return joined.join(sizes, joined["dataset_id"].eqNullSafe(sizes["_d"])).select(
        "dataset_id", "split", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.col("_all")).alias("share"), "target_share", (F.col("_largest") / F.col("_all")).alias("largest_group")
    )


def split_check(splits: DataFrame, configs: DataFrame, least: float = 0.02) -> DataFrame:
    """(dataset_id, records, groups, broken_groups, far_splits) of the data sets with a configuration.

    Broken are groups in several splits, far are splits farther from their share than ``least`` or half the largest group.
    """
    whole = splits.groupBy("dataset_id", "group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    per = whole.groupBy("dataset_id").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"), F.sum((F.col("k") > 1).cast("long")).alias("broken_groups"))
    off = F.abs(F.col("share") - F.col("target_share")) > F.greatest(F.lit(least), F.col("largest_group") / 2)
    far = split_report(splits, configs).where(F.col("split").isNotNull()).groupBy("dataset_id").agg(F.sum(off.cast("long")).alias("far_splits"))
    return per.join(far, "dataset_id")


def linked_pairs(records: DataFrame, clusters: DataFrame, configs: DataFrame) -> DataFrame:
    """(sequence_id_a, sequence_id_b): the least record of each group with each of its other records."""
    groups = record_groups(records, clusters, configs)
    return groups.where("sequence_id <> group_id").select(F.col("group_id").alias("sequence_id_a"), F.col("sequence_id").alias("sequence_id_b"))
