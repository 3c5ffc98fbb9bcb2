"""Texts in containers of fixed capacities: hierarchical multi-length packing over a histogram of lengths."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.sources.shared import cut

#: Ranks of a public byte-level BPE, and how it cuts texts into pieces. Fixed value: that vocabulary's own pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one length that a task ranks together, on average.
RANK_ROWS = 50_000
#: Longest capacity: it bounds the histogram that the plan is made from.
MOST_TOKENS = 1 << 20
#: Kinds of containers; more are an error.
MOST_KINDS = 1000
#: Tokens of a training step, as a multiple of the longest capacity.
STEP_CONTAINERS = 64
#: Unused share from which a window's items are packed again into the longest windows.
SPARSE = 0.02

_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document, by a public tokenizer's file; null texts have 0 tokens."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.fromiter((len(encode(t)) if isinstance(t, str) else 0 for t in pdf["text"]), np.int64, len(pdf))})

    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def _patterns(histogram: dict[int, int], tiers: list[int]) -> list[tuple[int, int, tuple]]:
    """(capacity, containers, ((size, items of it in a container), ...)) by best fit of decreasing sizes.

    All items of a size are placed at once: into the open containers with the smallest gap that holds them, whatever
    their tier, else into new containers of the least capacity that holds them.
    """
    gaps: list[int] = []  # gaps of open groups, sorted
    groups: dict[int, list[tuple[int, int, tuple]]] = {}
    closed = []

    def keep(gap: int, capacity: int, n: int, pattern: tuple) -> None:
        if n and gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((capacity, n, pattern))
        elif n:
            closed.append((capacity, n, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                capacity, n, pattern = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
            else:
                gap = capacity = tiers[bisect_left(tiers, size)]
                n, pattern = max(1, left // (capacity // size)), ()
            per = min(gap // size, left)
            full = min(n, left // per)  # containers that take per items each
            keep(gap - per * size, capacity, full, (*pattern, (size, per)))
            if pattern:
                keep(gap, capacity, n - full, pattern)
            left -= full * per
    return closed + [g for some in groups.values() for g in some]


def plan_containers(histogram: dict[int, int], capacities: list[int]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Segments (size, first_rank, n, container, per_container, offset) and containers (tier, first, n) of a packing.

    Decreasing sizes open long windows first, whose gaps shorter items fill before shorter windows open. Items of
    shorter windows that stay emptier than SPARSE are then packed again into the longest windows, where many short
    items leave little space. Work and result grow with the number of different sizes, not of items.
    """
    tiers = sorted(set(capacities))
    used = lambda p: sum(s * k for s, k in p)
    patterns = _patterns(histogram, tiers)
    dense = [x for x in patterns if x[0] == tiers[-1] or used(x[2]) >= (1 - SPARSE) * x[0]]
    again: dict[int, int] = {}
    for capacity, n, pattern in patterns:
        if capacity != tiers[-1] and used(pattern) < (1 - SPARSE) * capacity:
            for size, per in pattern:
                again[size] = again.get(size, 0) + n * per
    segments, opened, rank, following = [], [], dict.fromkeys(histogram, 0), 0
    for capacity, n, pattern in dense + _patterns(again, tiers[-1:]):
        opened.append((capacity, following, n))
        offset = 0
        for size, per in pattern:
            segments.append((size, rank[size], n * per, following, per, offset))
            rank[size] += n * per
            offset += size * per
        following += n
    return (
        pd.DataFrame(segments, columns=["size", "first_rank", "n", "container", "per_container", "offset"]).astype(np.int64),
        pd.DataFrame(opened, columns=["tier", "first", "n"]).astype(np.int64),
    )


def _pieces(counts: DataFrame, most: int) -> DataFrame:
    """Texts as items of at most ``most`` tokens; only longer texts are cut, into whole containers and a rest."""
    whole = F.floor(F.col("n_tokens") / most)
    n = F.greatest(whole + (F.col("n_tokens") % most > 0).cast("long"), F.lit(1))
    cutted = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("piece"))
    return cutted.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("first_token"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece").cast("long") * most).cast("long").alias("size"))


def pack(counts: DataFrame, capacities: dict[str, int], step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, pack_kind, container_id, start, step_group) of every document.

    Every text goes to one container whose kind is at least as long as the text (longer texts: see :func:`_pieces`);
    ``start`` is its first place there. A text may stand in a longer window than it needs, where that saves space.
    Containers of each kind are dealt out to step groups in turn, so every group
    has the same number of each kind to within one. Texts without tokens take no space: their container is null. Empty
    tables give no rows.

    The histogram (at most as many rows as the longest capacity) is planned on the driver; items are ranked within
    their size over hash parts, so no task holds all items of a size, and find their place by rank.
    """
    if not capacities or min(capacities.values()) < 1 or max(capacities.values()) > MOST_TOKENS:
        raise ValueError(f"capacities must be between 1 and {MOST_TOKENS}")
    kinds: dict[int, list[str]] = {}
    for name, c in sorted(capacities.items()):
        kinds.setdefault(c, []).append(name)
    most = max(kinds)
    items = _pieces(counts, most)
    histogram = {int(r["size"]): int(r["count"]) for r in items.groupBy("size").count().collect()}  # at most `most` rows
    segments, opened = plan_containers(histogram, list(kinds))
    parts = 1 + sum(histogram.values()) // RANK_ROWS
    parted = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    ahead = parted.groupBy("size", "part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("size", "part", (F.sum("_n").over(W.partitionBy("size").orderBy("part")) - F.col("_n")).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("size", "part").orderBy("doc_id", "piece")) - 1
    ranked = parted.withColumn("_own", own).join(ahead, ["size", "part"]).withColumn("rank", F.col("_own") + F.col("_ahead"))

    capacity_total = int((opened["tier"] * opened["n"]).sum())
    shared = {c: len(names) for c, names in kinds.items()}
    steps = max(1, -(-capacity_total // (most * step_containers)))
    opened = opened.sort_values("first").reset_index(drop=True)
    opened["before"] = opened.groupby("tier")["n"].cumsum() - opened["n"]  # containers of the tier before these
    segments = segments.sort_values(["size", "first_rank"]).reset_index(drop=True)
    key = segments["size"].to_numpy() * (1 << 40) + segments["first_rank"].to_numpy()  # size < 2^20, so ranks have 40 bits

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            at = np.searchsorted(key, size * (1 << 40) + rank, side="right") - 1
            seg = segments.iloc[at]
            within = rank - seg["first_rank"].to_numpy()
            per = seg["per_container"].to_numpy()
            container = seg["container"].to_numpy() + within // per
            home = opened.iloc[np.searchsorted(opened["first"].to_numpy(), container, side="right") - 1]
            number = home["before"].to_numpy() + container - home["first"].to_numpy()
            same = home["tier"].map(shared).to_numpy()  # kinds of one capacity take its containers in turn
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_token": pdf["first_token"], "n_tokens": size,
                    "pack_kind": [kinds[t][i] for t, i in zip(home["tier"], number % same)], "container_id": container, "start": seg["offset"].to_numpy() + (within % per) * size, "step_group": number // same % steps,
                }
            )

    schema = "doc_id long, piece int, first_token long, n_tokens long, pack_kind string, container_id long, start long, step_group long"
    placed = ranked.select("doc_id", "piece", "first_token", "size", "rank").mapInPandas(place, schema)
    none = counts.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("pack_kind", "string"), ("container_id", "long"), ("start", "long"), ("step_group", "long"))])
    return placed.unionByName(none)


def capacities_of(table: DataFrame) -> dict[str, int]:
    """The kinds and their capacities; a kind that is listed twice has the greater one. More than MOST_KINDS are an error."""
    rows = table.where(F.col("pack_kind").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("pack_kind").agg(F.max("capacity_tokens").alias("c")).limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    return {r["pack_kind"]: int(r["c"]) for r in rows}


def pack_tiers(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text once, over all capacities as tiers; see :func:`pack`."""
    return pack(cut(token_counts(documents, vocabulary), "tokens"), capacities_of(capacities))


def pack_each(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text once for each capacity by itself; see :func:`pack`."""
    counts = cut(token_counts(documents, vocabulary), "tokens")
    return reduce(DataFrame.unionByName, [pack(counts, {kind: c}).withColumn("pack_kind", F.lit(kind)) for kind, c in sorted(capacities_of(capacities).items())])


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_kind, containers, tokens, capacity, fill): how much of the containers' space is used, per kind."""
    per = placed.where(F.col("container_id").isNotNull()).groupBy("pack_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    size = capacities.groupBy("pack_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    return per.join(size, "pack_kind").select("pack_kind", "containers", "tokens", (F.col("containers") * F.col("capacity_tokens")).alias("capacity"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def pack_check(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(documents, overfull_containers, overlapping_items, wrongly_split) of a packing: all but the first must be 0.

    Items overlap if one starts before the one before it in its container has ended; a document is wrongly split if it
    has several items though its tokens fit the greatest capacity, or if its items don't add up.
    """
    size = capacities.groupBy("pack_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    inside = placed.where(F.col("container_id").isNotNull())
    w = W.partitionBy("pack_kind", "container_id").orderBy("start")  # a container's items: capacity tokens at most
    overlapping = inside.withColumn("_end", F.lag(F.col("start") + F.col("n_tokens")).over(w)).agg(F.coalesce(F.sum((F.col("start") < F.col("_end")).cast("long")), F.lit(0)).alias("overlapping_items"))
    used = inside.groupBy("pack_kind", "container_id").agg(F.max(F.col("start") + F.col("n_tokens")).alias("used")).join(F.broadcast(size), "pack_kind")  # MOST_KINDS rows
    overfull = used.agg(F.coalesce(F.sum((F.col("used") > F.col("capacity_tokens")).cast("long")), F.lit(0)).alias("overfull_containers"))
    most = size.agg(F.max("capacity_tokens").alias("most"))
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    split = docs.crossJoin(F.broadcast(most)).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum((((F.col("items") > 1) & (F.col("tokens") <= F.col("most"))) | (F.col("tokens") != F.col("end"))).cast("long")), F.lit(0)).alias("wrongly_split"))
    return split.crossJoin(overfull).crossJoin(overlapping).select("documents", "overfull_containers", "overlapping_items", "wrongly_split")  # one row each
