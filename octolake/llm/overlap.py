"""Sequences of evaluation splits that also stand, exactly or nearly, in train: partitioned suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolake.functions.sequence import symbols
from octolake.sources.shared import cut

#: Symbols of a suffix that are kept for sorting and for measuring common prefixes.
SUFFIX = 24
#: Blocks that a text may leave out at most because they are hot.
MOST_EXTRA = 3
#: Classes of texts from which hot blocks are estimated, and the rows from which a block counts as hot. Both only move work.
SAMPLE, HOT = 20_000, 1000
MOST_HOT = 1000
#: A hot block that a text can't leave out is met in chunks of so many members of both sides.
CHUNK = 1000
#: Anywhere in a text: letters of the words whose least hash in so many neighbours picks a suffix, and the least common prefix.
WORD, NEAR, LEAST = 16, 17, 24
#: Symbols that are kept of those suffixes.
WIDE = 48
#: Parts into which the held-out side of a hot word is spread.
PARTS_OF_HOT = 64


def split_key(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(bare == "val", F.lit("validation")).otherwise(bare)


def sequence_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def least_span(length: int, threshold: float) -> tuple[int, int]:
    """A span s and a number x: two texts of identity ``threshold``, the longer of ``length`` symbols, share more than x blocks.

    Blocks are the spans of s symbols that start at multiples of s. Texts with at most m unequal places have x + 1 equal
    blocks among any m + 1 + x. s is chosen for x = 1 if that costs one symbol at most, and from 16 on in steps of an
    eighth, so that texts of similar length share their s; x is what the blocks then allow.
    """
    unequal = max(0, int(np.floor((1.0 - threshold) * length + 1e-9)))
    widest = max(1, length // (unequal + 1))
    span = length // (unequal + 2)
    span = span if span >= max(1, widest - 1) else widest
    if span >= 16:
        span -= span % max(1, 1 << (span.bit_length() - 4))
    return span, min(MOST_EXTRA, length // span - unequal - 1)


def grids_of(length: int, threshold: float) -> list[tuple[int, int]]:
    """Spans under which a text must be listed: its own as the longer of a pair, and those of possible longer ones.

    With each comes the number of blocks that it may leave out, whatever the length of the other text.
    """
    most = int(np.floor(length / threshold + 1e-9)) if threshold > 0 else length
    found: dict[int, int] = {}
    for n in range(length, most + 1):
        span, extra = least_span(n, threshold)
        found[span] = min(extra, found.get(span, extra))
    return sorted(found.items())


def split_members(sequences: DataFrame, splits: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership and texts of the records that stand on a side of a split.

    (dataset_id, class_id, sequence_id, train, held), and (dataset_id, class_id, text, threshold, train, held) with every
    different text of a data set once. Texts are shuffled once, by their class.
    """
    texts = sequences.where(F.col("sequence_id").isNotNull()).select("sequence_id", sequence_key(F.col("sequence")).alias("text")).where(F.length("text") > 0)
    texts = texts.withColumn("class_id", F.xxhash64("text", F.length("text"), F.md5("text")))
    side = split_key(F.col("split"))
    sides = (
        splits.where(F.col("sequence_id").isNotNull())
        .select("sequence_id", "dataset_id", side.alias("split"))
        .where(F.col("split").isin("train", "validation", "test"))
        .groupBy("dataset_id", "sequence_id")
        .agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") != "train").alias("held"))
    )
    limits = configs.where(F.col("sequence_similarity_threshold").isNotNull()).groupBy("dataset_id").agg(F.max("sequence_similarity_threshold").alias("threshold"))
    limits = F.broadcast(limits) if limits.count() <= 10_000 else limits
    ids = texts.select("sequence_id", "class_id").distinct()
    members = cut(sides.join(limits, "dataset_id").join(ids, "sequence_id").select("dataset_id", "threshold", "class_id", "sequence_id", "train", "held"), "members")
    of_class = members.groupBy("dataset_id", "class_id").agg(F.max("threshold").alias("threshold"), F.bool_or("train").alias("train"), F.bool_or("held").alias("held"))
    once = texts.groupBy("class_id").agg(F.first("text").alias("text"))
    own = F.xxhash64("dataset_id", "class_id").alias("class_id")  # a text of two data sets is two classes
    classes = cut(once.join(of_class, "class_id").select("dataset_id", own, "text", "threshold", "train", "held"), "classes")
    return members.select("dataset_id", own, "sequence_id", "train", "held"), classes


def _letters(flat: np.ndarray) -> np.ndarray:
    """Symbols as bytes from 1 on: those beyond ASCII share 128 values, which can only make more candidates."""
    return np.where(flat < 128, np.maximum(flat, 1), 128 + flat % 128).astype(np.uint8)


def _heads(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = SUFFIX) -> np.ndarray:
    """The first ``width`` letters of suffixes in rows, 0 behind the end of their text."""
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    return np.where(inside, letters[np.where(inside, at, 0)], np.uint8(0))


def _hashes(letters: np.ndarray, starts: np.ndarray, width: int, seed: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of the ``width`` letters from each start, in bounded pieces."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(width, 0x9E3779B97F4A7C15, np.uint64))
        for lo in range(0, len(starts), max(1, 4_000_000 // width)):
            hi = lo + max(1, 4_000_000 // width)
            some = letters[starts[lo:hi, None] + np.arange(width)].astype(np.uint64)
            out[lo:hi] = (some * power).sum(1, dtype=np.uint64)
        out ^= np.asarray(seed, np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        return out ^ (out >> np.uint64(31))


ROWS = pa.schema([("block", pa.int64()), ("train_chunk", pa.int32()), ("held_chunk", pa.int32()), ("suffix", pa.binary()), ("class_id", pa.int64()), ("train", pa.bool_()), ("pos", pa.int32()), ("span", pa.int32())])
ROWS_DDL = "block long, train_chunk int, held_chunk int, suffix binary, class_id long, train boolean, pos int, span int"


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _placed(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per batch of classes and kind of grid: owner, pos, span, extra, block hash and suffix of the blocks of its texts."""
    flat, edges = symbols(batch.column("text"))
    letters = _letters(flat)
    sizes = np.diff(edges)
    data = np.array([hash_text(d) for d in batch.column("dataset_id").to_pylist()], np.uint64)
    limits = batch.column("threshold").to_numpy(zero_copy_only=False)
    owners: dict[tuple[int, int], list[int]] = {}
    for i, (n, t) in enumerate(zip(sizes.tolist(), limits.tolist())):
        for grid in _known_grids(n, t):
            owners.setdefault(grid, []).append(i)
    for (span, extra), who in sorted(owners.items()):
        who = np.array(who)
        count = sizes[who] // span
        owner = np.repeat(who, count)
        pos = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * span
        start = edges[owner] + pos
        with np.errstate(over="ignore"):
            seed = data[owner] ^ (pos.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(span)
        yield owner, pos, span, extra, _hashes(letters, start, span, seed).view(np.int64), lambda use, s=start, o=owner: _heads(letters, s[use], edges[o[use] + 1])


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text or "")


_GRIDS: dict[tuple[int, float], list[tuple[int, int]]] = {}


def _known_grids(length: int, threshold: float) -> list[tuple[int, int]]:
    if (length, threshold) not in _GRIDS:
        if len(_GRIDS) > 100_000:
            _GRIDS.clear()
        _GRIDS[length, threshold] = grids_of(length, threshold)
    return _GRIDS[length, threshold]


def _suffixes(hot: list[tuple[int, int, int]]):
    """Rows of the suffix array: suffixes at the blocks' starts, for both sides, less the hot blocks that a text can spare."""
    hot = sorted(hot)
    hot_block = np.array([h[0] for h in hot], np.int64)
    hot_train, hot_held = (np.array([h[i] for h in hot], np.int64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                classes = batch.column("class_id").to_numpy()
                sides = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("train", "held")]
                for owner, pos, span, extra, block, heads in _placed(batch):
                    use = np.ones(len(block), bool)
                    at = np.searchsorted(hot_block, block)
                    at[at == len(hot)] = 0
                    is_hot = np.flatnonzero(hot_block[at] == block) if len(hot) else np.zeros(0, np.int64)
                    if extra and len(is_hot):
                        # the hottest of a text's blocks first, in an order that is the same for all texts
                        rows = is_hot[np.lexsort((block[is_hot], -(hot_train + hot_held)[at[is_hot]], owner[is_hot]))]
                        first = np.flatnonzero(np.diff(owner[rows], prepend=-1))
                        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
                        use[rows[rank < extra]] = False
                    for train in (True, False):
                        mine = np.flatnonzero(use & sides[0 if train else 1][owner])
                        t_parts = h_parts = np.ones(len(mine), np.int64)
                        if len(hot):
                            h = hot_block[at[mine]] == block[mine]
                            t_parts = np.where(h, -(-hot_train[at[mine]] // CHUNK), 1)
                            h_parts = np.where(h, -(-hot_held[at[mine]] // CHUNK), 1)
                        t_parts, h_parts = np.maximum(t_parts, 1), np.maximum(h_parts, 1)
                        own, other = (t_parts, h_parts) if train else (h_parts, t_parts)
                        my_chunk = classes[owner[mine]] % own
                        again = np.repeat(np.arange(len(mine)), other)
                        their_chunk = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                        rows = mine[again]
                        chunks = (my_chunk[again], their_chunk) if train else (their_chunk, my_chunk[again])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(block[rows]), pa.array(chunks[0].astype(np.int32)), pa.array(chunks[1].astype(np.int32)), _binary(heads(rows)), pa.array(classes[owner[rows]]), pa.array(np.full(len(rows), train)), pa.array(pos[rows].astype(np.int32)), pa.array(np.full(len(rows), span, np.int32))],
                            schema=ROWS,
                        )

    return run


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("train", "held")]
        for owner, _, _, _, block, _ in _placed(batch):
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(sides[0][owner]), pa.array(sides[1][owner])], names=["block", "t", "h"])


def hot_blocks(classes: DataFrame) -> list[tuple[int, int, int]]:
    """(block, train rows, held rows) as estimated from a bounded sample of blocks that surely have more than HOT rows; MOST_HOT at most."""
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = classes.where(F.pmod(F.xxhash64("class_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.mapInArrow(_block_counts, "block long, t long, h long").groupBy("block").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    top = counts.where((F.col("t") + F.col("h") >= 5) & (F.col("t") + F.col("h") >= HOT * share)).orderBy(F.desc(F.col("t") + F.col("h")), "block").limit(MOST_HOT).collect()
    return [(r["block"], int(r["t"] / share), int(r["h"] / share)) for r in top]


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that rows of two arrays of suffixes share from their start on; ends of texts are no letters."""
    same = (a == b) & (a > 0)
    return np.where(same.all(1), a.shape[1], (~same).argmax(1))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "suffix"}
    column = batch.column("suffix").cast(pa.binary())
    data = np.frombuffer(column.buffers()[2], np.uint8)
    first, second = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + 2]
    out["suffix"] = data[first : first + batch.num_rows * (second - first)].reshape(batch.num_rows, -1)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by the keys, cut where the keys change, some ten thousand rows at a time."""
    wait: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        wait = rows if wait is None else {c: np.concatenate([wait[c], rows[c]]) for c in rows}
        differs = np.any([wait[k][:-1] != wait[k][-1] for k in keys], axis=0)
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if last:
            yield {c: v[:last] for c, v in wait.items()}
            wait = {c: v[last:] for c, v in wait.items()}
    if wait is not None:
        yield wait


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of both sides in every run of adjacent suffixes whose common prefixes reach the span, and the pairs' own prefix."""
    keys = ["block", "train_chunk", "held_chunk"]
    for rows in _grouped(batches, keys):
        least = np.minimum(rows["span"], SUFFIX)
        apart = np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0) | (common_prefix(rows["suffix"][1:], rows["suffix"][:-1]) < least[1:])
        run = np.concatenate([[0], np.cumsum(apart)])
        train, held = np.flatnonzero(rows["train"]), np.flatnonzero(~rows["train"])
        first = np.searchsorted(run[train], run[held], "left")
        many = np.searchsorted(run[train], run[held], "right") - first
        ends = np.cumsum(many)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, 100_000):
            k = np.arange(lo, min(lo + 100_000, int(ends[-1])))
            h = np.searchsorted(ends, k, "right")
            t = train[first[h] + k - (ends[h] - many[h])]
            h = held[h]
            other = rows["class_id"][t] != rows["class_id"][h]
            t, h = t[other], h[other]
            length = common_prefix(rows["suffix"][t], rows["suffix"][h])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["class_id"][t]), pa.array(rows["class_id"][h]), pa.array(rows["pos"][h]), pa.array(np.maximum(length, rows["span"][h]).astype(np.int32))],
                names=["train_class", "held_class", "pos", "length"],
            )


def merged(spans: Column) -> Column:
    """Symbols in the union of spans, an array of (pos, length) in any order."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["pos"] + x["length"]).alias("end"),
        (s["sum"] + F.greatest(F.lit(0), x["pos"] + x["length"] - F.greatest(s["end"], x["pos"]))).alias("sum"),
    )
    return F.aggregate(F.array_sort(spans), state, step, lambda s: s["sum"])


def shared_spans(classes: DataFrame) -> DataFrame:
    """(train_class, held_class, covered): pairs of different texts of the two sides and the symbols of their shared spans.

    A suffix array over the places of positional identity: suffixes at the places where :func:`grids_of` must find a
    shared block are brought together by place and first block, and sorted; runs of neighbours whose common prefixes
    reach the span hold the pairs. Spans of a pair are merged. A block that very many texts share is left out by a text
    as long as another block must find its pairs as well; where it can't, both sides meet in chunks over many tasks.
    """
    rows = classes.select("dataset_id", "class_id", "text", "threshold", "train", "held").mapInArrow(_suffixes(hot_blocks(classes)), ROWS_DDL)
    order = ["block", "train_chunk", "held_chunk"]
    array = rows.repartition(*order).sortWithinPartitions(*order, "suffix", "class_id")
    spans = array.mapInArrow(_pairs, "train_class long, held_class long, pos int, length int")
    return spans.groupBy("train_class", "held_class").agg(merged(F.collect_set(F.struct("pos", "length"))).cast("long").alias("covered"))


def sampled(letters: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of suffixes by content: of any NEAR successive words of WORD letters in a text, the one of the least hash."""
    n = len(letters) - WORD + 1
    if n < 1:
        return np.zeros(0, np.int64)
    hashes = np.full(n + NEAR - 1, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        for i in range(WORD):
            value = value * np.uint64(0x100000001B3) + letters[i : i + n]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes[:n] = value ^ (value >> np.uint64(32))
    owner = np.searchsorted(edges, np.arange(n), "right") - 1
    inside = np.arange(n) + WORD <= edges[owner + 1]
    hashes[:n][~inside] = np.iinfo(np.uint64).max
    least = np.arange(n)
    picked = [least[:0]]
    for lo in range(0, n, 200_000):
        hi = min(n, lo + 200_000)
        near = np.lib.stride_tricks.sliding_window_view(hashes[lo : hi + NEAR - 1], NEAR).argmin(1) + np.arange(lo, hi)
        picked.append(near[inside[lo:hi]])
    starts = np.unique(np.concatenate(picked))
    return starts[inside[starts]]


def _content_suffixes(hot: list[int]):
    """Rows of the suffix array over all places. Held-out suffixes of a hot word are spread by class over PARTS_OF_HOT parts."""
    known = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, bytes], set] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                flat, edges = symbols(batch.column("text"))
                letters = _letters(flat)
                starts = sampled(letters, edges)
                owner = np.searchsorted(edges, starts, "right") - 1
                data = np.array([hash_text(d) for d in batch.column("dataset_id").to_pylist()], np.uint64)
                block = _hashes(letters, starts, WORD, data[owner]).view(np.int64)
                heads = _heads(letters, starts, edges[owner + 1], WIDE)
                classes = batch.column("class_id").to_numpy()
                is_hot = np.isin(block, known)
                for train in (True, False):
                    side = batch.column("train" if train else "held").to_numpy(zero_copy_only=False).astype(bool)[owner]
                    rows = np.flatnonzero(side)
                    if len(known) and train:
                        few = []
                        for i in np.flatnonzero(side & is_hot).tolist():
                            # of equal suffixes two train texts a split are enough; they meet every part of the other side
                            seen = sent.setdefault((int(block[i]), heads[i].tobytes()), set())
                            if len(seen) < 2 and classes[owner[i]] not in seen:
                                seen.add(classes[owner[i]])
                                few.append(i)
                        rows = np.concatenate([rows[~is_hot[rows]], np.repeat(np.array(few, np.int64), PARTS_OF_HOT)])
                        if len(sent) > 200_000:
                            sent.clear()
                    my_salt = np.zeros(len(rows), np.int32)
                    hot_rows = np.flatnonzero(is_hot[rows])
                    if len(hot_rows):
                        my_salt[hot_rows] = np.arange(len(hot_rows)) % PARTS_OF_HOT if train else classes[owner[rows[hot_rows]]] % PARTS_OF_HOT
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[rows]), pa.array(my_salt), pa.array(np.zeros(len(rows), np.int32)), _binary(heads[rows]), pa.array(classes[owner[rows]]), pa.array(np.full(len(rows), train)), pa.array((starts - edges[owner])[rows].astype(np.int32)), pa.array(np.full(len(rows), LEAST, np.int32))],
                        schema=ROWS,
                    )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every held-out suffix the longer of its common prefixes with the train suffixes next before and after it."""
    for rows in _grouped(batches, ["block", "train_chunk"]):
        n = len(rows["block"])
        index = np.arange(n)
        train = rows["train"]
        best, mate = np.zeros(n, np.int64), np.full(n, -1)
        held = np.flatnonzero(~train)
        # the text itself may stand on both sides, so two train suffixes of other texts are looked at each way
        places = np.flatnonzero(train)
        at = np.searchsorted(places, held)
        for step in (-2, -1, 0, 1):
            k = at + step
            ok = (k >= 0) & (k < len(places))
            h, t = held[ok], places[k[ok]]
            ok = (rows["class_id"][h] != rows["class_id"][t]) & (rows["block"][h] == rows["block"][t]) & (rows["train_chunk"][h] == rows["train_chunk"][t])
            h, t = h[ok], t[ok]
            length = common_prefix(rows["suffix"][h], rows["suffix"][t])
            more = length > best[h]
            best[h[more]], mate[h[more]] = length[more], t[more]
        found = index[best >= LEAST]
        yield pa.RecordBatch.from_arrays([pa.array(rows["class_id"][found]), pa.array(rows["pos"][found]), pa.array(best[found].astype(np.int32)), pa.array(rows["class_id"][mate[found]])], names=["class_id", "pos", "length", "train_class"])


def shared_anywhere(classes: DataFrame) -> DataFrame:
    """(class_id, covered, spans, train_class): held-out texts that share spans with train texts, wherever they stand.

    Suffixes are picked by content, so two texts that share LEAST + NEAR - 1 symbols have picked a suffix in common that
    goes on for LEAST symbols. Sorted, the longest common prefix of a held-out suffix with the other side is that with
    the next train suffix before or after it, so no pairs are listed. Spans of a text are merged to the symbols
    ``covered``; the first NEAR - 1 symbols of a span may be missing. ``train_class`` is one of the texts met. A text
    of train and of the held-out side is not compared with itself.
    """
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = classes.where(F.pmod(F.xxhash64("class_id", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.mapInArrow(_content_suffixes([]), ROWS_DDL).groupBy("block").count()
    hot = [r["block"] for r in counts.where((F.col("count") >= 5) & (F.col("count") >= 20 * HOT * share)).orderBy(F.desc("count"), "block").limit(MOST_HOT).collect()]
    rows = classes.mapInArrow(_content_suffixes(hot), ROWS_DDL)
    array = rows.repartition("block", "train_chunk").sortWithinPartitions("block", "train_chunk", "suffix", "class_id")
    spans = array.mapInArrow(_neighbours, "class_id long, pos int, length int, train_class long")
    per = spans.groupBy("class_id").agg(merged(F.collect_set(F.struct("pos", "length"))).cast("long").alias("covered"), F.count_distinct("pos").alias("spans"), F.min("train_class").alias("train_class"))
    return per


def _identity(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        share = np.empty(len(pdf))
        for i, (a, b) in enumerate(zip(pdf["train_text"], pdf["held_text"])):
            x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
            n = min(len(x), len(y))
            share[i] = np.count_nonzero(x[:n] == y[:n]) / max(len(x), len(y))
        yield pdf.assign(identity=share)[["dataset_id", "train_class", "held_class", "covered", "threshold", "identity"]]


def split_overlaps(sequences: DataFrame, splits: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different texts, the membership of records in texts, and the texts.

    The links are (dataset_id, train_class, held_class, covered, identity) with identity at the data set's threshold or
    more; a text that stands on both sides itself is linked with itself at identity 1. The membership is (dataset_id,
    class_id, sequence_id, train, held). Null, blank or unknown splits, null sequences and data sets without a threshold
    take no part; empty sequences have no identity. Copies of a text are one class and never multiply the search.
    """
    members, classes = split_members(sequences, splits, configs)
    found = shared_spans(classes)
    text = classes.select("class_id", "text")
    with_train = found.join(classes.select("dataset_id", F.col("class_id").alias("train_class"), F.col("text").alias("train_text"), "threshold"), "train_class")
    with_both = with_train.join(text.withColumnsRenamed({"class_id": "held_class", "text": "held_text"}), "held_class")
    near = with_both.mapInPandas(_identity, "dataset_id string, train_class long, held_class long, covered long, threshold double, identity double").where(F.col("identity") >= F.col("threshold"))
    same = classes.where("train and held").select("dataset_id", F.col("class_id").alias("train_class"), F.col("class_id").alias("held_class"), F.length("text").cast("long").alias("covered"), "threshold", F.lit(1.0).alias("identity"))
    return near.unionByName(same).drop("threshold"), members, classes


def overlap_pairs(sequences: DataFrame, splits: DataFrame, configs: DataFrame) -> DataFrame:
    """(sequence_id_a, sequence_id_b), a < b: records of one data set on both sides whose texts are linked."""
    links, members, _ = split_overlaps(sequences, splits, configs)
    train = members.where("train").select("dataset_id", F.col("class_id").alias("train_class"), F.col("sequence_id").alias("_t"))
    held = members.where("held").select("dataset_id", F.col("class_id").alias("held_class"), F.col("sequence_id").alias("_h"))
    pairs = links.join(train, ["dataset_id", "train_class"]).join(held, ["dataset_id", "held_class"]).where("_t <> _h")
    return pairs.select(F.least("_t", "_h").alias("sequence_id_a"), F.greatest("_t", "_h").alias("sequence_id_b")).distinct()


def overlap_report(sequences: DataFrame, splits: DataFrame, configs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per data set, split and subject: held-out records, and those that train holds exactly, nearly or in part.

    ``overlapping`` records have a copy in train by positional identity, ``sharing`` ones hold a span of train wherever
    it stands (see :func:`shared_anywhere`) or are overlapping; ``highest_covered`` is the greatest share of a record's
    symbols in such spans. A record without a subject counts under null; one with several subjects counts under each.
    """
    links, members, classes = split_overlaps(sequences, splits, configs)
    best = links.groupBy(F.col("held_class").alias("class_id")).agg(F.max("identity").alias("identity"))
    length = classes.where("held").select("class_id", F.length("text").alias("_length"))
    spans = shared_anywhere(classes).join(length, "class_id").select("class_id", (F.col("covered") / F.col("_length")).alias("share"))
    trained = members.where("train").groupBy("class_id").agg(F.count_distinct("sequence_id").alias("_in_train"), F.first("sequence_id").alias("_one"))
    held = members.where("held").join(best, "class_id", "left").join(spans, "class_id", "left").join(trained, "class_id", "left")
    # a record that stands on both sides itself is no copy of another record
    own = (F.col("_in_train") == 1) & (F.col("_one") == F.col("sequence_id"))
    held = held.withColumn("hit", F.col("identity").isNotNull() & ~F.coalesce(own & (F.col("identity") == 1.0), F.lit(False)))
    per = held.groupBy("dataset_id", "sequence_id").agg(
        F.max("hit").alias("hit"), F.max(F.when(F.col("hit"), F.col("identity"))).alias("identity"), F.max(F.when(F.col("hit") & (F.col("identity") == 1.0), 1.0).otherwise(F.coalesce("share", F.lit(0.0)))).alias("share")
    )
    side = splits.select("dataset_id", "sequence_id", split_key(F.col("split")).alias("split")).where(F.col("split").isin("validation", "test")).distinct()
    who = subjects.select("sequence_id", "species_or_subject").distinct()
    return (
        per.join(side, ["dataset_id", "sequence_id"])
        .join(who, "sequence_id", "left")
        .groupBy("dataset_id", "split", F.col("species_or_subject").alias("subject"))
        .agg(
            F.count_distinct("sequence_id").alias("records"),
            F.count_distinct(F.when(F.col("hit"), F.col("sequence_id"))).alias("overlapping"),
            F.count_distinct(F.when(F.col("hit") | (F.col("share") > 0), F.col("sequence_id"))).alias("sharing"),
            F.max("identity").alias("highest_identity"),
            F.max("share").alias("highest_covered"),
        )
    )
