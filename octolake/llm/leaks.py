"""Passages of evaluation items in a corpus: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, combinations
from uuid import uuid4

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolake.llm.words import words

#: Words of a part of an item that leaks by itself; items of fewer words are listed as one window of their own size.
PART = 12
#: Item-sized windows up to so many bits apart are candidates. A pair within RADIUS bits differs by at most
#: RADIUS // BLOCKS bits in one of the blocks, and items are listed under all such values of each block.
RADIUS, BLOCKS = 11, 4
#: Words of a shingle, and the share of an item's words, weighted, that must stand in shingles of the document.
SHINGLE, SIMILARITY = 5, 0.8
#: Windows of items up to this size have the item's own size; longer ones keep this many steps to the next power of two.
OWN_SIZE, SIZE_STEPS = 64, 16
#: Characters of passages in one broadcast and index. The corpus is read once, however many of them there are.
BLOCK_CHARS = 8_000_000
#: Words of documents that are searched at once in a task, and indexes that a worker keeps.
CHUNK_WORDS, MOST_KEPT = 300_000, 4

OUT = "doc_id long, passage_id long, words_run int, similarity double"


class _Words(dict):
    """Words as 64-bit hashes whose two lowest bits hold the weight less 1: longer words say more."""

    def __missing__(self, word: str) -> int:
        h = self[word] = (xxhash.xxh3_64_intdigest(word) & ~3) | min(3, len(word) // 4)
        return h

    def coded(self, text: str) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
        return np.array(list(map(self.__getitem__, words(text))), np.uint64)


def weights_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(3)).astype(np.int64) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Per bit the weighted sum of the signs of the words' bits before each place: any window is a difference of two rows."""
    bits = np.unpackbits(mixed(hashes).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    signed = (2 * bits - 1) * weights_of(hashes).astype(np.int8)[:, None]
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(signed, axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(running: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of windows of ``width`` words: the sign of the weighted sum of the words' bits, as uint64."""
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(starts), 100_000):
        some = starts[lo : lo + 100_000]
        out[lo : lo + 100_000] = np.packbits(running[some + width] > running[some], axis=1).view(np.uint64).ravel()
    return out


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of every two successive words."""
    return mixed(mixed(hashes[:-1]) ^ hashes[1:])


def among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they stand in it."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def shingle_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of every SHINGLE successive words."""
    n = len(hashes) - SHINGLE + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE):
        key = mixed(key ^ hashes[i : i + n]) if n > 0 else key
    return key


def window_size(n: int) -> int:
    """Words of the item-sized windows for an item of n words."""
    if n <= OWN_SIZE:
        return n
    step = max(1, (1 << (n.bit_length() - 1)) // SIZE_STEPS)
    return n - n % step


class HammingIndex:
    """Fingerprints listed by the values of their blocks, and by all values that differ from those in a few bits."""

    def __init__(self, fp: np.ndarray) -> None:
        self.fp = fp
        width = 64 // BLOCKS
        near = [0]
        for flips in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(width), flips)]
        near = np.array(near, np.int64)
        self.order, self.start = [], []
        for b in range(BLOCKS):
            key = ((fp >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            listed = (key[:, None] ^ near).ravel()
            order = np.argsort(listed, kind="stable")
            self.order.append((order // len(near)).astype(np.int32))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(listed, minlength=1 << width))]))

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item window) within RADIUS bits; none is missed."""
        width, left, right = 64 // BLOCKS, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            key = ((fp >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lo = self.start[b][key]
            n = self.start[b][key + 1] - lo
            some = np.flatnonzero(n)
            for part in np.array_split(some, max(1, int(n.sum()) // 2_000_000 + 1)):
                k = n[part]
                at = np.repeat(part, k)
                j = self.order[b][np.repeat(lo[part], k) + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)]
                close = np.bitwise_count(fp[at] ^ self.fp[j]) <= RADIUS
                left.append(at[close])
                right.append(j[close].astype(np.int64))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


class PassageIndex:
    """The passages of one block: their pairs of words and shingles, their item-sized windows, and their parts."""

    def __init__(self, passages: list[tuple[int, str]]) -> None:
        code = _Words()
        items = [(p, h) for p, h in ((p, code.coded(t)) for p, t in passages) if len(h)]
        self.ids = np.array([p for p, _ in items], np.int64)
        self.size = np.array([len(h) for _, h in items], np.int64)
        self.words = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        owner = np.repeat(np.arange(len(items)), self.size)
        self.pairs = np.unique(pair_keys(self.words)[owner[1:] == owner[:-1]])
        self.keys = shingle_keys(self.words)
        self.shingles = np.unique(self.keys)
        running = running_bits(self.words)
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        self.whole: dict[int, tuple] = {}
        for w in np.unique(np.minimum(self.size, PART)).tolist():
            n = np.where(np.minimum(self.size, PART) == w, self.size - w + 1, 0)
            item = np.repeat(np.arange(len(items)), n)
            at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            fp = fingerprints(running, self.first[item] + at, w)
            order = np.argsort(fp, kind="stable")
            self.parts[w] = (fp[order], item[order], at[order])
        sizes: dict[int, set[tuple[int, int]]] = {}
        for i, n in enumerate(self.size.tolist()):
            if n > PART:
                w = window_size(n)
                sizes.setdefault(w, set()).update({(i, 0), (i, n - w)})
        weight = np.concatenate([[0], np.cumsum(weights_of(self.words))])
        for w, who in sorted(sizes.items()):
            item, at = (np.array(x, np.int64) for x in zip(*sorted(who)))
            start = self.first[item] + at
            least = int(np.ceil(SIMILARITY * (weight[start + w] - weight[start]).min()))
            self.whole[w] = (HammingIndex(fingerprints(running, start, w)), start, item, least)

    def search(self, hashes: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
        """(doc, item, words_run, similarity) of the documents whose words are given one after another."""
        exact, near = [], []
        if len(hashes) and len(self.words):
            pair = among(pair_keys(hashes), self.pairs)[1] & (owner[1:] == owner[:-1])
            pairs_before = np.concatenate([[0], np.cumsum(pair)])
            beside = np.zeros(len(hashes), bool)
            beside[1:] |= pair
            beside[:-1] |= pair
            weight_before = np.concatenate([[0], np.cumsum(np.where(beside, weights_of(hashes), 0))])
            parts, whole = {}, {}
            for w in self.parts:
                n = len(hashes) - w + 1
                # only windows in which all words follow each other as in passages can equal one; single words are looked up themselves
                all_pairs = pairs_before[w - 1 : w - 1 + n] - pairs_before[:n] == w - 1 if n > 0 else np.zeros(0, bool)
                parts[w] = np.flatnonzero(all_pairs & (owner[w - 1 :] == owner[:n])) if n > 0 else np.zeros(0, np.int64)
            for w, (_, _, _, least) in self.whole.items():
                n = len(hashes) - w + 1
                # a window whose words beside words as in passages weigh less can't hold enough of any item of this size
                whole[w] = np.flatnonzero((weight_before[w:] - weight_before[:-w] >= least) & (owner[w - 1 :] == owner[:n])) if n > 0 else np.zeros(0, np.int64)
            # bits are summed over the words of such windows only
            edge = np.zeros(len(hashes) + 1, np.int32)
            for w, start in chain(parts.items(), whole.items()):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w, -1)
            used = np.cumsum(edge[:-1]) > 0
            place = np.concatenate([[0], np.cumsum(used)])
            running, keys = running_bits(hashes[used]), shingle_keys(hashes)
            exact = [self._equal(hashes, owner, fingerprints(running, place[start], w), start, w) for w, start in parts.items()]
            near = [self._near(owner, fingerprints(running, place[start], w), keys, start, w) for w, start in whole.items()]
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "at", "line", "w")})
        runs = pd.concat([empty, *exact]).sort_values(["doc", "item", "line", "at"])
        new = runs[["doc", "item", "line"]].diff().ne(0).any(axis=1) | runs["at"].diff().ne(1)
        runs = runs.assign(run=new.cumsum()).groupby(["doc", "item", "run"]).agg(n=("at", "size"), w=("w", "first")).reset_index()
        runs["words_run"] = runs["n"] + runs["w"] - 1
        out = runs.groupby(["doc", "item"])["words_run"].max().reset_index()
        out["similarity"] = out["words_run"] / self.size[out["item"].to_numpy(np.int64)]
        if near:
            out = pd.concat([out, pd.concat(near).assign(words_run=0)]).groupby(["doc", "item"]).max().reset_index()
        return out

    def _equal(self, hashes: np.ndarray, owner: np.ndarray, key: np.ndarray, start: np.ndarray, w: int) -> pd.DataFrame:
        """Windows with a part's fingerprint and words."""
        fp, item, part = self.parts[w]
        lo, hi = np.searchsorted(fp, key, "left"), np.searchsorted(fp, key, "right")
        k = hi - lo
        a = np.repeat(start, k)
        j = np.repeat(lo, k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        same = np.ones(len(a), bool)
        for i in range(w):
            same &= hashes[a + i] == self.words[self.first[item[j]] + part[j] + i]
        a, j = a[same], j[same]
        return pd.DataFrame({"doc": owner[a], "item": item[j], "at": a, "line": a - part[j], "w": w})

    def _near(self, owner: np.ndarray, key: np.ndarray, keys: np.ndarray, start: np.ndarray, w: int) -> pd.DataFrame:
        """Windows within RADIUS bits of an item-sized one that hold enough of its words in shingles."""
        index, first, item, _ = self.whole[w]
        a, j = index.near(key)
        share = np.zeros(len(a))
        for lo in range(0, len(a), 20_000):
            at, of = start[a[lo : lo + 20_000]], first[j[lo : lo + 20_000]]
            share[lo : lo + 20_000] = self.covered_share(keys, at, of, w)
        good = share >= SIMILARITY
        return pd.DataFrame({"doc": owner[start[a[good]]], "item": item[j[good]], "similarity": share[good]})

    def covered_share(self, keys: np.ndarray, at: np.ndarray, of: np.ndarray, w: int) -> np.ndarray:
        """The weighted share of items' words that stand in shingles which the windows from ``at`` hold too."""
        m = w - SHINGLE + 1
        row = np.arange(len(at))[:, None] * np.int64(len(self.shingles))
        mine, known = among(keys[at[:, None] + np.arange(m)], self.shingles)
        theirs = np.searchsorted(self.shingles, self.keys[of[:, None] + np.arange(m)])
        shared = np.isin(theirs + row, (mine + row)[known])
        inside = np.zeros((len(at), w), bool)
        for i in range(SHINGLE):
            inside[:, i : i + m] |= shared
        weight = weights_of(self.words[of[:, None] + np.arange(w)])
        return (weight * inside).sum(1) / weight.sum(1)


_KEPT: OrderedDict[str, PassageIndex] = OrderedDict()


def _index(key: str, block: Broadcast) -> PassageIndex:
    """The index of a block, built once in a worker as long as MOST_KEPT others haven't been used since."""
    if key not in _KEPT:
        _KEPT[key] = PassageIndex(block.value)
        if len(_KEPT) > MOST_KEPT:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(key)
    return _KEPT[key]


def _leaks(blocks: list[Broadcast], chunk: int):
    name = uuid4().hex  # of this search, as workers serve others too

    def found(wait: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        hashes = np.concatenate([h for _, h in wait])
        owner = np.repeat(np.arange(len(wait)), [len(h) for _, h in wait])
        names = np.array([d for d, _ in wait], np.int64)
        for i, block in enumerate(blocks):
            index = _index(f"{name}-{i}", block)
            out = index.search(hashes, owner)
            at = out["item"].to_numpy(np.int64)
            yield pd.DataFrame({"doc_id": names[out["doc"].to_numpy(np.int64)], "passage_id": index.ids[at], "words_run": out["words_run"].astype(np.int32), "similarity": out["similarity"].astype(float)})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, wait, size = _Words(), [], 0
        for pdf in it:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                coded = code.coded(text)
                if len(coded):
                    wait.append((doc_id, coded))
                    size += len(coded)
                if size >= chunk:
                    yield from found(wait)
                    wait, size = [], 0
        if wait:
            yield from found(wait)

    return run


def find_leaks(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, words_run, similarity): documents with a window that an item's passage holds, or nearly holds.

    Windows of every document that have an item's size, and those of PART words, are fingerprinted, as far as enough of
    their words are words of passages. Item-sized ones are looked up in the blocks of a multi-index, which finds all
    within RADIUS bits of an item; those are verified by the weighted share of the item's words that stand in common
    shingles. Parts must have an item's fingerprint and its words. ``words_run`` is the longest run of the passage's
    words that stands in the document as it is (0: only a near window), from PART words on or the whole passage;
    ``similarity`` is the share of the item's words that the run or the best near window holds.

    The corpus is read once and isn't shuffled; passages come in broadcasts of BLOCK_CHARS characters, one index of
    which a task holds at a time. Null or wordless texts and passages give no rows; equal passages are searched once and
    all their items found; repeated rows count once.
    """
    items = passages.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    items = items.withColumn("passage_id", F.xxhash64("passage", F.length("passage")))
    spark = documents.sparkSession
    blocks: list[Broadcast] = []
    block, size = [], 0
    for row in items.groupBy("passage_id").agg(F.first("passage").alias("passage")).toLocalIterator():  # one partition at a time
        if block and size + len(row["passage"]) > BLOCK_CHARS:
            blocks.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((row["passage_id"], row["passage"]))
        size += len(row["passage"])
    blocks.append(spark.sparkContext.broadcast(block))
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInPandas(_leaks(blocks, CHUNK_WORDS * len(blocks)), OUT)
    per = found.groupBy("doc_id", "passage_id").agg(F.max("words_run").alias("words_run"), F.max("similarity").alias("similarity"))
    return per.join(items.select("item_id", "passage_id"), "passage_id").select("doc_id", "item_id", "words_run", "similarity")


def item_report(documents: DataFrame, passages: DataFrame, least: int = PART) -> DataFrame:
    """(suite, item_id, leaking_documents, near_documents, longest_run) of every item, 0 where it leaks nowhere.

    Leaking documents hold ``least`` successive words of the passage, near ones SIMILARITY of all its words in shingles.
    """
    hits = find_leaks(documents, passages).where((F.col("words_run") >= least) | (F.col("similarity") >= SIMILARITY))
    run, near = F.col("words_run") >= least, F.col("similarity") >= SIMILARITY
    per = hits.groupBy("item_id").agg(
        F.count_distinct(F.when(run, F.col("doc_id"))).alias("leaking_documents"), F.count_distinct(F.when(near, F.col("doc_id"))).alias("near_documents"), F.max(F.when(run, F.col("words_run"))).alias("longest_run")
    )
    items = passages.where(F.col("item_id").isNotNull()).select("suite", F.col("item_id").cast("long").alias("item_id")).distinct()
    return items.join(per, "item_id", "left").select("suite", "item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("leaking_documents", "near_documents", "longest_run")])
