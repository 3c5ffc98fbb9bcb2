"""The most similar vectors of a query set: an inverted multi-index over two vector halves, with reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolake.sources.shared import cut, drop

#: Rows of each scheme on which the centroids are fitted, for each centroid of a half, and at least; chosen by a hash of
#: the row's id. Every row is indexed.
FIT_PER_CENTROID, FIT_ROWS = 40, 20_000
#: Rows that a cell should hold. The centroids grow with the root of a scheme's rows, until all schemes have MOST_CELLS.
CELL_ROWS, LEAST_CENTROIDS, MOST_CELLS = 150, 2, 1 << 22
#: Rows that a query must meet before its traversal ends.
CANDIDATES = 3000
#: Up to so many queries are searched on the rows' side, without a shuffle; more are joined with the cells.
FEW_QUERIES = 2000
#: Rows of a cell, and queries of a cell, that one group of the join holds at most, on average of a hash.
PART_ROWS, PART_QUERIES = 20_000, 20_000
#: Different schemes (groups that are searched apart) that the index holds at most; more are an error.
MOST_SCHEMES = 200


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct random rows; an empty centroid moves to the worst-served row."""
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[: min(k, len(rows))]].copy()
    for _ in range(rounds):
        near, least = _nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-least, kind="stable")[: len(empty)]]
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0.0)


def _nearest_centroid(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and its squared distance, in blocks that bound memory."""
    near, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, 4_000_000 // len(c))
    for lo in range(0, len(x), step):
        d = _squared(x[lo : lo + step], c)
        near[lo : lo + step] = d.argmin(1)
        least[lo : lo + step] = d.min(1)
    return near, least


class MultiIndex:
    """Centroids of both halves of each scheme, the rows of each cell, and the bounds of the rows of each half's centroids."""

    def __init__(self, centroids: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.centroids = centroids
        self.size: dict[str, np.ndarray] = {}
        self.bounds: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def cells(self, scheme: str, x: np.ndarray) -> np.ndarray:
        a, b = self.centroids[scheme]
        h = a.shape[1]
        return _nearest_centroid(x[:, :h], a)[0] * len(b) + _nearest_centroid(x[:, h:], b)[0]

    def fill(self, cells: pd.DataFrame, halves: list[pd.DataFrame], axes: list[str]) -> None:
        for scheme, some in cells.groupby("scheme"):
            a, b = self.centroids[scheme]
            self.size[scheme] = np.zeros(len(a) * len(b), np.int32)
            self.size[scheme][some["cell"]] = np.minimum(some["n"], 2**31 - 1)
            h = a.shape[1]
            self.bounds[scheme] = []
            for table, names, k in zip(halves, (axes[:h], axes[h:]), (len(a), len(b))):
                mine = table[table["scheme"] == scheme]
                low, high = np.full((k, len(names)), np.inf), np.full((k, len(names)), -np.inf)
                low[mine["half"]], high[mine["half"]] = mine[[f"lo_{e}" for e in names]], mine[[f"hi_{e}" for e in names]]
                self.bounds[scheme].append((low, high))

    def traverse(self, scheme: str, q: np.ndarray, candidates: int) -> list[int]:
        """Filled cells in the order of the summed distances of their centroids, until they hold enough rows.

        Each half's centroids are sorted by distance; a heap walks the pairs from the nearest outwards, each pair
        entering after its neighbours in both orders.
        """
        a, b = self.centroids[scheme]
        h = a.shape[1]
        da, db = _squared(q[None, :h], a)[0], _squared(q[None, h:], b)[0]
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        sa, sb = da[oa].tolist(), db[ob].tolist()
        size, wide = self.size[scheme], len(b)
        heap, met, found = [(sa[0] + sb[0], 0, 0)], 0, []
        reached = [0] * len(oa)  # next column of each row of the walk
        reached[0] = 1
        while heap and met < candidates:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * wide + ob[j]
            if size[cell]:
                found.append(cell)
                met += int(size[cell])
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
                reached[i + 1] = 1
            if j + 1 < len(ob):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        return found

    def within(self, scheme: str, q: np.ndarray, squared: float) -> np.ndarray:
        """Filled cells that can hold a row as near as a squared distance, by the bounds of both halves: no other cell can."""
        h = self.centroids[scheme][0].shape[1]
        gaps = []
        for (low, high), part in zip(self.bounds[scheme], (q[:h], q[h:])):
            gap = np.maximum(np.maximum(low - part, part - high), 0.0)
            gaps.append((gap * gap).sum(1))
        most = squared * (1 + 1e-9) + 1e-12
        first = np.flatnonzero((gaps[0] <= most) & np.isfinite(gaps[0]))
        wide = len(gaps[1])
        near = [a * wide + np.flatnonzero(gaps[1] <= most - gaps[0][a]) for a in first]
        found = np.concatenate(near) if near else np.zeros(0, np.int64)
        return found[self.size[scheme][found] > 0]


def _complete(vectors: DataFrame, row_id: str, scheme: str, axes: list[str]) -> DataFrame:
    kept = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(scheme).cast("string").alias("scheme"), *[F.col(e).cast("double").alias(e) for e in axes])
    whole = F.col("id").isNotNull() & F.col("scheme").isNotNull()
    for e in axes:
        whole &= F.col(e).isNotNull() & ~F.isnan(e)
    return kept.where(whole)


def _once(rows: DataFrame, axes: list[str]) -> DataFrame:
    """One row an id and scheme, whatever the number of its deliveries: every split sends one copy at most."""
    return rows.groupBy("id", "scheme").agg(*[F.first(e).alias(e) for e in axes])


def build_index(vectors: DataFrame, row_id: str, scheme: str, axes: list[str], seed: int = 7) -> tuple[MultiIndex | None, DataFrame]:
    """The index, and the table of all complete rows with their cells (written to the shared folder).

    Only the centroids come from a sample. Rows with a null or NaN component, id or scheme aren't indexed. A row that was
    delivered several times is held and counted once. None for an empty table.
    """
    rows = cut(_once(_complete(vectors, row_id, scheme, axes), axes), "complete")
    counts = {r["scheme"]: r["count"] for r in rows.groupBy("scheme").count().limit(MOST_SCHEMES + 1).collect()}
    if len(counts) > MOST_SCHEMES:
        raise ValueError(f"more than {MOST_SCHEMES} schemes")
    if not counts:
        return None, rows.withColumn("cell", F.lit(0))
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    total = sum(counts.values())
    width = {name: max(LEAST_CENTROIDS, int(round(np.sqrt(min(n / CELL_ROWS, MOST_CELLS * n / total))))) for name, n in counts.items()}
    wanted = {name: max(FIT_ROWS, FIT_PER_CENTROID * k) for name, k in width.items()}
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("scheme") == name, F.lit(int(min(1.0, wanted[name] / n) * (1 << 30)))).otherwise(share)
    sample = rows.where(u < share).limit(2 * sum(wanted.values())).toArrow().to_pandas()  # bounded by the rows wanted
    half = (len(axes) + 1) // 2
    centroids = {}
    for name in counts:
        x = sample.loc[sample["scheme"] == name].sort_values(["id", *axes])[axes].to_numpy()
        if not len(x):
            x = np.array([rows.where(F.col("scheme") == name).select(*axes).first()], float)
        centroids[name] = (kmeans(x[:, :half], width[name]), kmeans(x[:, half:], width[name]))
    index = MultiIndex(centroids)
    wide = {name: len(b) for name, (_, b) in centroids.items()}
    shared = rows.sparkSession.sparkContext.broadcast(index)  # centroids only, as yet

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            cell, first = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            names, x = pdf["scheme"].to_numpy(), pdf[axes].to_numpy()
            for name in pd.unique(names):
                at = names == name
                cell[at] = shared.value.cells(name, x[at])
                first[at] = cell[at] // wide[name]
            yield pdf.assign(cell=cell, a=first.astype(np.int32), b=(cell - first * np.array([wide[n] for n in names], np.int64)).astype(np.int32))

    table = cut(rows.mapInPandas(assign, rows.schema.simpleString()[7:-1].replace(":", " ") + ", cell long, a int, b int"), "cells")
    cells = table.groupBy("scheme", "cell").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()  # MOST_CELLS rows at most
    bounds = lambda side, names: table.groupBy("scheme", F.col(side).alias("half")).agg(*[f(e).alias(f"{s}_{e}") for e in names for s, f in (("lo", F.min), ("hi", F.max))]).toArrow().to_pandas()
    index.fill(cells, [bounds("a", axes[:half]), bounds("b", axes[half:])], axes)  # a row a centroid
    drop(rows)
    return index, table.drop("a", "b")


def _top(q_id: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, of rows sorted or not; a repeated row counts once."""
    order = np.lexsort((ids, d, q_id))
    q_id, ids, d = q_id[order], ids[order], d[order]
    new = np.ones(len(q_id), bool)
    new[1:] = (q_id[1:] != q_id[:-1]) | (ids[1:] != ids[:-1])
    q_id, ids, d = q_id[new], ids[new], d[new]
    start = np.flatnonzero(np.diff(q_id, prepend=q_id[0] - 1)) if len(q_id) else np.zeros(0, int)
    rank = np.arange(len(q_id)) - np.repeat(start, np.diff(np.append(start, len(q_id))))
    return pd.DataFrame({"query": q_id[rank < k], "neighbour": ids[rank < k], "squared": d[rank < k]})


def _nearest(qi: np.ndarray, qx: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k + some nearest rows of every query in one cell, in blocks that bound memory; exact differences are squared."""
    parts = []
    for a in range(0, len(qi), 256):
        q, name = qx[a : a + 256], qi[a : a + 256]
        best_i, best_d = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in range(0, len(ids), 4000):
            d = np.zeros((len(q), len(ids[b : b + 4000])))
            for j in range(x.shape[1]):
                d += (q[:, j, None] - x[None, b : b + 4000, j]) ** 2
            same = name[:, None] == ids[None, b : b + 4000]
            d[same] = np.inf
            keep = np.argsort(d, axis=1, kind="stable")[:, : 2 * k] if d.shape[1] <= 4 * k else np.argpartition(d, 2 * k, axis=1)[:, : 2 * k]
            best_i = np.concatenate([best_i, ids[b : b + 4000][keep]], 1)
            best_d = np.concatenate([best_d, np.take_along_axis(d, keep, 1)], 1)
        good = np.isfinite(best_d)
        parts.append((np.repeat(name, best_d.shape[1])[good.ravel()], best_i[good], best_d[good]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _search_rows(queries: pd.DataFrame, cells: dict[tuple[str, int], np.ndarray], axes: list[str], k: int):
    """On the rows' side: every split ranks its own rows of the cells that the queries visit."""
    q_ids, q_x = queries["id"].to_numpy(), queries[axes].to_numpy()

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame | None:
        pdf = pdf.drop_duplicates("id")
        key = pdf["scheme"].to_numpy(), pdf["cell"].to_numpy()
        ids, x = pdf["id"].to_numpy(), pdf[axes].to_numpy()
        order = np.lexsort((key[1], key[0]))
        scheme, cell = key[0][order], key[1][order]
        edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (scheme[1:] != scheme[:-1]), [True]]))
        found = []
        for a, b in zip(edge[:-1], edge[1:]):
            who = cells.get((scheme[a], int(cell[a])))
            if who is not None:
                at = order[a:b]
                found.append(_nearest(q_ids[who], q_x[who], ids[at], x[at], k))
        return _top(*(np.concatenate(p) for p in zip(*found)), k) if found else None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait, size = [], 0
        for pdf in it:
            wait.append(pdf)
            size += len(pdf)
            if size >= 200_000:
                if (out := ranked(pd.concat(wait))) is not None:
                    yield out
                wait, size = [], 0
        if wait and (out := ranked(pd.concat(wait))) is not None:
            yield out

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query of all parts; each part sent k at most, so a query has few rows."""
    sorted_rows = F.sort_array(F.collect_set(F.struct("squared", "neighbour")))
    top = found.groupBy("query").agg(F.slice(sorted_rows, 1, k).alias("top"))
    return top.select("query", F.posexplode("top").alias("rank", "n")).select("query", F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("n.squared").alias("squared"))


def _visits(index: Broadcast, queries: DataFrame, axes: list[str], candidates: int, rest: bool) -> DataFrame:
    """(id, scheme, cell, axes): the cells that each query visits, walked in tasks.

    With ``rest`` these are the cells that a query has not visited yet and that can hold a row as near as its column
    ``far``, the squared distance of the k-th row found (null: fewer were found, so all cells can).
    """

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in it:
            for lo in range(0, len(whole), 500):
                pdf = whole.iloc[lo : lo + 500]
                x = pdf[axes].to_numpy()
                visits = [np.array(index.value.traverse(s, q, candidates), np.int64) for s, q in zip(pdf["scheme"], x)]
                if rest:
                    visits = [np.setdiff1d(index.value.within(s, q, np.inf if np.isnan(f) else f), v) for s, q, f, v in zip(pdf["scheme"], x, pdf["far"].to_numpy(float), visits)]
                at = np.repeat(np.arange(len(pdf)), [len(v) for v in visits])
                out = pdf.iloc[at].reset_index(drop=True)
                out["cell"] = np.concatenate([*visits, np.zeros(0, np.int64)]).astype(np.int64)
                yield out[["id", "scheme", "cell", *axes]]

    wanted = queries.select("id", "scheme", *axes, *(["far"] if rest else []))
    return wanted.mapInPandas(walk, "id long, scheme string, cell long, " + ", ".join(f"{e} double" for e in axes))


def _few(table: DataFrame, queries: pd.DataFrame, visits: pd.DataFrame, axes: list[str], k: int) -> DataFrame:
    """The rows of the visited cells are ranked where they lie; ``queries`` are FEW_QUERIES at most."""
    place = pd.Series(np.arange(len(queries)), queries["id"])
    cells = {key: place[g["id"]].to_numpy() for key, g in visits.groupby(["scheme", "cell"])}
    cells = {(str(s), int(c)): v for (s, c), v in cells.items()}
    spark = table.sparkSession
    wanted = spark.createDataFrame(list(cells) or [("", -1)], "scheme string, cell long")
    rows = table.join(F.broadcast(wanted), ["scheme", "cell"], "left_semi").select("id", "scheme", "cell", *axes)  # the cells of FEW_QUERIES
    return rows.mapInPandas(_search_rows(queries, cells, axes, k), "query long, neighbour long, squared double")


def _many(table: DataFrame, visits: DataFrame, axes: list[str], k: int) -> DataFrame:
    """Queries meet the rows of their cells in a shuffle; large cells and much-visited cells are cut into parts."""
    visits = cut(visits, "visits")
    asked = visits.groupBy("scheme", "cell").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("qparts"))
    held = table.groupBy("scheme", "cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    plan = F.broadcast(asked.join(held, ["scheme", "cell"]))  # one row a cell: MOST_CELLS at most
    left = visits.join(plan, ["scheme", "cell"]).withColumn("qpart", F.pmod(F.xxhash64("id"), F.col("qparts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = table.join(plan, ["scheme", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    keys = ["scheme", "cell", "part", "qpart"]

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "squared": np.zeros(0)})
        q, r = q.drop_duplicates("id"), r.drop_duplicates("id")
        return _top(*_nearest(q["id"].to_numpy(), q[axes].to_numpy(), r["id"].to_numpy(), r[axes].to_numpy(), k), k)

    return left.select("id", *keys, *axes).groupBy(*keys).cogroup(right.select("id", *keys, *axes).groupBy(*keys)).applyInPandas(meet, "query long, neighbour long, squared double")


def nearest(vectors: DataFrame, queries: DataFrame, row_id: str, scheme: str, axes: list[str], k: int = 5, candidates: int = CANDIDATES, exact: bool = False) -> DataFrame:
    """(query, neighbour, rank, distance): the k nearest other rows of the same scheme of every row named in ``queries``.

    ``queries`` has the column ``row_id``. The cells of the inverted multi-index are visited by summed centroid
    distance until they hold ``candidates`` rows, and these are reranked by their distance over all axes. With
    ``exact`` all other cells that the bounds of their halves allow to hold a row nearer than the k-th row found are
    searched too, so nothing is missed, for any number of queries. Ties go to the lesser id. Queries that are unknown or
    incomplete give no rows; a row delivered several times counts once; a scheme with fewer than k other rows gives
    what it has.
    """
    index, table = build_index(vectors, row_id, scheme, axes)
    asked = queries.select(F.col(row_id).cast("long").alias("id")).where(F.col("id").isNotNull()).distinct()
    few = asked.count() <= FEW_QUERIES
    rows = table.join(F.broadcast(asked) if few else asked, "id", "left_semi").select("id", "scheme", *axes).dropDuplicates(["id"])
    if index is None:
        return table.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.col("cell").alias("rank"), F.lit(0.0).alias("distance"))
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    rows = cut(rows, "queries")
    known = rows.toArrow().to_pandas().sort_values("id").reset_index(drop=True) if few else None  # FEW_QUERIES at most

    def met(visits: DataFrame) -> DataFrame:
        return _few(table, known, visits.select("id", "scheme", "cell").toArrow().to_pandas(), axes, k) if few else _many(table, visits, axes, k)

    found = met(_visits(shared, rows, axes, candidates, False))
    if exact:
        found = cut(found, "near")
        far = _merge(found, k).groupBy("query").agg(F.max("squared").alias("far"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("query").alias("id"), "far")
        found = found.unionByName(met(_visits(shared, rows.join(far, "id", "left"), axes, candidates, True)))
    return _merge(found, k).select("query", "neighbour", "rank", F.sqrt("squared").alias("distance"))
