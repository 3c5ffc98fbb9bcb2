"""Registered queries of the numbered problems 1, 2 and 4 to 8, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.llm import leaks, neighbours, overlap, packing, quotas, splits, toxicity
from octolake.sources.shared import cut

AXES = [f"e{i}" for i in range(8)]
#: Neighbours of a window.
NEAREST = 5


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.linked_pairs(*_read(spark, folder, "benchmark_metadata", "homology_clusters", "dataset_configs"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_splits(*_read(spark, folder, "benchmark_metadata", "homology_clusters", "dataset_configs"))


def _split_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return cut(p1_splits(spark, folder), "splits"), *_read(spark, folder, "dataset_configs")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(*_split_rows(spark, folder))


def p1_check(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_check(*_split_rows(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.quota_report(*_read(spark, folder, "coding_metadata", "sample_targets")).where("short").select("target_id")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.quota_sample(*_read(spark, folder, "coding_metadata", "sample_targets"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.quota_report(*_read(spark, folder, "coding_metadata", "sample_targets")).select("target_id", "request_id", "available", "wanted", "sampled", "deficit", "short", "target_share", F.round("reached_share", 6).alias("reached_share"))


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.sample_check(*_read(spark, folder, "coding_metadata", "sample_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_pairs(*_read(spark, folder, "fasta_records", "benchmark_splits", "dataset_configs"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(*_read(spark, folder, "fasta_records", "benchmark_splits", "dataset_configs", "benchmark_metadata"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    windows, probes = _read(spark, folder, "window_octonions", "neighbour_probes")
    top = neighbours.nearest(windows, probes, "window_id", "axis_scheme_id", AXES, NEAREST, exact=True)
    return top.select(F.least("query", "neighbour").alias("window_id_a"), F.greatest("query", "neighbour").alias("window_id_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    (windows,) = _read(spark, folder, "window_octonions")
    return neighbours.nearest(windows, windows.where("window_id % 20 = 0").select("window_id"), "window_id", "axis_scheme_id", AXES, NEAREST)


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_tiers(*_read(spark, folder, "documents", "pack_capacities"))


def p6_pack_each(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_each(*_read(spark, folder, "documents", "pack_capacities"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    documents, capacities = _read(spark, folder, "documents", "pack_capacities")
    return packing.fill_report(packing.pack_tiers(documents, capacities), capacities)


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    documents, capacities = _read(spark, folder, "documents", "pack_capacities")
    return packing.pack_check(cut(packing.pack_tiers(documents, capacities), "packed"), capacities)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(*_read(spark, folder, "documents", "eval_passages")).where(F.col("words_run") >= leaks.PART).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.item_report(*_read(spark, folder, "documents", "eval_passages"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(*_read(spark, folder, "documents", "content_labels")).where("flagged").select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.source_rates(*_read(spark, folder, "documents", "content_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_report, p1_check, p2_found, p2_sample, p2_report, p2_check, p4_found, p4_neighbours, p5_found, p5_report, p6_pack, p6_pack_each, p6_fill, p6_check, p7_found, p7_items, p8_found, p8_rates)}

_LABEL = r"regexp_replace(lower({c}), '[\s-]+', '', 'g')"
_FIELDS = f"{_LABEL.format(c='label')} AS label, regexp_replace({_LABEL.format(c='chromosome')}, '^chr', '') AS chromosome, gc_bin"
_QUOTAS = (
    f"WITH r AS (SELECT DISTINCT sequence_id, {_FIELDS} FROM coding_metadata WHERE sequence_id IS NOT NULL), "
    f"t AS (SELECT DISTINCT target_id, request_id, sample_size, target_share, min_rows, {_FIELDS} FROM sample_targets), "
    "a AS (SELECT t.target_id, t.request_id, t.sample_size, t.target_share, t.min_rows, t.target_share * t.sample_size AS exact, count(DISTINCT r.sequence_id) AS available FROM t LEFT JOIN r ON (t.label IS NULL OR t.label = r.label) AND (t.chromosome IS NULL OR t.chromosome = r.chromosome) AND (t.gc_bin IS NULL OR t.gc_bin = r.gc_bin) GROUP BY ALL), "
    "p AS (SELECT *, greatest(round(exact)::BIGINT, min_rows) AS wanted, available < min_rows OR available < exact AS short, least(min_rows, available) AS lo, CASE WHEN exact > 0 THEN available ELSE least(min_rows, available) END AS hi FROM a) "
)
_DRAWN = (
    ", q AS (SELECT request_id, sum(lo) AS base, greatest(sum(lo), least(max(sample_size), sum(hi))) AS total FROM p GROUP BY 1), "
    "b AS (SELECT request_id, lo / exact AS pt, exact AS ds, lo AS dt FROM p WHERE exact > 0 UNION ALL SELECT request_id, hi / exact, -exact, -hi FROM p WHERE exact > 0), "
    "c AS (SELECT request_id, pt, sum(ds) OVER w AS slope, sum(dt) OVER w AS t FROM b WINDOW w AS (PARTITION BY request_id ORDER BY pt RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
    "f AS (SELECT c.request_id, max(struct_pack(pt := pt, s := base + slope * pt - t, slope := slope, total := total)) AS x FROM c JOIN q USING (request_id) WHERE base + slope * pt - t <= total + 1e-6 GROUP BY 1), "
    "y AS (SELECT p.*, total, greatest(lo, least(hi, coalesce(x.pt + CASE WHEN x.slope > 1e-9 THEN (x.total - x.s) / x.slope ELSE 0 END, 0) * exact)) AS ex FROM p JOIN q USING (request_id) LEFT JOIN f USING (request_id)), "
    "z AS (SELECT *, floor(ex + 1e-6)::BIGINT AS fl, round(greatest(0, ex - floor(ex + 1e-6)), 6) AS part FROM y), "
    "s AS (SELECT *, fl + (row_number() OVER (PARTITION BY request_id ORDER BY part DESC, target_id) <= total - sum(fl) OVER (PARTITION BY request_id) AND fl < hi)::BIGINT AS sampled FROM z) "
)
_SUBJECT = r"regexp_replace(lower(species_or_subject), '[\s _-]+', '', 'g')"
_GROUPS = (
    "WITH RECURSIVE m AS (SELECT DISTINCT sequence_id, dataset_id, species_or_subject, group_column FROM benchmark_metadata JOIN dataset_configs USING (dataset_id) WHERE sequence_id IS NOT NULL), "
    f"k AS (SELECT dataset_id || '|s|' || {_SUBJECT} AS key, sequence_id AS node FROM m WHERE group_column LIKE '%species_or_subject%' AND {_SUBJECT} NOT IN ('', 'na', 'n/a', 'unknown') "
    "UNION SELECT dataset_id || '|h|' || homology_cluster, m.sequence_id FROM m JOIN homology_clusters h ON h.sequence_id = m.sequence_id WHERE group_column LIKE '%homology_cluster%' AND trim(homology_cluster) <> ''), "
    "l AS (SELECT key, min(node) AS low FROM k GROUP BY 1), e AS (SELECT low AS x, node AS y FROM k JOIN l USING (key) UNION SELECT node, low FROM k JOIN l USING (key)), "
    "reach(node, root) AS (SELECT DISTINCT node, node FROM k UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node) "
)
_SIDES = (
    r"WITH s AS (SELECT DISTINCT sequence_id, upper(regexp_replace(sequence, '\s+', '', 'g')) AS t FROM fasta_records WHERE sequence_id IS NOT NULL AND regexp_replace(sequence, '\s+', '', 'g') <> ''), "
    r"b AS (SELECT DISTINCT dataset_id, sequence_id, CASE WHEN regexp_replace(lower(split), '\s+', '', 'g') = 'train' THEN 'train' WHEN regexp_replace(lower(split), '\s+', '', 'g') IN ('val', 'validation', 'test') THEN 'held' END AS side FROM benchmark_splits), "
    "x AS (SELECT b.dataset_id, b.sequence_id, side, t, sequence_similarity_threshold AS least FROM b JOIN s USING (sequence_id) JOIN dataset_configs c ON c.dataset_id = b.dataset_id WHERE side IS NOT NULL) "
)
_COMPLETE = " AND ".join(f"{e} IS NOT NULL" for e in AXES)
_NEAR = (
    f"WITH w AS (SELECT DISTINCT window_id, axis_scheme_id, {', '.join(AXES)} FROM window_octonions WHERE window_id IS NOT NULL AND axis_scheme_id IS NOT NULL AND {_COMPLETE}), "
    f"d AS (SELECT q.window_id AS query, r.window_id AS neighbour, row_number() OVER (PARTITION BY q.window_id ORDER BY {' + '.join(f'power(q.{e} - r.{e}, 2)' for e in AXES)}, r.window_id) AS rank "
    "FROM w q JOIN neighbour_probes USING (window_id) JOIN w r ON r.axis_scheme_id = q.axis_scheme_id AND r.window_id <> q.window_id) "
)
SQL: dict[str, str] = {
    "p4_found": _NEAR + f"SELECT DISTINCT least(query, neighbour) AS window_id_a, greatest(query, neighbour) AS window_id_b FROM d WHERE rank <= {NEAREST}",
    "p1_found": _GROUPS + "SELECT min(root) AS sequence_id_a, node AS sequence_id_b FROM reach GROUP BY node HAVING min(root) <> node",
    "p1_check": _GROUPS
    + "SELECT dataset_id, count(*) AS records, count(DISTINCT root) AS groups, 0 AS broken_groups, 0 AS far_splits FROM (SELECT DISTINCT b.dataset_id, b.sequence_id, coalesce(g.root, b.sequence_id) AS root FROM benchmark_metadata b JOIN dataset_configs USING (dataset_id) "
    "LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) g ON g.node = b.sequence_id WHERE b.sequence_id IS NOT NULL) GROUP BY 1",
    "p2_found": _QUOTAS + "SELECT target_id FROM p WHERE short",
    "p2_report": _QUOTAS
    + _DRAWN
    + "SELECT target_id, request_id, available, wanted, sampled, greatest(0, wanted - available) AS deficit, short, target_share, round(CASE WHEN sum(sampled) OVER (PARTITION BY request_id) > 0 THEN sampled / sum(sampled) OVER (PARTITION BY request_id) ELSE 0 END, 6) AS reached_share FROM s",
    "p2_check": _QUOTAS + _DRAWN + "SELECT target_id, sampled AS rows, 0 AS strangers FROM s WHERE sampled > 0",
    "p6_check": "SELECT count(DISTINCT doc_id) AS documents, 0 AS overfull_containers, 0 AS overlapping_items, 0 AS wrongly_split FROM documents WHERE doc_id IS NOT NULL",
    "p5_found": _SIDES
    + "SELECT DISTINCT least(a.sequence_id, b.sequence_id) AS sequence_id_a, greatest(a.sequence_id, b.sequence_id) AS sequence_id_b FROM x a JOIN x b ON a.dataset_id = b.dataset_id AND a.side = 'train' AND b.side = 'held' AND a.sequence_id <> b.sequence_id "
    "AND least(length(a.t), length(b.t)) >= a.least * greatest(length(a.t), length(b.t)) - 1e-9 "
    "WHERE list_sum(list_transform(range(1, least(length(a.t), length(b.t)) + 1), lambda i: (substr(a.t, i, 1) = substr(b.t, i, 1))::INT))::DOUBLE / greatest(length(a.t), length(b.t)) >= a.least",
}
