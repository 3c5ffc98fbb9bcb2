"""Queries of statistics, features, folds, context and groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.functions import sequence as S
from octolake.operators import benchmark as B
from octolake.operators import context as X
from octolake.operators import controls as N
from octolake.operators import models as M
from octolake.operators import sequences as Q
from octolake.operators import statistics as ST
from octolake.operators import trajectory as T
from octolake.plans import sequences as PS
from octolake.plans import trajectories as PT
from octolake.plans.common import WINDOW_ID, WINDOW_KEYS, WINDOW_POSITION, neighbours_sql, r6, rounded, sql6, table, units_sql
from octolake.sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BINS, FOLDS, PROJECTED, RESAMPLES = 5, 5, 4, 199
TRACKS = ["view", "click", "purchase", "error", "signup"]


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _h(cols: str) -> str:
    return f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM r GROUP BY {cols}))"


_SETS = {"h_x": "label", "h_y": "chromosome", "h_z": "gc_bin", "h_xy": "label, chromosome", "h_xz": "label, gc_bin", "h_yz": "chromosome, gc_bin", "h_xyz": "label, chromosome, gc_bin"}


@_add(
    "label_information",
    "WITH r AS (SELECT DISTINCT * FROM coding_metadata WHERE label IS NOT NULL AND chromosome IS NOT NULL AND gc_bin IS NOT NULL), h AS (SELECT "
    + ", ".join(f"{_h(c)} AS {n}" for n, c in _SETS.items())
    + ") SELECT "
    + ", ".join(sql6(n, n) for n in _SETS)
    + f", {sql6('h_x + h_y - h_xy', 'mi_xy')}, {sql6('h_xz + h_yz - h_z - h_xyz', 'cmi_xy_z')}, {sql6('(h_x + h_y - h_xy) - (h_xz + h_yz - h_z - h_xyz)', 'interaction')}, {sql6('h_x + h_y + h_z - h_xyz', 'total_correlation')} FROM h",
)
def label_information(spark, folder):
    return rounded(ST.information(table(spark, folder, "coding_metadata").distinct(), "label", "chromosome", "gc_bin"))


_EDGES = ", ".join(f"quantile_cont(gc_content, {i / BINS}) AS q{i}" for i in range(1, BINS))


@_add(
    "gc_quantile_bins",
    f"WITH r AS (SELECT DISTINCT window_id, gc_content FROM window_octonions WHERE window_id IS NOT NULL), e AS (SELECT min(gc_content) AS lo, {_EDGES} FROM r), "
    + "c AS (SELECT DISTINCT cut FROM e, unnest([" + ", ".join(f"q{i}" for i in range(1, BINS)) + "]) t(cut) WHERE cut > lo) "
    "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN gc_content IS NOT NULL THEN (SELECT count(*) FROM c WHERE cut < gc_content) END AS bin FROM r) GROUP BY bin",
)
def gc_quantile_bins(spark, folder):
    rows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", "gc_content").dropDuplicates(["window_id"])
    return ST.quantile_bins(rows, "gc_content", BINS).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_RANK = "count(*) OVER (PARTITION BY {c})"


@_add(
    "entropy_gc_rank_correlation",
    "WITH r AS (SELECT DISTINCT window_id, mono_entropy AS x, gc_content AS y FROM window_octonions WHERE window_id IS NOT NULL AND mono_entropy IS NOT NULL AND gc_content IS NOT NULL), "
    "k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM r) "
    f"SELECT count(*) AS n, {sql6('corr(rx, ry)', 'spearman')} FROM k",
)
def entropy_gc_rank_correlation(spark, folder):
    return rounded(ST.rank_correlation(table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()), "window_id", "mono_entropy", "gc_content"))


_ROWS = "r AS (SELECT DISTINCT window_id, " + ", ".join(O.AXES) + " FROM window_octonions WHERE window_id IS NOT NULL AND " + " AND ".join(f"{e} IS NOT NULL" for e in O.AXES) + ")"


def _windows(spark, folder):
    return table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", *O.AXES).dropna().dropDuplicates(["window_id"])


@_add("component_correlations", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {sql6(f'corr({a}, {b})', 'correlation')} FROM r" for a, b in combinations(O.AXES, 2)))
def component_correlations(spark, folder):
    return rounded(ST.correlations(_windows(spark, folder), list(O.AXES)))


@_add("component_quality", "WITH r AS (SELECT DISTINCT window_id, " + ", ".join(O.AXES) + " FROM window_octonions WHERE window_id IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{e}' AS \"column\", count({e}) AS n, count(*) - count({e}) AS n_null, {sql6(f'avg({e})', 'mean')}, {sql6(f'var_pop({e})', 'variance')}, var_pop({e}) < 1e-10 AS constant FROM r" for e in O.AXES))
def component_quality(spark, folder):
    rows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", *O.AXES).dropDuplicates(["window_id"])
    return rounded(ST.column_quality(rows, list(O.AXES)))


_LABEL = r"CASE WHEN regexp_replace(lower(label), '[\s-]+', '', 'g') = 'coding' THEN 'coding' WHEN regexp_replace(lower(label), '[\s-]+', '', 'g') = 'noncoding' THEN 'noncoding' END"
_LABELS = f"l AS (SELECT sequence_id, min({_LABEL}) AS y FROM coding_metadata WHERE sequence_id IS NOT NULL GROUP BY 1)"
_SIDE = lambda g, e: f"(CASE WHEN y = '{g}' THEN {e} END)"


def _labels(spark, folder):
    bare = F.regexp_replace(F.lower("label"), r"[\s-]+", "")
    return table(spark, folder, "coding_metadata").where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(F.min(F.when(bare.isin("coding", "noncoding"), bare)).alias("y"))


def _test_sql(e: str) -> str:
    a, b = _SIDE("coding", e), _SIDE("noncoding", e)
    z = f"(avg({a}) - avg({b})) / nullif(sqrt(var_samp({a}) / count({a}) + var_samp({b}) / count({b})), 0)"
    return f"SELECT '{e}' AS \"column\", avg({a}) AS mean_first, avg({b}) AS mean_second, {z} AS z FROM r"


@_add(
    "component_tests",
    f"WITH {_LABELS}, r AS (SELECT DISTINCT window_id, y, {', '.join('w.' + e for e in O.AXES)} FROM window_octonions w JOIN l ON l.sequence_id = w.sequence_id WHERE window_id IS NOT NULL), t AS ({' UNION ALL '.join(map(_test_sql, O.AXES))}), "
    "p AS (SELECT *, least(1.0, 2.0 / (1.0 + exp(least(0.07056 * abs(z) * abs(z) * abs(z) + 1.5976 * abs(z), 700.0)))) AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p, \"column\") AS i, count(*) OVER () AS n FROM p WHERE p IS NOT NULL), "
    "q AS (SELECT *, least(1.0, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k) "
    f"SELECT \"column\", {', '.join(sql6(c, c) for c in ('mean_first', 'mean_second', 'z', 'p', 'q'))} FROM q",
)
def component_tests(spark, folder):
    windows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", "sequence_id", *O.AXES)
    rows = windows.join(_labels(spark, folder), "sequence_id").dropDuplicates(["window_id"])
    return rounded(ST.mean_tests(rows, "y", "coding", "noncoding", list(O.AXES)))


_POLY = [(f"{n}_{a}", x) for a in O.AXES for n, x in (("mean", a), ("square", f"{a} * {a}"), ("cube", f"{a} * {a} * {a}"))] + [(f"product_{a}_{b}", f"{a} * {b}") for a, b in combinations(O.AXES, 2)]
_POLY_ROWS = "r AS (SELECT DISTINCT window_id, sequence_id, " + ", ".join(O.AXES) + " FROM window_octonions WHERE window_id IS NOT NULL AND sequence_id IS NOT NULL AND " + " AND ".join(f"{e} IS NOT NULL" for e in O.AXES) + ")"


@_add("polynomial_features", f"WITH {_POLY_ROWS} SELECT sequence_id, {', '.join(sql6(f'avg({x})', n) for n, x in _POLY)} FROM r GROUP BY 1")
def polynomial_features(spark, folder):
    return rounded(B.polynomial_features(table(spark, folder, "window_octonions"), ["sequence_id"], "window_id"))


_WEIGHTS = ST.projection_weights(len(_POLY), PROJECTED)


@_add("random_projection", f"WITH {_POLY_ROWS}, p AS (SELECT sequence_id, {', '.join(f'avg({x}) AS {n}' for n, x in _POLY)} FROM r GROUP BY 1) SELECT sequence_id, " + ", ".join(sql6(" + ".join(f"({float(_WEIGHTS[i, j])!r}) * {n}" for i, (n, _) in enumerate(_POLY)), f"proj_{j}") for j in range(PROJECTED)) + " FROM p")
def random_projection(spark, folder):
    rows = B.polynomial_features(table(spark, folder, "window_octonions"), ["sequence_id"], "window_id")
    return rounded(ST.project(rows, ["sequence_id"], [n for n, _ in _POLY], PROJECTED))


_TERMS = [(f"w_{a}_{b}", f"x.e{a} * y.e{b} - x.e{b} * y.e{a}") for a, b in combinations(range(1, 8), 2)]
_K = ", ".join(WINDOW_KEYS)
_DENSE = f"WITH v AS ({units_sql('window_octonions', WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID)}), u AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY {_K} ORDER BY pos) - 1 AS pos FROM v)"


@_add("antisymmetric_features", f"{_DENSE}, t AS (SELECT {', '.join('x.' + k for k in WINDOW_KEYS)}, {', '.join(f'{e} AS {n}' for n, e in _TERMS)} {neighbours_sql(WINDOW_KEYS)}) SELECT {_K}, " + ", ".join(sql6(f"{f}({n})", f"{s}_{n}") for n, _ in _TERMS for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + f" FROM t GROUP BY {_K}")
def antisymmetric_features(spark, folder):
    return rounded(B.antisymmetric_features(table(spark, folder, "window_octonions"), WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID))


@_add("line_stability")
def line_stability(spark, folder):
    products = T.adjacent_products(table(spark, folder, "window_octonions"), WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID)
    return rounded(B.line_stability(products, WINDOW_KEYS, WINDOW_POSITION))


_FP = ["mean_transition", "max_transition", "mean_associator", "max_associator"]
_CODON = ["n_codons", "codon_entropy", "stop_density", "gc1", "gc2", "gc3"]


@_add(
    "sequence_fingerprints",
    f"WITH w AS (SELECT sequence_id, sum(n_units) AS n, {', '.join(f'max({c}) AS {c}' for c in _FP)} FROM ({PT.SQL['window_summary']}) GROUP BY 1), c AS (SELECT sequence_id, {', '.join(f'avg({c}) AS {c}' for c in _CODON)} FROM ({PS.SQL['codon_summary']}) GROUP BY 1) "
    f"SELECT coalesce(w.sequence_id, c.sequence_id) AS sequence_id, coalesce(n, 0) AS window_units, {', '.join(sql6(f'coalesce({c}, 0)', f'window_{c}') for c in _FP)}, {', '.join(sql6(f'coalesce({c}, 0)', f'codon_{c}') for c in _CODON)} FROM w FULL JOIN c ON w.sequence_id = c.sequence_id",
)
def sequence_fingerprints(spark, folder):
    """Window and codon summaries of a sequence side by side, 0 where one is missing."""
    w = PT.window_summary(spark, folder).groupBy("sequence_id").agg(F.sum("n_units").alias("window_units"), *[F.max(c).alias(f"window_{c}") for c in _FP])
    c = PS.codon_summary(spark, folder).groupBy("sequence_id").agg(*[F.avg(x).alias(f"codon_{x}") for x in _CODON])
    both = w.join(c, "sequence_id", "full").fillna(0, subset=["window_units"])
    names = [f"window_{x}" for x in _FP] + [f"codon_{x}" for x in _CODON]
    return both.fillna(0.0, subset=names).select("sequence_id", "window_units", *[r6(n) for n in names])


_PAIRS = [f"kmer_{w}" for w in PS._WORDS]
_SHARES = [f"share_{r}" for r in S.RESIDUES]
_FEATURES = _PAIRS + _SHARES
#: Nested sets of features, from the least to all of them.
LADDER = {"gc": ["kmer_GC", "kmer_CG", "kmer_GG", "kmer_CC"], "pairs": _PAIRS, "all": _FEATURES}
_GROUP = r"coalesce(nullif(regexp_replace(lower(species_or_subject), '[\s_-]+', '', 'g'), ''), sequence_id)"
_DATASET = ["dataset_id"]


def _labelled(spark, folder):
    """(dataset_id, sequence_id, label, g): one row for each labelled record of each data set, with its subject as group."""
    meta = table(spark, folder, "benchmark_metadata").where(F.col("dataset_id").isNotNull() & F.col("sequence_id").isNotNull())
    bare = F.regexp_replace(F.lower("species_or_subject"), r"[\s_-]+", "")
    one = meta.groupBy("dataset_id", "sequence_id").agg(F.min("label").alias("label"), F.min(F.coalesce(F.when(bare != "", bare), F.col("sequence_id"))).alias("g"))
    return one.where(F.col("label").isNotNull())


def _features(spark, folder):
    """One row per record: shares of pairs for DNA, of residues for protein, 0 for those of the other kind."""
    records = table(spark, folder, "fasta_records")
    dna = Q.kmer_matrix(Q.records(records, "dna"), 2).select("sequence_id", *_PAIRS, *[F.lit(0.0).alias(c) for c in _SHARES])
    protein = Q.composition(Q.records(records, "protein")).select("sequence_id", *[F.lit(0.0).alias(c) for c in _PAIRS], *_SHARES)
    return dna.unionByName(protein)


def _fold_features(spark, folder):
    """The features of every labelled record of every data set, with its label, and its fold by subject."""
    return _features(spark, folder).join(_labelled(spark, folder), "sequence_id").withColumn("fold", B.fold_of(F.col("g"), FOLDS))


def _plain(sql: str) -> str:
    """A statement without its rounding."""
    return sql.replace("round((", "((").replace(") + 3.7e-13, 6)", "))")


_M = f"m AS (SELECT dataset_id, sequence_id, min(label) AS label, min({_GROUP}) AS g FROM benchmark_metadata WHERE dataset_id IS NOT NULL AND sequence_id IS NOT NULL GROUP BY 1, 2 HAVING min(label) IS NOT NULL)"
_XF = f"x AS (SELECT sequence_id, {', '.join(_PAIRS)}, {', '.join(f'0.0::DOUBLE AS {c}' for c in _SHARES)} FROM ({_plain(PS.SQL['kmer_matrix'])}) UNION ALL SELECT sequence_id, {', '.join(f'0.0::DOUBLE AS {c}' for c in _PAIRS)}, {', '.join(_SHARES)} FROM ({_plain(PS.SQL['residue_composition'])}))"
_FOLD_SQL = f"(('0x' || substr(md5(g), 1, 8))::BIGINT % {FOLDS})::INT"
_FOLDED = f"WITH {_M}, {_XF}, f AS (SELECT x.*, m.dataset_id, label, g, {_FOLD_SQL} AS fold FROM x JOIN m ON m.sequence_id = x.sequence_id) "


def _centroids_sql(columns: list[str], source: str = "f", tag: str = "") -> str:
    """Predictions p and metrics z (with a suffix) of nearest centroids of the other folds."""
    gap = " + ".join(f"power(f.{c} - c.{c}, 2)" for c in columns)
    return (
        f", c{tag} AS (SELECT k.dataset_id, k.fold, f.label, {', '.join(f'avg(f.{c}) AS {c}' for c in columns)} FROM {source} f JOIN (SELECT DISTINCT dataset_id, fold FROM {source}) k ON k.dataset_id = f.dataset_id AND k.fold <> f.fold GROUP BY 1, 2, 3), "
        f"p{tag} AS (SELECT f.dataset_id, f.sequence_id, f.fold, f.label, min(struct_pack(d := {gap}, l := c.label)).l AS predicted FROM {source} f JOIN c{tag} c ON c.dataset_id = f.dataset_id AND c.fold = f.fold GROUP BY 1, 2, 3, 4), "
        f"t{tag} AS (SELECT dataset_id, fold, label AS l, count(*) AS held, sum((label = predicted)::INT) AS hit FROM p{tag} GROUP BY 1, 2, 3), s{tag} AS (SELECT dataset_id, fold, predicted AS l, count(*) AS said FROM p{tag} GROUP BY 1, 2, 3), "
        f"b{tag} AS (SELECT coalesce(t.dataset_id, s.dataset_id) AS dataset_id, coalesce(t.fold, s.fold) AS fold, coalesce(held, 0)::DOUBLE AS held, coalesce(hit, 0)::DOUBLE AS hit, coalesce(said, 0)::DOUBLE AS said FROM t{tag} t FULL JOIN s{tag} s ON t.dataset_id = s.dataset_id AND t.fold = s.fold AND t.l = s.l), "
        f"z{tag} AS (SELECT dataset_id, fold, sum(held)::BIGINT AS n, sum(hit) / sum(held) AS accuracy, avg(CASE WHEN held > 0 THEN hit / held END) AS balanced_accuracy, avg(2 * hit / (held + said)) AS macro_f1, "
        "CASE WHEN (sum(held) * sum(held) - sum(held * held)) * (sum(held) * sum(held) - sum(said * said)) > 0 THEN (sum(held) * sum(hit) - sum(held * said)) / sqrt((sum(held) * sum(held) - sum(held * held)) * (sum(held) * sum(held) - sum(said * said))) ELSE 0 END AS mcc "
        f"FROM b{tag} GROUP BY 1, 2)"
    )


_KFOLD = _FOLDED + _centroids_sql(_FEATURES)
_METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "mcc"]


def _centroid_metrics(rows, columns=None):
    predictions = B.centroid_predictions(rows, "sequence_id", "label", "fold", columns or _FEATURES, _DATASET)
    return B.fold_metrics(predictions, "label", "fold", _DATASET)


@_add("kfold_metrics", _KFOLD + f" SELECT dataset_id, fold, n, {', '.join(sql6(c, c) for c in _METRICS)} FROM z")
def kfold_metrics(spark, folder):
    return rounded(_centroid_metrics(_fold_features(spark, folder)))


@_add("kfold_summary", _KFOLD + " " + " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS metric, count({c}) AS n_folds, {sql6(f'avg({c})', 'mean')}, {sql6(f'coalesce(stddev_samp({c}), 0)', 'sd')}, {sql6(f'1.96 * coalesce(stddev_samp({c}), 0) / sqrt(count({c}))', 'half_interval')} FROM z GROUP BY 1" for c in _METRICS))
def kfold_summary(spark, folder):
    return rounded(B.metric_summary(_centroid_metrics(_fold_features(spark, folder)), _METRICS, _DATASET))


_TEXT = "concat_ws('|', '7', r::VARCHAR, fold::VARCHAR)"
_U = f"(('0x' || substr(md5({_TEXT}), 1, 8))::BIGINT / 4294967296.0)::DOUBLE"
_STEPS, _TERM = [], 0.36787944117144233
for _k in range(8):
    _STEPS.append((_STEPS[-1] if _STEPS else 0.0) + _TERM)
    _TERM /= _k + 1
_COMPARED = (
    f", d AS (SELECT a.dataset_id, a.fold, a.balanced_accuracy - b.balanced_accuracy AS d FROM z a JOIN z_gc b ON a.dataset_id = b.dataset_id AND a.fold = b.fold), "
    f"w AS (SELECT dataset_id, r, d, {' + '.join(f'({_U} > {c!r})::INT' for c in _STEPS)} AS w, CASE WHEN (('0x' || substr(md5('s' || {_TEXT}), 1, 2))::BIGINT % 2) = 0 THEN 1.0 ELSE -1.0 END AS s FROM d, range(1, {RESAMPLES} + 1) t(r)), "
    "e AS (SELECT dataset_id, r, avg(s * d) AS flipped, CASE WHEN sum(w) > 0 THEN sum(w * d) / sum(w) END AS mean FROM w GROUP BY 1, 2), "
    "h AS (SELECT dataset_id, count(*) AS n, avg(d) AS mean_difference, stddev_samp(d) AS sd FROM d GROUP BY 1) "
    f"SELECT h.dataset_id, n, {sql6('mean_difference', 'mean_difference')}, {sql6('sd', 'sd')}, {sql6('CASE WHEN sd > 1e-12 THEN mean_difference / sd END', 'dz')}, {sql6(f'(1 + sum((abs(flipped) >= abs(mean_difference) - 1e-12)::INT)) / {1.0 + RESAMPLES}', 'p_sign')}, {sql6('quantile_cont(mean, 0.025)', 'low')}, {sql6('quantile_cont(mean, 0.975)', 'high')} "
    "FROM e JOIN h ON h.dataset_id = e.dataset_id GROUP BY h.dataset_id, n, mean_difference, sd"
)


@_add("kfold_paired_comparison", _KFOLD + _centroids_sql(LADDER["gc"], "f", "_gc") + _COMPARED)
def kfold_paired_comparison(spark, folder):
    """All features against those of GC pairs alone, on the same folds of every data set."""
    rows = cut(_fold_features(spark, folder), "folded")
    return rounded(B.paired_comparison(_centroid_metrics(rows), _centroid_metrics(rows, LADDER["gc"]), _DATASET, "fold", "balanced_accuracy", RESAMPLES))


@_add(
    "ablation_table",
    _FOLDED
    + "".join(_centroids_sql(c, "f", f"_{n}") for n, c in LADDER.items())
    + ", g AS ("
    + " UNION ALL ".join(f"SELECT dataset_id, {i} AS stage, '{n}' AS features, avg(balanced_accuracy) AS score FROM z_{n} GROUP BY 1" for i, n in enumerate(LADDER))
    + f") SELECT dataset_id, stage, features, {sql6('score', 'score')}, {sql6('score - lag(score) OVER (PARTITION BY dataset_id ORDER BY stage)', 'increment')} FROM g",
)
def ablation_table(spark, folder):
    """Mean balanced accuracy of nested sets of features on the same folds, and what each stage adds."""
    rows = cut(_fold_features(spark, folder), "folded")
    stages = [_centroid_metrics(rows, c).groupBy("dataset_id").agg(F.avg("balanced_accuracy").alias("score")).select("dataset_id", F.lit(i).alias("stage"), F.lit(n).alias("features"), "score") for i, (n, c) in enumerate(LADDER.items())]
    both = reduce(lambda a, b: a.unionByName(b), stages)
    return rounded(both.withColumn("increment", F.col("score") - F.lag("score").over(Window.partitionBy("dataset_id").orderBy("stage"))))


_PLACE = lambda text: f"row_number() OVER (PARTITION BY dataset_id ORDER BY md5({text}), {text})"
_NULL_F = f", pf AS (SELECT * EXCLUDE (label), {_PLACE('sequence_id')} AS place FROM f), pl AS (SELECT dataset_id, label, {_PLACE(chr(39) + '1|' + chr(39) + ' || sequence_id')} AS place FROM f), fn AS (SELECT pf.* EXCLUDE (place), pl.label FROM pf JOIN pl ON pl.dataset_id = pf.dataset_id AND pl.place = pf.place)"


@_add("null_label_metrics", _FOLDED + _NULL_F + _centroids_sql(_FEATURES, "fn", "_n") + f" SELECT dataset_id, fold, n, {', '.join(sql6(c, c) for c in _METRICS)} FROM z_n")
def null_label_metrics(spark, folder):
    """The metrics of the same folds with labels in another order: what no relation between features and labels gives."""
    rows = cut(_fold_features(spark, folder), "folded")
    return rounded(_centroid_metrics(B.permuted_labels(rows, _DATASET, "sequence_id", "label", 1)))


_STRATA = (
    f"WITH {_M}, n AS (SELECT dataset_id, g, label, count(*) AS n FROM m GROUP BY ALL), q AS (SELECT dataset_id, g, min(struct_pack(n := -n, l := label)).l AS l, floor(log2(sum(n)) + 1e-9)::INT AS s FROM n GROUP BY 1, 2), "
    f"d AS (SELECT dataset_id, g, ((row_number() OVER (PARTITION BY dataset_id, l, s ORDER BY md5(g), g) - 1) % {FOLDS})::INT AS fold FROM q) "
)


@_add("stratified_folds", _STRATA + "SELECT m.dataset_id, d.fold, m.label, count(*) AS records, count(DISTINCT m.g) AS groups FROM m JOIN d ON d.dataset_id = m.dataset_id AND d.g = m.g GROUP BY ALL")
def stratified_folds(spark, folder):
    """Records and groups of every label in folds that keep subjects whole and labels even."""
    rows = B.stratified_group_folds(_labelled(spark, folder), _DATASET, "sequence_id", "g", "label", FOLDS, strict=False)
    return rows.groupBy("dataset_id", "fold", "label").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("g").alias("groups"))


@_add(
    "label_ranking_scores",
    _FOLDED
    + f", c AS (SELECT dataset_id, label, {', '.join(f'avg({c}) AS {c}' for c in _FEATURES)} FROM f GROUP BY 1, 2), e AS (SELECT f.dataset_id, c.label AS reference, (f.label = c.label)::INT AS y, -round(sqrt({' + '.join(f'power(f.{c} - c.{c}, 2)' for c in _FEATURES)}), 9) AS s FROM f JOIN c ON c.dataset_id = f.dataset_id), "
    "k AS (SELECT dataset_id, reference, s, sum(y) AS p, sum(1 - y) AS q FROM e GROUP BY 1, 2, 3), r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM k WINDOW w AS (PARTITION BY dataset_id, reference ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    f"SELECT dataset_id, reference, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, {sql6('CASE WHEN sum(p) * sum(q) > 0 THEN sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)) END', 'roc_auc')}, {sql6('CASE WHEN sum(p) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END', 'pr_auc')} FROM r GROUP BY 1, 2",
)
def label_ranking_scores(spark, folder):
    """How well the distance to a label's mean ranks that label's records before the others, for each label of a data set."""
    rows = cut(_fold_features(spark, folder), "folded")
    means = rows.groupBy("dataset_id", F.col("label").alias("reference")).agg(*[F.avg(c).alias(c) for c in _FEATURES])
    far = N.reference_distances(rows.withColumn("_id", F.struct("sequence_id", "label")), "_id", means, "reference", _FEATURES, _DATASET)
    scored = far.select("dataset_id", "reference", (-F.round("euclidean", 9)).alias("s"), (F.col("_id.label") == F.col("reference")).alias("y"))
    return rounded(B.ranking_scores(scored, ["dataset_id", "reference"], "s", "y"))


@_add(
    "kfold_line",
    _FOLDED
    + f", y AS (SELECT sequence_id, max(length(s))::DOUBLE AS y FROM ({PS._CLEAN}) WHERE s <> '' GROUP BY 1), l AS (SELECT f.dataset_id, f.sequence_id, f.fold, f.kmer_CG AS x, y.y FROM f JOIN y ON y.sequence_id = f.sequence_id), "
    "o AS (SELECT dataset_id, fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM l GROUP BY 1, 2), t AS (SELECT dataset_id, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM o GROUP BY 1), "
    "b AS (SELECT o.dataset_id, o.fold, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM o JOIN t ON t.dataset_id = o.dataset_id), "
    "p AS (SELECT l.*, sy / n + CASE WHEN n * sxx - sx * sx > 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END * (x - sx / n) AS p FROM l JOIN b ON b.dataset_id = l.dataset_id AND b.fold = l.fold) "
    f"SELECT dataset_id, fold, count(*) AS n, {sql6('CASE WHEN var_pop(y) > 1e-12 THEN 1 - avg((y - p) * (y - p)) / var_pop(y) END', 'r2')}, {sql6('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {sql6('avg(abs(y - p))', 'mae')} FROM p WHERE p IS NOT NULL GROUP BY 1, 2",
)
def kfold_line(spark, folder):
    """Length of a record from its share of CG pairs, by the line of the other folds."""
    length = Q.records(table(spark, folder, "fasta_records")).groupBy("sequence_id").agg(F.max(F.length("sequence")).cast("double").alias("length"))
    rows = _fold_features(spark, folder).select("dataset_id", "sequence_id", "fold", "kmer_CG").join(length, "sequence_id")
    return rounded(B.regression_metrics(M.line_predictions(rows, "sequence_id", "length", "fold", "kmer_CG", _DATASET), ["dataset_id", "fold"], "length", "predicted"))


@_add("kfold_ridge")
def kfold_ridge(spark, folder):
    """Length of a record from all its shares, by ridge regression on the other folds."""
    length = Q.records(table(spark, folder, "fasta_records")).groupBy("sequence_id").agg(F.max(F.length("sequence")).cast("double").alias("length"))
    rows = _fold_features(spark, folder).join(length, "sequence_id")
    found = M.cross_validated_values(rows, "sequence_id", "length", "fold", _FEATURES, "ridge", by=_DATASET)
    return rounded(B.regression_metrics(found, ["dataset_id", "fold"], "length", "predicted"))


@_add(
    "assigned_clusters",
    "WITH c AS (SELECT sequence_id, min(homology_cluster) AS c, count(DISTINCT homology_cluster) AS k FROM homology_clusters WHERE homology_cluster IS NOT NULL GROUP BY 1) "
    "SELECT i.sequence_id, coalesce(c, 'singleton__' || i.sequence_id) AS homology_cluster, c IS NOT NULL AS assigned, coalesce(k, 0) > 1 AS conflicts FROM (SELECT DISTINCT sequence_id FROM benchmark_metadata WHERE sequence_id IS NOT NULL) i LEFT JOIN c ON c.sequence_id = i.sequence_id",
)
def assigned_clusters(spark, folder):
    return X.assigned_clusters(table(spark, folder, "benchmark_metadata"), table(spark, folder, "homology_clusters"))


_SPLIT = r"CASE WHEN lower(regexp_replace(split, '\s+', '', 'g')) = 'val' THEN 'validation' ELSE lower(regexp_replace(split, '\s+', '', 'g')) END"


@_add("group_leakage", f"SELECT dataset_id, split_group, count(DISTINCT s) AS n_splits, count(DISTINCT sequence_id) AS records FROM (SELECT dataset_id, split_group, sequence_id, {_SPLIT} AS s FROM benchmark_splits WHERE split IS NOT NULL AND split_group IS NOT NULL) GROUP BY 1, 2 HAVING count(DISTINCT s) > 1")
def group_leakage(spark, folder):
    return X.group_leakage(table(spark, folder, "benchmark_splits"))


@_add(
    "dataset_composition",
    f"WITH d AS ({PS._CLEAN} AND regexp_replace(sequence, '\\s+', '', 'g') <> ''), n AS (SELECT sequence_id, max(length(s)) AS len FROM d GROUP BY 1) "
    f"SELECT dataset_id, label, count(*) AS sequences, sum((len IS NULL)::INT) AS without_record, min(len) AS min_length, {sql6('avg(len)', 'mean_length')}, max(len) AS max_length FROM (SELECT DISTINCT dataset_id, label, sequence_id FROM benchmark_metadata WHERE sequence_id IS NOT NULL) m LEFT JOIN n ON n.sequence_id = m.sequence_id GROUP BY 1, 2",
)
def dataset_composition(spark, folder):
    return rounded(X.composition_of(table(spark, folder, "benchmark_metadata"), Q.records(table(spark, folder, "fasta_records"))))


_CTX = ("genome_build", "chromosome", "strand", "feature_type")


@_add(
    "windows_in_context",
    f"WITH c AS (SELECT sequence_id, {', '.join(f'min({c}) AS {c}' for c in _CTX)} FROM genomic_context WHERE start_pos >= 0 AND start_pos < end_pos AND strand IN ('+', '-', '.') GROUP BY 1) "
    f"SELECT {', '.join(_CTX)}, count(*) AS windows FROM (SELECT DISTINCT window_id, sequence_id FROM window_octonions WHERE window_id IS NOT NULL) w LEFT JOIN c ON c.sequence_id = w.sequence_id GROUP BY {', '.join(_CTX)}",
)
def windows_in_context(spark, folder):
    rows = X.in_context(table(spark, folder, "window_octonions"), "window_id", table(spark, folder, "genomic_context"))
    return rows.groupBy(*_CTX).agg(F.count(F.lit(1)).alias("windows"))


@_add("event_tracks", "SELECT user_id, CAST(ts AS DATE) AS \"day\", " + ", ".join(sql6(f"coalesce(sum(value) FILTER (event_type = '{t}'), 0)", f"track_{t}") for t in TRACKS) + f" FROM events WHERE event_type IN ({', '.join(repr(t) for t in TRACKS)}) GROUP BY 1, 2")
def event_tracks(spark, folder):
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return rounded(X.track_pivot(rows, ["user_id", "day"], "event_type", "value", TRACKS))
