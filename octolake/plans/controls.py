"""Queries of controls, spectra, references and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators import benchmark as B
from octolake.operators import codon as D
from octolake.operators import controls as N
from octolake.operators import models as M
from octolake.operators import sequences as Q
from octolake.operators import statistics as ST
from octolake.plans import analysis as PA
from octolake.plans import sequences as PS
from octolake.plans.common import WINDOW_ID, WINDOW_KEYS, WINDOW_POSITION, neighbours_sql, norm, rounded, Sql, sql6, table, turned, units_sql
from octolake.sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CONTROLS = N.axis_controls(6)


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _moved(side: str, perm: list[int], sign: list[int]) -> list[Sql]:
    return [Sql(f"{side}.e0"), *[Sql(f"({s} * {side}.e{p})") for p, s in zip(perm, sign)]]


@_add(
    "axis_control_transitions",
    f"WITH u AS ({units_sql('window_octonions', WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID)}), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS control, {norm(turned(_moved('x', p, s), _moved('y', p, s)))} AS v {neighbours_sql(WINDOW_KEYS)}" for n, p, s in CONTROLS)
    + f") SELECT control, count(*) AS n_pairs, {sql6('avg(v)', 'mean_score')}, {sql6('max(v)', 'max_score')} FROM c GROUP BY 1",
)
def axis_control_transitions(spark, folder):
    return rounded(N.control_transitions(table(spark, folder, "window_octonions"), WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID, CONTROLS))


@_add("shuffled_pairs", f"WITH {PS._DNA}, p AS (SELECT sequence_id, substr(s, i, 2) AS pair FROM (SELECT sequence_id, s, unnest(range(1, length(s))) AS i FROM d)) SELECT sequence_id, pair, count(*) AS n FROM p GROUP BY ALL")
def shuffled_pairs(spark, folder):
    """Neighbouring pairs of every record after a shuffle that must keep them."""
    rows = N.shuffled(Q.records(table(spark, folder, "fasta_records"), "dna"), "sequence_id", "sequence")
    return Q.units(rows, 2, 1, "pair").groupBy("sequence_id", "pair").agg(F.count(F.lit(1)).alias("n"))


_PLACES = ", ".join(f"('{c}', {i})" for i, c in enumerate(D.CODONS))


@_add("codon_walsh_spectrum", f"WITH {PS._ROWS}, p AS (SELECT * FROM (VALUES {_PLACES}) v(codon, place)), k AS (SELECT sequence_id, frame, place, count(*) AS n FROM r JOIN p ON p.codon = r.codon GROUP BY ALL) SELECT sequence_id, frame, i::INT AS coefficient, {sql6('sum(n * (1 - 2 * (bit_count((i & place)::INT) % 2)))::DOUBLE / sum(n) / 8', 'value')} FROM k, range(64) t(i) GROUP BY sequence_id, frame, i")
def codon_walsh_spectrum(spark, folder):
    return rounded(D.walsh_spectrum(table(spark, folder, "codon_octonions")))


_F = PA._FEATURES
_DOT = lambda f: " + ".join(f.format(c=c) for c in _F)
_VAR = lambda a, b: f"(({_DOT('%s.{c} * %s.{c}' % (a, b))}) - ({_DOT('%s.{c}' % a)}) * ({_DOT('%s.{c}' % b)}) / {len(_F)}.0)"
_FAR = (
    PA._FOLDED
    + f", c AS (SELECT dataset_id, label AS reference, {', '.join(f'avg({c}) AS {c}' for c in _F)} FROM f GROUP BY 1, 2), far AS (SELECT f.dataset_id, f.sequence_id, f.label, c.reference, sqrt({_DOT('power(f.{c} - c.{c}, 2)')}) AS euclidean, {_DOT('abs(f.{c} - c.{c})')} AS manhattan, "
    + f"CASE WHEN ({_DOT('f.{c} * f.{c}')}) > 0 AND ({_DOT('c.{c} * c.{c}')}) > 0 THEN 1 - ({_DOT('f.{c} * c.{c}')}) / sqrt(({_DOT('f.{c} * f.{c}')}) * ({_DOT('c.{c} * c.{c}')})) ELSE 1 END AS cosine, "
    + f"CASE WHEN {_VAR('f', 'f')} < 1e-12 OR {_VAR('c', 'c')} < 1e-12 THEN 1 ELSE 1 - {_VAR('f', 'c')} / sqrt({_VAR('f', 'f')} * {_VAR('c', 'c')}) END AS correlation FROM f JOIN c ON c.dataset_id = f.dataset_id) "
)
_DISTANCES = ("euclidean", "manhattan", "cosine", "correlation")


def _label_distances(spark, folder):
    rows = cut(PA._fold_features(spark, folder), "folded")
    means = rows.groupBy("dataset_id", F.col("label").alias("reference")).agg(*[F.avg(c).alias(c) for c in _F])
    return rows, N.reference_distances(rows, "sequence_id", means, "reference", _F, ["dataset_id"])


@_add("label_distances", _FAR + f"SELECT dataset_id, sequence_id, reference, {', '.join(sql6(d, d) for d in _DISTANCES)} FROM far")
def label_distances(spark, folder):
    """Four distances of every labelled record to the mean of each label of its data set."""
    return rounded(_label_distances(spark, folder)[1])


@_add("distance_summary", _FAR + " UNION ALL ".join(f"SELECT dataset_id, label = reference AS own, '{d}' AS distance, count(*) AS n, {sql6(f'avg({d})', 'mean')}, {sql6(f'quantile_cont({d}, 0.5)', 'median')}, {sql6(f'min({d})', 'least')}, {sql6(f'max({d})', 'greatest')} FROM far GROUP BY 1, 2" for d in _DISTANCES))
def distance_summary(spark, folder):
    """Each distance to the own label's mean and to the other labels', by data set."""
    rows, far = _label_distances(spark, folder)
    marked = far.join(rows.select("dataset_id", "sequence_id", "label"), ["dataset_id", "sequence_id"]).withColumn("own", F.col("label") == F.col("reference"))
    return rounded(ST.value_summary(marked, ["dataset_id", "own"], list(_DISTANCES), "distance"))


def _fitted(model: str):
    def query(spark, folder):
        rows = PA._fold_features(spark, folder)
        return rounded(B.fold_metrics(M.cross_validated(rows, "sequence_id", "label", "fold", _F, model, by=["dataset_id"]), "label", "fold", ["dataset_id"]))

    return query


for _name in ("logistic", "tree"):
    _add(f"kfold_{_name}")(_fitted(_name))


@_add("cluster_agreement")
def cluster_agreement(spark, folder):
    """How k-means clusters of the shares agree with the labels of each data set, and how well they are parted."""
    rows = cut(PA._fold_features(spark, folder), "folded")
    found = M.clustered(rows, "sequence_id", _F, 4, by=["dataset_id"])
    both = found.join(rows.select("dataset_id", "sequence_id", "label"), ["dataset_id", "sequence_id"])
    width = found.groupBy("dataset_id").agg(F.max("silhouette").alias("silhouette"))
    return rounded(M.agreement(both, "cluster", "label", ["dataset_id"]).join(width, "dataset_id"))
