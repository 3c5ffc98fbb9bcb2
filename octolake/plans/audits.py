"""Queries of k-mer and codon tables, geometry, redundancy, information, soundness and further controls."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.functions import sequence as S
from octolake.operators import benchmark as B
from octolake.operators import codon as D
from octolake.operators import context as X
from octolake.operators import controls as N
from octolake.operators import sequences as Q
from octolake.operators import statistics as ST
from octolake.operators import trajectory as T
from octolake.operators.skew import skew_join
from octolake.plans import analysis as PA
from octolake.plans import sequences as PS
from octolake.plans import trajectories as PT
from octolake.plans.common import CODON_ID, CODON_KEYS, CODON_POSITION, WINDOW_ID, WINDOW_KEYS, WINDOW_POSITION, Sql, neighbours_sql, norm, parts, rounded, sql6, table, turned, units_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W, C = (WINDOW_KEYS, WINDOW_POSITION, WINDOW_ID), (CODON_KEYS, CODON_POSITION, CODON_ID)
SPACE_K, PER_LABEL, PER_PARENT, MATRICES = 3, 50, 2, 3
RESIDUE_LETTERS = "".join(S.RESIDUES)


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _records(spark, folder, kind):
    return Q.records(table(spark, folder, "fasta_records"), kind)


def _entropy_sql(kind: str, k: int, size: int, valid: str) -> str:
    units = PS._UNITS.format(w=k, step=1)
    return (
        f"SELECT '{kind}' AS alphabet, {k} AS k, i.sequence_id, coalesce(total, 0)::BIGINT AS n_kmers, {sql6(f'coalesce(greatest(0, log2(total) - nlogn / total) / ({k} * log2({size})), 0)', 'entropy')} FROM (SELECT DISTINCT sequence_id FROM d) i LEFT JOIN ("
        f"SELECT sequence_id, sum(n) AS total, sum(n * log2(n)) AS nlogn FROM (SELECT sequence_id, u, count(*) AS n FROM ({units}) WHERE regexp_full_match(u, '[{valid}]+') GROUP BY ALL) GROUP BY 1) g ON g.sequence_id = i.sequence_id"
    )


_KINDS = (("dna", 2, S.BASES, PS._DNA), ("dna", 3, S.BASES, PS._DNA), ("protein", 2, RESIDUE_LETTERS, PS._PROTEIN))


@_add("kmer_entropies", " UNION ALL ".join(f"SELECT * FROM (WITH {source} {_entropy_sql(kind, k, len(a), a)})" for kind, k, a, source in _KINDS))
def kmer_entropies(spark, folder):
    """Normalised entropies of the k-mers of every DNA and protein record."""
    out = None
    for kind, k, alphabet, _ in _KINDS:
        rows = Q.kmer_entropies(_records(spark, folder, kind), k, alphabet).select(F.lit(kind).alias("alphabet"), F.lit(k).alias("k"), "sequence_id", "n_kmers", "entropy")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


_CELLS = [(w, *(int("".join(bits["ACGT".index(b)] for b in w), 2) for bits in ("0011", "0110"))) for w in ("".join(p) for p in product("ACGT", repeat=SPACE_K))]


@_add(
    "kmer_space",
    f"WITH {PS._DNA}, k AS (SELECT sequence_id, u AS kmer, count(*) AS n FROM ({PS._UNITS.format(w=SPACE_K, step=1)}) WHERE u NOT LIKE '%N%' GROUP BY ALL), c AS (SELECT * FROM (VALUES {', '.join(map(str, _CELLS))}) v(kmer, x, y)), "
    f"r AS (SELECT i.sequence_id, c.kmer, c.x, c.y, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT sequence_id FROM d) i CROSS JOIN c LEFT JOIN k ON k.sequence_id = i.sequence_id AND k.kmer = c.kmer) "
    f"SELECT sequence_id, kmer, x, y, n, {sql6('CASE WHEN sum(n) OVER (PARTITION BY sequence_id) > 0 THEN n / sum(n) OVER (PARTITION BY sequence_id) ELSE 0 END', 'frequency')} FROM r",
)
def kmer_space(spark, folder):
    """All possible words of three bases of every DNA record, with their cell of the chaos-game matrix."""
    return rounded(Q.kmer_space(_records(spark, folder, "dna"), SPACE_K))


_KNOWN = "r AS (SELECT DISTINCT ON (codon_row_id) * FROM codon_octonions WHERE sequence_id IS NOT NULL AND regexp_full_match(codon, '[ACGT]{3}'))"
_BY_RESIDUE = {a: [c for c in D.CODONS if D.FAMILY[c] == a] for a in sorted(D.FAMILY_SIZE)}


@_add(
    "codon_usage_matrix",
    f"WITH {_KNOWN}, h AS (SELECT sequence_id, frame, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 6 AS entropy FROM (SELECT sequence_id, frame, codon, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL) SELECT r.sequence_id, r.frame, count(*) AS n_codons, "
    + ", ".join(sql6(f"avg((codon = '{c}')::INT)", f"codon_{c}") for c in D.CODONS)
    + ", "
    + ", ".join(sql6(f"avg((codon IN ({', '.join(repr(c) for c in cs)}))::INT)", f"residue_{'stop' if a == '*' else a}") for a, cs in _BY_RESIDUE.items())
    + f", {sql6('greatest(0, any_value(h.entropy))', 'entropy')}, "
    + ", ".join(sql6(f"avg((substr(codon, {i}, 1) IN ('G', 'C'))::INT)", f"gc_at_{i}") for i in (1, 2, 3))
    + " FROM r JOIN h ON h.sequence_id = r.sequence_id AND h.frame = r.frame GROUP BY r.sequence_id, r.frame",
)
def codon_usage_matrix(spark, folder):
    return rounded(D.usage_matrix(table(spark, folder, "codon_octonions")))


@_add("codon_components", f"WITH {PS._ROWS} SELECT sequence_id, frame, codon, count(*) AS n, {', '.join(sql6(f'avg({e})', f'mean_{e}') for e in O.AXES)} FROM r GROUP BY 1, 2, 3")
def codon_components(spark, folder):
    return rounded(D.codon_components(table(spark, folder, "codon_octonions")))


_MOVE = norm(turned(parts("x"), parts("y")))


@_add(
    "codon_transition_summary",
    f"WITH s AS ({PS.SQL['codon_summary']}), u AS ({units_sql('codon_octonions', CODON_KEYS, CODON_POSITION, CODON_ID)}), m AS (SELECT x.sequence_id, x.frame, avg({_MOVE}) AS mean_transition, max({_MOVE}) AS max_transition {neighbours_sql(CODON_KEYS)} GROUP BY 1, 2) "
    f"SELECT s.*, {sql6('coalesce(mean_transition, 0)', 'mean_transition')}, {sql6('coalesce(max_transition, 0)', 'max_transition')} FROM s LEFT JOIN m ON m.sequence_id = s.sequence_id AND m.frame = s.frame",
)
def codon_transition_summary(spark, folder):
    """The codon summary of every trajectory with the mean and greatest transition between its codons."""
    rows = table(spark, folder, "codon_octonions")
    moves = T.adjacent_products(rows, *C).groupBy(*CODON_KEYS).agg(F.avg("transition_score").alias("mean_transition"), F.max("transition_score").alias("max_transition"))
    return rounded(D.codon_summary(rows).join(moves, CODON_KEYS, "left").fillna(0.0, subset=["mean_transition", "max_transition"]))


_ONE = "bases_apart = 1"
_BASE = lambda s, i: f"substr(codon_{s}, {i}, 1)"
_PURINE = lambda s, i: f"({_BASE(s, i)} IN ('A', 'G'))"
_SAME_KIND = "(" + " OR ".join(f"({_BASE('a', i)} <> {_BASE('b', i)} AND {_PURINE('a', i)} = {_PURINE('b', i)})" for i in (1, 2, 3)) + ")"
_STOPS = "('TAA', 'TAG', 'TGA')"
_CATEGORIES = {
    "all": "true", "synonymous": "synonymous", "different": "NOT synonymous", "one_base": _ONE, "two_bases": "bases_apart = 2", "three_bases": "bases_apart = 3", "transition": f"{_ONE} AND {_SAME_KIND}", "transversion": f"{_ONE} AND NOT {_SAME_KIND}",
    **{f"place_{i}": f"{_ONE} AND {_BASE('a', i)} <> {_BASE('b', i)}" for i in (1, 2, 3)}, "one_stop": f"(codon_a IN {_STOPS}) <> (codon_b IN {_STOPS})",
}


@_add("codon_pair_categories", f"WITH g AS ({PA._plain(PS.SQL['codon_pair_geometry'])}) " + " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) AS n, {sql6('avg(distance)', 'mean')}, {sql6('quantile_cont(distance, 0.5)', 'median')}, {sql6('min(distance)', 'least')}, {sql6('max(distance)', 'greatest')} FROM g WHERE {c} HAVING count(*) > 0" for n, c in _CATEGORIES.items()))
def codon_pair_categories(spark, folder):
    return rounded(D.pair_categories(table(spark, folder, "codon_octonions")))


_CELL = "((strpos('ACGT', substr(codon, 1, 1)) - 1) * 16 + (strpos('ACGT', substr(codon, 2, 1)) - 1) * 4 + strpos('ACGT', substr(codon, 3, 1)) - 1)"


@_add("codon_table_counts", f"WITH {_KNOWN} SELECT ({_CELL} // 8)::INT AS row, ({_CELL} % 8)::INT AS col, count(*) AS n, sum((codon IN ('TTG', 'CTG', 'ATG'))::INT)::BIGINT AS starts FROM r GROUP BY 1, 2")
def codon_table_counts(spark, folder):
    """How many codons of the table stand in each cell of the 8 x 8 table, and how many of these can start a protein."""
    row, col = S.codon_cell(F.col("codon"))
    rows = D.distinct_codons(table(spark, folder, "codon_octonions")).where(F.col("codon").isin(*D.CODONS))
    return rows.groupBy(row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.is_start(F.col("codon")).cast("long")).alias("starts"))


_MITO = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"


@_add("mitochondrial_residues", f"WITH {PS._DNA}, c AS (SELECT sequence_id, substr(s, 1 + 3 * i, 3) AS u FROM (SELECT sequence_id, s, unnest(range(0, (length(s) + 2) // 3)) AS i FROM d)) SELECT sequence_id, amino_acid, count(*) AS n FROM (SELECT sequence_id, {PS._CODE.replace(S.STANDARD_CODE, _MITO)} AS amino_acid FROM c) GROUP BY ALL")
def mitochondrial_residues(spark, folder):
    """Residue counts of the first frame by the vertebrate mitochondrial code, an incomplete last codon included as X."""
    return Q.codons(_records(spark, folder, "dna"), (0,), "vertebrate_mitochondrial", True).groupBy("sequence_id", "amino_acid").agg(F.count(F.lit(1)).alias("n"))


_SPECTRUM = f"WITH r AS (SELECT DISTINCT window_id, axis_scheme_id, {', '.join(O.AXES)} FROM window_octonions WHERE window_id IS NOT NULL AND axis_scheme_id IS NOT NULL AND {' AND '.join(f'{e} IS NOT NULL' for e in O.AXES)}), g AS (SELECT axis_scheme_id, count(*) AS n, " + ", ".join(f"sum({a} * {b}) AS g_{a}_{b}" for a in O.AXES for b in O.AXES) + " FROM r GROUP BY 1) "


def _windows(spark, folder):
    rows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull() & F.col("axis_scheme_id").isNotNull())
    return rows.select("window_id", "axis_scheme_id", *O.AXES).dropna().dropDuplicates(["window_id"])


@_add("component_spectrum_sums", _SPECTRUM + f"SELECT axis_scheme_id, n, {sql6('(' + ' + '.join(f'g_{e}_{e}' for e in O.AXES) + ') / n', 'mean_square')}, {sql6('(' + ' + '.join(f'g_{a}_{b} * g_{a}_{b}' for a in O.AXES for b in O.AXES) + ') / n / n', 'mean_fourth')} FROM g")
def component_spectrum_sums(spark, folder):
    """Sums of the second and fourth powers of the singular values of each scheme's components, per row."""
    rows = ST.singular_values(_windows(spark, folder), ["axis_scheme_id"], list(O.AXES))
    square = F.col("singular_value") * F.col("singular_value")
    n = F.first("n")
    return rounded(rows.groupBy("axis_scheme_id").agg(n.alias("n"), (F.sum(square) / n).alias("mean_square"), (F.sum(square * square) / n / n).alias("mean_fourth")))


@_add("component_spectrum")
def component_spectrum(spark, folder):
    """The singular values of each scheme's components, with rank, condition and effective dimension."""
    return rounded(ST.singular_values(_windows(spark, folder), ["axis_scheme_id"], list(O.AXES)))


@_add("feature_redundancy")
def feature_redundancy(spark, folder):
    """How redundant families of features of neighbouring windows are, and how well they give the transition score linearly."""
    pairs = T.adjacent_products(table(spark, folder, "window_octonions"), *W)
    families = {
        "components": {e: F.col(f"x.{e}") for e in O.AXES},
        "products": {p: F.col(p) for p in T.PRODUCT},
        "differences": {e: F.col(f"y.{e}") - F.col(f"x.{e}") for e in O.AXES},
        "lines": {f"l{i}": F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]) for i, t in enumerate(O.line_terms([F.col(f"x.{e}") for e in O.AXES], [F.col(f"y.{e}") for e in O.AXES]))},
    }
    out = None
    for name, columns in families.items():
        rows = pairs.select("axis_scheme_id", "transition_score", *[c.alias(n) for n, c in columns.items()])
        found = ST.redundancy(rows, ["axis_scheme_id"], list(columns), "transition_score").select(F.lit(name).alias("family"), "*")
        out = found if out is None else out.unionByName(found)
    return rounded(out)


_EQUAL = ["mono_entropy", "gc_content", "valid_fraction", "ambiguous_fraction", *O.AXES]


@_add(
    "equal_window_columns",
    f"WITH r AS (SELECT DISTINCT window_id, {', '.join(_EQUAL)} FROM window_octonions WHERE window_id IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, coalesce(sum(({a} IS DISTINCT FROM {b})::INT), 0) = 0 AS duplicate, coalesce(CASE WHEN var_pop({a}) FILTER ({b} IS NOT NULL) > 1e-15 AND var_pop({b}) FILTER ({a} IS NOT NULL) > 1e-15 THEN abs(corr({a}, {b})) >= {1 - 1e-9!r} END, false) AS collinear FROM r" for a, b in combinations(_EQUAL, 2)),
)
def equal_window_columns(spark, folder):
    """Columns of the window table that are equal or collinear."""
    rows = table(spark, folder, "window_octonions").where(F.col("window_id").isNotNull()).select("window_id", *_EQUAL).dropDuplicates(["window_id"])
    return ST.equal_columns(rows, _EQUAL)


_INFO = ["label", "chromosome", "length_bin", "gc_bin"]
_NLOGN = lambda c: f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM r GROUP BY {c}))"


@_add(
    "pair_information",
    f"WITH r AS (SELECT DISTINCT * FROM coding_metadata WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _INFO)}), h AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, (SELECT count(*) FROM r) AS n, {_NLOGN(a)} AS h_a, {_NLOGN(b)} AS h_b, {_NLOGN(f'{a}, {b}')} AS h_ab" for a, b in combinations(_INFO, 2))
    + f") SELECT column_a, column_b, n, {sql6('h_a', 'h_a')}, {sql6('h_b', 'h_b')}, {sql6('h_a + h_b - h_ab', 'mutual')}, {sql6('CASE WHEN sqrt(greatest(0, h_a * h_b)) > 1e-9 THEN (h_a + h_b - h_ab) / sqrt(h_a * h_b) ELSE 0 END', 'normalised')} FROM h",
)
def pair_information(spark, folder):
    return rounded(ST.pair_information(table(spark, folder, "coding_metadata").distinct(), _INFO))


@_add(
    "triple_information",
    f"WITH r AS (SELECT DISTINCT * FROM coding_metadata), h AS ("
    + " UNION ALL ".join(
        f"SELECT '{x}|{y}|{z}' AS columns, " + ", ".join(f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM r WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {z} IS NOT NULL GROUP BY {c})) AS {n}" for n, c in (("hx", x), ("hy", y), ("hz", z), ("hxy", f"{x}, {y}"), ("hxz", f"{x}, {z}"), ("hyz", f"{y}, {z}"), ("hxyz", f"{x}, {y}, {z}")))
        for x, y, z in combinations(_INFO, 3)
    )
    + f") SELECT columns, {sql6('hx + hy - hxy', 'mi_xy')}, {sql6('hxz + hyz - hz - hxyz', 'cmi_xy_z')}, {sql6('(hx + hy - hxy) - (hxz + hyz - hz - hxyz)', 'interaction')}, {sql6('hx + hy + hz - hxyz', 'total_correlation')} FROM h",
)
def triple_information(spark, folder):
    """Mutual, conditional and interaction information of all triples of the coding table's columns."""
    rows = table(spark, folder, "coding_metadata").distinct()
    out = None
    for x, y, z in combinations(_INFO, 3):
        one = ST.information(rows, x, y, z).select(F.lit(f"{x}|{y}|{z}").alias("columns"), "mi_xy", "cmi_xy_z", "interaction", "total_correlation")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@_add("packed_events", "WITH t AS (" + PA._plain(PA.SQL["event_tracks"]) + ") SELECT user_id, \"day\", " + ", ".join(sql6(f"track_{PA.TRACKS[i]}" if i < len(PA.TRACKS) else "0.0", f"e{i}") for i in range(8)) + " FROM t")
def packed_events(spark, folder):
    """The daily tracks of every user as units of eight components."""
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    wide = X.track_pivot(rows, ["user_id", "day"], "event_type", "value", PA.TRACKS)
    return rounded(X.packed_tracks(wide, ["user_id", "day"], [f"track_{t}" for t in PA.TRACKS]))


@_add(
    "dataset_problems",
    r"WITH k AS (SELECT DISTINCT sequence_id FROM fasta_records WHERE sequence_id IS NOT NULL), c AS (SELECT m.dataset_id, count(*) AS rows, sum((label IS NULL OR trim(label) = '')::INT)::BIGINT AS missing_labels, sum((species_or_subject IS NULL OR trim(species_or_subject) = '')::INT)::BIGINT AS missing_subjects, sum((k.sequence_id IS NULL)::INT)::BIGINT AS without_record FROM benchmark_metadata m LEFT JOIN k ON k.sequence_id = m.sequence_id GROUP BY 1), "
    "r AS (SELECT dataset_id, sum((sequence_id IS NOT NULL AND n > 1)::INT)::BIGINT AS repeated_ids FROM (SELECT dataset_id, sequence_id, count(*) AS n FROM benchmark_metadata GROUP BY 1, 2) GROUP BY 1) SELECT c.*, repeated_ids FROM c JOIN r ON r.dataset_id IS NOT DISTINCT FROM c.dataset_id",
)
def dataset_problems(spark, folder):
    return X.dataset_problems(table(spark, folder, "benchmark_metadata"), table(spark, folder, "fasta_records"))


_AXIS = {a: " + ".join(f"{n}_share" for n in PT.LINE_NAMES if str(a) in n.split("_")[1:]) for a in range(1, 8)}


@_add(
    "axis_shares",
    f"WITH l AS ({PA._plain(PT.SQL['fano_line_features'])}), s AS (SELECT sequence_id, axis_scheme_id, total, {', '.join(f'({v}) / 3.0 AS share_e{a}' for a, v in _AXIS.items())} FROM l), "
    f"z AS (SELECT *, greatest({', '.join(f'share_e{a}' for a in _AXIS)}) AS top FROM s) SELECT sequence_id, axis_scheme_id, {', '.join(sql6(f'share_e{a}', f'share_e{a}') for a in _AXIS)}, "
    f"CASE WHEN total > 0 THEN CASE {' '.join(f'WHEN round(share_e{a}, 12) = round(top, 12) THEN {chr(39)}e{a}{chr(39)}' for a in _AXIS)} END END AS dominant_axis, {sql6('top', 'dominant_axis_share')} FROM z",
)
def axis_shares(spark, folder):
    features = T.line_features(T.adjacent_products(table(spark, folder, "window_octonions"), *W), WINDOW_KEYS)
    return rounded(T.axis_shares(features, WINDOW_KEYS))


_CROSS = [Sql(f"({v.text} / 2)") for v in turned(parts("x"), parts("y"))]


@_add("window_cross_products", f"WITH u AS ({units_sql('window_octonions', *W)}) SELECT x.sequence_id, x.axis_scheme_id, x.pos AS position, {', '.join(sql6(v.text, f'c{i}') for i, v in enumerate(_CROSS, 1))} {neighbours_sql(WINDOW_KEYS)}")
def window_cross_products(spark, folder):
    """The seven-dimensional cross product of every window and the next."""
    pairs = T.adjacent_products(table(spark, folder, "window_octonions"), *W)
    c = O.cross([F.col(f"x.{e}") for e in O.AXES], [F.col(f"y.{e}") for e in O.AXES])
    return rounded(pairs.select(*WINDOW_KEYS, WINDOW_POSITION, *[v.alias(f"c{i}") for i, v in enumerate(c, 1)]))


_WEIGHTS = B.structure_weights()
_RANDOM = [(f"r_{j}", " + ".join(f"({float(v)!r}) * {n}" for v, (n, _) in zip(w, PA._TERMS))) for j, w in enumerate(_WEIGHTS)]


@_add("randomised_structure_features", f"{PA._DENSE}, t AS (SELECT {', '.join('x.' + k for k in WINDOW_KEYS)}, {', '.join(f'{e} AS {n}' for n, e in PA._TERMS)} {neighbours_sql(WINDOW_KEYS)}), r AS (SELECT {PA._K}, {', '.join(f'{e} AS {n}' for n, e in _RANDOM)} FROM t) SELECT {PA._K}, " + ", ".join(sql6(f"{f}({n})", f"{s}_{n}") for n, _ in _RANDOM for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + f" FROM r GROUP BY {PA._K}")
def randomised_structure_features(spark, folder):
    return rounded(B.randomised_structure_features(table(spark, folder, "window_octonions"), *W))


_TURNS = N.orthogonal_matrices(MATRICES)
_TURNED = lambda u, m: [Sql("0.0"), *[Sql("(" + " + ".join(f"({v!r}) * {u}.e{j}" for j, v in enumerate(row, 1)) + ")") for row in m]]


@_add(
    "orthogonal_control_transitions",
    f"WITH u AS ({units_sql('window_octonions', *W)}), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS control, {', '.join(f'{v.text} AS x{i}' for i, v in enumerate(_TURNED('x', m)))}, {', '.join(f'{v.text} AS y{i}' for i, v in enumerate(_TURNED('y', m)))} {neighbours_sql(WINDOW_KEYS)}" for n, m in _TURNS)
    + f"), s AS (SELECT control, {norm(turned(parts('c', 'x'), parts('c', 'y')))} AS v FROM c) SELECT control, count(*) AS n_pairs, {sql6('avg(v)', 'mean_score')}, {sql6('max(v)', 'max_score')} FROM s GROUP BY 1",
)
def orthogonal_control_transitions(spark, folder):
    return rounded(N.orthogonal_transitions(table(spark, folder, "window_octonions"), *W, _TURNS))


@_add("synonymous_shuffle_codons", f"WITH {PS._DNA} SELECT sequence_id, codon, amino_acid, count(*) AS n FROM (SELECT sequence_id, u AS codon, {PS._CODE} AS amino_acid FROM (SELECT sequence_id, substr(s, 1 + 3 * i, 3) AS u FROM (SELECT sequence_id, s, unnest(range(0, length(s) // 3)) AS i FROM d))) GROUP BY ALL")
def synonymous_shuffle_codons(spark, folder):
    """Codons of every record after a shuffle that must keep their number, and with it the protein."""
    rows = N.shuffled(_records(spark, folder, "dna"), "sequence_id", "sequence", "synonymous")
    return Q.codons(rows).groupBy("sequence_id", "codon", "amino_acid").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "balanced_panel",
    f"WITH {PA._M}, o AS (SELECT dataset_id, sequence_id, label, row_number() OVER (PARTITION BY dataset_id, label ORDER BY md5(sequence_id), sequence_id) AS i FROM m), k AS (SELECT dataset_id, least(min(n), {PER_LABEL}) AS n FROM (SELECT dataset_id, label, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1) SELECT o.dataset_id, o.sequence_id, o.label FROM o JOIN k ON k.dataset_id = o.dataset_id WHERE i <= n",
)
def balanced_panel(spark, folder):
    """As many records of every label of a data set, at most a fixed number of each: a sampling operator."""
    return B.balanced_sample(PA._labelled(spark, folder).select("dataset_id", "sequence_id", "label"), ["dataset_id"], "label", "sequence_id", PER_LABEL)


@_add("exact_duplicates", f"SELECT min(sequence_id) AS sequence_id, length(s) AS length, md5(s) AS digest FROM ({PS._CLEAN}) WHERE s <> '' GROUP BY s")
def exact_duplicates(spark, folder):
    """One record for each different sequence: that of the least id."""
    rows = Q.deduplicated(_records(spark, folder, None), "sequence", ["sequence_id"])
    return rows.select("sequence_id", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


_NUMBERS = ["length", "gc_fraction", "length_bin", "gc_bin"]


@_add("numeric_by_sequence", "SELECT sequence_id, " + ", ".join(sql6(f"{f}({c})::DOUBLE", f"{s}_{c}") for c in _NUMBERS for s, f in (("mean", "avg"), ("max", "max"))) + " FROM (SELECT DISTINCT * FROM coding_metadata) WHERE sequence_id IS NOT NULL GROUP BY 1")
def numeric_by_sequence(spark, folder):
    return rounded(ST.numeric_by_key(table(spark, folder, "coding_metadata").distinct(), "sequence_id"))


_DIGESTED = {"homology_clusters": ["sequence_id", "homology_cluster"], "benchmark_metadata": ["sequence_id", "label", "species_or_subject", "dataset_id"], "benchmark_splits": ["sequence_id", "dataset_id", "split", "split_group", "label", "notes"]}


@_add("table_digests", " UNION ALL ".join("SELECT '%s' AS table_name, count(*) AS rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), %s)), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS digest FROM %s" % (t, ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in cs), t) for t, cs in _DIGESTED.items()))
def table_digests(spark, folder):
    """Digests of whole tables that don't depend on the order of rows."""
    out = None
    for name, columns in _DIGESTED.items():
        one = ST.table_digest(table(spark, folder, name), columns).select(F.lit(name).alias("table_name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@_add("capped_clusters", f"SELECT sequence_id, homology_cluster FROM (SELECT *, row_number() OVER (PARTITION BY homology_cluster ORDER BY md5(sequence_id), sequence_id) AS i FROM (SELECT DISTINCT sequence_id, homology_cluster FROM homology_clusters WHERE sequence_id IS NOT NULL AND homology_cluster IS NOT NULL)) WHERE i <= {PER_PARENT}")
def capped_clusters(spark, folder):
    """A few members of every homology cluster: a sampling operator."""
    rows = table(spark, folder, "homology_clusters").select("sequence_id", "homology_cluster").distinct()
    return B.capped_per_parent(rows, "homology_cluster", "sequence_id", PER_PARENT)


_SAME = "list_sum(list_transform(range(1, least(length(a.s), length(b.s)) + 1), lambda i: (substr(a.s, i, 1) = substr(b.s, i, 1))::INT))"


@_add(
    "cluster_identity",
    f"WITH d AS ({PS._CLEAN}), o AS (SELECT sequence_id, min(s) AS s FROM d WHERE s <> '' GROUP BY 1), m AS (SELECT DISTINCT sequence_id, homology_cluster FROM homology_clusters WHERE homology_cluster IS NOT NULL), r AS (SELECT m.homology_cluster, min(m.sequence_id) AS first FROM m JOIN o ON o.sequence_id = m.sequence_id GROUP BY 1) "
    f"SELECT m.homology_cluster, m.sequence_id, {sql6(f'CASE WHEN greatest(length(a.s), length(b.s)) > 0 THEN coalesce({_SAME}, 0)::DOUBLE / greatest(length(a.s), length(b.s)) ELSE 1 END', 'identity')} FROM m JOIN r ON r.homology_cluster = m.homology_cluster JOIN o a ON a.sequence_id = m.sequence_id JOIN o b ON b.sequence_id = r.first",
)
def cluster_identity(spark, folder):
    """The positional identity of every member of a homology cluster with the cluster's least member."""
    text = _records(spark, folder, None).groupBy("sequence_id").agg(F.min("sequence").alias("s"))
    members = table(spark, folder, "homology_clusters").where(F.col("homology_cluster").isNotNull()).select("sequence_id", "homology_cluster").distinct().join(text, "sequence_id")
    first = members.groupBy("homology_cluster").agg(F.min_by("s", "sequence_id").alias("t"))
    both = skew_join(members, first, ["homology_cluster"])
    return rounded(both.select("homology_cluster", "sequence_id", S.positional_identity(F.col("s"), F.col("t")).alias("identity")))


@_add("alphabet_validity", f"SELECT dataset_id, count(*) AS records, sum(regexp_full_match(s, '[ACGT]+')::INT)::BIGINT AS valid_dna, sum(regexp_full_match(s, '[{RESIDUE_LETTERS}]+')::INT)::BIGINT AS valid_protein FROM (SELECT DISTINCT dataset_id, sequence_id FROM benchmark_metadata) m JOIN (SELECT * FROM ({PS._CLEAN}) WHERE s <> '') d ON d.sequence_id = m.sequence_id GROUP BY 1")
def alphabet_validity(spark, folder):
    """How many records of every data set hold known bases, or known residues, alone."""
    rows = table(spark, folder, "benchmark_metadata").select("dataset_id", "sequence_id").distinct().join(_records(spark, folder, None), "sequence_id")
    count = lambda alphabet: F.sum(S.valid(F.col("sequence"), alphabet).cast("long"))
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("records"), count(S.BASES).alias("valid_dna"), count(RESIDUE_LETTERS).alias("valid_protein"))
