"""Queries over FASTA records and codon rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.functions import sequence as S
from octolake.operators import codon as D
from octolake.operators import sequences as Q
from octolake.plans.common import norm, parts, r6, rounded, sql6, table, turned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, FCGR_K, MATRIX_K = 4, 4, 2


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _records(spark, folder, kind):
    return Q.records(table(spark, folder, "fasta_records"), kind)


_CLEAN = r"SELECT DISTINCT sequence_id, upper(regexp_replace(sequence, '\s+', '', 'g')) AS s FROM fasta_records WHERE sequence_id IS NOT NULL"
_DNA = f"d AS (SELECT * FROM ({_CLEAN}) WHERE regexp_full_match(s, '[ACGTN]+'))"
_PROTEIN = f"d AS (SELECT * FROM ({_CLEAN}) WHERE s <> '' AND NOT regexp_full_match(s, '[ACGTN]+'))"


def _count(c: str, letter: str) -> str:
    return f"(length({c}) - length(replace({c}, '{letter}', '')))"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END)"


def _entropy(counts: list[str]) -> str:
    total = " + ".join(counts)
    return "(" + " + ".join(f"(CASE WHEN {n} > 0 THEN -({n}::DOUBLE / ({total})) * log2({n}::DOUBLE / ({total})) ELSE 0 END)" for n in counts) + f") / log2({len(counts)})"


def _balances(c: str) -> str:
    n = {b: _count(c, b) for b in S.BASES}
    known = " + ".join(n.values())
    mirror = f"(CASE WHEN length({c}) > 0 THEN list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN substr({c}, i, 1) = substr(reverse(translate({c}, 'ACGT', 'TGCA')), i, 1) THEN 1 ELSE 0 END))::DOUBLE / length({c}) ELSE 0 END)"
    return ", ".join(
        [
            sql6(_ratio(known, f"length({c})"), "valid_fraction"),
            sql6(_ratio(f"{n['G']} + {n['C']}", known), "gc_content"),
            sql6(_ratio(f"{n['A']} + {n['G']} - {n['C']} - {n['T']}", known), "purine_balance"),
            sql6(_ratio(f"{n['G']} + {n['T']} - {n['A']} - {n['C']}", known), "keto_balance"),
            sql6(_ratio(f"{n['G']} - {n['C']}", f"{n['G']} + {n['C']}"), "gc_skew"),
            sql6(_ratio(f"{n['A']} - {n['T']}", f"{n['A']} + {n['T']}"), "at_skew"),
            sql6(_entropy(list(n.values())), "base_entropy"),
            sql6(mirror, "mirror_similarity"),
        ]
    )


@_add("sequence_features", f"WITH {_DNA} SELECT sequence_id, length(s) AS length, {_balances('s')} FROM d")
def sequence_features(spark, folder):
    return rounded(Q.sequence_features(_records(spark, folder, "dna")))


_UNITS = "SELECT sequence_id, i AS start, substr(s, i + 1, {w}) AS u FROM (SELECT sequence_id, s, unnest(range(0, length(s) - {w} + 1, {step})) AS i FROM d WHERE length(s) >= {w})"


@_add("dna_window_descriptors", f"WITH {_DNA}, w AS ({_UNITS.format(w=60, step=30)}) SELECT sequence_id, start // 30 AS position, start AS start_pos, start + 60 AS end_pos, {_balances('u')} FROM w WHERE u NOT LIKE '%N%'")
def dna_window_descriptors(spark, folder):
    return rounded(Q.window_descriptors(_records(spark, folder, "dna")))


_KMERS = f"k AS (SELECT sequence_id, u AS kmer, count(*) AS n FROM ({_UNITS.format(w=K, step=1)}) WHERE u NOT LIKE '%N%' GROUP BY ALL)"


@_add("kmer_counts", f"WITH {_DNA}, {_KMERS} SELECT sequence_id, kmer, n, {sql6('n::DOUBLE / sum(n) OVER (PARTITION BY sequence_id)', 'frequency')} FROM k")
def kmer_counts(spark, folder):
    return rounded(Q.kmer_counts(_records(spark, folder, "dna"), K))


_XY = [" + ".join(f"(CASE WHEN substr(kmer, {i + 1}, 1) IN ({which}) THEN {1 << (FCGR_K - 1 - i)} ELSE 0 END)" for i in range(FCGR_K)) for which in ("'G', 'T'", "'C', 'G'")]


@_add("fcgr_matrix", f"WITH {_DNA}, {_KMERS} SELECT sequence_id, {_XY[0]} AS x, {_XY[1]} AS y, {sql6('n::DOUBLE / sum(n) OVER (PARTITION BY sequence_id)', 'frequency')} FROM k")
def fcgr_matrix(spark, folder):
    return rounded(Q.fcgr(_records(spark, folder, "dna"), FCGR_K))


_WORDS = ["".join(w) for w in product(S.BASES, repeat=MATRIX_K)]


@_add(
    "kmer_matrix",
    f"WITH {_DNA}, k AS (SELECT sequence_id, u FROM ({_UNITS.format(w=MATRIX_K, step=1)}) WHERE u NOT LIKE '%N%'), g AS (SELECT sequence_id, "
    + ", ".join(f"count(*) FILTER (u = '{w}')::DOUBLE / count(*) AS k_{w}" for w in _WORDS)
    + " FROM k GROUP BY 1) SELECT i.sequence_id, "
    + ", ".join(sql6(f"coalesce(k_{w}, 0)", f"kmer_{w}") for w in _WORDS)
    + " FROM (SELECT DISTINCT sequence_id FROM d) i LEFT JOIN g ON g.sequence_id = i.sequence_id",
)
def kmer_matrix(spark, folder):
    return rounded(Q.kmer_matrix(_records(spark, folder, "dna"), MATRIX_K))


_RES = [_count("s", r) for r in S.RESIDUES]


@_add("residue_composition", f"WITH {_PROTEIN} SELECT sequence_id, length(s) AS length, " + ", ".join(sql6(_ratio(n, " + ".join(_RES)), f"share_{r}") for r, n in zip(S.RESIDUES, _RES)) + f", {sql6(_entropy(_RES), 'residue_entropy')} FROM d")
def residue_composition(spark, folder):
    return rounded(Q.composition(_records(spark, folder, "protein")))


_CODE = "CASE WHEN regexp_full_match(u, '[ACGT]{3}') THEN substr('" + S.STANDARD_CODE + "', (strpos('TCAG', substr(u, 1, 1)) - 1) * 16 + (strpos('TCAG', substr(u, 2, 1)) - 1) * 4 + strpos('TCAG', substr(u, 3, 1)), 1) ELSE 'X' END"


@_add("translated_residues", f"WITH {_DNA}, c AS (" + " UNION ALL ".join(f"SELECT sequence_id, {f} AS frame, substr(s, {f + 1} + 3 * i, 3) AS u FROM (SELECT sequence_id, s, unnest(range(0, (length(s) - {f}) // 3)) AS i FROM d WHERE length(s) >= {f + 3})" for f in range(3)) + f") SELECT sequence_id, frame, amino_acid, count(*) AS n FROM (SELECT sequence_id, frame, {_CODE} AS amino_acid FROM c) GROUP BY ALL")
def translated_residues(spark, folder):
    """Residue counts of the three forward frames of every DNA record."""
    return Q.codons(_records(spark, folder, "dna"), (0, 1, 2)).groupBy("sequence_id", "frame", "amino_acid").agg(F.count(F.lit(1)).alias("n"))


@_add("base_transitions", f"WITH {_DNA}, b AS (SELECT sequence_id, substr('N' || s, i, 1) AS previous, substr(s, i, 1) AS base FROM (SELECT sequence_id, s, unnest(range(1, length(s) + 1)) AS i FROM d)) SELECT sequence_id, previous, base, count(*) AS n FROM b GROUP BY ALL")
def base_transitions(spark, folder):
    """How often each base follows each other one, from the base-context rows of every record."""
    return Q.base_context(_records(spark, folder, "dna")).groupBy("sequence_id", "previous", "base").agg(F.count(F.lit(1)).alias("n"))


_ROWS = "r AS (SELECT DISTINCT ON (codon_row_id) * FROM codon_octonions WHERE sequence_id IS NOT NULL AND codon IS NOT NULL)"
_USED = f"{_ROWS}, t AS (SELECT sequence_id, frame, count(*) AS total FROM r GROUP BY ALL), n AS (SELECT sequence_id, frame, codon, count(*) AS n FROM r GROUP BY ALL), dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{D.FAMILY[c]}', {D.FAMILY_SIZE[D.FAMILY[c]]})" for c in D.CODONS) + ") v(codon, amino_acid, size)), f AS (SELECT t.sequence_id, t.frame, dim.codon, dim.amino_acid, coalesce(n.n, 0) AS n, total, size, sum(coalesce(n.n, 0)) OVER (PARTITION BY t.sequence_id, t.frame, dim.amino_acid) AS family FROM t CROSS JOIN dim LEFT JOIN n ON n.sequence_id = t.sequence_id AND n.frame = t.frame AND n.codon = dim.codon)"


def _usage_sql(stops: str) -> str:
    rscu = "CASE WHEN family > 0 THEN n::DOUBLE * size / family ELSE 0 END"
    rscu = f"CASE WHEN amino_acid <> '*' THEN {rscu} END" if stops == "pooled" else rscu
    return f"WITH {_USED} SELECT sequence_id, frame, codon, amino_acid, n, {sql6('n::DOUBLE / total', 'frequency')}, {sql6(rscu, 'rscu')} FROM f" + (" WHERE amino_acid <> '*'" if stops == "exclude" else "")


for _stops in ("exclude", "separate", "pooled"):
    _add(f"codon_usage_{_stops}", _usage_sql(_stops))(lambda spark, folder, stops=_stops: rounded(D.codon_usage(table(spark, folder, "codon_octonions"), stops)))


@_add(
    "codon_summary",
    f"WITH {_ROWS}, k AS (SELECT sequence_id, frame, codon, count(*) AS n FROM r GROUP BY ALL), h AS (SELECT sequence_id, frame, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 6 AS codon_entropy FROM k GROUP BY ALL) "
    "SELECT r.sequence_id, r.frame, count(*) AS n_codons, sum(is_stop::INT) AS n_stops, " + ", ".join(sql6(f"avg(gc{i})", f"gc{i}") for i in (1, 2, 3)) + f", {sql6('avg(codon_associator_score)', 'mean_associator')}, {sql6('max(codon_associator_score)', 'max_associator')}, {sql6('any_value(codon_entropy)', 'codon_entropy')}, {sql6('sum(is_stop::INT)::DOUBLE / count(*)', 'stop_density')} FROM r JOIN h ON h.sequence_id = r.sequence_id AND h.frame = r.frame GROUP BY r.sequence_id, r.frame",
)
def codon_summary(spark, folder):
    return rounded(D.codon_summary(table(spark, folder, "codon_octonions")))


_VEC = "v AS (SELECT codon, min(amino_acid) AS amino_acid, " + ", ".join(f"min({e}) AS {e}" for e in O.AXES) + " FROM codon_octonions WHERE regexp_full_match(codon, '[ACGT]{3}') AND " + " AND ".join(f"{e} IS NOT NULL" for e in O.AXES) + " GROUP BY codon)"


@_add(
    "codon_pair_geometry",
    f"WITH {_VEC} SELECT a.codon AS codon_a, b.codon AS codon_b, {sql6('sqrt(' + ' + '.join(f'power(a.{e} - b.{e}, 2)' for e in O.AXES) + ')', 'distance')}, {sql6(norm(turned(parts('a'), parts('b'))), 'commutator_norm')}, {sql6(' + '.join(f'a.{e} * b.{e}' for e in O.AXES), 'dot')}, a.amino_acid = b.amino_acid AS synonymous, "
    + " + ".join(f"(substr(a.codon, {i}, 1) <> substr(b.codon, {i}, 1))::INT" for i in (1, 2, 3)) + " AS bases_apart FROM v a JOIN v b ON a.codon < b.codon",
)
def codon_pair_geometry(spark, folder):
    return rounded(D.codon_pairs(table(spark, folder, "codon_octonions")))


@_add("codon_collisions", f"WITH {_VEC} SELECT string_agg(codon, ' ' ORDER BY codon) AS codons, count(*) AS n_codons FROM v GROUP BY {', '.join(O.AXES)} HAVING count(*) > 1")
def codon_collisions(spark, folder):
    return D.collisions(table(spark, folder, "codon_octonions"))


_EFFECT = "x AS (SELECT a.codon, sum((a.amino_acid = b.amino_acid)::INT) AS same, sum((b.amino_acid = '*' AND a.amino_acid <> '*')::INT) AS stop FROM dim a JOIN dim b ON " + " + ".join(f"(substr(a.codon, {i}, 1) <> substr(b.codon, {i}, 1))::INT" for i in (1, 2, 3)) + " = 1 GROUP BY a.codon)"


@_add("codon_substitutions", f"WITH {_USED}, {_EFFECT} SELECT sequence_id, frame, count(*) * 9 AS substitutions, sum(same) AS synonymous, sum(stop) AS to_stop, count(*) * 9 - sum(same) - sum(stop) AS changing FROM r JOIN x ON x.codon = r.codon GROUP BY ALL")
def codon_substitutions(spark, folder):
    return D.substitutions(table(spark, folder, "codon_octonions"))
