"""Codon usage and codon geometry over a table of codon rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.functions import sequence as S

CODONS = tuple(a + b + c for a in S.BASES for b in S.BASES for c in S.BASES)


def amino(codon: str) -> str:
    i = [S.CODE_ORDER.index(b) for b in codon]
    return S.STANDARD_CODE[i[0] * 16 + i[1] * 4 + i[2]]


FAMILY = {c: amino(c) for c in CODONS}
FAMILY_SIZE = {a: sum(v == a for v in FAMILY.values()) for a in set(FAMILY.values())}


def distinct_codons(df: DataFrame) -> DataFrame:
    """The table's distinct codon rows that belong to a sequence, ambiguous codons included."""
    return df.where(F.col("sequence_id").isNotNull() & F.col("codon").isNotNull()).dropDuplicates(["codon_row_id"])


def codon_counts(df: DataFrame) -> DataFrame:
    """sequence_id, frame, total and a map from each codon that occurs (64 and ambiguous ones) to its count."""
    kinds = distinct_codons(df).groupBy("sequence_id", "frame", "codon").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("sequence_id", "frame").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("codon", "n"))).alias("counts"))


def codon_usage(df: DataFrame, stops: str = "exclude") -> DataFrame:
    """(sequence_id, frame, codon, amino_acid, n, frequency, rscu): all 64 codons of every trajectory.

    frequency is over all codons, ambiguous ones included. RSCU is the count over the mean count of the codon's family,
    0 for families not used. ``stops``: exclude leaves stop codons out, separate gives them their own family, pooled
    keeps them with an RSCU of null.
    """
    if stops not in ("exclude", "separate", "pooled"):
        raise ValueError(stops)
    kept = [(c, FAMILY[c], FAMILY_SIZE[FAMILY[c]]) for c in CODONS if stops != "exclude" or FAMILY[c] != "*"]
    dim = F.broadcast(df.sparkSession.createDataFrame(kept, "codon string, amino_acid string, size int"))  # 64 rows
    rows = codon_counts(df).crossJoin(dim).select("sequence_id", "frame", "codon", "amino_acid", "size", F.coalesce(F.try_element_at("counts", F.col("codon")), F.lit(0)).cast("long").alias("n"), "total")
    family = F.sum("n").over(W.partitionBy("sequence_id", "frame", "amino_acid"))
    rscu = S.ratio(F.col("n") * F.col("size"), family)
    if stops == "pooled":
        rscu = F.when(F.col("amino_acid") != "*", rscu)
    return rows.select("sequence_id", "frame", "codon", "amino_acid", "n", S.ratio(F.col("n"), F.col("total")).alias("frequency"), rscu.alias("rscu"))


def codon_summary(df: DataFrame) -> DataFrame:
    """Per trajectory: codons, stops, stop density, codon entropy over log2 64, GC by place, associator scores, valid codons."""
    rows = distinct_codons(df)
    other = rows.groupBy("sequence_id", "frame").agg(
        F.count(F.lit(1)).alias("n_codons"), F.sum(F.col("is_stop").cast("long")).alias("n_stops"), *[F.avg(f"gc{i}").alias(f"gc{i}") for i in (1, 2, 3)],
        F.avg("codon_associator_score").alias("mean_associator"), F.max("codon_associator_score").alias("max_associator"),
    )
    kinds = rows.groupBy("sequence_id", "frame", "codon").agg(F.count(F.lit(1)).alias("_n")).groupBy("sequence_id", "frame")
    # sum of n log n gives the entropy in one pass: log N - (sum n log n) / N
    terms = kinds.agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))).alias("_nlogn"))
    terms = terms.select("sequence_id", "frame", ((F.log2(F.col("_all").cast("double")) - F.col("_nlogn") / F.col("_all")) / 6.0).alias("codon_entropy"))
    return other.join(terms, ["sequence_id", "frame"]).withColumn("stop_density", F.col("n_stops") / F.col("n_codons"))


def usage_matrix(df: DataFrame) -> DataFrame:
    """One row a trajectory: frequency of each of the 64 codons among the unambiguous ones, of each residue, entropy, GC by place.

    The entropy is over log2 64; GC at a place is the share of codons with G or C there. Trajectories without an
    unambiguous codon give no row.
    """
    kinds = distinct_codons(df).where(F.col("codon").isin(*CODONS)).groupBy("sequence_id", "frame", "codon").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").cast("double")
    part = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / n
    residues = sorted(FAMILY_SIZE)
    gc = [part(F.substring("codon", i, 1).isin("G", "C")).alias(f"gc_at_{i}") for i in (1, 2, 3)]
    entropy = F.greatest(F.lit(0.0), F.log2(n) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n) / 6.0
    return kinds.groupBy("sequence_id", "frame").agg(
        F.sum("n").alias("n_codons"), *[part(F.col("codon") == c).alias(f"codon_{c}") for c in CODONS], *[part(F.col("codon").isin(*[c for c in CODONS if FAMILY[c] == a])).alias(f"residue_{'stop' if a == '*' else a}") for a in residues], entropy.alias("entropy"), *gc
    )


def codon_components(df: DataFrame) -> DataFrame:
    """(sequence_id, frame, codon, n, mean_e0..mean_e7): the mean components of every codon of a trajectory; nulls are left out."""
    return distinct_codons(df).groupBy("sequence_id", "frame", "codon").agg(F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(f"mean_{e}") for e in O.AXES])


def pair_categories(df: DataFrame) -> DataFrame:
    """(category, n, mean, median, least, greatest) of the distance of codon pairs a < b, in overlapping categories.

    All pairs; those that code the same residue or different ones; those that are one, two or three bases apart; of those
    one base apart, the transitions, the transversions and those that differ at each place; pairs with one stop codon.
    """
    pairs = codon_pairs(df)
    base = lambda side, i: F.substring(f"codon_{side}", i, 1)
    one = F.col("bases_apart") == 1
    differs = {i: base("a", i) != base("b", i) for i in (1, 2, 3)}
    kind = F.coalesce(*[F.when(differs[i], S.substitution_type(base("a", i), base("b", i))) for i in (1, 2, 3)])
    stops = [c for c in CODONS if FAMILY[c] == "*"]
    category = {
        "all": F.lit(True), "synonymous": F.col("synonymous"), "different": ~F.col("synonymous"), "one_base": one, "two_bases": F.col("bases_apart") == 2, "three_bases": F.col("bases_apart") == 3,
        "transition": one & (kind == "transition"), "transversion": one & (kind == "transversion"), **{f"place_{i}": one & differs[i] for i in (1, 2, 3)}, "one_stop": F.col("codon_a").isin(*stops) != F.col("codon_b").isin(*stops),
    }
    rows = pairs.select("distance", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in category.items()]))).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.percentile("distance", 0.5).alias("median"), F.min("distance").alias("least"), F.max("distance").alias("greatest"))


def codon_vectors(df: DataFrame) -> DataFrame:
    """(codon, amino_acid, n, e0..e7) of the 64 unambiguous codons that the table holds: at most 64 rows."""
    rows = df.where(F.col("codon").isin(*CODONS)).dropna(subset=["codon_row_id", *O.AXES]).dropDuplicates(["codon_row_id"])
    return rows.groupBy("codon").agg(F.min("amino_acid").alias("amino_acid"), F.count(F.lit(1)).alias("n"), *[F.min(e).alias(e) for e in O.AXES])


def codon_pairs(df: DataFrame) -> DataFrame:
    """Geometry of the codons that the table holds, for pairs a < b (at most 2016): distance, commutator, dot product, flags."""
    v = codon_vectors(df)
    a = v.select(*[F.col(c).alias(f"a_{c}") for c in v.columns])
    b = F.broadcast(v.select(*[F.col(c).alias(f"b_{c}") for c in v.columns]))  # at most 64 rows
    x, y = [F.col(f"a_{e}") for e in O.AXES], [F.col(f"b_{e}") for e in O.AXES]
    dot = sum((p * q for p, q in zip(x[1:], y[1:])), x[0] * y[0])
    unequal = sum(((F.substring("a_codon", i, 1) != F.substring("b_codon", i, 1)).cast("int") for i in (2, 3)), (F.substring("a_codon", 1, 1) != F.substring("b_codon", 1, 1)).cast("int"))
    return a.join(b, F.col("a_codon") < F.col("b_codon")).select(
        F.col("a_codon").alias("codon_a"), F.col("b_codon").alias("codon_b"), F.sqrt(O.squared_norm([p - q for p, q in zip(x, y)])).alias("distance"), F.sqrt(O.squared_norm(O.commutator(x, y))).alias("commutator_norm"), dot.alias("dot"),
        (F.col("a_amino_acid") == F.col("b_amino_acid")).alias("synonymous"), unequal.alias("bases_apart"),
    )


def substitutions(df: DataFrame) -> DataFrame:
    """Per trajectory: single-base substitutions of its codons, and how many keep the residue, change it, or make a stop.

    Every codon has nine; the 64 rows of their effects are joined by broadcast, so nothing is multiplied per row.
    """
    effects = []
    for c in CODONS:
        to = [FAMILY[c[:i] + b + c[i + 1 :]] for i in range(3) for b in S.BASES if b != c[i]]
        effects.append((c, sum(t == FAMILY[c] for t in to), sum(t == "*" != FAMILY[c] for t in to)))
    known = F.broadcast(df.sparkSession.createDataFrame(effects, "codon string, same int, stop int"))  # 64 rows
    rows = distinct_codons(df).select("sequence_id", "frame", "codon").join(known, "codon")
    out = rows.groupBy("sequence_id", "frame").agg((F.count(F.lit(1)) * 9).alias("substitutions"), F.sum("same").alias("synonymous"), F.sum("stop").alias("to_stop"))
    return out.withColumn("changing", F.col("substitutions") - F.col("synonymous") - F.col("to_stop"))


def collisions(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Groups of different codons with equal vectors within the tolerance: (codons, n_codons), none if all differ."""
    v = codon_vectors(df)
    return v.groupBy(*[F.round(F.col(e) / tolerance).alias(e) for e in O.AXES]).agg(F.array_join(F.sort_array(F.collect_list("codon")), " ").alias("codons"), F.count(F.lit(1)).alias("n_codons")).where("n_codons > 1").select("codons", "n_codons")


def walsh_spectrum(df: DataFrame) -> DataFrame:
    """(sequence_id, frame, coefficient, value): the Walsh-Hadamard spectrum of each trajectory's 64 codon shares.

    Coefficient i is the sum of the shares with the sign of the parity of the bits that i and the codon's place share,
    over 8; codons count in ACGT order. Ambiguous codons are left out; a trajectory of those alone gives no rows. Only
    counts by codon are shuffled; the 64 coefficients are made from a trajectory's one array of counts.
    """
    place = F.create_map(*[F.lit(x) for pair in ((c, i) for i, c in enumerate(CODONS)) for x in pair])
    rows = distinct_codons(df).where(F.col("codon").isin(*CODONS))
    counts = rows.groupBy("sequence_id", "frame", "codon").agg(F.count(F.lit(1)).alias("n"))
    arrays = counts.groupBy("sequence_id", "frame").agg(F.collect_list(F.struct(place[F.col("codon")].alias("p"), "n")).alias("c"), F.sum("n").alias("_all"))
    signed = lambda i: F.aggregate("c", F.lit(0).cast("long"), lambda t, c: t + c["n"] * (1 - 2 * (F.bit_count(i.bitwiseAND(c["p"])) % 2)))
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("coefficient"), (signed(i) / F.col("_all") / 8.0).alias("value")))
    return arrays.select("sequence_id", "frame", F.explode(values).alias("v")).select("sequence_id", "frame", "v.coefficient", "v.value")


def dyadic_shifts() -> list[tuple[int, float, float]]:
    """(shift, share of codons whose partner codes the same residue, mean difference of family size) for shifts 1 to 63."""
    out = []
    for shift in range(1, 64):
        pairs = [(CODONS[i], CODONS[i ^ shift]) for i in range(64)]
        out.append((shift, sum(FAMILY[a] == FAMILY[b] for a, b in pairs) / 64, sum(abs(FAMILY_SIZE[FAMILY[a]] - FAMILY_SIZE[FAMILY[b]]) for a, b in pairs) / 64))
    return out


def root_degeneracy() -> list[tuple[str, int, bool]]:
    """(root, residues, strong): the 16 first-two-base roots, and whether the third base never matters."""
    return [(r, len({FAMILY[r + b] for b in S.BASES}), len({FAMILY[r + b] for b in S.BASES}) == 1) for r in (a + b for a in S.BASES for b in S.BASES)]
