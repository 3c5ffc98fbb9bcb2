"""Operators over whole sequences: records, windows, k-mers, composition, translation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolake.functions import sequence as S
from octolake.operators.skew import skew_join

#: Starts that one piece of a long sequence covers. A chromosome is worked on in pieces, never as one array, and short
#: pieces are cheap to carry along with each of their units.
PIECE = 256


def records(df: DataFrame, seq_type: str | None = None) -> DataFrame:
    """(sequence_id, sequence) of the distinct records, cleaned of white space and case, empty and null ones left out.

    Records delivered again with the same symbols count once. With ``seq_type`` dna or protein only records of that
    alphabet (with N or X for unknown symbols) are kept.
    """
    rows = df.select("sequence_id", S.clean(F.col("sequence")).alias("sequence")).where(F.col("sequence_id").isNotNull() & (F.length("sequence") > 0))
    # a fixed number of parts: sequences are small but what is cut from them isn't, so parts must not be merged by size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "sequence_id", "sequence").distinct()
    dna = F.col("sequence").rlike("^[ACGTN]+$")
    return rows if seq_type is None else rows.where(dna if seq_type == "dna" else ~dna)


def pieces(df: DataFrame, reach: int, step: int = 1, piece: int = PIECE) -> DataFrame:
    """(sequence_id, first, part): parts of the sequences in which every start 0, step, 2 step.. with ``reach`` symbols stands once.

    One pass cuts a sequence into pieces; each gets the head of the next one for the units that cross its end, so the
    work grows with the length of a sequence and not with its square.
    """
    piece = max(piece, reach)
    piece += -piece % step
    cut = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    rows = df.where(F.length("sequence") >= reach).select("sequence_id", cut.alias("_p"))
    longer = max(0, reach - step)
    joined = F.transform("_p", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, longer)) if longer else x)
    out = rows.select("sequence_id", F.posexplode(joined).alias("_i", "part"))
    return out.select("sequence_id", (F.col("_i").cast("long") * piece).alias("first"), "part").where(F.length("part") >= reach)


def units(df: DataFrame, width: int, step: int, name: str = "unit") -> DataFrame:
    """(sequence_id, start, unit): every substring of ``width`` symbols at a multiple of ``step``; narrow, no shuffle."""
    parts = pieces(df, width, step)
    starts = F.sequence(F.lit(0), F.length("part") - width, F.lit(step))
    out = parts.select("sequence_id", "first", "part", F.explode(starts).alias("at"))
    return out.select("sequence_id", (F.col("first") + F.col("at")).cast("long").alias("start"), F.expr(f"substring(part, at + 1, {width})").alias(name))


def balances(c: Column) -> list[Column]:
    """Public descriptors of a DNA string over its known bases: shares and balances of chemistry, skews, entropies, mirror."""
    n = {b: S.count_of(c, b) for b in S.BASES}
    known = n["A"] + n["C"] + n["G"] + n["T"]
    return [
        S.ratio(known, F.length(c)).alias("valid_fraction"),
        S.ratio(n["G"] + n["C"], known).alias("gc_content"),
        S.ratio(n["A"] + n["G"] - n["C"] - n["T"], known).alias("purine_balance"),
        S.ratio(n["G"] + n["T"] - n["A"] - n["C"], known).alias("keto_balance"),
        S.ratio(n["G"] - n["C"], n["G"] + n["C"]).alias("gc_skew"),
        S.ratio(n["A"] - n["T"], n["A"] + n["T"]).alias("at_skew"),
        S.entropy([n[b] for b in S.BASES]).alias("base_entropy"),
        S.mirror_similarity(c).alias("mirror_similarity"),
    ]


def window_descriptors(df: DataFrame, width: int = 60, step: int = 30, most_ambiguous: float = 0.0) -> DataFrame:
    """sequence_id, position, start_pos, end_pos and :func:`balances` of every window; too ambiguous ones are skipped.

    ``position`` counts all starts, skipped ones too, so that a gap stays a gap.
    """
    rows = units(df, width, step)
    out = rows.select("sequence_id", (F.col("start") / step).cast("long").alias("position"), F.col("start").alias("start_pos"), (F.col("start") + width).alias("end_pos"), *balances(F.col("unit")))
    return out.where((1 - F.col("valid_fraction") <= most_ambiguous + 1e-12) & (F.col("valid_fraction") > 0))


def word_counts(codes: np.ndarray, edges: np.ndarray, k: int, base: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(string, word, n) of the words of k letters in strings of codes 0..base - 1; words with a code of ``base`` are no words.

    Up to ``most`` starts are counted at once, so a string of any length needs bounded memory and may come several times.
    """
    power = base ** np.arange(k - 1, -1, -1, dtype=np.int64)
    for lo in range(0, len(codes) - k + 1, most):
        some = codes[lo : lo + most + k - 1].astype(np.int64)
        n = len(some) - k + 1
        word, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            word += some[i : i + n] * power[i]
            known &= some[i : i + n] < base
        start = np.arange(lo, lo + n)
        owner = np.searchsorted(edges, start, "right") - 1
        known &= start + k <= edges[owner + 1]
        owner, word = owner[known], word[known]
        order = np.lexsort((word, owner))
        owner, word = owner[order], word[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])) if len(owner) else np.zeros(0, np.int64)
        yield owner[new], word[new], np.diff(np.append(new, len(owner)))


def kmer_counts(df: DataFrame, k: int, alphabet: str = S.BASES) -> DataFrame:
    """(sequence_id, kmer, n, frequency) of the k-mers over the alphabet; others aren't counted.

    Words are counted as numbers in each Arrow batch, so what is shuffled is one row for each k-mer of a sequence, or of
    a million symbols of it. Words too long for a number are cut out as strings instead.
    """
    base = len(alphabet)
    if base**k < 1 << 62:
        code = np.full(128, base, np.int64)
        code[[ord(a) for a in alphabet]] = np.arange(base)
        letters = np.frombuffer(alphabet.encode(), np.uint8)
        schema = pa.schema([("sequence_id", pa.string()), ("kmer", pa.string()), ("n", pa.int64())])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, edges = S.symbols(batch.column(1))
                codes = np.where(flat < 128, code[np.minimum(flat, 127)], base)
                for owner, word, n in word_counts(codes, edges, k, base):
                    text = letters[(word[:, None] // base ** np.arange(k - 1, -1, -1, dtype=np.int64)) % base]
                    words = pa.Array.from_buffers(pa.large_string(), len(word), [None, pa.py_buffer(np.arange(0, (len(word) + 1) * k, k, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)).cast(pa.string()), words.cast(pa.string()), pa.array(n.astype(np.int64))], schema=schema)

        found = df.select(F.col("sequence_id").cast("string").alias("sequence_id"), "sequence").mapInArrow(counted, "sequence_id string, kmer string, n long")
    else:
        found = units(df, k, 1, "kmer").where(F.col("kmer").rlike(f"^[{alphabet}]+$")).withColumn("n", F.lit(1).cast("long"))
    counts = found.groupBy("sequence_id", "kmer").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("sequence_id").agg(F.sum("n").alias("_all"))
    return skew_join(counts, totals, ["sequence_id"]).select("sequence_id", "kmer", "n", (F.col("n") / F.col("_all")).alias("frequency"))


def fcgr(df: DataFrame, k: int) -> DataFrame:
    """(sequence_id, x, y, frequency): the frequency chaos-game matrix, cells without a k-mer left out.

    Corners: A (0,0), C (0,1), G (1,1), T (1,0); the first symbol sets the highest bit.
    """
    x, y = (F.conv(F.translate("kmer", "ACGT", bits), 2, 10).cast("int") for bits in ("0011", "0110"))
    return kmer_counts(df, k).select("sequence_id", x.alias("x"), y.alias("y"), "frequency")


def kmer_matrix(df: DataFrame, k: int) -> DataFrame:
    """One row per sequence, one column kmer_<word> per possible word (4^k columns: for small k), 0 where absent."""
    words = ["".join(w) for w in product(S.BASES, repeat=k)]
    rows = df.select("sequence_id").distinct()
    wide = kmer_counts(df, k).groupBy("sequence_id").agg(*[F.coalesce(F.sum(F.when(F.col("kmer") == w, F.col("frequency"))), F.lit(0.0)).alias(f"kmer_{w}") for w in words])
    return rows.join(wide, "sequence_id", "left").fillna(0.0)


def sequence_features(df: DataFrame) -> DataFrame:
    """sequence_id, length and :func:`balances` of whole DNA sequences."""
    return df.select("sequence_id", F.length("sequence").cast("long").alias("length"), *balances(F.col("sequence")))


def composition(df: DataFrame, alphabet: str = S.RESIDUES) -> DataFrame:
    """sequence_id, length, share_<residue> and their entropy; unknown residues count in the length only."""
    c = F.col("sequence")
    # counts are bound to columns first: each stands in the sum, its share and its entropy term
    df = df.select("sequence_id", F.length(c).cast("long").alias("length"), *[S.count_of(c, r).alias(f"_{r}") for r in alphabet])
    n = {r: F.col(f"_{r}") for r in alphabet}
    df = df.withColumn("_known", sum((n[r] for r in alphabet[1:]), n[alphabet[0]]))
    known = F.col("_known")
    return df.select("sequence_id", "length", *[S.ratio(n[r], known).alias(f"share_{r}") for r in alphabet], S.entropy([n[r] for r in alphabet]).alias("residue_entropy"))


def codons(df: DataFrame, frames: tuple[int, ...] = (0,), code: int | str = 1, partial: bool = False) -> DataFrame:
    """(sequence_id, frame, codon_index, codon, amino_acid, is_start, is_stop) of the in-frame triplets.

    With ``partial`` the one or two bases left at the end are a codon filled up with N; else they are dropped.
    """
    out = None
    for f in frames:
        text = F.substring("sequence", f + 1, 2**31 - 1)
        if partial:
            text = F.concat(text, F.repeat(F.lit("N"), F.pmod(-F.length(text), F.lit(3))))
        rows = units(df.select("sequence_id", text.alias("sequence")), 3, 3, "codon").select("sequence_id", F.lit(f).alias("frame"), (F.col("start") / 3).cast("long").alias("codon_index"), "codon")
        out = rows if out is None else out.unionByName(rows)
    aa = S.amino_acid(F.col("codon"), code)
    return out.withColumn("amino_acid", aa).withColumn("is_start", S.is_start(F.col("codon"), code)).withColumn("is_stop", F.col("amino_acid") == "*")


def kmer_entropies(df: DataFrame, k: int, alphabet: str = S.BASES) -> DataFrame:
    """(sequence_id, n_kmers, entropy): Shannon entropy of the k-mers over log2 of their possible number, 0 without any."""
    if k < 1:
        raise ValueError("k must be positive")
    counts = kmer_counts(df, k, alphabet)
    n, s = F.sum("n").cast("double"), F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    found = counts.groupBy("sequence_id").agg(F.sum("n").alias("n_kmers"), (F.greatest(F.lit(0.0), F.log2(n) - s / n) / (k * float(np.log2(len(alphabet))))).alias("entropy"))
    return df.select("sequence_id").distinct().join(found, "sequence_id", "left").fillna(0, subset=["n_kmers"]).fillna(0.0, subset=["entropy"])


def kmer_space(df: DataFrame, k: int) -> DataFrame:
    """(sequence_id, kmer, x, y, n, frequency) of every possible k-mer of every sequence, 0 where it doesn't occur: for small k.

    x and y are the cell of the chaos-game matrix, as in :func:`fcgr`.
    """
    words = ["".join(w) for w in product(S.BASES, repeat=k)]
    cell = [(w, *(int("".join(bits["ACGT".index(b)] for b in w), 2) for bits in ("0011", "0110"))) for w in words]
    dim = F.broadcast(df.sparkSession.createDataFrame(cell, "kmer string, x int, y int"))  # 4^k rows
    rows = df.select("sequence_id").distinct().crossJoin(dim)
    return rows.join(kmer_counts(df, k), ["sequence_id", "kmer"], "left").fillna(0, subset=["n"]).fillna(0.0, subset=["frequency"])


def deduplicated(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row, in the given order, of all rows with the same text; rows with a null text are left out.

    A minimum over a struct of all columns, so copies fall out before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in (text, *order)]
    first = F.min(F.struct(*order, *rest))
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(first.alias("_r")).select(*[F.col(c) if c == text else F.col(f"_r.{c}").alias(c) for c in df.columns])


def base_context(df: DataFrame) -> DataFrame:
    """(sequence_id, position, base, previous): every base with the one before it (N at the start), one-hot in c_* and p_*."""
    n = F.col("piece_")
    parts = pieces(df.select("sequence_id", F.concat(F.lit("N"), F.col("sequence")).alias("sequence")), 2).withColumnRenamed("part", "piece_")
    pairs = F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.struct(i.alias("at"), F.substring(n, i + 1, F.lit(1)).alias("base"), F.substring(n, i, F.lit(1)).alias("previous")))
    rows = parts.select("sequence_id", "first", F.explode(pairs).alias("x")).select("sequence_id", (F.col("first") + F.col("x.at") - 1).cast("long").alias("position"), "x.base", "x.previous")
    return rows.select("*", *[(F.col(c) == b).cast("int").alias(f"{c[0] if c == 'previous' else 'c'}_{b}") for c in ("base", "previous") for b in S.BASES])
