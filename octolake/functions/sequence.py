"""Column functions over nucleotide and residue strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BASES = "ACGT"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: The standard genetic code (NCBI table 1), codons in the order of TCAG, and its start codons. Fixed values.
CODE_ORDER = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("TTG", "CTG", "ATG")
#: Further codes of the NCBI's list by number: name, residues in the same order, starts. Fixed values.
CODES = {
    1: ("standard", STANDARD_CODE, STARTS),
    2: ("vertebrate_mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", ("ATT", "ATC", "ATA", "ATG", "GTG")),
    4: ("mold_mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    11: ("bacterial", STANDARD_CODE, ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
}
#: Symbols that are compared at once.
MIRROR_SYMBOLS = 1 << 20


def clean(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def count_of(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b)).otherwise(F.lit(0.0))


def entropy(counts: list[Column], symbols: int | None = None) -> Column:
    """Shannon entropy of counts over log2 of the number of symbols; 0 without any count."""
    n = len(counts) if symbols is None else symbols
    # log N - (sum of c log c) / N, folded over an array, so that the generated code stays small for long alphabets
    all_counts = F.array(*[c.cast("double") for c in counts])
    folded = F.aggregate(all_counts, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s")), lambda t, c: F.struct((t["n"] + c).alias("n"), (t["s"] + F.when(c > 0, c * F.log2(F.when(c > 0, c))).otherwise(0.0)).alias("s")))
    bits = F.aggregate(F.array(folded), F.lit(0.0), lambda t, f: t + F.when(f["n"] > 0, F.log2(F.when(f["n"] > 0, f["n"])) - f["s"] / F.when(f["n"] > 0, f["n"])).otherwise(0.0))
    return F.greatest(bits, F.lit(0.0)) / F.log2(F.lit(float(n)))


def genetic_code(code: int | str = 1) -> tuple[str, tuple[str, ...]]:
    """Residues in the order of TCAG and start codons of a code by its number or name; an unknown one is an error."""
    for number, (name, residues, starts) in CODES.items():
        if code in (number, name):
            return residues, starts
    raise ValueError(f"unknown genetic code: {code!r}")


def _known_codon(codon: Column) -> Column:
    return codon.rlike("^[ACGT]{3}$")


def amino_acid(codon: Column, code: int | str = 1) -> Column:
    """The residue of a codon, * for stops, X where a base is ambiguous."""
    residues, _ = genetic_code(code)
    at = [F.instr(F.lit(CODE_ORDER), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    index = (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2]
    known = _known_codon(codon)
    return F.when(known, F.substring(F.lit(residues), F.when(known, index).otherwise(1), F.lit(1))).otherwise(F.lit("X"))


def is_start(codon: Column, code: int | str = 1) -> Column:
    return codon.isin(*genetic_code(code)[1])


def substitution_type(a: Column, b: Column) -> Column:
    """transition within purines or pyrimidines, transversion between them, null for equal or unknown bases."""
    known = a.isin(*BASES) & b.isin(*BASES) & (a != b)
    return F.when(known, F.when(a.isin("A", "G") == b.isin("A", "G"), F.lit("transition")).otherwise(F.lit("transversion")))


def position_fraction(position: Column, length: Column) -> Column:
    """position / (length - 1); NaN before the start and for lengths up to 1."""
    return F.when((position >= 0) & (length > 1), position / F.when(length > 1, length - 1)).otherwise(F.lit(float("nan")))


def codon_cell(codon: Column) -> tuple[Column, Column]:
    """Row and column of an unambiguous codon in an 8 x 8 table in ACGT order, null for others."""
    at = [F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    index = F.when(_known_codon(codon), at[0] * 16 + at[1] * 4 + at[2])
    return F.floor(index / 8).cast("int"), F.pmod(index, F.lit(8)).cast("int")


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all strings of an Arrow array in one array, and the first index of each string (null: no symbols)."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets, data = (np.frombuffer(b, kind) if b is not None else np.zeros(0, kind) for b, kind in zip(texts.buffers()[1:], (np.int64, np.uint8)))
    edges = offsets[texts.offset : texts.offset + len(texts) + 1] if len(offsets) else np.zeros(1, np.int64)
    flat = data[edges[0] : edges[-1]]
    if len(flat) and flat.max() > 127:  # symbols beyond ASCII: one number a symbol instead of its bytes
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        return np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return flat, edges - edges[0]


def mirrored_places(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per string, the places that equal its own reverse complement: symbol i against the complement of symbol n - 1 - i."""
    other = np.arange(128, dtype=flat.dtype)
    other[[ord(b) for b in "ACGT"]] = [ord(b) for b in "TGCA"]
    out = np.zeros(len(edges) - 1, np.int64)
    at = 0
    while at < len(out):  # strings are taken together up to a bounded number of symbols; a longer one is alone
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + MIRROR_SYMBOLS, "right")) - 1)
        if end == at + 1:
            a, b = int(edges[at]), int(edges[end])
            for lo in range(a, b, MIRROR_SYMBOLS):
                hi = min(b, lo + MIRROR_SYMBOLS)
                far = flat[a + b - hi : a + b - lo][::-1]
                out[at] += np.count_nonzero(flat[lo:hi] == np.where(far < 128, other[np.minimum(far, 127)], far))
        else:
            lo, hi = int(edges[at]), int(edges[end])
            some = edges[at : end + 1] - lo
            owner = np.repeat(np.arange(end - at), np.diff(some))
            far = flat[lo:hi][some[owner] + some[owner + 1] - 1 - np.arange(hi - lo)]
            same = flat[lo:hi] == np.where(far < 128, other[np.minimum(far, 127)], far)
            out[at:end] = np.bincount(owner, weights=same, minlength=end - at)
        at = end
    return out


@F.arrow_udf(LongType())
def _mirrored(column: pa.Array) -> pa.Array:
    return pa.array(mirrored_places(*symbols(column)))


def mirror_similarity(c: Column) -> Column:
    """Share of places at which a string equals its own reverse complement; 0 for empty and null strings.

    The places are counted on whole Arrow batches, in time in proportion to the symbols.
    """
    n = F.length(c)
    return F.when(n > 0, _mirrored(c) / F.when(n > 0, n)).otherwise(0.0)


def equal_places(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Per pair of strings, the places at which both have the same symbol, counted from the start."""
    (x, x_edges), (y, y_edges) = symbols(a), symbols(b)
    n = np.minimum(np.diff(x_edges), np.diff(y_edges))
    out = np.zeros(len(n), np.int64)
    at = 0
    total = np.concatenate([[0], np.cumsum(n)])
    while at < len(n):  # pairs are taken together up to a bounded number of symbols; a longer one is alone
        end = max(at + 1, int(np.searchsorted(total, total[at] + MIRROR_SYMBOLS, "right")) - 1)
        owner = np.repeat(np.arange(at, end), n[at:end])
        inside = np.arange(len(owner)) - np.repeat(total[at:end] - total[at], n[at:end])
        same = x[x_edges[owner] + inside].astype(np.uint32) == y[y_edges[owner] + inside].astype(np.uint32)
        out[at:end] = np.bincount(owner - at, weights=same, minlength=end - at)
        at = end
    return out


@F.arrow_udf(LongType())
def _equal_places(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(equal_places(a, b))


def positional_identity(a: Column, b: Column) -> Column:
    """Equal places of two strings over the longer length; 1 for two empty strings, null if either is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longer > 0, _equal_places(a, b) / F.when(longer > 0, longer)).otherwise(1.0)


def valid(c: Column, alphabet: str) -> Column:
    """Whether a string is not empty and holds letters of the alphabet alone; false for null."""
    return F.coalesce(c.rlike(f"^[{alphabet}]+$"), F.lit(False))
