"""Scores for abusive, hateful and sexual wording: non-negative positive-unlabelled learning over windows of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolake.llm.words import KEYED, folding
from octolake.sources.shared import cut

#: Documents that a model is fitted on: confirmed ones, and unlabelled ones that are drawn from the whole corpus, both
#: chosen by a hash of doc_id. Priors of documents, thresholds and rates come from all documents and all labels.
MOST_CONFIRMED, MOST_UNLABELLED = 2400, 2500
#: Words of a window, and words between the windows of confirmed texts that are trained on (unlabelled ones: WINDOW).
WINDOW, STRIDE = 6, 3
#: Hashed features.
BITS = 18
SIZE = 1 << BITS
#: A feature counts if so many of the documents fitted on have it.
LEAST_DOCS = 3
#: Step size where the corrected risk of the unlabelled windows is negative.
DISCOUNT = 0.1
#: Class prior of the first fit, which takes all windows of confirmed texts as positive and only has to part them
#: roughly; from then on priors are estimated, within these bounds.
FIRST_PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.002, 2e-5, 0.2
#: What an unlabelled text above the parting weighs against a confirmed one.
WRONG = 1.5
#: Scores are counted in steps of this size up to this distance from 0.
STEP, FARTHEST = 0.1, 80.0

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНαεορυκντιΑΕΟΡΥΚΝΤΙΒΗΜΖ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHaeopukvtiAEOPYKNTIBHMZ")
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_JOINED = re.compile(r"\\[-/@]|\{\}|[­​‌‍⁠]")
_FORMAT = re.compile(r"\\(?:text(?:bf|it|tt|sc|rm|sf|up|sl)|emph|underline|mbox|hbox)\s*\{([^{}]*)\}")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$!|]{1,3}[^\W_]+)*")
_REPEAT = re.compile(r"(.)\1{2,}")


def _undone(token: str) -> str:
    """A token without look-alike signs and drawn-out letters; pure numbers become one word."""
    if token.isalpha():
        return _REPEAT.sub(r"\1", token) if len(token) > 3 else token
    if token.isdigit():
        return "0"
    return _REPEAT.sub(r"\1", re.sub(r"[*#]+", "*", token.translate(_SIGNS)))


def tokens(text: str) -> list[str]:
    """Words of the whole source, comments and definitions included, with disguises undone as far as signs go."""
    if "\\" in text or "{}" in text:
        text = KEYED.sub(" ", _JOINED.sub("", text))
        text = _FORMAT.sub(r"\1", text)
        text = _COMMAND.sub(" ", text)
    if not text.isascii():
        text = text.translate(_LOOKALIKE).translate(folding(text))
    return _TOKEN.findall(text.lower())


def spelled(raw: list[str]) -> list[str]:
    """Three or more single letters in a row are one word: ``s h o w`` is ``show``."""
    if not raw:
        return raw
    single = np.fromiter(map(len, raw), np.int32, len(raw)) == 1
    if not (single[:-2] & single[1:-1] & single[2:]).any():
        return raw
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= 3:
            out += raw[at:a]
            run = "".join(raw[a:b])
            out.append(run)
            at = b
    return out + raw[at:]


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its character n-grams (3 to 5 with its edges), each once."""
    word = _undone(word)
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [crc32(f"w{word}".encode()) & (SIZE - 1), *sorted({crc32(g.encode()) & (SIZE - 1) for g in grams})]


def pair_features(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B1) + second.astype(np.uint64) * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    return ((mixed ^ (mixed >> np.uint64(15))) & np.uint64(SIZE - 1)).astype(np.int64)


class Lexicon:
    """Ids of words, with their features in rows; a feature of a word with n features counts n ** -0.5."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.features: list[np.ndarray] = []

    def coded(self, raw: list[str]) -> list[int]:
        ids, out = self.ids, []
        for w in raw:
            i = ids.get(w)
            if i is None:
                i = ids[w] = len(ids)
                self.features.append(np.array(word_features(w), np.int32))
            out.append(i)
        return out

    def arrays(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words from ``start``: row of each entry, feature, weight, and the words' own hashes."""
        some = self.features[start:]
        n = np.fromiter(map(len, some), np.int64, len(some))
        flat = np.concatenate(some) if some else np.zeros(0, np.int32)
        return np.repeat(np.arange(len(n), dtype=np.int32), n), flat, np.repeat((1 / np.sqrt(np.maximum(n, 1))).astype(np.float32), n), np.fromiter((f[0] for f in some), np.int64, len(some))


@dataclass
class Model:
    """score = bias + word weights + weights of neighbouring words, summed over a window."""

    words: np.ndarray
    pairs: np.ndarray
    bias: float
    prior: float = float("nan")


def _windows(n: int, stride: int) -> np.ndarray:
    """Starts of windows over n words; the last ends with the last word."""
    starts = np.arange(0, max(1, n - WINDOW + 1), stride)
    return starts if n <= WINDOW or starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


class _Bag:
    """Windows of documents as rows of word ids (padded by a word without features) and pair features."""

    def __init__(self, docs: list[list[int]], lexicon: Lexicon, stride: int) -> None:
        pad = len(lexicon.ids)
        self.pad = pad
        rows, owner = [], []
        for d, ids in enumerate(docs):
            a = np.concatenate([np.array(ids, np.int32), np.full(max(0, WINDOW - len(ids)), pad, np.int32)])
            rows.append(a[_windows(len(ids), stride)[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(rows[-1]), d, np.int32))
        self.rows = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)


def _known(bags: list[_Bag], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Which word and pair features stand in at least LEAST_DOCS documents of the bags: rarer ones would be learned by heart."""
    entry_row, entry_feature, _, own = lexicon.arrays()
    start = np.searchsorted(entry_row, np.arange(len(own) + 1))
    hashes = np.append(own, 0)
    words, pairs = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for bag in bags:
        edges = np.searchsorted(bag.owner, np.arange(0, int(bag.owner.max(initial=-1)) + 2, 100))
        for lo, hi in zip(edges, np.append(edges[1:], len(bag.owner))):
            owner, rows = bag.owner[lo:hi].astype(np.int64), bag.rows[lo:hi]
            seen = np.unique(np.repeat(owner, WINDOW) << 32 | rows.ravel())
            doc, word = seen >> 32, seen & 0xFFFFFFFF
            doc, word = doc[word < len(own)], word[word < len(own)]
            n = start[word + 1] - start[word]
            flat = entry_feature[np.repeat(start[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            words += np.bincount(np.unique(np.repeat(doc, n) * SIZE + flat) % SIZE, minlength=SIZE)
            both = pair_features(hashes[rows[:, :-1]], hashes[rows[:, 1:]])
            pairs += np.bincount(np.unique(np.repeat(owner, WINDOW - 1) * SIZE + both.ravel()) % SIZE, minlength=SIZE)
    return words >= LEAST_DOCS, pairs >= LEAST_DOCS


def _fit(positive: np.ndarray, unlabelled: np.ndarray, lexicon: Lexicon, known: tuple[np.ndarray, np.ndarray], prior: float, rounds: int, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the class-prior-corrected risk with the non-negative correction.

    Risk: prior x E_P[l(+)] + max(0, E_U[l(-)] - prior x E_P[l(-)]), l the logistic loss. While the second term is
    negative the step goes up its gradient, discounted, instead, which keeps a flexible model from fitting the positives by heart.
    """
    entry_row, entry_feature, entry_weight, own = lexicon.arrays()
    keep = known[0][entry_feature]
    entry_row, entry_feature, entry_weight = entry_row[keep], entry_feature[keep], entry_weight[keep]
    vocabulary = len(lexicon.ids)
    rows = np.concatenate([positive, unlabelled])
    n_pos, n_unl = len(positive), len(unlabelled)
    hashes = np.append(own, 0)
    pairs = pair_features(hashes[rows[:, :-1]], hashes[rows[:, 1:]])
    flat_rows, flat_pairs = rows.ravel(), pairs.ravel()
    theta = [np.zeros(SIZE), np.zeros(SIZE), np.zeros(1)]
    theta[2][0] = np.log(prior / (1 - prior))
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    scale = 1.0 / prior
    for step in range(1, rounds + 1):
        word = np.append(np.bincount(entry_row, weights=theta[0][entry_feature] * entry_weight, minlength=vocabulary), 0.0)
        z = theta[2][0] + word[rows].sum(1) + theta[1][pairs].sum(1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        zp, zu = z[:n_pos], z[n_pos:]
        excess = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = np.empty(len(z))
        if excess >= 0:
            slope[:n_pos] = -prior / n_pos  # prior x (p - 1) for l(+), minus prior x p for l(-)
            slope[n_pos:] = p[n_pos:] / n_unl
        else:
            slope[:n_pos] = DISCOUNT * prior * p[:n_pos] / n_pos
            slope[n_pos:] = -DISCOUNT * p[n_pos:] / n_unl
        slope *= scale
        per_word = np.bincount(flat_rows, weights=np.repeat(slope, WINDOW), minlength=vocabulary + 1)[:vocabulary]
        grads = [
            np.bincount(entry_feature, weights=per_word[entry_row] * entry_weight, minlength=SIZE) + decay * theta[0],
            np.bincount(flat_pairs, weights=np.repeat(slope, WINDOW - 1), minlength=SIZE) + decay * theta[1],
            np.array([slope.sum()]),
        ]
        grads[0] *= known[0]
        grads[1] *= known[1]
        for t, g, m, v in zip(theta, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t -= rate * min(1.0, 1.5 * (1 - step / (rounds + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(theta[0], theta[1], float(theta[2][0]))


def score_rows(model: Model, rows: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    entry_row, entry_feature, entry_weight, own = lexicon.arrays()
    word = np.append(np.bincount(entry_row, weights=model.words[entry_feature] * entry_weight, minlength=len(own)), 0.0)
    hashes = np.append(own, 0)
    return model.bias + word[rows].sum(1) + model.pairs[pair_features(hashes[rows[:, :-1]], hashes[rows[:, 1:]])].sum(1)


def _best(owner: np.ndarray, z: np.ndarray, docs: int) -> np.ndarray:
    best = np.full(docs, -np.inf)
    np.maximum.at(best, owner, z)
    return best


def train(confirmed: list[str], unlabelled: list[str]) -> Model | None:
    """Fit on confirmed toxic and unlabelled texts; None with fewer than two confirmed or no unlabelled texts.

    A confirmed text is toxic somewhere only. The first fits take all its windows as positive; the next ones take the
    windows that were scored highest in each text, and leave out texts whose best window looks like unlabelled ones, for
    readers err. Windows of one half of the texts are scored by a fit on the other half, so no text speaks for itself.
    The prior of toxic windows is estimated from those scores: the share of unlabelled texts above the parting against
    that of confirmed ones, times the toxic windows of such a text, over the windows of a text.
    """
    lexicon = Lexicon()
    coded = [[c for c in (lexicon.coded(spelled(tokens(t))) for t in texts) if c] for texts in (confirmed, unlabelled)]
    pos, unl = _Bag(coded[0], lexicon, STRIDE), _Bag(coded[1], lexicon, WINDOW)
    if len(coded[0]) < 2 or not len(unl.rows):
        return None
    known = _known([pos, unl], lexicon)
    half = pos.owner % 2
    chosen = np.ones(len(pos.rows), bool)
    prior = FIRST_PRIOR
    for rounds in (30, 40):
        z, z_unl = np.full(len(pos.rows), -np.inf), np.zeros((2, len(unl.rows)))
        for side in (0, 1):
            mine = chosen & (half == side)
            fitted = _fit(pos.rows[mine if mine.any() else half == side], unl.rows, lexicon, known, prior, rounds)
            z[half != side] = score_rows(fitted, pos.rows[half != side], lexicon)
            z_unl[1 - side] = score_rows(fitted, unl.rows, lexicon)
        best = _best(pos.owner, z, len(coded[0]))
        best_unl = [_best(unl.owner, z_unl[side], len(coded[1])) for side in (0, 1)]
        usual = np.array([_parting(best[np.arange(len(best)) % 2 == side], best_unl[side]) for side in (0, 1)])
        chosen = (z >= best[pos.owner] - 1.0) & (z >= usual[half])
        above = best >= usual[np.arange(len(best)) % 2]
        docs = np.mean([np.mean(b >= u) for b, u in zip(best_unl, usual)]) / max(0.05, above.mean())
        windows = chosen.sum() / max(1, above.sum()) * STRIDE / WINDOW
        prior = float(np.clip(docs * windows * len(coded[1]) / len(unl.rows), LEAST_PRIOR, MOST_PRIOR))
    model = _fit(pos.rows[chosen], unl.rows, lexicon, known, prior, 90)
    model.prior = prior
    return model


def _parting(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The score that most positive and least unlabelled texts reach, by the weighted difference of the shares."""
    cuts = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / max(1, len(x))
    return float(cuts[np.argmax(above(positive) - WRONG * above(unlabelled))])


def best_share(corpus: np.ndarray, toxic: np.ndarray, wrong: float = WRONG) -> tuple[float, float]:
    """The share of the corpus to flag for the best F1, and the estimated share of toxic documents.

    ``corpus`` and ``toxic`` are counts of documents by steps of the score, from the lowest on: of all documents, and of
    confirmed ones that the model wasn't fitted on. Recall is taken one standard deviation of its count lower, so that
    few confirmed ones don't make much of chance. At the step that parts both best, what the corpus has above is taken
    for the share of toxic documents, and what confirmed ones have below for readers' errors; hits are the recall of the
    others times that share. Of the steps whose F1 is within 0.01 of the best the middle one is taken. (0, 0) without
    documents, or if confirmed ones score no higher than others.
    """
    if not corpus.sum() or not toxic.sum():
        return 0.0, 0.0
    flagged = corpus[::-1].cumsum()[::-1] / corpus.sum()
    hits = toxic[::-1].cumsum()[::-1]
    recall = (hits - np.sqrt(hits)) / toxic.sum()
    part = int(np.argmax(recall - wrong * flagged))
    if recall[part] <= wrong * flagged[part]:
        return 0.0, 0.0
    share = flagged[part]
    f1 = 2 * share * np.minimum(1.0, recall / recall[part]) / (share + flagged)
    good = np.flatnonzero(f1 >= f1.max() - 0.01)
    return float(flagged[(good[0] + good[-1]) // 2]), float(share)


class _Scorer:
    """Scores texts by their best window of WINDOW words, at every word, with several models at once."""

    def __init__(self, models: list[Model]) -> None:
        self.models = models
        self.reset()

    def reset(self) -> None:
        self.lexicon = Lexicon()
        self.word, self.hash = np.zeros((len(self.models), 0)), np.zeros(0, np.int64)

    def many(self, texts: list[str]) -> np.ndarray:
        """A row of scores for each model; -inf for wordless texts."""
        if len(self.lexicon.ids) > 400_000:
            self.reset()
        coded = [self.lexicon.coded(spelled(tokens(t))) for t in texts]
        if len(self.lexicon.features) > len(self.hash):
            row, feature, weight, own = self.lexicon.arrays(len(self.hash))
            self.word = np.concatenate([self.word, np.stack([np.bincount(row, weights=m.words[feature] * weight, minlength=len(own)) for m in self.models])], 1)
            self.hash = np.append(self.hash, own)
        sizes = np.array([len(c) for c in coded])
        out = np.full((len(self.models), len(texts)), -np.inf)
        if not sizes.sum():
            return out
        ids = np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum()))
        hashes = self.hash[ids]
        both = pair_features(hashes[:-1], hashes[1:])
        # a window starts at every word that has WINDOW words of its text from there on, or at a short text's first
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.arange(len(ids))
        last = np.minimum(starts + WINDOW, ends[owner])
        use = (last - starts == WINDOW) | (starts == (ends - sizes)[owner])
        starts, last, owner = starts[use], last[use], owner[use]
        for i, model in enumerate(self.models):
            total_word = np.concatenate([[0.0], np.cumsum(self.word[i, ids])])
            total_pair = np.concatenate([[0.0], np.cumsum(model.pairs[both]), [0.0]])
            z = model.bias + total_word[last] - total_word[starts] + total_pair[last - 1] - total_pair[starts]
            _best_in_order(owner, z, out[i])
        return out


def _best_in_order(owner: np.ndarray, z: np.ndarray, out: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    out[owner[first]] = np.maximum.reduceat(z, first)
    return out


def doc_scores(model: Model, texts: list[str]) -> np.ndarray:
    scorer = _Scorer([model])
    return np.concatenate([scorer.many(texts[i : i + 200])[0] for i in range(0, len(texts), 200)]) if texts else np.zeros(0)


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, clear): readers' verdicts per document; repeated rows count once, missing verdicts not at all."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull()).select("label_id", "doc_id", "category", "annotator", "labelled_at").distinct()
    toxic = (F.lower(F.trim("category")) != "none").cast("int")
    return rows.groupBy("doc_id").agg(F.sum(toxic).alias("toxic"), F.sum(1 - toxic).alias("clear"))


def _chosen(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of the ids (all if there are fewer), by a hash, without sorting them or sending them to the driver."""
    n = ids.count()
    share = min(1.0, most / max(1, n))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["kind", "doc_id"])
    model = train(*[pdf.loc[pdf["kind"] == k, "text"].tolist() for k in ("confirmed", "unlabelled")])
    out = pd.DataFrame({"part": pd.Series(dtype=np.int32), "words": pd.Series(dtype=object), "pairs": pd.Series(dtype=object), "bias": pd.Series(dtype=float), "prior": pd.Series(dtype=float)})
    if model is not None:
        out.loc[0] = [int(pdf["part"].iloc[0]), model.words.astype(np.float32).tobytes(), model.pairs.astype(np.float32).tobytes(), model.bias, model.prior]
    return out


def half_of(c: Column) -> Column:
    """The half of the confirmed documents, 0 or 1, to which a document belongs."""
    return F.pmod(F.xxhash64(c, F.lit(5)), F.lit(2)).cast("int")


def fit_models(documents: DataFrame, labels: DataFrame) -> list[Model] | None:
    """Three models, each fitted in a task: on all chosen confirmed documents, and on either half of them (see :func:`half_of`).

    The unlabelled documents of a fit are drawn from the whole corpus, labelled or not. Texts don't pass the driver, only
    the models do, whose size is fixed. None if a half has too few confirmed documents.
    """
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    confirmed = _chosen(votes(labels).where("toxic > clear").select("doc_id"), MOST_CONFIRMED, 1)
    unlabelled = _chosen(documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")), MOST_UNLABELLED, 2).distinct()
    parts = F.explode(F.array(half_of(F.col("doc_id")), F.lit(2)))
    few = confirmed.select("doc_id", F.lit("confirmed").alias("kind"), parts.alias("part")).unionByName(unlabelled.select("doc_id", F.lit("unlabelled").alias("kind"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part")))
    rows = texts.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id", "kind", "part"])  # MOST_CONFIRMED and MOST_UNLABELLED, thrice at most
    made = rows.groupBy("part").applyInPandas(_fitted, "part int, words binary, pairs binary, bias double, prior double").collect()  # three rows
    models = {r["part"]: Model(np.frombuffer(r["words"], np.float32).astype(float), np.frombuffer(r["pairs"], np.float32).astype(float), r["bias"], r["prior"]) for r in made}
    return [models[p] for p in (2, 0, 1)] if len(models) == 3 else None


def _raw_scores(documents: DataFrame, models: list[Model]) -> DataFrame:
    """(doc_id, source, z, z0, z1) of every document with an id, in one pass over the corpus; null for wordless texts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(models)
        for pdf in it:
            for part in range(0, len(pdf), 200):
                some = pdf.iloc[part : part + 200]
                z = scorer.many([t if isinstance(t, str) else "" for t in some["text"]])
                z = np.where(np.isfinite(z), np.clip(z, -FARTHEST, FARTHEST), np.nan)
                yield pd.DataFrame({"doc_id": some["doc_id"], "source": some["source"], "z": z[0], "z0": z[1], "z1": z[2]})

    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, source string, z double, z0 double, z1 double")


def threshold_of(scores: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The score from which a document is flagged, and the estimated share of toxic documents, from all documents and labels.

    Every confirmed document is judged by the model of the half that it isn't in, so none speaks for itself. For either
    half :func:`best_share` gives the share to flag; the mean of both is the share that the model of all documents flags.
    Where confirmed documents are too few to tell, a document is flagged if its worst window is likelier toxic than not.
    """
    toxic = votes(labels).where("toxic > clear").select("doc_id", F.lit(1).alias("toxic"))
    z = lambda c: F.when(F.isnan(c), None).otherwise(F.floor((F.col(c) + FARTHEST) / STEP).cast("int"))
    rows = scores.join(toxic, "doc_id", "left").select(half_of(F.col("doc_id")).alias("half"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.array(z("z"), z("z0"), z("z1")).alias("steps"))
    steps = rows.select("half", "toxic", F.posexplode("steps").alias("model", "step")).where(F.col("step").isNotNull())
    other = F.when(F.col("half") + 1 != F.col("model"), F.col("toxic")).otherwise(0)
    counts = steps.groupBy("model", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(other).alias("t")).toPandas()  # three models, 2 FARTHEST / STEP steps each
    size = int(2 * FARTHEST / STEP) + 1
    table = {m: (np.bincount(g["step"], weights=g["n"], minlength=size), np.bincount(g["step"], weights=g["t"], minlength=size)) for m, g in counts.groupby("model")}
    if len(table) < 3:
        return np.inf, 0.0
    found = [f for f in (best_share(*table[m]) for m in (1, 2)) if f[0] > 0]
    if not found:
        return 0.0, 0.0
    flag, share = np.mean(found, axis=0)
    corpus = table[0][0]
    above = corpus[::-1].cumsum()[::-1] / corpus.sum()
    step = int(np.argmin(np.abs(above - flag)))
    return step * STEP - FARTHEST, float(share)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document; the score is in 0..1, ``flagged`` from the threshold on.

    The score is that of the document's worst window, so one sentence in a long source is enough. Null, empty and
    wordless texts score 0. Without confirmed examples nothing is flagged. The corpus is scored in one pass and isn't
    shuffled; the scores are written to the shared folder, and the threshold is set from them.
    """
    models = fit_models(documents, labels)
    if models is None:
        rows = documents.where(F.col("doc_id").isNotNull())
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    scores = cut(_raw_scores(documents, models), "scores")
    threshold, _ = threshold_of(scores, labels)
    known = F.col("z").isNotNull() & ~F.isnan("z")
    score = F.when(known & F.lit(bool(np.isfinite(threshold))), 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(min(threshold, FARTHEST))) - F.col("z")))))).otherwise(0.0)
    return scores.select("doc_id", "source", score.alias("score"), (known & (F.col("z") >= threshold)).alias("flagged"))


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) of every source; documents without a source form one row."""
    scored = score_documents(documents, labels).dropDuplicates(["doc_id"])
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
