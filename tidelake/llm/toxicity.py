"""Toxicity by weak supervision.

Many voters (one per word of a lexicon, patterns, and words learned from labelled training documents) look at every text. A generative label model with one latent class
estimates from the votes of all training documents how often each voter fires on either class (expectation-maximisation over
the table of distinct vote vectors, one small aggregation a step) and, from joint firing, which voters are correlated;
correlated voters share their weight. A linear classifier is then trained on the model's posterior labels
of a bounded sample and scores all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import Stage
from tidelake.llm.words import U, batches_of, scan

# Words that insult or demean, one voter each.
LEXICON = (
    "bastard bitch clown coward crap damn despicable disgusting dumb filth fool freak garbage hate idiot imbecile jerk "
    "kill loser moron parasite pathetic scum scumbag shit stupid trash ugly useless vermin vile worthless"
).split()
PATTERNS = ("insulting_you", "repeated_insults", "no_insult", "several_learned", "dense_learned", "no_learned")
LEARNED_VOTERS = 16  # learned words are dealt out to so many voters
LEARNED_WORDS = 4096
LABELLED_DOCS = 40_000  # labelled training documents that words are learned from, about
STEPS = 8
LABEL_WEIGHT = 5.0  # a labelled document counts as so many others
SAMPLE_DOCS = 20_000  # training documents of the linear classifier, about
SEPARATORS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_NAMES = [*LEXICON, *PATTERNS, *(f"learned_{k}" for k in range(LEARNED_VOTERS))]
_P = len(LEXICON)


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for _, data, offsets in batches_of(pa.array(words)):
        out.append(scan(data, offsets, SEPARATORS)[0])
    return np.concatenate(out)


class Vocabulary:
    """Hashes of the lexicon's words and of learned words with their weights; picklable and of bounded size."""

    def __init__(self, learned: np.ndarray, weights: np.ndarray):
        lexicon = _hashes(LEXICON)
        fresh = ~np.isin(learned, lexicon)
        values = np.concatenate([lexicon, learned[fresh]])
        voters = np.concatenate([np.arange(_P), _P + len(PATTERNS) + np.arange(int(fresh.sum())) % LEARNED_VOTERS])
        weights = np.concatenate([np.zeros(_P), weights[fresh]])
        order = np.argsort(values)
        self.values, self.voters, self.weights = values[order], voters[order], weights[order]
        self.you = _hashes(["you"])[0]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.values & U((1 << 18) - 1)).astype(np.int64)] = True

    def votes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bitmask of the voters that fire, and per text: lexicon words, learned words, their weights' sum, all words."""
        n = len(column)
        masks, numbers = np.zeros(n, np.int64), np.zeros((n, 4))
        for i, data, offsets in batches_of(pc.utf8_lower(column)):
            words, first, _, _ = scan(data, offsets, SEPARATORS)
            numbers[i : i + len(first) - 1, 3] = np.diff(first)
            at = np.flatnonzero(self.maybe[(words & U((1 << 18) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.values, words[at]), len(self.values) - 1)
            ok = self.values[k] == words[at]
            at, k = at[ok], k[ok]
            voter = self.voters[k]
            doc = np.searchsorted(first, at, side="right") - 1 + i
            np.bitwise_or.at(masks, doc, np.int64(1) << voter)
            old = voter < _P
            np.add.at(numbers[:, 0], doc[old], 1)
            np.add.at(numbers[:, 1], doc[~old], 1)
            np.add.at(numbers[:, 2], doc, self.weights[k])
            at, doc = at[old], doc[old]
            for back in (1, 2, 3):  # "you ... idiot" within three words of one text
                near = (at >= back) & (at - back >= first[doc - i])
                hit = near.copy()
                hit[near] = words[at[near] - back] == self.you
                np.bitwise_or.at(masks, doc[hit], np.int64(1 << _P))
        known, learned, _, total = numbers.T
        for k, fires in enumerate((known >= 2, known == 0, learned >= 3, learned > 0.005 * total, learned == 0), _P + 1):
            masks |= np.where(fires, np.int64(1 << k), 0)
        return masks, numbers


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to document frequencies of words by class."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        seen, toxic = [np.zeros(0, U)], [np.zeros(0, bool)]
        for i, data, offsets in batches_of(pc.utf8_lower(batch.column(1))):
            words, first, _, _ = scan(data, offsets, SEPARATORS)
            for d in range(len(offsets) - 1):
                one = np.unique(words[first[d] : first[d + 1]])
                seen.append(one)
                toxic.append(np.full(len(one), labels[i + d]))
        values, where = np.unique(np.concatenate(seen), return_inverse=True)
        t = np.bincount(where, weights=np.concatenate(toxic), minlength=len(values)).astype(np.int64)
        n = np.bincount(where, minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(t), pa.array(n), pa.array([int(labels.sum())] + [0] * (len(t) - 1) if len(t) else [], pa.int64()), pa.array([len(labels)] + [0] * (len(t) - 1) if len(t) else [], pa.int64())], ["word", "t", "n", "all_t", "all_n"])


def learn_words(rows: DataFrame, most: int = LEARNED_WORDS) -> Vocabulary:
    """Words of labelled texts (label, text) that mark toxic ones: in five or more, at least half of those that hold the word,
    and six standard deviations above chance; the ``most`` clearest, weighted by log odds."""
    counts = Stage(rows.mapInArrow(_word_rows, "word long, t long, n long, all_t long, all_n long"), "words").read()
    totals = counts.agg(F.sum("all_t"), F.sum("all_n")).first()
    toxic, total = float(totals[0] or 0), float(totals[1] or 0)
    if not 0 < toxic < total:
        return Vocabulary(np.zeros(0, U), np.zeros(0))
    p = toxic / total
    z = (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    grouped = counts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where((F.col("t") >= 5) & (2 * F.col("t") >= F.col("n")))
    top = grouped.withColumn("z", z).where("z >= 6").orderBy(F.desc("z"), "word").limit(most).toArrow()
    t, n = top["t"].to_numpy().astype(float), top["n"].to_numpy().astype(float)
    return Vocabulary(top["word"].to_numpy().astype(np.int64).view(U), np.log((t + 0.5) / (toxic + 1)) - np.log((n - t + 0.5) / (total - toxic + 1)))


def _vote_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, numbers = shared.value.votes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks), pa.array(numbers.tolist(), pa.list_(pa.float64()))], ["id", "mask", "numbers"])

    return run


@dataclass
class LabelModel:
    """Class prior, rates at which each voter fires on toxic and other texts, and the share of its weight each keeps."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        fires, rests = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        bias = math.log(self.prior / (1 - self.prior)) + float((self.share * rests).sum())
        return bias, self.share * (fires - rests)


def _bit(k: int) -> Column:
    return F.shiftright("mask", k).bitwiseAND(F.lit(1).cast("long")).cast("double")


def fit_label_model(votes: DataFrame, steps: int = STEPS) -> LabelModel:
    """``votes``: mask, label (null if unknown), n. Labelled rows keep their label; the rest get posteriors."""
    m = len(_NAMES)
    bits = [_bit(k) for k in range(m)]
    known = votes.where("label is not null").groupBy("label").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("n") * x) for x in bits]).alias("on")).collect()  # two rows
    number = {r["label"]: float(r["n"]) for r in known}
    fires = {r["label"]: np.array(r["on"]) for r in known}
    prior = min(0.9, max(0.01, number.get(1, 0) / sum(number.values()))) if number else 0.1
    guess_toxic, guess_clean = np.full(m, 0.1), np.full(m, 0.002)  # worth ten documents each: an insult speaks for toxicity
    for name, a, b in (("repeated_insults", 0.4, 0.001), ("no_insult", 0.1, 0.95), ("several_learned", 0.4, 0.01), ("dense_learned", 0.4, 0.01), ("no_learned", 0.3, 0.8)):
        guess_toxic[_NAMES.index(name)], guess_clean[_NAMES.index(name)] = a, b
    toxic = (fires.get(1, 0) + 10 * guess_toxic) / (number.get(1, 0) + 10)
    clean = (fires.get(0, 0) + 10 * guess_clean) / (number.get(0, 0) + 10)
    share = np.ones(m)
    for step in range(steps):
        bias, weights = LabelModel(prior, toxic, clean, share).weights()
        odds = F.lit(bias)
        for k in range(m):
            odds = odds + bits[k] * float(weights[k])
        scored = votes.withColumn("n", F.when(F.col("label").isNotNull(), F.col("n") * LABEL_WEIGHT).otherwise(F.col("n"))).withColumn("p", F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-odds))))
        pairs = [(a, b) for a in range(m) for b in range(a)] if step == 1 else []
        sums = scored.agg(
            F.sum("n"), F.sum(F.col("n") * F.col("p")), F.array(*[F.sum(F.col("n") * F.col("p") * x) for x in bits]), F.array(*[F.sum(F.col("n") * x) for x in bits])
        ).first()
        total, mass = float(sums[0] or 0), float(sums[1] or 0)
        if not total:
            break
        on, fired = np.array(sums[2]), np.array(sums[3])
        toxic = (on + 0.5) / (mass + 1)
        clean = np.clip((fired - on + 0.05) / (total - mass + 1), 1e-6, 1 - 1e-6)
        toxic = np.clip(toxic, 1e-6, 1 - 1e-6)
        prior = min(0.9, max(0.01, mass / total))
        if pairs:
            share = _shares(scored, toxic, mass, m)
    return LabelModel(prior, np.clip(toxic, 1e-6, 1 - 1e-6), np.clip(clean, 1e-6, 1 - 1e-6), share)


def _shares(scored: DataFrame, toxic: np.ndarray, mass: float, m: int) -> np.ndarray:
    """1 / (1 + the sum of a voter's positive correlations with others, given the toxic class)."""
    joint = np.zeros((m, m))
    exploded = scored.select((F.col("n") * F.col("p")).alias("w"), F.array_compact(F.array(*[F.when(_bit(k) > 0, k) for k in range(m)])).alias("on"))
    both = exploded.select("w", F.explode("on").alias("a"), "on").select("w", "a", F.explode("on").alias("b")).where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    for r in both.collect():  # at most m * m rows
        joint[r["a"], r["b"]] = r["w"] / max(mass, 1e-9)
    spread = np.sqrt(toxic * (1 - toxic))
    correlation = (joint - np.outer(toxic, toxic)) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(correlation, 0)
    return 1 / (1 + np.clip(correlation - 0.1, 0, 1).sum(1))


def _features(masks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bits = (masks[:, None] >> np.arange(len(_NAMES))) & 1
    per = numbers[:, :3] / np.sqrt(numbers[:, 3:] + 1)
    return np.column_stack([bits, np.log1p(numbers), per, np.ones(len(masks))]).astype(float)


def fit_classifier(masks: np.ndarray, numbers: np.ndarray, posterior: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    x = _features(masks, numbers)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - posterior) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        masks, numbers = self.vocabulary.votes(column)
        return 1 / (1 + np.exp(-np.clip(_features(masks, numbers) @ self.weights, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_docs: int = LABELLED_DOCS, sample_docs: int = SAMPLE_DOCS
) -> tuple[LabelModel, Classifier]:
    """Learned words from about ``labelled_docs`` labelled training rows, the label model from the votes on all training rows,
    and the classifier from about ``sample_docs`` of them (both samples by a hash of the id).

    ``labels`` (id, 0 or 1) is used for training rows only; null labels are unknown, of several the largest counts."""
    spark = docs.sparkSession
    rows = docs.where(training).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))

    def part(df: DataFrame, most: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, df.count()))))

    chosen = part(one, labelled_docs)  # about labelled_docs rows of 12 bytes, whatever the input
    vocabulary = learn_words(rows.join(F.broadcast(chosen), "id").select("label", F.coalesce("text", F.lit("")).alias("text")))
    shared = spark.sparkContext.broadcast(vocabulary)  # at most LEARNED_WORDS words
    votes = Stage(rows.mapInArrow(_vote_rows(shared), "id long, mask long, numbers array<double>"), "votes").read()
    table = Stage(votes.join(one, "id", "left").groupBy("mask", "label").agg(F.count(F.lit(1)).alias("n")), "vote-table").read()
    model = fit_label_model(table)
    sample = part(votes, sample_docs).select("mask", "numbers").toArrow()
    masks, numbers = sample["mask"].to_numpy(), np.array(sample["numbers"].to_pylist(), float).reshape(-1, 4)
    bias, weights = model.weights()
    odds = bias + ((masks[:, None] >> np.arange(len(_NAMES))) & 1) @ weights
    return model, Classifier(vocabulary, fit_classifier(masks, numbers, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity (a column of this name is replaced). Null texts score as empty ones."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(pc.cast(batch.column(at), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
