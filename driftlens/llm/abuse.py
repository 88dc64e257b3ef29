"""Problem 1: a severity for every message, from cumulative-link ordinal regression on sparse text features.

P(grade > k) is the logistic of (w . x - threshold k): one weight vector serves all ordered thresholds. The
features are words, their runs of four letters, pairs of neighbouring words and of words one apart, and
classes of words with their pairs, so that wordings that no training sentence has are graded too. Half of the training rows
come without class features: words and letters have to tell by themselves as well. Messages are scored by
passage (sentence or clause); a message's severity is that of its worst passage: the expected grade, 0 to 3.

The model is fitted on the driver on the graded sentences of ``abuse_seeds``, a fixed set of some twenty thousand
rows, and on a sample of ordinary texts of the corpus, bounded by the parameter ORDINARY, as grade 0. The weights travel with the
function; all messages are scored, whole, in Arrow batches, without a shuffle. Only the id and the score move when
deliveries of a message meet.

Defined results: null, blank and wordless texts have severity 0. The latest delivery of a message counts; rows
with a null ``message_id`` are scored but not listed. An empty table gives an empty result. A column named
``severity`` in the input is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.abuse_seeds import TELLING, WORD_CLASS, templates, training_rows
from driftlens.llm.textnorm import Words, fold, join_spaced

GRADES = 3
#: A passage counts as abusive where grade 0 is less likely than not.
ABUSIVE = 0.5
PASSAGE = re.compile(r"[.!?;\n]+(?=\s|$)|\s[-–—|]\s|[.!?;:]{2,}|\n+")
#: Longer passages are read in overlapping windows of this many words; features of words further apart than that aren't made.
WINDOW, STRIDE = 14, 7
#: The bound of the sample of ordinary texts that the fit sees besides the graded sentences.
ORDINARY = 4000
LETTERS = (4,)
#: Values of the features by their sort: letters of a word are many, and each says little.
VALUES = {"~": 0.15, "#": 1.0}
#: How much more an ordinary passage counts in the fit than an abusive one, as nearly all passages are ordinary.
CALM_WEIGHT = 4.0
#: Rounds of each stage of the fit, and the shares of the ordinary passages that its later stages leave out as doubtful.
ROUNDS, DOUBTED = 40, (0.05, 0.02)
#: Classes of which one word keeps a passage out of the ordinary ones; and rows of no word at all.
STRONG = {"INS", "SEX", "HAT"}
EMPTY = 500
#: Values of the features by their sort: letters of a word are many, and each says little.
VALUES = {"~": 0.15, "#": 1.0}
#: How much more an ordinary passage counts in the fit than an abusive one, as nearly all passages are ordinary.
CALM_WEIGHT = 4.0
#: Classes of which one word keeps a passage out of the ordinary ones.
STRONG = {"INS", "SEX", "HAT"}


@lru_cache(200_000)
def letters(word: str) -> tuple[str, ...]:
    """The word itself and its character runs, with marks for its ends."""
    w = f"<{word}>"
    return (word, *("~" + w[i : i + n] for n in LETTERS for i in range(len(w) - n + 1)))


def pairs(words: list[str]) -> set[str]:
    """Neighbouring words, and words one apart."""
    out = {a + " " + b for a, b in zip(words, words[1:])}
    out.update([a + " _ " + b for a, b in zip(words, words[2:])])
    out.update(["^ " + words[0], words[-1] + " $"] if words else [])
    return out


def classes(words: list[str]) -> set[str]:
    """Classes of the words, and pairs of classes: anywhere in the passage, and of neighbours."""
    by_word = [WORD_CLASS.get(w, ()) for w in words]
    present = sorted({c for cs in by_word for c in cs})
    out = {"#" + c for c in present}
    for i, a in enumerate(present):
        for b in present[i + 1 :]:
            out.add(f"#{a}&{b}")
    for left, right in zip(by_word, by_word[1:]):
        for a in left:
            for b in right:
                out.add(f"#{a}>{b}")
    return out


def features(words: list[str], with_classes: bool = True) -> list[str]:
    """Sparse features of a passage's words."""
    own = [f for w in dict.fromkeys(words) for f in letters(w)]
    return [*own, *sorted(pairs(words)), *(sorted(classes(words)) if with_classes else ())]


def _value(feature: str) -> float:
    return VALUES.get(feature[0], 0.6 if " " in feature else 0.5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Fit:
    """The cumulative-link model over rows of features: weights by feature and ordered thresholds, by Adam on the likelihood."""

    def __init__(self, rows: list[tuple[list[str], int]]) -> None:
        names: dict[str, int] = {}
        number = names.setdefault
        cols, ptr, y = [], [0], []
        for feats, grade in rows:
            cols += [number(f, len(names)) for f in feats]
            ptr.append(len(cols))
            y.append(grade)
        cols = np.asarray(cols, dtype=np.int32)
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ptr))
        keep = np.bincount(cols, minlength=len(names))[cols] > 1  # a feature of one row says nothing about others
        self.names, self.grades, self.cols, self.row = names, np.asarray(y), cols[keep], row[keep]
        self.value = np.array([_value(n) for n in names])
        self.x = self.value[self.cols]
        self.w = np.zeros(len(names))
        self.t = np.concatenate([[0.5], np.full(GRADES - 1, np.log(1.5))])  # first threshold, logs of the steps up

    def linear(self) -> np.ndarray:
        return np.bincount(self.row, weights=self.w[self.cols] * self.x, minlength=len(self.grades))

    def thresholds(self) -> np.ndarray:
        return np.concatenate([[self.t[0]], self.t[0] + np.cumsum(np.exp(self.t[1:]))])

    def go(self, used: np.ndarray, rounds: int, l2: float = 3e-5, rate: float = 0.05) -> Fit:
        """Further rounds over the ``used`` rows, from where the weights are."""
        grades, t = self.grades, self.t
        share = np.bincount(grades[used], minlength=GRADES + 1) / max(1, used.sum())
        each = (1 / np.maximum(share, 1e-9) / (GRADES + 1))[grades] ** 0.5
        each[grades == 0] *= CALM_WEIGHT
        each *= used
        each /= each.sum()
        n = len(self.w)
        m, v = np.zeros(n + len(t)), np.zeros(n + len(t))
        for k in range(1, rounds + 1):
            th = self.thresholds()
            s = self.linear()
            a, b = _sigmoid(s - np.concatenate([[-np.inf], th])[grades]), _sigmoid(s - np.concatenate([th, [np.inf]])[grades])
            p = np.maximum(a - b, 1e-9)
            gs = -(1 - a - b) * each
            ga, gb = each * a * (1 - a) / p, -each * b * (1 - b) / p
            gth = np.array([ga[grades == j + 1].sum() + gb[grades == j].sum() for j in range(GRADES)])
            gt = np.concatenate([[gth.sum()], [gth[i:].sum() * np.exp(t[i]) for i in range(1, GRADES)]])
            g = np.concatenate([np.bincount(self.cols, weights=gs[self.row] * self.x, minlength=n) + l2 * self.w, gt])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
            self.w -= step[:n]
            t -= step[n:]
        return self

    def weights(self) -> tuple[dict[str, float], np.ndarray]:
        return {n: float(self.w[i] * self.value[i]) for n, i in self.names.items() if abs(self.w[i]) > 1e-3}, self.thresholds()


class Scorer:
    def __init__(self, weights: dict[str, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, [float(x) for x in thresholds]
        known = {w: abs(x) for w, x in weights.items() if w.isalpha()}
        known.update({w: max(known.get(w, 0.0), 1.0) for w in WORD_CLASS})
        self.words = Words(known)
        self.cache: dict[str, float] = {}
        self.alone = lru_cache(100_000)(self._alone)

    def _alone(self, word: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in letters(word)])

    def passage(self, words: list[str]) -> float:
        """The linear score w . x."""
        get = self.weights.get
        return sum(map(self.alone, set(words))) + sum([get(f, 0.0) for f in pairs(words)]) + sum([get(f, 0.0) for f in classes(words)])

    def linear(self, text: str) -> float:
        """The largest linear score of a text's passages; -inf without words."""
        best = float("-inf")
        text = join_spaced(fold(text))
        cache = self.cache
        for part in PASSAGE.split(text):
            if not part:
                continue
            s = cache.get(part)
            if s is None:
                words = self.words(part)
                if not words:
                    continue
                if len(words) <= WINDOW + 2:
                    s = self.passage(words)
                else:
                    s = max(self.passage(words[i : i + WINDOW]) for i in range(0, len(words) - STRIDE, STRIDE))
                if len(cache) > 50_000:
                    cache.clear()
                cache[part] = s
            if s > best:
                best = s
        return best

    def severities(self, texts: list[str | None]) -> np.ndarray:
        s = np.array([self.linear(t) if t else -np.inf for t in texts])
        return sum(_sigmoid(s - t) for t in self.thresholds) * np.isfinite(s)

    def cutoff(self, p: float = ABUSIVE) -> float:
        """The severity at which P(grade > 0) is ``p``."""
        s = self.thresholds[0] + np.log(p / (1 - p))
        return float(sum(_sigmoid(np.array(s - t)) for t in self.thresholds))


def _passages(plain: Words, text: str) -> list[list[str]]:
    return [w for w in (plain(part) for part in PASSAGE.split(join_spaced(fold(text)))) if w]


def _doubtful(words: list[str]) -> bool:
    """Whether the words of an ungraded passage are such that only a graded sentence may teach them."""
    told = {c for w in words for c in WORD_CLASS.get(w, ())}
    return bool(told & STRONG) or len(told & set(TELLING)) > 1 or bool(told & set(TELLING)) and "YOU" in told


def model(ordinary: tuple[str, ...] = (), graded: list[tuple[str, int]] | None = None) -> tuple[dict[str, float], np.ndarray]:
    """Weights and thresholds from the graded sentences, and from passages of ``ordinary`` texts as grade 0.

    Nobody has graded the ordinary texts, and some of them are abusive. Passages with words that tell are left out, and the model is
    fitted on the graded sentences first; then, twice, the share DOUBTED of the ordinary passages that it takes for the worst is set
    aside, and the rest joins the fit. Words alone, and no word at all, are grade 0 unless a graded sentence says otherwise.
    """
    plain = Words({w: 1.0 for w in WORD_CLASS})
    rows = [(w, g) for s, g in (training_rows() if graded is None else graded) if (w := plain(fold(s)))]
    told = {w for words, g in rows if g for w in words}
    calm = [p for t in ordinary for p in _passages(plain, t) if len(p) <= WINDOW + 2 and not _doubtful(p)]
    rows += [([w], 0) for w in sorted({w for p in calm for w in p} - told)] + [([], 0)] * EMPTY
    # Neighbouring passages run together now and then; what is abusive stays so beside a calm one.
    short = [p for p in calm if 3 <= len(p) <= 9]
    for k, (words, g) in enumerate(rows[: len(rows) if short else 0 : 3]):
        if words and len(words) <= WINDOW - 5:
            beside = short[k * 7919 % len(short)]
            rows.append(([*words, *beside] if k % 2 else [*beside, *words], g))
    n = len(rows)
    rows += [(p, 0) for p in calm]
    made = Fit([(features(words, k % 2 == 0 or k >= n), g) for k, (words, g) in enumerate(rows)])
    own = np.arange(len(rows)) < n
    made.go(own, ROUNDS)
    for share in DOUBTED if len(rows) > n else ():
        s = made.linear()
        made.go(own | (s <= np.quantile(s[n:], 1 - share)), ROUNDS)
    return made.weights()


def ordinary_texts(df: DataFrame, key: str, text: str, rows: int = ORDINARY) -> tuple[str, ...]:
    """About ``rows`` texts, at most twice as many, drawn by a hash of the key: the bounded sample of the fit."""
    every = max(1, df.count() // rows)
    drawn = df.where((F.pmod(F.xxhash64(F.col(key), F.lit("ordinary")), F.lit(every)) == 0) & F.col(text).isNotNull())
    return tuple(r[0] for r in drawn.select(F.col(text)).limit(2 * rows).collect())


def with_severity(df: DataFrame, text: str, fitted: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """``df`` with ``severity``, the expected grade (0 to 3) of the worst passage of ``text``."""
    weights, thresholds = fitted

    @F.pandas_udf("double")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = Scorer(weights, thresholds)
        for texts in batches:
            yield pd.Series(ready.severities(texts.tolist()))

    return df.withColumn("severity", severity(F.col(text)))


def message_severity(messages: DataFrame) -> tuple[DataFrame, float]:
    """``(message_id, source, severity)``, a row per message, by its latest delivery; and the abusive severity."""
    fitted = model(ordinary_texts(messages, "message_id", "message_text"))
    scored = with_severity(messages.select("message_id", "source", "message_text", "ingested_at"), "message_text", fitted).drop("message_text")
    return (
        scored.where(F.col("message_id").isNotNull())
        .groupBy("message_id")
        .agg(F.max(F.struct("ingested_at", "severity", "source")).alias("v"))
        .select("message_id", "v.source", "v.severity")
    ), Scorer(*fitted).cutoff()


def held_out(parts: int = 4, seed: int = 3) -> dict[str, float]:
    """Recall and precision on wordings kept apart: each part of the templates is judged by a model fitted on the others.

    Its harmless templates are the hard cases (reports, quotations, other senses of the words), in the share that the sentences have them, so
    the precision on ordinary traffic is far higher.
    """
    every = templates()
    random.Random(seed).shuffle(every)
    hit = miss = wrong = 0
    for part in range(parts):
        apart = {t for k, (_, _, t) in enumerate(every) if k % parts == part}
        scorer = Scorer(*model((), training_rows(keep={t for _, _, t in every} - apart)))
        rows = sorted(set(training_rows(keep=apart)))
        for s, (_, grade) in zip(scorer.severities([t for t, _ in rows]), rows, strict=True):
            found = s > scorer.cutoff()
            hit, miss, wrong = hit + (found and grade > 0), miss + (not found and grade > 0), wrong + (found and grade == 0)
    return {"recall": hit / (hit + miss), "precision": hit / (hit + wrong)}


def p1_scores(messages: DataFrame) -> DataFrame:
    """``(message_id, severity)`` of every message."""
    return message_severity(messages)[0].select("message_id", "severity")


def p1_found(messages: DataFrame) -> DataFrame:
    graded, cutoff = message_severity(messages)
    return graded.where(F.col("severity") > cutoff).select("message_id")


def p1_rates(messages: DataFrame) -> DataFrame:
    """By source: messages, abusive ones, their rate, and the mean severity."""
    graded, cutoff = message_severity(messages)
    hit = F.col("severity") > cutoff
    return graded.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(hit).alias("n_abusive"), F.avg(hit.cast("double")).alias("rate"), F.avg("severity").alias("mean_severity")
    )
