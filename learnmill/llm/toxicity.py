"""Operator 9, toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first, in one pass: compatibility forms, homoglyphs of other scripts and signs that stand for letters inside
words; a word with accents also stands in its plain form. The lexicon has whole words, and beginnings of words where these
tell more than the words alone, with the logarithms of their rates' ratio as weights, learned from labelled rows. An
occurrence inside an exception phrase does not count. The sum of weights is normalised by the length of the text in two
ways, and a logistic curve fitted on the training rows turns both into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmill.plans.session import ensure_package

from .common import arrow_map, fresh_name, release, stored

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a word that insults elsewhere is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash collector", "trash compactor", "trash day", "trash folder",
    "trash icon", "trash pickup", "trash truck", "take out the trash", "pond scum", "soap scum", "scum line", "clown fish", "clown car", "clown nose", "clown shoes", "class clown",
    "circus clown", "rodeo clown", "birthday clown", "garbage can", "garbage collection", "garbage collector", "garbage truck", "dumb waiter", "dumb bell", "dumb terminal",
    "pathetic fallacy", "pig iron", "guinea pig", "sewer rat", "lab rat", "snake plant", "weasel words", "kill switch", "dead line", "hell fire missile", "stupid simple",
)
#: Most training rows of each label, lengths of the beginnings tried, least rows with an entry, most candidates, most
#: occurrences of an entry that count in one training row.
SAMPLE, STEMS, LEAST, MOST, CAP = 5000, (4, 5, 6, 7, 8), 3, 5000, 5
#: Rows scored at once.
AT_ONCE = 200

_TABLE = str.maketrans(HOMOGLYPHS)
_SIGN_TABLE = str.maketrans(SIGNS)
_SIGNED = re.compile(r"[0-9@$]")
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[\w@$]+")


def plain(word: str) -> str:
    """The word without accents and other marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def unsigned(word: str) -> str:
    """Signs for letters become these letters in a word that has letters; signs at its end are marks."""
    word = word.rstrip("@$")
    return word.translate(_SIGN_TABLE) if _SIGNED.search(word) and any(map(str.isalpha, word)) else word


def folded_words(text: str | None) -> tuple[list[str], list[str]]:
    """The folded words in order, and the plain forms of those with accents."""
    if not text:
        return [], []
    accents = not text.isascii()
    if accents:
        text = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text)).lower().translate(_TABLE)
        text = "".join(c for c in text if not unicodedata.combining(c)) if any(map(unicodedata.combining, text)) else text
    else:
        text = text.lower()
    words = _WORD.findall(text.replace("_", " "))
    if _SIGNED.search(text):
        words = [w if w.isalpha() else unsigned(w) for w in words]
        words = [w for w in words if w]
    if not accents:
        return words, []
    return words, [p for w in words if not w.isascii() and (p := plain(w)) != w]


def fold(text: str | None) -> str:
    """Lower-case words in plain letters with one space between and around them; plain forms of words with accents follow after a bar."""
    words, more = folded_words(text)
    return f" {' '.join(words)} " + (f"| {' '.join(more)} " if more else "")


def beginnings(word: str, stems=STEMS) -> list[str]:
    return [word[:n] for n in stems if len(word) > n]


@dataclass(frozen=True)
class Lexicon:
    """Weights of the entries ' word ' and ' beginning', exception phrases, and the curve: constant, factors of the two densities."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 4.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for entry, weight in lexicon.weights:
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            own = fold(phrase)
            if own != "  ":
                self.automaton.add_word(own, (len(own), None))
        self.empty = not lexicon.weights
        if not self.empty:
            self.automaton.make_automaton()

    def densities(self, text: str | None) -> tuple[float, float]:
        """Weight of the matches, one for a word, by the logarithm of the text's length in words, and by hundred words."""
        folded = "  " if self.empty else fold(text)
        if folded == "  ":
            return 0.0, 0.0
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if safe:
            safe.sort()
            starts, reach, far = [a for a, _ in safe], [], -1
            for _, z in safe:
                far = max(far, z)
                reach.append(far)
            best = {i: w for i, w in best.items() if not ((k := bisect_right(starts, i)) and i < reach[k - 1])}
        total = sum(best.values())
        n = folded.count(" ", 0, folded.find("|") if "|" in folded else len(folded)) - 1
        return total / math.log2(2 + n), 100 * total / (n + 50)

    def score(self, text: str | None) -> float:
        a, b = self.densities(text)
        c = self.lexicon.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, c[0] + c[1] * a + c[2] * b))))


@lru_cache(maxsize=2)
def _matcher(lexicon: Lexicon) -> Matcher:
    return Matcher(lexicon)


def sampled(labels: DataFrame, id_col: str, label_col: str, size: int) -> DataFrame:
    """At most ``size`` rows of each label, those with the smallest hash of the id: (_id, _y). An id labelled both 0 and 1 tells nothing and is left out."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    return rows.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(size).union(rows.where("_y = 0").orderBy(F.xxhash64("_id"), "_id").limit(size))


def evidence(pos, neg, n_pos: int, n_neg: int):
    """Twice the logarithm of the likelihood ratio that rows with an entry have another share of label 1 than all rows; NumPy arrays."""
    pos, neg = np.asarray(pos, float), np.asarray(neg, float)
    share = n_pos / (n_pos + n_neg)
    total = np.zeros(pos.shape)
    for seen, of in ((pos, share), (neg, 1 - share)):
        total += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, (pos + neg) * of, 1))
    for seen, of in ((n_pos - pos, share), (n_neg - neg, 1 - share)):
        total += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, (n_pos + n_neg - pos - neg) * of, 1))
    return np.where(pos * n_neg > neg * n_pos, total, 0.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE, stems=STEMS, least: int = LEAST, most: int = MOST, exceptions=EXCEPTIONS) -> Lexicon:
    """A lexicon from the labelled rows given, of which at most ``size`` of each label are used (the bounded sample of a classifier).

    Texts with the same set of words count once. An entry needs ``least`` rows with label 1 and evidence (a likelihood ratio
    statistic) over twice the logarithm of the number of candidates, less on samples of under 25 rows with label 1; of these
    the ``most`` with most evidence are tried. All whole words that pass are taken. A beginning is taken only if the words
    that have it, but are not taken yet, pass on their own. Phrases of two words round a taken word that label 0 favours
    become exceptions, beside those given. The sample is read once from docs; to the driver come candidates' counts, and for
    each sampled row the candidates in it and its densities. Without labels of both kinds the lexicon is empty and all scores are alike."""
    picked = sampled(labels, id_col, label_col, size)
    texts = stored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id").select("_y", "_t").distinct(), "sample")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, more = folded_words(t)
                own = {*words, *more}
                for e in {f" {w} " for w in own} | {f" {b}" for w in own for b in beginnings(w, stems)}:
                    seen.setdefault(e, [0, 0])[y] += 1
                if len(seen) > 100_000:
                    yield counts_batch(seen)
                    seen = {}
        yield counts_batch(seen)

    counted = arrow_map(texts, count, "e string, pos long, neg long").groupBy("e").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    by_label = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    n_pos, n_neg = by_label.get(1, 0), by_label.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(exceptions=tuple(exceptions))
    counted = stored(counted, "counted").where((F.col("pos") >= min(least, max(1, n_pos // 4))) & (F.col("pos") * n_neg > F.col("neg") * n_pos * 3))
    n_candidates = max(2, counted.count())
    rows = counted.orderBy(F.desc(F.col("pos") / (F.col("neg") + 1)), F.desc("pos"), "e").limit(4 * most).collect()
    enough = 2 * math.log(10 * n_candidates) * min(1.0, n_pos / 25)
    found = evidence([r["pos"] for r in rows], [r["neg"] for r in rows], n_pos, n_neg) if rows else np.zeros(0)
    tried = {rows[i]["e"] for i in np.argsort(-found, kind="stable")[:most] if found[i] >= enough}

    def occurrences(batches):
        for batch in batches:
            ys, words_of, times = [], [], []
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, more = folded_words(t)
                hits = Counter(w for w in (*words, *more) if f" {w} " in tried or any(f" {b}" in tried for b in beginnings(w, stems)))
                ys.append(y)
                words_of.append(list(hits))
                times.append([min(CAP, n) for n in hits.values()])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(words_of, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], names=["y", "words", "times"])

    has = [(r["y"], dict(zip(r["words"], r["times"], strict=True))) for r in arrow_map(texts, occurrences, "y int, words array<string>, times array<int>").collect()]
    weights = chosen(has, tried, n_pos, n_neg, enough, stems)
    phrases = learned_exceptions(texts, {e.strip() for e in weights if e.endswith(" ")}, least)
    lexicon = Lexicon(tuple(sorted(weights.items())), tuple(dict.fromkeys((*exceptions, *phrases))))

    def densities(batches):
        for batch in batches:
            both = [_matcher(lexicon).densities(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64())], names=["y", "a", "b"])

    points = sorted((p["y"], p["a"], p["b"]) for p in arrow_map(texts, densities, "y int, a double, b double").collect())
    curve = fit_curve(np.array([p[0] for p in points], float), np.array([p[1:] for p in points], float).reshape(-1, 2))
    return Lexicon(lexicon.weights, lexicon.exceptions, curve)


def counts_batch(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["e", "pos", "neg"])


def chosen(has: list[tuple[int, dict[str, int]]], tried: set[str], n_pos: int, n_neg: int, enough: float, stems=STEMS) -> dict[str, float]:
    """Entries with their weights: the words of ``tried``, then each time the beginning with most evidence from words that no entry taken has."""
    weights: dict[str, float] = {}

    def weigh(entry: str, belongs) -> None:
        """The logarithm of the ratio of occurrences by row, smoothed."""
        times = [0.5, 0.5]
        for y, words in has:
            times[y] += min(CAP, sum(n for w, n in words.items() if belongs(w)))
        weights[entry] = max(0.1, math.log(times[1] / n_pos) - math.log(times[0] / n_neg))

    whole = {e.strip() for e in tried if e.endswith(" ")}
    for word in sorted(whole):
        weigh(f" {word} ", word.__eq__)
    starts = {e[1:] for e in tried if not e.endswith(" ")}
    taken: set[str] = set()

    def open_words():
        """Of each row the words without an entry yet, by beginning."""
        for y, words in has:
            left = [w for w in words if w not in whole and taken.isdisjoint(beginnings(w, stems))]
            yield y, {b for w in left for b in beginnings(w, stems) if b in starts}

    while starts:
        pos, neg = Counter(), Counter()
        for y, own in open_words():
            (pos if y else neg).update(own)
        names = sorted(starts)
        found = evidence([pos[b] for b in names], [neg[b] for b in names], n_pos, n_neg)
        # of equal evidence the longest beginning is the most specific one
        best = max(range(len(names)), key=lambda i: (found[i], len(names[i])))
        if found[best] < enough:
            break
        begin = names[best]
        weigh(f" {begin}", lambda w, begin=begin: w not in whole and w.startswith(begin) and taken.isdisjoint(beginnings(w, stems)))
        taken.add(begin)
        starts.discard(begin)
    return weights


def learned_exceptions(texts: DataFrame, words: set[str], least: int) -> list[str]:
    """Phrases of two words, one of them given, in at least ``least`` rows with label 0 and in no row with label 1."""

    def phrases(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = folded_words(t)[0]
                for e in {f"{a} {b}" for a, b in zip(own, own[1:], strict=False) if a in words or b in words}:
                    seen.setdefault(e, [0, 0])[y] += 1
            yield counts_batch(seen)

    if not words:
        return []
    counted = arrow_map(texts, phrases, "e string, pos long, neg long").groupBy("e").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sorted(r["e"] for r in counted.where((F.col("neg") >= least) & (F.col("pos") == 0)).orderBy(F.desc("neg"), "e").limit(1000).collect())


def fit_curve(labels: np.ndarray, points: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float, float]:
    """Constant and factors (not negative) of a logistic curve over two densities, both labels weighing the same, by Newton's method."""
    share = np.where(labels == 1, 0.5 / max(1.0, labels.sum()), 0.5 / max(1.0, (1 - labels).sum()))
    out = (-4.0, 0.0, 0.0)
    for use in ([0, 1], [0], [1]):
        x = np.column_stack([np.ones(len(points)), points[:, use]])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            g = x.T @ (share * (p - labels)) + ridge * np.r_[0, w[1:]]
            h = (x.T * (share * p * (1 - p))) @ x + np.diag(np.r_[1e-9, np.full(len(use), ridge)])
            step = np.linalg.solve(h, g)
            w = w - step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-9:
                break
        factors = [0.0, 0.0]
        for k, value in zip(use, w[1:], strict=True):
            factors[k] = float(value)
        out = (float(w[0]), *factors)
        if min(factors) >= 0:
            return out
    return (out[0], 0.0, 0.0)


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score_col (double, 0 to 1) and predicted_col (1 if the score >= threshold). Null and empty texts have densities
    of 0. Columns named so are replaced, all others stay; each row is scored alone, whole text, so repeats get equal scores."""
    ensure_package(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        release()
        tool = _matcher(lexicon)
        return pa.array([tool.score(t) for i in range(0, len(texts), AT_ONCE) for t in texts.slice(i, AT_ONCE).to_pylist()], pa.float64())

    return docs.withColumn(score_col, scored(F.col(text_col))).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def held_out(id_col: str):
    """Rows that labels are never learned from: CRC-32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """docs with held_out, score and predicted; the lexicon is learned from labelled rows that are not held out.

    One row for each input row; columns named held_out, score or predicted are replaced, all others stay. Null ids and labels,
    labels other than 0 and 1 and ids labelled both ways teach nothing; null and empty texts get the curve's constant. Without
    labelled rows of both kinds, or with an empty labels table, all scores are alike and under the threshold."""
    lexicon = learn(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    return score_texts(docs, lexicon, text_col, threshold).withColumn("held_out", held_out(id_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that toxicity() predicts 1 for; all columns stay as they are, whatever their names."""
    lexicon = learn(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    score, predicted = fresh_name(docs, "score"), fresh_name(docs, "predicted")
    return score_texts(docs, lexicon, text_col, threshold, score, predicted).where(F.col(predicted) == 0).drop(score, predicted)
