"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, strips accents, maps look-alike letters of other scripts to Latin ones, and reads digits and
symbols between letters as the letters they stand for, so ``1d10t`` and Cyrillic look-alikes meet the lexicon.  The
lexicon holds whole words and word beginnings with log-odds weights.  It is learned from a bounded sample of labelled
rows, with public seed words as a prior; exception phrases cancel matches inside them.  A document's score is a
logistic function of the strongest match, the sum of matches and that sum normalised by length.

Input columns with the names of results give way to these.  Null and empty texts have no match and get the score of the intercept.  Texts are read whole.  Equal texts get equal
scores.  Without labels of both classes the seed words alone decide.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm.common import map_text, slices, stored, texts
from rowscope.llm.rules import labelled_sample

SAMPLE_ROWS = 20_000
# Look-alike letters of other scripts.
HOMOGLYPHS = {x[0]: x[1] for x in "аa вb сc ԁd еe һh іi јj кk ӏl мm иn оo рp ԛq гr ѕs тt υu ѵv хx уy ԝw ѡw αa βb εe ιi κk νv οo ρp τt χx γy".split()}
# Digits and symbols read as letters between letters.
DIGITS = dict(zip("013457@$!|", "oieastasil", strict=True))
# Seed words, mild public insults, used as a prior.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb")
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "pond scum", "clown fish", "circus clown", "sore loser", "stupid mistake of mine", "white trash bag")


class _Fold(dict):
    """Character map filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).lower())
        c = "".join(x for x in c if not unicodedata.combining(x)) or ("" if unicodedata.combining(chr(code)) else " ")
        c = "".join(HOMOGLYPHS.get(x, x) for x in c)
        if code in (0x200B, 0x200C, 0x200D, 0x00AD, 0xFEFF, 0x2060):
            c = ""
        self[code] = c
        return c


_MAP = _Fold()
_LEET = re.compile(r"[013457@$!|]+(?=[a-z])|(?<=[a-z])[01345 7@$!|]+(?=[a-z])".replace(" ", ""))
_LEET_MAP = str.maketrans(DIGITS)
_WORD = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    low = text.lower() if text.isascii() else text.translate(_MAP)
    return _LEET.sub(lambda m: m[0].translate(_LEET_MAP), low)


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def terms(ws: set[str], short: int = 4, long: int = 6) -> set[str]:
    """Whole words as ``word`` + space, and word beginnings."""
    out = {w + " " for w in ws if len(w) > 2}
    for n in range(short, long + 1):
        out |= {w[:n] for w in ws if len(w) > n}
    return out


@dataclass
class Lexicon:
    weight: dict[str, float]
    coef: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.2, 0.5]))
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weight.items():
            a.add_word(" " + t, (len(t) + 1, w))
        for e in self.exceptions:
            a.add_word(f" {e} ", (len(e) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def features(self, text: str, automaton) -> tuple[float, float, float]:
        """Strongest match, log of the sum of matches, log of the sum a hundred words."""
        ws = words(text)
        if not ws or not len(automaton):
            return 0.0, 0.0, 0.0
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(" " + " ".join(ws) + " "):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > hits.get(start, 0.0):
                hits[start] = w
        if excused:
            # phrases come by their ends; a start is excused if a phrase begun by then reaches beyond it
            excused.sort()
            begins = [a for a, _ in excused]
            reach = list(accumulate((b for _, b in excused), max))
            hits = {s: w for s, w in hits.items() if not (i := bisect_right(begins, s)) or reach[i - 1] <= s}
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(hits.values())
        return max(hits.values()), float(np.log1p(total)), float(np.log1p(100.0 * total / len(ws)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -40, 40)))


def learn(rows: DataFrame, least_docs: int = 4, least_weight: float = 2.0, most_terms: int = 5_000) -> Lexicon:
    """A lexicon from rows (t: text, y: 0 or 1).  Tasks count terms and compute features; no text comes to the driver."""
    seeds = {s + " ": 4.0 for s in SEEDS}
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon(seeds)

    def found(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                sets = [sorted(terms(set(words(t)))) for t in texts(b, "t").to_pylist()]
                y = np.repeat(b.column("y").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array([t for x in sets for t in x], pa.string()), pa.array(y, pa.int32())], names=["term", "y"])

    def rate(k, of: int):
        return F.log(k + 0.5) - float(np.log(of + 1))

    counts = rows.mapInArrow(found, "term string, y int").groupBy("term").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("all"))
    odds = counts.where(F.col("bad") >= least_docs).withColumn("w", rate(F.col("bad"), n[1]) - rate(F.col("all") - F.col("bad"), n[0]))
    best = odds.where(F.col("w") >= least_weight).orderBy((F.round("w", 9) * F.sqrt("bad")).desc(), "term").limit(most_terms)
    lex = Lexicon(seeds | {r["term"]: r["w"] for r in best.collect()})

    def measured(batches):
        auto = lex.automaton()
        for whole in batches:
            for b in slices(whole, "t"):
                x = np.array([lex.features(t, auto) for t in texts(b, "t").to_pylist()]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column("y")], names=["a", "b", "c", "y"])

    got = sorted(rows.mapInArrow(measured, "a double, b double, c double, y int").collect())  # a bounded sample, four numbers a row
    x = np.array(got, float)
    lex.coef = fit_logistic(x[:, :3], x[:, 3])
    return lex


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(np.size(a, 1))
    r = np.full(np.size(a, 1), ridge)
    r[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + np.diag(r)
        d = np.linalg.solve(h, a.T @ (p - y) + r * w)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn from labelled rows outside the held-out fold."""
    seen = labels.where(~held_out(F.col(key)))
    got = labelled_sample(docs.select(key, text), seen, label, rows, key).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    return learn(stored(got.withColumn("y", (F.col("y") > 0).cast("int"))))


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns but the text, with the fold, the score and the prediction."""
    keep = [c for c in docs.columns if c not in (text, "held_out", "score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    state: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(lexicon.automaton())
        x = np.array([lexicon.features(t, state[0]) for t in texts(batch, text).to_pylist()]).reshape(-1, 3)
        s = lexicon.score(x)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_text(docs.select(*keep, text), text, run, schema).withColumn("held_out", held_out(F.col(key)))
