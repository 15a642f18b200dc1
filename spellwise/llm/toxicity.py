"""Toxicity after noisy-channel deobfuscation.

Suspicious stretches of a text (letters mixed with look-alike signs, single letters set apart, stretched letters) become
lattices of what could have been meant; Viterbi decoding under a character language model of the whole corpus restores
the likeliest letters. The restored text's words are then scored by a classifier learnt from labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

# What look-alike signs may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Symbols of the character model: 0 a word's edge or anything else, 1 to 26 the letters, 27 any other letter.
SYMBOLS, ORDER = 28, 4
#: Log costs of the channel: a sign for a letter, a letter repeated, a gap inside a word.
SIGN, REPEAT, GAP = -1.0, -1.0, -0.5
#: Labelled rows the classifier is learnt from, about at most; features it weighs at most; how sure they must be.
ROWS, WORDS, SURE = 20_000, 4096, 10.0
#: Lengths of the word beginnings that are features.
SHORT, LONG = 4, 9
UNIT = 2_000_000

_runs = re.compile(r"[^\W\d_]+").findall
_sign = "".join(map(re.escape, LEET))
#: A token that has both a letter and a sign, wherever they stand.
_mixed = re.compile(rf"(?<!\S)(?=\S*[^\W\d_])(?=\S*[{_sign}])\S+").finditer
_spaced = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·][^\W_]){2,}(?![^\W_])").finditer
_spaced_sign = re.compile(rf"(?<!\w)[^\W_]?(?:[ .\-_*·]?(?<=[ .\-_*·])[\w{_sign}]){{3,}}(?!\w)").finditer
#: A word with a letter that stands twice or more in a row.
_stretched = re.compile(r"(?<![^\W_])(?=[^\W_]*?([^\W\d_])\1)[^\W_]+").finditer
#: Quick tests without which some of the above can't match.
_any_sign = re.compile(rf"[{_sign}]").search
_gaps = re.compile(rf"[ .\-_*·][\w{_sign}][ .\-_*·][\w{_sign}](?!\w)").search
_doubled = re.compile(r"([^\W\d_])\1").search


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): counts of ORDER symbols in a row over all whole texts; at most SYMBOLS ** ORDER rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(0x110000, 255, np.uint8)
        table[:128] = 0
        table[97:123] = np.arange(1, 27)
        total = np.zeros(SYMBOLS**ORDER, np.int64)

        def add(parts: list[str]) -> None:
            codes = np.frombuffer(("\n\n\n" + "\n\n\n".join(parts).lower() + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            sym = table[codes]
            if (sym == 255).any():
                for c in np.unique(codes[sym == 255]).tolist():
                    table[c] = 27 if chr(c).isalpha() else 0
                sym = table[codes]
            sym = sym.astype(np.int32)
            gram = sym[3:] + SYMBOLS * (sym[2:-1] + SYMBOLS * (sym[1:-2] + SYMBOLS * sym[:-3]))
            total[:] += np.bincount(gram, minlength=len(total))

        for batch in batches:
            parts, size = [], 0
            for text in batch.column(0).to_pylist():
                parts.append(text or "")
                size += len(parts[-1])
                if size > UNIT:
                    add(parts)
                    parts, size = [], 0
            if parts:
                add(parts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: pd.DataFrame) -> np.ndarray:
    """Log probability of the last symbol of each gram given those before it; shorter contexts smooth longer ones."""
    c = np.zeros(SYMBOLS**ORDER)
    c[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    c = c.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        part = c.sum(axis=tuple(range(ORDER - n))) if n < ORDER else c
        p = (part + 4.0 * p) / (part.sum(axis=-1, keepdims=True) + 4.0)
    return np.log(p).ravel()


def options(stretch: str) -> list[list[tuple[str, float]]]:
    """The lattice: per place of the (lower-case) stretch, what it may have stood for and at what cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(stretch):
        j = i
        while j < len(stretch) and stretch[j] == stretch[i]:
            j += 1
        c, n = stretch[i], j - i
        if c in LEET:
            # a sign may be itself only as an edge of the word
            out.append([(x * k, SIGN + (REPEAT if n > k else 0)) for x in LEET[c] for k in (1, 2) if k <= n] + [(" ", SIGN * 3)])
        elif c.isalpha():
            out.append([(c * k, REPEAT if n > k else 0.0) for k in (1, 2) if k <= n])
        else:
            out.append([("", GAP), (" ", 0.0)])
        i = j
    return out


def decode(stretch: str, model: np.ndarray) -> str:
    """The likeliest reading of a stretch (Viterbi over the last three symbols)."""
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    width = SYMBOLS ** (ORDER - 1)
    for place in [*options(stretch), [(" ", 0.0)]]:
        new: dict[int, tuple[float, str]] = {}
        for state, (score, read) in states.items():
            for text, cost in place:
                s, total = state, score + cost
                for c in text:
                    gram = s * SYMBOLS + code(c)
                    total += model[gram]
                    s = gram % width
                if s not in new or total > new[s][0]:
                    new[s] = (total, read + text)
        states = new
    return max(states.values())[1]


def suspicious(text: str) -> Iterator[str]:
    """Stretches of a lower-case text that may hide a word."""
    if _any_sign(text):
        for m in _mixed(text):
            yield m[0]
            yield m[0].strip("!|+$%&*#.,;:?()[]{}\"'")  # those at its edges may be punctuation, at its end also letters
            yield m[0].strip("%&*#.,;:?()[]{}\"'")
    if _gaps(text):
        for m in _spaced(text):
            yield m[0]
        for m in _spaced_sign(text):
            yield m[0]
    if _doubled(text):
        for m in _stretched(text):
            yield m[0]


def restored_words(text: str | None, model: np.ndarray, memory: dict[str, str]) -> set[str]:
    """Words of a text and of its restored stretches, in lower case."""
    text = (text or "").lower()
    words = set(_runs(text))
    for stretch in set(suspicious(text)):
        read = memory.get(stretch)
        if read is None:
            if len(memory) > 100_000:
                memory.clear()
            read = memory[stretch] = decode(stretch, model)
        words.update(_runs(read))
    return words


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings (marked by a star), which inflected forms share."""
    out = set(words)
    for w in words:
        for n in range(SHORT, min(len(w), LONG) + 1):
            out.add(w[:n] + "*")
    return out


class Classifier:
    """Logistic regression over the presence of chosen features."""

    def __init__(self, prior: float, weights: dict[str, float]):
        self.prior, self.weights = prior, weights
        self.first = {f[:SHORT] for f in weights if f.endswith("*")}

    def present(self, words: set[str]) -> set[str]:
        out = {w for w in words if w in self.weights}
        for w in words:
            if w[:SHORT] in self.first:
                out.update(f for n in range(SHORT, min(len(w), LONG) + 1) if (f := w[:n] + "*") in self.weights)
        return out

    def score(self, words: set[str]) -> float:
        x = self.prior + sum(self.weights[f] for f in sorted(self.present(words)))
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -50, 50))))


def _counted(rows: DataFrame, model: np.ndarray, only: frozenset | None = None) -> DataFrame:
    """(f, n): documents of `rows` that show each feature; `only` those named, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                shown = features(restored_words(text, model, memory))
                for f in shown if only is None else shown & only:
                    counts[f] = counts.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["f", "n"])

    return rows.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, model: np.ndarray, rows: int = ROWS) -> Classifier:
    """Fit on about `rows` rows of (text, toxic), chosen by a digest (a bounded sample of labelled rows).

    Features whose company with the label is beyond chance, n1 * log(share / base share) of at least SURE, are candidates;
    the WORDS best are weighed together by regularised logistic regression, so that a stem and its forms share their weight.
    """
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 24)) < int((1 << 24) * rows / total))
    labelled = settle(labelled)
    n = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Classifier(prior, {})
    toxic = {r["f"]: r["n"] for r in _counted(labelled.where("toxic = 1"), model).where("n >= 4").collect()}
    clean = {r["f"]: r["n"] for r in _counted(labelled.where("toxic = 0"), model, frozenset(toxic)).collect()}
    base = n1 / (n1 + n0)
    sure = {f: k * np.log(k / (k + clean.get(f, 0)) / base) for f, k in toxic.items() if k / (k + clean.get(f, 0)) > max(2 * base, 0.3)}
    chosen = sorted((f for f in sure if sure[f] >= SURE), key=lambda f: (-sure[f], f))[:WORDS]
    picker = Classifier(0.0, dict.fromkeys(chosen, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        number = {f: i for i, f in enumerate(chosen)}
        for batch in batches:
            shown = [sorted(number[f] for f in picker.present(restored_words(t, model, memory))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.list_(pa.int32())), batch.column(1)], ["f", "toxic"])

    # rows that show the same features count together: few rows, whatever the sample
    table = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "f array<int>, toxic int").groupBy("f", "toxic").count().toPandas()
    return Classifier(*_regress(table, chosen, prior))


def _regress(table: pd.DataFrame, chosen: list[str], prior: float) -> tuple[float, dict[str, float]]:
    """Weights by Newton-free accelerated gradient steps on the penalised log likelihood (diagonal scaling)."""
    table = table.assign(key=[tuple(f) for f in table["f"]]).sort_values(["key", "toxic"])
    rows = np.repeat(np.arange(len(table)), [len(f) for f in table["f"]])
    cols = np.concatenate([np.asarray(f, np.int64) for f in table["f"]]) if len(rows) else np.zeros(0, np.int64)
    y, n = table["toxic"].to_numpy(float), table["count"].to_numpy(float)
    w, b = np.zeros(len(chosen)), prior
    lw, lb = w.copy(), b
    penalty = 0.05
    per_row = np.bincount(rows, minlength=len(table)) + 1.0
    # each coordinate's curvature bound, given how many features share a row
    curve = penalty + 0.25 * np.bincount(cols, (n * per_row)[rows], minlength=len(chosen))
    curve_b = 0.25 * float((n * per_row).sum())
    for t in range(400):
        m = t / (t + 3.0)
        vw, vb = w + m * (w - lw), b + m * (b - lb)
        x = vb + np.bincount(rows, vw[cols], minlength=len(table))
        r = n * (1.0 / (1.0 + np.exp(-np.clip(x, -50, 50))) - y)
        lw, lb = w, b
        w = vw - (np.bincount(cols, r[rows], minlength=len(chosen)) + penalty * vw) / curve
        b = vb - float(r.sum()) / curve_b
    return b, {f: float(v) for f, v in zip(chosen, w)}


def scorer(model: np.ndarray, fitted: Classifier):
    prior, weights = fitted.prior, fitted.weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, str] = {}
        here = Classifier(prior, weights)
        for series in texts:
            yield pd.Series([here.score(restored_words(t, model, memory)) for t in series.tolist()], dtype=float)

    return score


def rate(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the double column `toxicity` (0 to 1) added.

    The character model counts all texts; the classifier is learnt from the rows of `labels` (the id, toxic) where
    `train`, a condition on the id, holds. Null and empty texts get the share of toxic labels (below one half unless most
    are toxic); without labels every score is one half; repeated rows get equal scores; long texts are read whole.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = language_model(settle(character_counts(text)).toPandas())
    known = labels.where(train & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("l")).agg(F.max("toxic").alias("toxic"))
    fitted = learn(text.join(known, F.col("doc_id") == F.col("l")).select("text", "toxic"), model)
    return docs.withColumn("toxicity", scorer(model, fitted)(F.col(text_col)))
