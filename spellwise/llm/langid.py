"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces (forward algorithm), a text's the product over its words. The piece probabilities
come from expectation-maximisation over the language's word counts: those are summed over all training texts by
Spark, the expected piece counts are summed per pass, and only one number per language and piece reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Words are runs of letters and marks, cut into stretches of at most this many letters (which bounds the lattice).
LONGEST = 24
PASSES = 2
#: Labelled texts per language that the probabilities are learnt from.
MOST = 1000
#: Words a task remembers, and characters of the texts it takes at a time.
MEMORY = 150_000
UNIT = 500_000

letters = regex.compile(r"[\p{L}\p{M}]+")
#: A word holds a letter: marks alone are none.
_word = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
#: In these texts, the standard pattern finds the same runs, quicker.
_plain = regex.compile(r"[^\x00-\x7e -ɏ]").search
_quick = regex.compile(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]+").findall

MARK = "▁"


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's letter pieces in lower case, with the word-start mark, without repeats."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    keep = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        bare = p.removeprefix(MARK)
        if bare and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i) and letters.fullmatch(bare):
            keep[p] = None
    return list(keep)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    found = _word.findall(text) if _plain(text) else _quick(text)
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


class Model:
    """Languages, pieces and their probabilities (languages x (pieces + 1) numbers, the last row an unknown letter).

    Pieces are found by a 64-bit rolling hash in two small tables, for all words of one length at a time.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SPREAD = 0xD6E8FEB86659FD93

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.langs, self.pieces, self.table = langs, pieces, table
        self.longest = max((len(p.removeprefix(MARK)) for p in pieces), default=1)
        self.hash = np.array([self._hash_of(p) for p in pieces] or [0], np.uint64)
        self.slots = [np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)]
        for k, h in enumerate(self.hash.tolist()[: len(pieces)]):
            g = h * self.SPREAD & 0xFFFFFFFFFFFFFFFF
            for slot, at in zip(self.slots, (g >> 44, g >> 20 & 0xFFFFF)):
                if not slot[at]:
                    slot[at] = k + 1
                    break
            else:
                raise ValueError("two pieces share both slots")

    def _hash_of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is a piece's, and the pieces."""
        g = h * np.uint64(self.SPREAD)
        k = self.slots[0][(g >> np.uint64(44)).astype(np.int64)] - 1
        hit = (k >= 0) & (self.hash[k] == h)
        k2 = self.slots[1][((g >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64)] - 1
        second = ~hit & (k2 >= 0)
        second &= self.hash[k2] == h
        at = np.flatnonzero(hit | second)
        return at, np.where(second[at], k2[at], k[at])

    def lattice(self, words: list[str]):
        """Of words of one length: steps (start, end, word numbers, piece numbers), by rising start."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        steps = []
        for i in range(n):
            bare = np.zeros(len(words), np.uint64)
            marked = np.full(len(words), self._hash_of(MARK), np.uint64) if i == 0 else None
            single = np.zeros(len(words), bool)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                bare = bare * self.BASE + codes[:, j - 1]
                at, k = self.find(bare)
                if len(at):
                    steps.append((i, j, at, k))
                if j == i + 1:
                    single[at] = True
                if marked is not None:
                    marked = marked * self.BASE + codes[:, j - 1]
                    at, k = self.find(marked)
                    if len(at):
                        steps.append((i, j, at, k))
                    if j == 1:
                        single[at] = True
            at = np.flatnonzero(~single)
            if len(at):
                steps.append((i, i + 1, at, np.full(len(at), -1)))
        return n, steps

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (any lengths) in every language: all segmentations summed."""
        out = np.zeros((len(words), self.table.shape[1]))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            _, steps = self.lattice([words[i] for i in which.tolist()])
            a = np.zeros((n + 1, len(which), self.table.shape[1]))
            a[0] = 1.0
            for i, j, at, k in steps:
                a[j, at] += a[i, at] * self.table[k]
            out[which] = np.log(a[n])
        return out

    def expected(self, words: list[str], n_of: np.ndarray, lang: int) -> np.ndarray:
        """Expected counts of every piece in one language's words, each counted n_of times (forward and backward sums)."""
        p = self.table[:, lang]
        sums = np.zeros(len(p))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            _, steps = self.lattice([words[i] for i in which.tolist()])
            a, b = np.zeros((n + 1, len(which))), np.zeros((n + 1, len(which)))
            a[0] = b[n] = 1.0
            for i, j, at, k in steps:
                a[j, at] += a[i, at] * p[k]
            for i, j, at, k in reversed(steps):
                b[i, at] += p[k] * b[j, at]
            for i, j, at, k in steps:
                np.add.at(sums, k, n_of[which[at]] * a[i, at] * p[k] * b[j, at] / a[n, at])
        return sums


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts, summed per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > MEMORY:
                    yield _batch(counts)
                    counts = {}
            if counts:
                yield _batch(counts)

    def _batch(counts):
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"]
        )

    found = labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sampled(labelled: DataFrame, most: int) -> DataFrame:
    """About `most` rows of each lang, chosen by a digest of the text; all rows of a lang that has fewer.

    The languages' counts, one number each as in the model itself, go into the filter, so that no text moves."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 24)) / float(1 << 24)
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < most / n))
    return labelled.where(chosen).select("lang", "text")


def fit(labelled: DataFrame, model_file: str, passes: int = PASSES, most: int = MOST) -> Model:
    """Piece probabilities of every non-null `lang` of `labelled` (lang, text), by `passes` passes of EM over the
    words of about `most` whole texts per language (a bounded sample of labelled rows)."""
    pieces = pieces_of(model_file)
    counts = settle(word_counts(sampled(labelled.where("lang is not null and text is not null"), most)))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = np.array([len(p.removeprefix(MARK)) for p in pieces])
    start = np.append(0.05 ** np.minimum(size, 6), 1e-8)
    table = np.repeat((start / start.sum())[:, None], max(len(langs), 1), axis=1)
    model = Model(langs, pieces, table)
    for _ in range(passes):
        sums = np.zeros_like(model.table)
        column = {lang: i for i, lang in enumerate(langs)}
        for lang, k, n in _expect(counts, model).collect():
            sums[k, column[lang]] = n
        sums += 0.05  # what was never seen keeps a little mass
        model = Model(langs, pieces, sums / sums.sum(axis=0))
    return model


def _expect(counts: DataFrame, model: Model) -> DataFrame:
    """(lang, piece, n): expected counts; one row per language and piece, summed per task before the shuffle."""
    langs, pieces, table = model.langs, model.pieces, model.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(langs, pieces, table)
        sums = np.zeros_like(table)
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                c = langs.index(lang)
                sums[:, c] += here.expected(part["word"].tolist(), part["n"].to_numpy(float), c)
        k, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs[i] for i in c], pa.string()), pa.array(k.astype(np.int32)), pa.array(sums[k, c])], ["lang", "piece", "n"]
        )

    return counts.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n"))


def predictor(model: Model):
    """A pandas function column source: text -> (lang_pred, score)."""
    langs, pieces, table = model.langs, model.pieces, model.table

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = Model(langs, pieces, table)
        known: dict[str, int] = {}
        rows = np.zeros((MEMORY, len(langs)))

        def totals(part: list) -> np.ndarray:
            """Summed log probabilities of some texts; NaN where a text has no word."""
            nonlocal rows
            words = [words_of(t) for t in part]
            new = list({w for ws in words for w in ws if w not in known})
            if len(known) + len(new) > len(rows):
                known.clear()
                new = list({w for ws in words for w in ws})
                rows = rows if len(new) <= len(rows) else np.zeros((len(new), len(langs)))
            if new:
                at = len(known)
                rows[at : at + len(new)] = here.forward(new)
                known.update(zip(new, range(at, at + len(new))))
            get = known.__getitem__
            return np.array([rows[list(map(get, ws))].sum(axis=0) if ws else np.full(len(langs), np.nan) for ws in words])

        for series in texts:
            names: list = []
            scores: list = []
            part: list = []
            size = 0
            values = series.tolist()
            for i, text in enumerate(values):
                part.append(text)
                size += len(text or "")
                if size < UNIT and i + 1 < len(values):
                    continue
                total = totals(part) if langs else np.full((len(part), 1), np.nan)
                for row in total:
                    if np.isnan(row[0]):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        share = np.exp(row - row.max())
                        names.append(langs[int(np.argmax(row))])
                        scores.append(float(1.0 / share.sum()))
                part, size = [], 0
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.array(scores, float)})

    return predict


def identify(docs: DataFrame, train: Column, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with the struct column `lang_id` (lang_pred, score) added; learnt from rows where `train` holds.

    A null text or one without a letter is `und` with score 0, as is every text when nothing was learnt. Ties go to
    the language that sorts first; repeated rows get equal results; long texts are read whole.
    """
    labelled = docs.where(train).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return docs.withColumn("lang_id", predictor(fit(labelled, model_file))(F.col(text_col)))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text leaves `fold` modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
