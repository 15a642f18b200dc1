"""Language-model scores by deleted interpolation of word n-grams.

P(w | h) = l2 * c(hw) / c(h) + l1 * c(w) / N + l0 / (V + 1): maximum-likelihood estimates of bigrams and unigrams and
a uniform share, mixed by weights that depend on how often the context h was seen. The weights come from
expectation-maximisation on held-out counts: one fold of the training texts is scored with the counts of the others.

Counts belong to the whole corpus and grow with it, so nothing is collected. Texts become blocks of token numbers; each
block asks once for every distinct word and word pair it holds. A question carries the block's own counts, so that the
same rows first make the corpus counts and are then answered by them. Words are named by 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Tokens of a block, at least (its last text is whole); keys that one task counts, about.
BLOCK, SHARE = 1_200_000, 1_000_000
END, START = np.uint64(xxhash.xxh64_intdigest(b" ", 1)), np.uint64(xxhash.xxh64_intdigest(b"  ", 1))
#: Leading bits of a pair's digest that are kept: of n distinct pairs about n / 2^48 share theirs with another one.
PAIR_BITS = 48
TEST, MAIN, FOLD = 0, 1, 2
#: Width of the cells, in natural logarithms, in which held-out tokens are counted for the weights.
CELL = 0.1
PASSES = 60


def squeeze(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed: small numbers leave empty planes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def expand(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Digest of a word pair."""
    h = (context ^ (word * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) + word
    h = h * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - PAIR_BITS) << np.uint64(64 - PAIR_BITS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, role, text) to blocks of one role: ids, lengths, digests of the distinct words, token numbers."""
    names = ["seq", "role", "n_tokens", "ids", "sizes", "words", "tokens"]
    kept: dict[int, tuple[list, list, dict, list]] = {}
    seq = 0
    id_type = None

    def block(role: int) -> pa.RecordBatch:
        nonlocal seq
        ids, sizes, known, tokens = kept.pop(role)
        digest = xxhash.xxh64_intdigest
        keys = np.fromiter((digest(w, 1) for w in known), np.uint64, len(known))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        t = place[np.concatenate(tokens)]
        seq += 1
        values = [seq, role, len(t), ids, squeeze(np.array(sizes, np.int32)), squeeze(np.diff(keys[order], prepend=np.uint64(0))), squeeze(t)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types)], names)

    count: dict[int, int] = {}
    for batch in batches:
        id_type = batch.schema.field(0).type
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            texts = part.column(2).cast(pa.binary()).to_pylist()
            for doc_id, role, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                ids, sizes, known, tokens = kept.setdefault(role, ([], [], {b" ": 0}, []))
                words = (text or b"").lower().split()
                words.append(b" ")  # the end
                put = known.setdefault
                tokens.append(np.array([put(w, len(known)) for w in words], np.int32))
                ids.append(doc_id)
                sizes.append(len(words))
                count[role] = count.get(role, 0) + len(words)
                if count[role] >= BLOCK:
                    count[role] = 0
                    yield block(role)
    for role in list(kept):
        yield block(role)


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: text lengths, word digests (sorted), token numbers, distinct pair digests, each token's pair number."""
    sizes, tokens = expand(row["sizes"], np.int32), expand(row["tokens"], np.int32)
    keys = np.cumsum(expand(row["words"], np.uint64))
    word = keys[tokens]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = START
    pairs, which = np.unique(pair(context, word), return_inverse=True)
    return sizes, keys, tokens, pairs, which


def _ask(parts: int):
    """Blocks to questions: per part of the key space the block's digests (differences) and its counts of them."""
    shift = np.uint64(64 - parts.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, keys, tokens, pairs, which = _opened(row)
                out = {"part": list(range(parts)), "block": [row["block"]] * parts, "role": [row["role"]] * parts}
                for name, k, n in (("word", keys, np.bincount(tokens, minlength=len(keys))), ("pair", pairs, np.bincount(which, minlength=len(pairs)))):
                    ends = np.append(np.searchsorted(k >> shift, np.arange(parts, dtype=np.uint64)), len(k))
                    cuts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
                    out[name] = [squeeze(np.diff(k[c], prepend=np.uint64(0))) for c in cuts]
                    out[f"{name}_n"] = [squeeze(n[c].astype(np.uint32)) for c in cuts]
                # only parts that the block has keys in: never more rows than keys, however many parts there are
                some = [p for p in range(parts) if out["word"][p] or out["pair"][p]]
                yield pa.RecordBatch.from_pydict(
                    {name: [values[p] for p in some] for name, values in out.items()},
                    pa.schema([("part", pa.int32()), ("block", pa.int64()), ("role", pa.int32()), *((n, pa.binary()) for n in ("word", "word_n", "pair", "pair_n"))]),
                )

    return run


QUESTION = "part int, block long, role int, word binary, word_n binary, pair binary, pair_n binary"
ANSWER = "part int, block long, role int, word_main binary, word_fold binary, pair_main binary, pair_fold binary, n_main long, n_fold long, n_words long"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """All questions of one part of the key space, answered by the counts they add up to."""
    out = {"part": group["part"].tolist(), "block": group["block"].tolist(), "role": group["role"].tolist()}
    roles = group["role"].to_numpy()
    totals = [0, 0, 0]
    for name in ("word", "pair"):
        keys = [np.cumsum(expand(k, np.uint64)) for k in group[name]]
        size = np.array([len(k) for k in keys])
        n = np.concatenate([expand(k, np.uint32) for k in group[f"{name}_n"]]).astype(np.int64)
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        role = np.repeat(roles, size)
        sums = [np.bincount(which, n * (role == r), minlength=len(distinct)).astype(np.int64) for r in (MAIN, FOLD)]
        if name == "word":
            totals = [int(sums[0].sum()), int(sums[1].sum()), int((sums[0] + sums[1] > 0).sum())]
        cuts = np.cumsum(size)[:-1]
        for label, s in zip(("main", "fold"), sums):
            out[f"{name}_{label}"] = [squeeze(x) for x in np.split(s[which], cuts)]
    # the part's totals stand once, with its first row
    for name, v in zip(("n_main", "n_fold", "n_words"), totals):
        out[name] = [v] + [0] * (len(group) - 1)
    return pd.DataFrame(out)


def bucket(c: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen contexts, then by powers of two."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def _estimates(row, answers: pd.DataFrame, deleted: bool):
    """Per token of a block: count, context count, pair count; with the fold's own counts taken away if `deleted`."""
    sizes, keys, tokens, _, which = _opened(row)
    answers = answers.sort_values("part")

    def counts(name: str) -> np.ndarray:
        main = np.concatenate([expand(x, np.int64) for x in answers[f"{name}_main"]])
        return main if deleted else main + np.concatenate([expand(x, np.int64) for x in answers[f"{name}_fold"]])

    words, pairs = counts("word"), counts("pair")
    c = words[tokens]
    context = np.empty_like(c)
    context[1:] = c[:-1]
    # a text's start was seen as often as its end
    context[np.cumsum(sizes) - sizes] = words[np.searchsorted(keys, END)]
    return sizes, c, context, pairs[which]


def _cells(n: int, v: int):
    """Held-out tokens counted by context bucket and by the logarithms of both estimates, in units of the uniform share."""

    def run(key, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(answers):
            return pd.DataFrame({"b": [], "f2": [], "f1": [], "n": []}).astype(np.int64)
        _, c, h, hw = _estimates(block.iloc[0], answers, True)

        def cell(f: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return np.where(f > 0, np.round(np.log(f * (v + 1)) / CELL), NOTHING).astype(np.int64)

        table = np.stack([bucket(h), cell(hw / np.maximum(h, 1)), cell(c / max(n, 1))])
        some, count = np.unique(table, axis=1, return_counts=True)
        return pd.DataFrame({"b": some[0], "f2": some[1], "f1": some[2], "n": count})

    return run


NOTHING = -(1 << 20)


def weights(cells: pd.DataFrame, passes: int = PASSES) -> np.ndarray:
    """Mixture weights (l2, l1, l0) of each bucket by EM; buckets without held-out tokens use those of the one below."""
    out = np.tile([0.4, 0.5, 0.1], (64, 1))
    out[0] = [0.0, 0.9, 0.1]
    value = lambda x: np.where(x == NOTHING, 0.0, np.exp(x * CELL))
    for b in range(64):
        part = cells[cells["b"] == b]
        if not len(part):
            out[b] = out[b - 1] if b > 1 else out[b]
            continue
        f = np.stack([value(part["f2"].to_numpy(float)), value(part["f1"].to_numpy(float)), np.ones(len(part))], axis=1)
        n = part["n"].to_numpy(float)
        lam = out[b]
        for _ in range(passes):
            share = lam * f
            share *= (n / share.sum(axis=1))[:, None]
            lam = share.sum(axis=0) / n.sum()
            lam[2] = max(lam[2], 1e-6)  # unknown words keep a little mass
            lam = lam / lam.sum()
        out[b] = lam
    return out


def _scores(n: int, v: int, lam: np.ndarray):
    def run(key, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(block) or not len(answers):
            return pd.DataFrame({x: [] for x in columns})
        row = block.iloc[0]
        sizes, c, h, hw = _estimates(row, answers, False)
        at = np.cumsum(sizes) - sizes
        mix = lam[bucket(h)]
        p = mix[:, 0] * hw / np.maximum(h, 1) + mix[:, 1] * c / max(n, 1) + mix[:, 2] / (v + 1)
        return pd.DataFrame({
            "doc_id": pd.Series(list(row["ids"])), "held_out": row["role"] == TEST, "n_tokens": sizes.astype(np.int64),
            "n_known": np.add.reduceat((c > 0).astype(np.int64), at),
            "base_score": np.add.reduceat(np.log10((c + 1.0) / (n + v + 1.0)), at), "score": np.add.reduceat(np.log10(p), at),
        })

    return run


def score(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from the rows where `held_out` is false; of these, the rows where `deleted` holds are the fold that the
    mixture weights are learnt on. Nothing to learn from makes every token equally likely. Null texts count as empty (their end
    is their one token); repeated rows count each; texts of any length are read whole; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    role = F.when(held_out, TEST).when(deleted, FOLD).otherwise(MAIN)
    slim = docs.select(F.col(id_col).alias("doc_id"), role.cast("int").alias("role"), F.col(text_col).alias("text"))
    blocks = slim.mapInArrow(_blocks, f"seq long, role int, n_tokens long, ids array<{kind}>, sizes binary, words binary, tokens binary")
    blocks = settle(blocks.withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("seq")).drop("seq"))
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = 64
    while parts * SHARE < tokens:
        parts *= 2
    asked = blocks.select("block", "role", "sizes", "words", "tokens").mapInArrow(_ask(parts), QUESTION)
    answers = settle(asked.groupBy("part").applyInPandas(_answer, ANSWER))
    total = answers.agg(F.sum("n_main"), F.sum("n_fold"), F.sum("n_words")).first()
    n_main, n_fold, v = (x or 0 for x in total)
    n = n_main + n_fold
    replies = answers.select(F.col("block").alias("to"), "role", "part", "word_main", "word_fold", "pair_main", "pair_fold")

    def met(where: str):
        return blocks.where(where).groupBy("block").cogroup(replies.where(where).drop("role").groupBy("to"))

    cells = met(f"role = {FOLD}").applyInPandas(_cells(n_main, v), "b long, f2 long, f1 long, n long")
    lam = weights(cells.groupBy("b", "f2", "f1").agg(F.sum("n").alias("n")).toPandas())
    if not n:
        lam[:] = [0.0, 0.0, 1.0]
    out = met("true").applyInPandas(
        _scores(n, v, lam), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
