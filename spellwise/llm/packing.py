"""Best-fit packing with swap-based local search.

Documents are tokenised where they lie; a piece's row holds a few numbers, never its tokens. Pieces are dealt evenly
to packs of about PACK pieces and every pack is packed in one task: best fit in decreasing order, then
a local search between underfull bins that moves a piece or exchanges one for one or two for one
whenever that raises the sum of squared fills, until no bin can be emptied any more.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

PACK = 16384
#: Distinct pre-tokens whose ids a worker remembers, in two halves: when the newer one is full it becomes the older one, whose
#: words come back as they are met again. So frequent ones stay known.
REMEMBER = 400_000


#: Texts of these characters only can be cut by the quicker pattern, which means the same there.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search
PLAIN_CUT = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\u00c0-\u024f]+| ?[0-9]+| ?[^\sA-Za-z0-9\u00c0-\u024f]+|\s+(?!\S)|\s+"
).findall

_known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def encoder(path: str):
    """A function text -> ids (numpy uint32), equal to Tokenizer.encode(text, add_special_tokens=False).

    A byte-level BPE file splits a text by a pattern before it merges, so the ids of a piece between two splits
    never depend on its neighbours; a worker remembers them by piece. Texts that hold a special token's string
    are encoded whole.
    """
    import regex
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = regex.compile(PATTERN).findall
    known, older = _known.setdefault(path, ({}, {}))

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
        pieces = cut(text) if PLAIN(text) else PLAIN_CUT(text)
        try:
            parts = list(map(known.__getitem__, pieces))
        except KeyError:
            new = [p for p in dict.fromkeys(pieces) if p not in known]
            if len(known) + len(new) > REMEMBER // 2:
                older.clear()
                older.update(known)
                known.clear()
                new = list(dict.fromkeys(pieces))
            known.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in known]
            for p, e in zip(new, tok.encode_batch(new, add_special_tokens=False)):
                known[p] = np.array(e.ids, np.uint32).tobytes()
            parts = list(map(known.__getitem__, pieces))
        return np.frombuffer(b"".join(parts), np.uint32)

    return ids


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple]:
    """Rows of a batch, a few at a time as Python objects."""
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield from zip(*(c.to_pylist() for c in part.columns))


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        salt = 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt")}
            for doc_id, text in _slices(batch):
                tokens = np.append(ids(text or ""), np.uint32(end))
                n = len(tokens)
                first = n % size or size
                for k, (a, b) in enumerate(zip([0, *range(first, n, size)], range(first, n + 1, size))):
                    salt += 1
                    for name, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(tokens[a:b].astype("<u4").tobytes()), salt)):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(
                out, pa.schema([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()), *((k, pa.int64()) for k in list(out)[2:])])
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): every document's ids and the id `end`, cut from the end into pieces of `size`."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(
        _pieces(tokenizer, size, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long"
    )


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is free in them
    free: list[int] = []  # values of free that have bins, sorted
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(free, n)
        if at == len(free):
            b, left = len(bins), size - n
            bins.append([i])
        else:
            have = free[at]
            b = room[have].pop()
            if not room[have]:
                free.pop(at)
            bins[b].append(i)
            left = have - n
        if not room[left]:
            insort(free, left)
        room[left].append(b)
    return bins


class Underfull:
    """Bins with room, as flat arrays of (bin, length of a piece in it, room): one search meets them all at once."""

    def __init__(self, bins: list[list[int]], fill: list[int], ln: list[int], size: int):
        self.bins, self.fill, self.ln, self.size = bins, fill, ln, size
        self.members = [b for b in range(len(bins)) if 0 < fill[b] < size]
        self.order()

    def order(self) -> None:
        """Bins by fill, emptiest first; a full or empty one drops out for good."""
        fill = self.fill
        self.members = sorted((b for b in self.members if 0 < fill[b] < self.size), key=lambda b: (fill[b], b))
        rows = [(b, n) for b in self.members for n in (0, *sorted({self.ln[i] for i in self.bins[b]}))]
        self.owner = np.array([b for b, _ in rows], np.int64)
        self.taken = np.array([n for _, n in rows], np.int64)
        self.filled = np.array([fill[b] for b, _ in rows], np.int64)

    def spare(self) -> bool:
        """Whether what the bins hold could do with one bin less."""
        return len(self.members) > 1 and sum(self.fill[b] for b in self.members) <= (len(self.members) - 1) * self.size

    def best(self, source: int):
        """(target, given, taken) of the exchange that fills a bin at least as full as `source` best, the fullest such bin first;
        None if there is none. A move gives one piece for none, the others one for one and two for one."""
        own = sorted((self.ln[i] for i in self.bins[source]), reverse=True)
        ones = sorted(set(own), reverse=True)
        twos = {own[i] + own[j]: (own[i], own[j]) for i in range(len(own)) for j in range(i + 1, len(own))}
        usable = (self.filled >= self.fill[source]) & (self.owner != source)
        room = self.size - self.filled
        found = None
        for given, parts in [(n, (n,)) for n in ones] + list(twos.items()):
            grow = given - self.taken
            good = usable & (grow > 0) & (grow <= room)
            if len(parts) == 2:
                good &= self.taken > 0
            at = np.flatnonzero(good)
            if len(at):
                top = at[np.lexsort((-grow[at], -self.filled[at]))[0]]
                key = (self.filled[top], grow[top])
                if found is None or key > found[0]:
                    found = (key, int(self.owner[top]), parts, int(self.taken[top]))
        return found and found[1:]


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empty bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The emptiest bin gives to fuller ones what fills them best; where it can give nothing any more, the next emptiest
    tries, and so on through all of them. What a fuller bin gains, squared, outweighs what the emptier one loses, so the search
    ends: where no bin can give anything, or where the underfull bins' contents can't do with one bin less, so that no
    exchange could save one.
    """
    ln = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(ln[i] for i in b) for b in bins]
    under = Underfull(bins, fill, ln, size)

    def pick(b: int, n: int) -> int:
        return next(i for i in bins[b] if ln[i] == n)

    while under.spare():
        for source in under.members:
            found = under.best(source)
            if found:
                break
        else:
            break
        target, given, taken = found
        for n in given:
            i = pick(source, n)
            bins[source].remove(i)
            bins[target].append(i)
        if taken:
            i = next(i for i in bins[target] if ln[i] == taken)
            bins[target].remove(i)
            bins[source].append(i)
        grow = sum(given) - taken
        fill[source] -= grow
        fill[target] += grow
        under.order()
    return [b for b in bins if b]


def _pack(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["salt"], group["ids_crc32"], group["piece"], group["doc_id"]))
        group, lengths = group.iloc[order], lengths[order]
        whole = np.flatnonzero(lengths >= size)
        part = np.flatnonzero(lengths < size)
        bins = [[int(i)] for i in whole]
        bins += [[int(part[i]) for i in b] for b in local_search(best_fit(lengths[part], size), lengths[part], size)]
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        base = int(group["pack"].iloc[0]) << 32
        for s, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + s, at
                at += int(lengths[i])
        return group.assign(sequence_id=sequence, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the id `end` alone; long texts are cut from the end, so only the first piece may be
    short; repeated rows are packed each; other columns are not read. Packs share no bin, which costs
    at most one bin per pack of about PACK pieces.
    """
    cut = settle(pieces(docs, tokenizer, size, end, id_col, text_col))
    packs = max(1, -(-cut.count() // PACK))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(packs)))
    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("pack").applyInPandas(
        _pack(size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
