"""Document fingerprints from prefix polynomial hashes.

Modular prefix sums of a text answer the hash of any span in constant time; a binary search over them finds the
longest common extension of two places. A document's fingerprint is its whole hash followed by the SKETCH least hashes
of its spans of SPAN code points, so that the likeness of two texts is read from their fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Two primes below 2^31 and their bases: products fit 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 92821)
SPAN = 12
SKETCH = 64

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """Base^0 ... base^(n-1) modulo the prime; grown by doubling and kept."""
    p = np.uint64(PRIMES[which])
    have = _powers[which]
    while len(have) < n:
        step = np.uint64(pow(BASES[which], len(have), PRIMES[which]))
        have = np.concatenate([have, have * step % p])
    _powers[which] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text: H[i] = sum of (c + 1) * base^j over j < i, modulo each prime."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for which, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            # below 2^21 * 2^31 each; reduced before they are summed
            np.cumsum(c * powers(which, self.n) % np.uint64(p), out=sums[1:])
            self.prefix.append(sums % np.uint64(p))

    def spans(self, starts, length: int, top: int | None = None) -> np.ndarray:
        """62-bit hashes of the spans of `length` at `starts`, each shifted to base^top (default: the last start)."""
        starts = np.asarray(starts, np.int64)
        top = self.n if top is None else top
        out = np.zeros(len(starts), np.uint64)
        for which, p in enumerate(PRIMES):
            h, q = self.prefix[which], np.uint64(p)
            raw = (h[starts + length] + q - h[starts]) % q
            out = (out << np.uint64(31)) | (raw * powers(which, top + 1)[top - starts] % q)
        return out

    def grams(self, length: int) -> np.ndarray:
        """Hashes of all spans of `length`, comparable between texts: divided by their start's power."""
        m = self.n - length + 1
        out = np.zeros(m, np.uint64)
        for which, p in enumerate(PRIMES):
            h, q = self.prefix[which], np.uint64(p)
            back = np.uint64(pow(BASES[which], -1, PRIMES[which]))
            raw = h[length:] + q - h[:-length]
            out = (out << np.uint64(31)) | (raw % q * _inverse(which, m, back) % q)
        return out

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether text[i:i+length] equals other[j:j+length] (but for collisions of 62 bits)."""
        for which, p in enumerate(PRIMES):
            h, g = self.prefix[which], other.prefix[which]
            a, b = int(h[i + length]) - int(h[i]), int(g[j + length]) - int(g[j])
            if i != j:  # the span that begins earlier is shifted to the other's place
                shift = pow(BASES[which], abs(j - i), p)
                a, b = (a * shift, b) if i < j else (a, b * shift)
            if (a - b) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension from i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


    def extension_back(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension that ends before i here and before j there, by binary search."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def ends(self, other: PrefixHash) -> tuple[int, int]:
        """Code points that both texts share at their starts and, beyond those, at their ends."""
        start = self.extension(0, other, 0)
        return start, min(self.extension_back(self.n, other, other.n), min(self.n, other.n) - start)


_inverses: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(which: int, n: int, back: np.uint64) -> np.ndarray:
    have, p = _inverses[which], PRIMES[which]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(int(back), len(have), p)) % np.uint64(p)])
    _inverses[which] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    """Scatter hashes over 64 bits, so that the least ones are a fair sample."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(codes: np.ndarray | PrefixHash) -> tuple[int, np.ndarray]:
    """The whole text's hash (its length included) and the least distinct hashes of its spans, 32 bits each."""
    h = codes if isinstance(codes, PrefixHash) else PrefixHash(codes)
    n = h.n
    if not n:
        return 0, np.zeros(0, np.uint32)
    whole = int(_mix(np.array([int(h.prefix[0][n]) << 31 | int(h.prefix[1][n])], np.uint64) + np.uint64(n))[0])
    least = (_mix(h.grams(min(SPAN, n))) >> np.uint64(32)).astype(np.uint32)
    if len(least) > 4 * SKETCH:
        some = np.unique(np.partition(least, 4 * SKETCH)[: 4 * SKETCH])
        least = some if len(some) >= SKETCH else np.unique(least)
    else:
        least = np.unique(least)
    return whole, least[:SKETCH]


def as_bytes(print_: tuple[int, np.ndarray]) -> bytes:
    return print_[0].to_bytes(8, "big") + print_[1].astype(">u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal hashes among the least ones of both texts (an estimate of their spans' Jaccard similarity)."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s, ">u4", offset=8) for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y, True)).mean())


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


#: Columns of a finished row, in order; the last three need the next document's own hashes.
COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(),
    "near_edited": pa.float64(), "start_edited": pa.int64(), "end_edited": pa.int64(),
    "near_next": pa.float64(), "start_next": pa.int64(), "end_next": pa.int64(),
}


class Print:
    """One document's hashes and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.hash = PrefixHash(code_points(text))
        self.bytes = as_bytes(sketch(self.hash))

    def row(self, doc_id, following: str) -> tuple:
        """All columns that need no more than the following text."""
        new = edited(self.text, following)
        other = Print(new) if new != self.text else self
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(self.text), sha, self.bytes, other.bytes, likeness(self.bytes, other.bytes), *self.hash.ends(other.hash)

    def to(self, other: Print) -> tuple:
        return likeness(self.bytes, other.bytes), *self.hash.ends(other.hash)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in falling doc_id order; each is finished when the next has come. The first row and the unfinished
    last one leave as edge rows with their texts."""
    names = [*COLUMNS, "kind", "pid", "text"]
    schema = pa.schema([*COLUMNS.items(), ("kind", pa.string()), ("pid", pa.int32()), ("text", pa.string())])
    none = (None,) * (len(COLUMNS) - 1)
    held = None  # (doc_id, Print, pid)
    for batch in batches:
        out = []
        for pid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            now = Print(text or "")
            if held is None:
                out.append((doc_id, *none, "first", pid, now.text))
            else:
                out.append((*held[1].row(held[0], now.text), *held[1].to(now), "row", held[2], None))
            held = (doc_id, now, pid)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (held[0], *none, "last", held[2], held[1].text)))], schema)


def _ddl(names) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{n} {kinds[COLUMNS[n]]}" for n in names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the code
    points shared with the edited text and with the next document at the start (start_edited, start_next) and, beyond those,
    at the end (end_edited, end_next), located by binary search for the longest common extension.

    The next document is the one with the next smaller doc_id, after the last one the first; null ids come last and
    repeated ids follow each other by text. Null texts count as empty; two empty texts are alike (1), an empty and another
    one not at all (0); a single document is its own next. Texts move once, to be ordered by id in
    ranges; only the first and last text of each range meet their neighbours in a join.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = slim.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    done = settle(
        ranged.select(F.spark_partition_id().alias("pid"), "doc_id", "text").mapInArrow(
            _run, f"{_ddl(COLUMNS)}, kind string, pid int, text string"
        )
    )
    # one number per range: which non-empty range comes next
    ring = done.where("kind = 'last'").select("pid")
    by = Window.orderBy("pid")
    ring = ring.select("pid", F.coalesce(F.lead("pid").over(by), F.min("pid").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    first = done.where("kind = 'first'").select(F.col("pid").alias("then"), F.col("text").alias("following"))
    last = done.where("kind = 'last'").select("pid", "doc_id", "text").join(ring, "pid").join(first, "then")
    ends = last.select("doc_id", "text", "following").mapInArrow(_ends, _ddl(COLUMNS))
    out = done.where("kind = 'row'").select(*COLUMNS).union(ends)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            own = Print(text)
            rows.append(dict(zip(COLUMNS, (*own.row(doc_id, following), *own.to(Print(following))))))
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(COLUMNS.items())))
