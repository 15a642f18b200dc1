"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 bits over word shingles. Candidates are exact: with `radius` differing bits at most,
two fingerprints agree whole in at least `BLOCKS - radius` of their BLOCKS bit blocks, so each one is filed under
every choice of so many blocks. Inside a bucket all pairs are compared, but never listed: bit planes lie
vertically, one word holds the same bit of 64 pairs, carry-save counters add up the differing bits and words whose
pairs are all beyond the radius (or already in one component) are abandoned. Only links that join two components of
the bucket leave the task, so a bucket of m fingerprints gives m - 1 rows at most, and no component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellwise.llm.common import components, settle

BLOCKS = 6
#: Fingerprints of one bucket that one comparison takes at most twice; larger buckets are cut and compared chunk by chunk.
CHUNK = 2048
#: Fingerprints gathered before a pass over their bit planes.
UNIT = 8192


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero where it has no word."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    m = max(n - shingle + 1, 1)
    starts = (ends - size)[:m].tolist()
    ends = ends[n - m :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 16384):
        h = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts[i : i + 16384], ends[i : i + 16384])), np.uint64
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > m, bitorder="little").tobytes(), "little")


def fingerprint_column(text: str = "text", shingle: int = 4):
    """An Arrow function column: the fingerprint of `text` as a signed long."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash(t, shingle) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return fp(F.col(text))


def masks(radius: int) -> list[int]:
    """Signed masks of every choice of blocks of which at least one agrees whole."""
    bounds = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    both = [sum(c) for c in combinations(block, BLOCKS - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit plane k, row k: bit k of every fingerprint, 64 to a word, with a spare word at the end."""
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    words = (n + 63) // 64 + 1
    out = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three bit vectors: sum and carry."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(planes: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i (row numbers) whose fingerprints i and i + d differ in at most `radius` (below 8) bits."""
    n = len(valid)
    words = planes.shape[1] - 1
    live = np.zeros(words * 8, np.uint8)
    packed = np.packbits(valid, bitorder="little")
    live[: len(packed)] = packed
    live = live.view(np.uint64)
    at = np.flatnonzero(live)
    live = live[at]
    ones = np.zeros(len(at), np.uint64)
    twos, fours = ones.copy(), ones.copy()
    skip, shift = d >> 6, np.uint64(d & 63)
    limit = [np.uint64(0) if radius >> k & 1 else ~np.uint64(0) for k in range(3)]
    for k in range(0, 64, 8):
        if not len(at):
            break
        plane = planes[k : k + 8]
        other = plane[:, np.minimum(at + skip, words)]
        if shift:
            other = (other >> shift) | (plane[:, np.minimum(at + skip + 1, words)] << (np.uint64(64) - shift))
        x = plane[:, at] ^ other
        ones, two_a = _add(ones, x[0], x[1])
        ones, two_b = _add(ones, x[2], x[3])
        twos, four_a = _add(twos, two_a, two_b)
        ones, two_a = _add(ones, x[4], x[5])
        ones, two_b = _add(ones, x[6], x[7])
        twos, four_b = _add(twos, two_a, two_b)
        fours, over = _add(fours, four_a, four_b)  # eight or more: beyond the radius for good
        # counter > radius, from the highest digit down
        more, same = np.zeros_like(ones), ~np.zeros_like(ones)
        for digit, zero in ((fours, limit[2]), (twos, limit[1]), (ones, limit[0])):
            more |= same & digit & zero
            same &= ~(digit ^ ~zero)
        live = live & ~(over | more)
        keep = live != 0
        if not keep.all():
            at, live, ones, twos, fours = at[keep], live[keep], ones[keep], twos[keep], fours[keep]
    out = np.zeros(words, np.uint64)
    out[at] = live
    return np.flatnonzero(np.unpackbits(out.view(np.uint8), bitorder="little")[:n])


def links(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each group; rows of a group lie together."""
    n = len(fp)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = planes_of(fp)
    label = np.arange(n)
    out = []
    for d in range(1, n):
        same = group[:-d] == group[d:]
        if not same.any():
            break
        valid = same & (label[:-d] != label[d:])
        if not valid.any():
            continue
        joined = False
        for i in within(planes, d, valid, radius).tolist():
            a, b = root(i), root(i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + d))
                joined = True
        if joined:
            label = np.array(parent)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_fp, rest_key = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

        def solved(fp, key):
            new = np.ones(len(fp), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1
            fp, group = fp[many], group[many]
            pairs = links(fp.view(np.uint64), group, radius) if len(fp) else []
            i, j = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

        for batch in batches:
            fp = np.concatenate([rest_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "part")], axis=1)
            key = np.concatenate([rest_key, key])
            while len(fp) > UNIT:
                # up to the last place at or after UNIT where a bucket ends
                ends = np.flatnonzero((key[UNIT:] != key[UNIT - 1 : -1]).any(axis=1))
                if not len(ends):
                    break
                cut = UNIT + int(ends[0])
                yield solved(fp[:cut], key[:cut])
                fp, key = fp[cut:], key[cut:]
            rest_fp, rest_key = fp, key
        if len(rest_fp):
            yield solved(rest_fp, rest_key)

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at most `radius` bits apart; all of them up to components."""
    filed = fps.select(
        "fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key")
    )
    large = filed.groupBy("t", "key").count().where(F.col("count") > CHUNK)
    large = large.select("t", "key", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    cut = filed.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # chunk x of c meets every other chunk once: part = the pair's number, c * lower + higher
    cut = cut.withColumn("x", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    part = F.expr(
        "if(chunks = 1, array(0L), transform(filter(sequence(0L, chunks - 1), y -> y <> x), "
        "y -> least(x, y) * chunks + greatest(x, y)))"
    )
    cut = cut.select("fp", F.col("t").cast("long").alias("t"), "key", F.explode(part).alias("part"))
    cut = cut.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "fp")
    return cut.mapInArrow(_compare(radius), "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id) for every distinct `fp` of `prints` (doc_id, fp): the smallest doc_id reachable over links
    of at most `radius` bits. Null ids don't count; a component that has no other gets null."""
    reps = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(reps.select("fp"), radius))
    named = reps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    return named.join(least, F.col("root") == F.col("r")).select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null text counts as empty, texts without words share fingerprint zero and are linked like any other, repeated
    rows stay repeated, other columns are not read. Very long texts are hashed whole, block by block.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = settle(slim.select("doc_id", fingerprint_column("text", shingle).alias("fp")))
    out = prints.join(classes(prints, radius), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest doc_id, of repeated rows any one.

    Texts are fingerprinted once; the rows to keep are found again by id and a 64-bit digest of the text.
    """
    columns = docs.columns
    digest = F.xxhash64("text")  # of a null text, too
    prints = settle(docs.select("doc_id", digest.alias("th"), fingerprint_column("text", shingle).alias("fp")))
    named = prints.join(classes(prints.select("doc_id", "fp"), radius), "fp")
    # a class without an id is known by one of its fingerprints
    first = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("m")
    )
    first = first.select(F.col("m.doc_id").alias("__id"), F.col("m.th").alias("__keep"))
    marked = docs.withColumn("__th", digest)
    kept = marked.join(first, marked["doc_id"].eqNullSafe(first["__id"]) & (marked["__th"] == first["__keep"]))
    one = Window.partitionBy("__id", "__keep").orderBy("__th")
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*columns)
