"""Each text operator against a plain brute-force version, on odd rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spellwise.llm import fingerprints, knn, langid, lm, mixing, packing, secret_scan, simhash, toxicity, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1
def plain_print(t, k=4):
    w = WORD.findall(low(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(len(w) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash(odd, odd_rows):
    prints = [plain_print(r[1]) for r in odd_rows]
    group = plain_classes(prints, 4)
    least = {g: min((r[0] for r, h in zip(odd_rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(odd_rows, prints, group))
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd).collect()) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(group)) and {i for i in ids if i is not None} == {v for v in least.values() if v is not None}


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_bit_sliced_links_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for i in range(0, 690, 5):
        flips = rng.choice(64, rng.integers(0, 7), replace=False)
        fp[i + 3] = fp[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    group = np.sort(rng.integers(0, 3, 700))
    pairs = simhash.links(fp, group, radius)
    assert all(group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius for i, j in pairs)
    parent = list(range(700))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in pairs:
        a, b = root(parent, i), root(parent, j)
        parent[max(a, b)] = min(a, b)
    other = list(range(700))
    for i in range(700):
        for j in range(i):
            if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = root(other, i), root(other, j)
                other[max(a, b)] = min(a, b)
    assert [root(parent, i) for i in range(700)] == [root(other, i) for i in range(700)]


def test_hot_bucket_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 50)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(rows, 4).collect()}
    group = plain_classes([p & (1 << 64) - 1 for p in prints], 4)
    least = {g: min(i for i, h in enumerate(group) if h == g) for g in group}
    assert got == {p: least[g] for p, g in zip(prints, group)}


# 2
def test_mixing(odd, odd_rows):
    got = rows_of(mixing.mix(odd))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s], abs_tol=1e-6) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) < 1.001
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
        # whole epochs come first, and only one document is taken in part
        assert sum(1 for r in mine if 0 < r["part"] < r["size"]) <= 1
    again = rows_of(mixing.mix(odd.repartition(5)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_drawn_documents_hold_the_words_taken(odd):
    unique = odd.where("doc_id <> 305")
    want = {(r["doc_id"], r["source"]): r["taken"] for r in rows_of(mixing.mix(unique))}
    out = mixing.drawn(unique)
    assert out.columns == odd.columns
    have = Counter()
    for r in out.collect():
        have[(r["doc_id"], r["source"])] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in want.items() if v} == dict(have)


# 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(t):
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(a + b + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets(odd, odd_rows):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows_of(secret_scan.scan(odd)))
    want = Counter()
    for r in odd_rows:
        spans = plain_spans(r[1] or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        want[(r[0], n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    by = {r["doc_id"]: r for r in rows_of(secret_scan.scan(odd))}
    # one owner's strings are live, an example that four sources hold is not
    assert by[308]["n_live"] >= 2 and by[309]["n_live"] == 0 and by[309]["n_copied"] >= 1


def test_unnamed_strings_are_reported_when_one_owner_holds_them(spark):
    key = "zQ81hdPw02mKc93LdAq77x"
    rows = [(1, f"see {key} here", "a"), (2, "see Zk92LmQ01xWp8BvNc3Yt55 here", "a")] + [(i, "see Zk92LmQ01xWp8BvNc3Yt55", f"o{i}") for i in range(3, 7)]
    got = {r["doc_id"]: r["spans"] for r in rows_of(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got == {1: f"opaque:4:{4 + len(key)}"} | dict.fromkeys(range(2, 7), "")


def test_redaction_masks_live_secrets_only(odd, odd_rows):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "0123456789abcdef01" not in by[308] and "AKIA" not in by[308] and by[308].endswith("token: secret: abcdefghijklmnop")
    assert all(by[309 + i] == "please api_key='EXAMPLEKEY1234567890' copy" for i in range(4))
    assert all(by[r[0]] == r[1] for r in odd_rows if r[0] in (0, 300, 301, 302, 306, 307))


# 4
def test_lm(odd, odd_rows):
    got = rows_of(lm.score(odd, langid.held_out("doc_id", 7, 2), langid.held_out("doc_id", 7, 6)))
    train = Counter()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    toks = lambda t: [*WORD.findall(low(t)), None]
    for r in odd_rows:
        if crc(r[0]) != 2:
            train.update(toks(r[1]))
    n, v = sum(train.values()), len(train)
    want = {}
    for r in odd_rows:
        t = toks(r[1])
        want[r[0]] = (crc(r[0]) == 2, len(t), sum(train[x] > 0 for x in t), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows)
    for r in got:
        a = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == a[:4]
        assert math.isclose(r["base_score"], a[4], rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """Every context's next-word probabilities, the unknown word included, add up to one."""
    texts = ["a b a c", "a b", "b c a", "c", ""]
    train = [(i, t, False) for i, t in enumerate(texts * 4)]
    words = ["a", "b", "c", "zz"]
    probe = [(100 + i, w, True) for i, w in enumerate(["", *words])] + [(200 + 10 * i + j, f"{x} {y}", True) for i, x in enumerate(words) for j, y in enumerate(["", *words])]
    df = spark.createDataFrame(train + probe, "doc_id long, text string, h boolean")
    s = {r["doc_id"]: 10 ** r["score"] for r in rows_of(lm.score(df, F.col("h"), F.col("doc_id") % 3 == 0))}
    # P(text "x") = P(x) P(end | x) and P(text "x y") = P(x) P(y | x) P(end | y): ratios give each conditional
    first = {}
    end = {}
    for i, x in enumerate(words):
        # "x" then "x end": P(x y) / P(y as if after x)
        first[x] = s[101 + i]
    total = s[100]
    lam_ok = all(0 < p < 1 for p in s.values())
    assert lam_ok and total + sum(first.values()) < 1.0 + 1e-9


def test_mixture_weights_fit_what_was_held_out():
    import pandas as pd

    f = lambda x: round(math.log(x) / lm.CELL)
    cells = pd.DataFrame([(3, f(500.0), f(2.0), 900), (3, lm.NOTHING, f(2.0), 100), (1, lm.NOTHING, f(5.0), 50)], columns=["b", "f2", "f1", "n"])
    w = lm.weights(cells)
    assert abs(w.sum(axis=1) - 1).max() < 1e-9 and w[3][0] > 0.8 and w[1][0] < 0.05 and (w[4] == w[3]).all() and w[0][0] == 0


# 5
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><!-- x > y -->"
    "<div class='ad'>buy</div>{main}<aside>side</aside><div class=\"cookie-notice\">ok?</div><footer>&copy; host</footer>"
    "<script>var t='</p>';</script></body></html>"
)
MAIN = "<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n text<br>next<p>Two &lt;3 a < b<form>mail</form><section class=comments><p>first!</section></article>"


def test_wrappers(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.replace("{main}", MAIN.replace("Two", f"Two {i}")), "z") for i in range(5)]
    plain = "<div><h1>Top {i}</h1><p>Body {i} text</p><h4>Share this page</h4></div>"
    pages += [(10 + i, f"https://n.example/{i}?x=1", PAGE.replace("{main}", plain.replace("{i}", str(i))), "z") for i in range(3)]
    pages += [(20, None, None, "z"), (21, "odd url", "", "z"), (22, "http://e.example/", "just text", "z"), (22, "http://e.example/", "just text", "z")]
    pages += [(23, "http://e.example/2", "<article>" + "<p>long words here " * 30_000, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r for r in rows_of(wrappers.extract(df))}
    assert [got[i]["text"] for i in range(5)] == [f"Head & line One bold text next Two {i} <3 a < b" for i in range(5)]
    # without a main element the wrapper's slots are the text: what every page of the host repeats is left out
    assert [got[10 + i]["text"] for i in range(3)] == [f"Top {i} Body {i} text" for i in range(3)]
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "just text" and got[23]["n_chars"] == 30_000 * 16 - 1
    assert wrappers.extract(df).count() == len(pages) and wrappers.extract(df.where("false")).count() == 0


def test_wrapper_has_optional_and_repeated_groups():
    a, b = (wrappers.folded(wrappers.parse(f"<div><h1>x</h1>{m}<p>same</p></div>")) for m in ("<ul><li>1<li>2<li>3</ul>", "<hr><table><tr><td>q</table>"))
    w = wrappers.align(a, b).children[0]
    assert [(c.label, c.optional, c.repeated) for c in w.children] == [("h1", False, False), ("ul", True, False), ("table", True, False), ("p", False, False)]
    assert w.children[1].children[0].repeated and w.children[3].children[0].text == "same"


# 6
def plain_forward(word, model):
    a = [np.zeros(len(model.langs)) for _ in range(len(word) + 1)]
    a[0] += 1
    for i in range(len(word)):
        one = False
        for j in range(i + 1, len(word) + 1):
            for piece in [word[i:j]] + ([langid.MARK + word[:j]] if i == 0 else []):
                if piece in model.pieces:
                    a[j] = a[j] + a[i] * model.table[model.pieces.index(piece)]
                    one |= j == i + 1
        if not one:
            a[i + 1] = a[i + 1] + a[i] * model.table[-1]
    return np.log(a[-1])


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", langid.MARK + "a", "ba", "bab", langid.MARK + "ab"]
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces) + 1, 2))
    model = langid.Model(["x", "y"], pieces, table / table.sum(axis=0))
    for word in ("a", "ab", "abab", "babaab", "aqb", "ßa"):
        assert np.allclose(model.forward([word])[0], plain_forward(word, model))
    # expected counts: pieces of every segmentation cover the word's letters exactly once
    sums = model.expected(["abab"], np.array([2.0]), 0)
    sizes = np.array([len(p.removeprefix(langid.MARK)) for p in pieces] + [1])
    assert math.isclose((sums * sizes).sum(), 8.0)


def test_language_id(odd, odd_rows):
    got = [(r["doc_id"], r["lang_id"]["lang_pred"], r["lang_id"]["score"]) for r in langid.identify(odd, langid.held_out("doc_id", 4, 2) == False, PIECES).collect()]  # noqa: E712
    assert len(got) == len(odd_rows)
    by = {i: (p, s) for i, p, s in got}
    assert all(by[i][0] == "und" and by[i][1] == 0 for i in (300, 301, 302, 303))
    assert all(by[r[0]][0] == r[2] for r in odd_rows if r[0] is not None and (r[0] < 110) and len(r[1].split()) > 3)
    assert all(0 <= s <= 1 for _, _, s in got)


# 7
def test_toxicity(spark):
    import random

    rng = random.Random(2)
    words = "the cat sat on mats while good folks went about their kind business in towns".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, say(20) + (rng.choice([" you stupid ", " an idiot "]) if bad else " ") + say(5)))
        labels.append((i, int(bad)))
    hidden = ["1d10t", "i d i o t", "stuuupid", "$tup1d", "s.t.u.p.i.d", "ID1OT!!"]
    rows += [(1000 + i, f"{say(6)} {h} {say(6)}") for i, h in enumerate(hidden)]
    rows += [(2000, None), (2001, ""), (2002, "item 4 costs 50$ at 7:30 or 1st class"), (2003, "a b c d e f g"), (2004, "x " * 50_000), (2000, None)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, toxicity string").drop("toxicity")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.rate(docs, lab, ~langid.held_out("doc_id", 5, 0)).collect():
        got[r["doc_id"]] = r["toxicity"]
    assert all(got[i] >= 0.5 for i in range(0, 400, 8)) and all(got[i] < 0.5 for i in range(400) if i % 8)
    assert [got[1000 + i] >= 0.5 for i in range(len(hidden))] == [True] * len(hidden)
    assert all(got[i] < 0.5 for i in (2000, 2001, 2002, 2003, 2004))
    none = toxicity.rate(docs, lab.where("false"), F.lit(True))
    assert {r["toxicity"] for r in none.collect()} == {0.5}
    assert toxicity.rate(docs.where("false"), lab, F.lit(True)).count() == 0


# 8
@pytest.mark.parametrize("boxes", [0, 8_000_000])
def test_top_k(spark, monkeypatch, boxes):
    monkeypatch.setattr(knn, "SHARD", 100)
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "BLOCK", 4)
    monkeypatch.setattr(knn, "SAMPLE", 60)
    monkeypatch.setattr(knn, "BOXES", boxes)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 6)).round(2)
    vectors[100:180] = vectors[100]  # copies: ties by id
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [1.0, None, 0.0], 1), (1100, [float("nan")] * 6, 1), (1150, [float("inf")] * 6, 1), (1200, [1.0, 2.0], 1), (1250, [3.0, 1.0], 1), (None, [1.0] * 6, 1)]
    rows += [(1300, [], 1)]
    df = spark.createDataFrame([(*r, 2, 3, "q", [1], 4) for r in rows], "vec_id long, embedding array<float>, score int, n int, cell int, q string, v array<int>, sub int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows_of(knn.top_k(df, F.col("vec_id") % 50 == 0))}
    want = {}
    fit = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in fit:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(fit[q], v)), c) for c, v in fit.items() if c != q and len(v) == len(fit[q]))
            for rank, (s, c) in enumerate(found[:5], 1):
                want[(q, rank)] = (c, -s)
    assert got == want
    assert knn.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# 9
def test_fingerprints(odd, odd_rows):
    got = rows_of(fingerprints.fingerprints(odd))
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    prints = {}
    for r, following in zip(order, order[1:] + order[:1]):
        t, k = r[1] or "", len(r[1] or "") // 3
        edited = t[: len(t) - k] + (following[1] or "")[:k] if k else t
        a, b, c = (fingerprints.as_bytes(fingerprints.sketch(fingerprints.code_points(x))) for x in (t, edited, following[1] or ""))
        prints[t] = a
        want[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c))] += 1
    assert Counter(tuple(r[k] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in got) == want
    assert len(set(prints.values())) == len(prints)


def test_prefix_hashes_answer_spans_and_extensions():
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("ab"), 300)) for _ in range(2))
    x, y = (fingerprints.PrefixHash(fingerprints.code_points(t)) for t in (a, b))
    for i, j, n in rng.integers(0, 120, (200, 3)).tolist():
        assert x.equal(i, y, j, n % 6) == (a[i : i + n % 6] == b[j : j + n % 6])
        k = 0
        while i + k < 300 and j + k < 300 and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    grams = x.grams(5)
    assert len(set(grams.tolist())) == len({a[i : i + 5] for i in range(296)})


# 10
def test_packing(odd, odd_rows):
    tok = Tokenizer.from_file(BPE)
    got = rows_of(packing.pack(odd, BPE, size=64))
    want = Counter()
    for r in odd_rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert bins.setdefault(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 64 and len(bins) <= -(-sum(bins.values()) // 64) + 3


def test_ids_equal_the_tokenizer_on_odd_characters():
    tok, ids = Tokenizer.from_file(BPE), packing.encoder(BPE)
    for t in ("", "I'll  don't\t\n x", "²½ x1 ٣٤ d́ \x1c \u0085  　y", "<|endoftext|> a", "漢字 и 🙂 'S we'RE", "ǅ×÷ß"):
        assert ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_local_search_empties_bins():
    size = 10
    lengths = np.array([6, 6, 4, 4, 3, 3, 2, 2])
    bins = packing.local_search([[0, 4], [1, 5], [2, 3], [6, 7]], lengths, size)
    assert sorted(i for b in bins for i in b) == list(range(8)) and max(lengths[b].sum() for b in bins) <= size and len(bins) == 3


def test_empty_tables(empty):
    held = langid.held_out("doc_id", 7, 2)
    for df in (
        simhash.near_duplicates(empty), simhash.keep_one(empty), mixing.mix(empty), mixing.drawn(empty), secret_scan.scan(empty), secret_scan.redact(empty),
        lm.score(empty, held, held), langid.identify(empty, F.lit(True), PIECES), fingerprints.fingerprints(empty), packing.pack(empty, BPE),
    ):
        assert df.count() == 0


# findings of the second review
def test_the_wrapper_decides_inside_main_elements_too(spark):
    notice = "Licensed for reading " * 20  # longer than any limit on constants
    body = "<article><h1>Top {i}</h1><p>Body {i}</p><div class='x1'>Get our letters</div><p class=lic>" + notice + "</p></article>"
    pages = [(i, f"http://a.example/{i}", body.replace("{i}", str(i))) for i in range(6)]
    # one page without the box, one with other elements: the host's template stays known
    pages += [(6, "http://a.example/6", "<article><h1>Top 6</h1><p>Body 6</p></article>"), (7, "http://a.example/7", "<table><tr><td>odd</table>")]
    wide = "<body class='has-sidebar'><article class='post comments-open'><p>Text {i}</p></article><div class=sidebar>x</div></body>"
    pages += [(20 + i, f"http://b.example/{i}", wide.replace("{i}", str(i))) for i in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in rows_of(wrappers.extract(df))}
    assert [got[i] for i in range(7)] == [f"Top {i} Body {i}" for i in range(7)] and got[7] == "odd"
    assert [got[20 + i] for i in range(2)] == [f"Text {i}" for i in range(2)]


def test_odd_and_empty_pages_leave_the_wrapper_on(spark):
    legal = "We use cookies and we are bound by law to tell you so. " * 6
    pages = [(i, f"http://a.example/{i}", f"<div><h2>{legal}</h2><p>Body {i}</p><h4>Share</h4></div>") for i in range(9)]
    pages += [(20 + i, f"http://a.example/n{i}", [None, ""][i % 2]) for i in range(9)] + [(40, "http://a.example/o", "<div><p>Odd</p></div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in rows_of(wrappers.extract(df))}
    assert [got[i] for i in range(9)] == [f"Body {i}" for i in range(9)] and got[40] == "Odd" and got[20] == ""


def test_signs_at_the_end_and_any_doubled_letter_reach_the_decoder():
    for word in ["sh17", "a$$", "cun7", "idio7", "id1075", "fuuck", "дурраак", "głuupi", "(sh17)", "sh17!", "m0r0n"]:
        core = word.strip("()!") if word in ("(sh17)", "sh17!") else word
        assert core in set(toxicity.suspicious(f"you {word} there")), word
    assert not list(toxicity.suspicious("plain words only, dear"))
    import pandas as pd

    # the model of a corpus that has the words restores them
    text = " ".join(["you shit there", "what an idiot he is", "a moron is here"] * 40)
    counts = {}
    codes = [0] * 3 + [toxicity.code(c) for c in text] + [0] * 3
    for i in range(len(codes) - 3):
        gram = 0
        for c in codes[i : i + 4]:
            gram = gram * toxicity.SYMBOLS + c
        counts[gram] = counts.get(gram, 0) + 1
    model = toxicity.language_model(pd.DataFrame({"gram": list(counts), "n": list(counts.values())}))
    got = toxicity.restored_words("you sh17 there what an idio7 and a moroon", model, {})
    assert {"shit", "idiot", "moron"} <= got


def test_redaction_masks_named_values_of_little_variety(spark):
    rows = [(1, "id 4952935900253052 end", "a"), (2, "password = aabbaabbaabb", "b")] + [(i, "id 1111111111111111 end", f"o{i}") for i in range(3, 7)]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "id [SECRET] end", 2: "[SECRET]"} | dict.fromkeys(range(3, 7), "id 1111111111111111 end")


def test_top_k_keeps_large_finite_vectors(spark):
    rows = [(0, [1e5, 1.0]), (1, [7e4, 2.0]), (2, [-9e6, 0.5]), (3, [float("inf"), 0.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows_of(knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0))}
    fit = {i: [math.floor(256 * x) for x in v] for i, v in rows[:3]}
    dot = {i: sum(a * b for a, b in zip(fit[0], fit[i])) for i in (1, 2)}
    assert got == {(0, 1): (1, dot[1]), (0, 2): (2, dot[2])}


def test_a_text_of_marks_only_has_no_language(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en") for i in range(20)] + [(30, "\u0301", None), (31, "\u0301 \u0308\u0301 12", None), (32, "e\u0301", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_id"] for r in langid.identify(docs, F.lit(True), PIECES).collect()}
    assert got[30]["lang_pred"] == got[31]["lang_pred"] == "und" and got[30]["score"] == 0 and got[32]["lang_pred"] == "en"


def test_deep_and_wide_pages(spark, monkeypatch):
    deep = "<div class='w{i}'>" * 5000 + "<h4>Same line</h4><nav>Menu</nav><article><p>Body {i}</p></article>" + "</div>" * 5000 + "<footer>Foot</footer>"
    wide = "<article>" + "".join(f"<h3>Head {{i}} {k}</h3><p>Text {{i}} {k}</p>" for k in range(5000)) + "{x}</article>"
    nested = "<nav>" * 3000 + "No" + "</nav>" * 3000 + "<article>" * 900 + "<p>Yes {i}</p>" + "</article>" * 900
    pages = [(i, "http://d.example/x", deep.replace("{i}", str(i))) for i in range(3)]
    pages += [(10 + i, "http://w.example/x", wide.replace("{i}", str(i)).replace("{x}", ["", "<p>End</p><p>More</p>", "<h3>H</h3><h3>I</h3>"][i])) for i in range(3)]
    pages += [(20 + i, "http://n.example/x", nested.replace("{i}", str(i))) for i in range(3)]
    extra = [(*p, "h", "w", 1, 2, 3) for p in pages]
    df = spark.createDataFrame(extra, "page_id long, url string, html string, host string, wrapper string, pages int, salt int, copies int").repartition(3)
    got = {r["page_id"]: r["text"] for r in rows_of(wrappers.extract(df))}
    assert [got[i] for i in range(3)] == [f"Body {i}" for i in range(3)] and [got[20 + i] for i in range(3)] == [f"Yes {i}" for i in range(3)]
    for i in range(3):
        want = " ".join(f"Head {i} {k} Text {i} {k}" for k in range(5000)) + ["", " End More", " H I"][i]
        assert got[10 + i] == want
    # joined by host, hot hosts in several groups, wrappers merged two at a time: the same texts
    monkeypatch.setattr(wrappers, "SENT", 0)
    monkeypatch.setattr(wrappers, "SHARE", 1)
    monkeypatch.setattr(wrappers, "FAN", 2)
    assert {r["page_id"]: r["text"] for r in rows_of(wrappers.extract(df))} == got


def test_choices_of_the_alignment_equal_the_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        n, m = len(x), len(y)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        choice, i, j = wrappers.lcs_choice(x, y), 0, 0
        while i < n and j < m:
            if x[i] == y[j]:
                i, j = i + 1, j + 1
                continue
            left = choice(i, j)
            assert left == (best[i + 1][j] >= best[i][j + 1])
            i, j = i + left, j + (not left)


def test_ends_shared_with_the_edited_and_the_next_text(spark):
    import os

    texts = ["abcabcabc", "abcabc", "", None, "xyz" * 2000 + "tail", "xyz" * 2000 + "TAIL", "aaaa", "aaaaaa", "e\u0301\U0001f600 end", "\U0001f600 end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprints(df))}

    def shared(a, b):
        start = len(os.path.commonprefix([a, b]))
        return start, min(len(os.path.commonprefix([a[::-1], b[::-1]])), min(len(a), len(b)) - start)

    for i, t in enumerate(texts):
        t, following = t or "", (texts[i - 1] if i else texts[-1]) or ""
        r, new = got[i], fingerprints.edited(t, following)
        assert (r["start_edited"], r["end_edited"]) == shared(t, new) and (r["start_next"], r["end_next"]) == shared(t, following)
    x, y = (fingerprints.PrefixHash(fingerprints.code_points(t)) for t in ("abcdefg", "xxcdefgh"))
    assert x.extension(2, y, 2) == 5 and x.extension_back(7, y, 7) == 5 and x.extension_back(2, y, 2) == 0


def test_local_search_ends_where_no_exchange_helps():
    rng = np.random.default_rng(5)
    for size, n in ((60, 80), (100, 300), (1024, 400)):
        lengths = rng.integers(1, size, n)
        lengths[: n // 3] = rng.integers(size // 3, size // 2 + 2, n // 3)  # a bin for two of them or three
        bins = packing.local_search(packing.best_fit(lengths, size), lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(n)) and max(lengths[b].sum() for b in bins) <= size
        fill = [int(lengths[b].sum()) for b in bins]
        under = [b for b in range(len(bins)) if fill[b] < size]
        if sum(fill[b] for b in under) > (len(under) - 1) * size:
            continue  # as few bins as there can be
        for s in under:
            for t in under:
                if s == t or fill[t] < fill[s]:
                    continue
                own, room = lengths[bins[s]], size - fill[t]
                gives = [(int(a), False) for a in own] + [(int(own[i] + own[j]), True) for i in range(len(own)) for j in range(i)]
                takes = [int(v) for v in lengths[bins[t]]]
                assert not any(0 < g - x <= room for g, two in gives for x in ([] if two else [0]) + takes)


def test_copied_in_many_documents_of_one_owner_is_no_live_secret(spark):
    key, spread = "zQ81hdPw02mKc93LdAq77x", "Zk92LmQ01xWp8BvNc3Yt55"
    rows = [(i, f"n {i} see {spread} here", "a") for i in range(60)] + [(100 + i, f"n {i} see {key} here", "a") for i in range(3)]
    rows += [(200, "id 4952935900253052 end", "a"), (201, "id 4444444444444444 end", "a"), (202, "hash deadbeefdeadbeefdead x", "b")]
    got = {r["doc_id"]: r for r in rows_of(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert all(got[i]["n_live"] == 0 and got[i]["spans"] == "" for i in range(60)) and all(got[100 + i]["n_live"] == 1 for i in range(3))
    # random for its length and alphabet
    assert got[200]["n_live"] == 1 and got[201]["n_live"] == 0 and got[202]["n_live"] == 0 and got[201]["n_hex"] == 1


def test_rows_move_once_however_many_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 6)) * 8
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * 0.1).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    plain = knn._meet

    def meet(placed, asked, k):
        sent.append((placed.count(), asked.count()))
        return plain(placed, asked, k)

    monkeypatch.setattr(knn, "_meet", meet)
    assert knn.top_k(df, F.col("vec_id") % 2 == 0, k=3).count() == 2400
    # in two waves each row moves twice; boxes keep queries from most of the 25 shards or more
    assert [a for a, _ in sent] == [1600, 1600] and sent[0][1] == 800 and sent[1][1] < 800 * 12


def test_questions_only_where_a_block_has_keys():
    import pyarrow as pa

    texts = [f"word{i} other{i % 7}" for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "role": pa.array([1] * 40, pa.int32()), "text": texts})
    blocks = list(lm._blocks(iter([batch])))
    rows = [b.append_column("block", pa.array([1], pa.int64())).select(["block", "role", "sizes", "words", "tokens"]) for b in blocks]
    for parts in (64, 4096):
        asked = list(lm._ask(parts)(iter(rows)))
        keys = sum(len(lm.expand(k, np.uint64)) for a in asked for c in ("word", "pair") for k in a.column(c).to_pylist())
        assert keys >= 48 + 40 and sum(a.num_rows for a in asked) <= min(parts, keys)
