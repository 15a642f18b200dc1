"""Licence notices against a version without an index."""

import math
import re
from collections import Counter

import pytest

from spellwise.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, phrases=None, notices=None):
    """All words in a list, every place tried."""
    phrases, notices = phrases or L.PHRASES, notices or L.NOTICES
    texts = [words(t) for _, t in rows]
    vocab = {w for t in [*phrases, *(n for _, n, _ in notices)] for w in words(t)}
    df = Counter(w for t in texts for w in vocab.intersection(t))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1e-9 for w in vocab}

    def stands(phrase, t):
        return [i for i in range(len(t) - len(phrase) + 1) if t[i : i + len(phrase)] == phrase]

    near = lambda places, at: any(abs(p - at) <= L.SLACK for p in places)
    out = []
    for (doc_id, _), t in zip(rows, texts):
        base = {label: stands(words(p), t) for p, label in phrases.items()}
        base = {k: v for k, v in base.items() if v}
        starts = sorted(s for v in base.values() for s in v)
        labels, score = set(base), 0.5 if starts else 0.0
        for label, notice, keys in notices:
            nw = words(notice)
            where = {w: [i for i, x in enumerate(t) if x == w] for w in nw}
            spots = [(stands(words(k), t), stands(words(k), nw)[0]) for k in keys]
            if not all(p for p, _ in spots):
                continue
            anchors = sorted({w for w in nw if where[w]}, key=lambda w: (-idf[w], w))[: L.ANCHORS]
            begins = [[p - q for p in where[a] for q, x in enumerate(nw) if x == a] for a in anchors]
            for s in set(begins[0]):
                if 2 * sum(near(b, s) for b in begins) >= len(begins) and all(near(p, s + o) for p, o in spots):
                    share = sum(idf[w] for i, w in enumerate(nw) if near(where[w], s + i)) / sum(idf[w] for w in nw)
                    if share >= L.LEAST:
                        labels.add(label)
                        score = max(score, 0.5 + 0.5 * min(share, 1.0))
        join = lambda x: ",".join(sorted(x))
        out.append((doc_id, len(t), len(starts), starts[0] if starts else None, starts[-1] if starts else None, join(base), join(labels), round(score, 9)))
    return Counter(out)


def rows_of(odd_rows):
    long = " ".join(f"w{i}" for i in range(40_000))
    mit = next(n for label, n, _ in L.NOTICES if label == "mit" and len(n) > 60)
    gpl = next(n for label, n, _ in L.NOTICES if label == "gpl" and "program" in n)
    bsd = next(n for label, n, _ in L.NOTICES if label == "bsd" and len(n) > 60)
    own = [
        "Licensed under CC BY-NC 4.0", "cc, by! CC-BY cc by", "xcc by cc byx ccby", "all rights\nreserved.", "ALL RIGHTS RESERVED all rights reserved",
        "the general public license", "general public licenseé", "Released under the MIT License.", f"{long} {gpl} {long}", f"{long} {bsd[:60]}",
        mit.upper(), mit.replace(" ", "\n * "), " ".join(f"{w} {'zz' if i in (10, 15, 20) else ''}" for i, w in enumerate(mit.split())),
        " ".join(reversed(mit.split())), "free of charge " * 200, "the " * 5000 + "apache license", f"{mit} {long} {bsd} {gpl} all rights reserved",
        "licensed under the apache license, version 2.0", "a general public\u00a0license", "This work is licensed under the GNU General Public License, version 3",
    ]
    return [(r[0], r[1]) for r in odd_rows] + [(2000 + i, t) for i, t in enumerate(own)]


def rounded(df):
    return Counter((*tuple(r)[:-1], round(r["score"], 9)) for r in df.collect())


def test_equals_a_version_without_an_index(spark, odd_rows):
    rows = rows_of(odd_rows)
    extra = [(*r, 1, "x", 2, "y", 0.5, "z") for r in rows]
    df = spark.createDataFrame(extra, "doc_id long, text string, n_words int, labels string, n int, word string, score double, base_labels string")
    assert rounded(L.scan(df.repartition(4))) == plain(rows)


def test_notices_found_and_left_alone(spark, odd_rows):
    rows = rows_of(odd_rows)
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if (r["doc_id"] or 0) >= 2000}
    labels = [got[2000 + i]["labels"] for i in range(20)]
    assert labels[0] == "cc-by,cc-by-nc" and labels[1] == "cc-by" and labels[2] == "" and labels[3] == labels[4] == "reserved"
    assert labels[5] == "gpl" and labels[6] == "" and labels[7] == "mit" and labels[8] == "gpl" and labels[9] == ""
    assert labels[10] == labels[11] == labels[12] == "mit" and labels[13] == "" and labels[14] == ""
    assert labels[16] == "bsd,gpl,mit,reserved" and labels[17] == "apache" and labels[18] == "" and labels[19] == "gpl"
    assert (got[2001]["n_base"], got[2001]["first_word"], got[2001]["last_word"]) == (3, 0, 4) and got[2010]["score"] == pytest.approx(1.0)


def test_chunks_cut_between_words(monkeypatch):
    text = ("aé漢 b-c " * 50 + "x" * 100 + " end").encode()
    whole = L._WORDS.findall(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(L, "CHUNK", size)
        assert [w for part in L.chunks(text) for w in part] == whole


def test_no_rows(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        L.templates([("x", "some words", ["other words"])])
