"""Secret scans with DataFrame functions only: patterns find candidates, corpus-wide ownership tells what is live.

Every candidate's digest is counted over the corpus by distinct documents (repositories) and sources (owners). A
value that many owners hold, or few in very many repositories each, is a widely copied example; one that is specific to its
owners and looks random for its length and alphabet is live.
Random-looking strings that no pattern names are candidates as well, and are reported only when live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: These two are whole runs, so that a least length in the pattern drops exactly the short ones.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value that more owners than this hold is a copied example.
OWNERS = 2
#: Documents per owner beyond which a value is a copied example even where few owners hold it.
MANY = 25
#: A live-looking value has this share at least of the distinct characters that a random one of its length and alphabet has.
RATE = 0.6
# Alphabets of values, the narrowest first, and their sizes.
ALPHABETS = (("^[0-9]+$", 10), ("^[0-9a-f]+$", 16), ("^([0-9a-z]+|[0-9A-Z]+)$", 36), ("", 64))
MASK = "[SECRET]"


def found(text: Column, kind: int, pattern: str) -> Column:
    """Spans array<struct<start, kind, end, value>> of all leftmost matches, in order.

    The texts between matches and the matches themselves alternate, so their lengths add up to the places."""
    no = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, hit: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(gaps, acc["n"] + 1))
        end = start + F.length(hit)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hit.alias("value"))
        return F.struct((acc["n"] + 1).alias("n"), end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("at"), no.alias("out"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(hits, first, step, lambda acc: acc["out"])).otherwise(no)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(doc_id, owner, print, base, opaque): the spans of every text, which `print` (a digest) stands for."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.coalesce(text_col, F.lit("")).alias("text"))
    t = F.col("text")
    assign = F.filter(found(t, 0, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    assign = F.transform(assign, lambda s: s.withField("value", F.regexp_extract(s["value"], ASSIGN, 2)))
    opaque = F.filter(
        found(t, 3, OPAQUE),
        lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[A-Z]")) & F.regexp_like(s["value"], F.lit("[a-z]")),
    )
    base = F.concat(assign, found(t, 1, ACCESS), found(t, 2, HEX))
    return slim.select("doc_id", "owner", F.xxhash64("text").alias("print"), F.array_sort(base).alias("base"), opaque.alias("opaque")).withColumn(
        "opaque", F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    )


def looks_random(value: Column) -> Column:
    """Whether a value has about as many distinct characters as random ones of its length, in the narrowest alphabet that fits."""
    size = None
    for pattern, letters in ALPHABETS:
        fits = F.regexp_like(value, F.lit(pattern))
        size = F.when(fits, letters) if size is None else size.when(fits, letters)
    expected = size * (F.lit(1.0) - F.pow(F.lit(1.0) - F.lit(1.0) / size, F.length(value)))
    distinct = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    return distinct >= F.lit(RATE) * expected


def judged(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(doc_id, print, spans): spans array<struct<start, kind, end, live>> of the documents that have any.

    Distinct documents and owners of each value are counted in two grouped steps, so that a value which a
    third of all documents hold is summed up before it moves."""
    spans = found.where("size(base) + size(opaque) > 0").select(
        "doc_id", "owner", "print", F.explode(F.concat("base", "opaque")).alias("s")
    )
    spans = spans.withColumn("digest", F.sha2("s.value", 256))
    own = spans.groupBy("digest", "owner", "doc_id").agg(F.lit(1).alias("one"))
    own = own.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    own = own.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    own_specific = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= F.col("n_owners") * MANY)
    live = own_specific & looks_random(F.col("s.value"))
    each = spans.join(own, "digest").select(
        "doc_id", "print",
        F.struct("s.start", "s.kind", "s.end", live.alias("live"), "n_owners", "n_repositories").alias("span"),
    )
    return each.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, owners: int = OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Offsets are code points, ends exclusive. A null text counts as empty; a null owner is an owner of its own;
    repeated rows stay repeated and count once; ties in start go by kind; other columns are not read.
    """
    every = settle(candidates(docs, id_col, text_col, owner_col))
    some = judged(every, owners).select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "spans")
    # documents without a candidate need no partner
    bare = F.size(F.col("base")) + F.size(F.col("opaque")) == 0
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>")
    rich = every.where(~bare).join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")))
    rows = rich.select("doc_id", "base", "spans").union(every.where(bare).select("doc_id", "base", none.alias("spans")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    spans = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"] & (s["kind"] < 3))).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """`docs` with every live secret in `text` replaced by MASK; widely copied examples and all other text stay.

    What a pattern names is masked whenever few owners hold it, also where it doesn't look random or stands very often."""
    columns = docs.columns
    some = judged(settle(candidates(docs)), owners).select(
        F.col("doc_id").alias("__d"), F.col("print").alias("__p"), F.filter("spans", lambda s: s["live"] | ((s["kind"] < 3) & (s["n_owners"] <= owners))).alias("__spans")
    ).where("size(__spans) > 0")
    marked = docs.withColumn("__print", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = marked.join(some, marked["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__print") == F.col("__p")), "left")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"),
        )

    rebuilt = F.aggregate(
        "__spans", first, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    )
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rebuilt)).select(*columns)
