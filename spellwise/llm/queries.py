"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellwise.llm import clustering, conversations, fingerprints, knn, langid, license_scan, lm, mixing, packing, secret_scan, simhash, toxicity, wrappers
from spellwise.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"), radius=4, shingle=4)


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"))


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf, "documents"))


@query
def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf, "documents"))


@query
def op8_kdtree_topk(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op8_kdtree_topk"] = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q, ok c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held = langid.held_out("doc_id", 4, 2)
    found = langid.identify(docs.select("doc_id", "text", "lang"), ~held, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", held.alias("held_out"), "lang_id.lang_pred", "lang_id.score")


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held = langid.held_out("doc_id", 5, 0)
    rated = toxicity.rate(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "labels"), ~held)
    return rated.select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


@query
def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract(read(spark, sf, "pages"))


@query
def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(read(spark, sf, "documents"), langid.held_out("doc_id", 7, 2), langid.held_out("doc_id", 7, 6))


ORACLES["op2_mixing"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), t)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / CAST(4503599627370497 AS DOUBLE))
      / greatest(0.05::DOUBLE, 1 - 4 * CAST(length(t) - length(translate(t, '{mixing.SYMBOLS}', '')) AS DOUBLE) / greatest(length(t), 1)) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w
  FROM k GROUP BY source
), l AS (
  SELECT *, source_size * 2::DOUBLE / w AS bound,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(source_size) OVER f, 0) AS DOUBLE) * 2::DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM s WINDOW f AS (ORDER BY source_size * 2::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    coalesce(least((SELECT arg_min(level, (bound, level)) FROM l WHERE bound >= level) * w, source_size * 2::DOUBLE), source_size * 2::DOUBLE) AS target
  FROM l
), b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.source, k.size, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS budget,
    CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - start)) AS BIGINT) AS taken,
  CAST(epochs AS INTEGER) AS epochs, CAST(greatest(0, least(size, budget - start)) AS BIGINT) AS part
FROM r
"""


def _spans(kind: int, pattern: str, keep: str, value: str = "h[i]") -> str:
    """Spans of one kind: texts between matches and matches alternate, so their lengths add up to the places."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(h{kind}) + 1), lambda i: struct_pack(
        "start" := CAST(list_sum(list_transform(g{kind}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h{kind}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        kind := {kind}, size := length(h{kind}[i]), "value" := {value.replace('h[i]', f'h{kind}[i]')})), lambda s: {keep})""".replace("{p}", p)


def _secret_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    assign, opaque = quote(secret_scan.ASSIGN), quote(secret_scan.OPAQUE)
    hits = ", ".join(
        f"regexp_extract_all(t, '{quote(p)}') AS h{k}, regexp_split_to_array(t, '{quote(p)}') AS g{k}"
        for k, p in enumerate((secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.OPAQUE))
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    joined = lambda x: f"""coalesce(list_aggregate(list_transform({x}, lambda s: concat({kinds}[s.kind + 1], ':', s."start", ':', s."start" + s.size)), 'string_agg', ','), '')"""
    alphabet = "CASE " + " ".join(f"WHEN regexp_matches(value, '{p}') THEN {k}" for p, k in secret_scan.ALPHABETS) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id, source, {hits} FROM d),
n AS (SELECT r, doc_id, source,
    {_spans(0, '', "length(s.value) >= 12", f"regexp_extract(h[i], '{assign}', 2)")} AS a, {_spans(1, '', 'true')} AS b, {_spans(2, '', 'true')} AS c,
    {_spans(3, '', "regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Z]') AND regexp_matches(s.value, '[a-z]')")} AS o FROM m),
e AS (SELECT r, doc_id, source, list_sort(list_concat(a, b, c)) AS base, o FROM n),
f AS (SELECT r, doc_id, source, base, list_filter(o, lambda x: len(list_filter(base, lambda y: y."start" < x."start" + x.size AND x."start" < y."start" + y.size)) = 0) AS o FROM e),
u AS (SELECT r, doc_id, source, unnest(list_concat(base, o)) AS s FROM f),
w AS (SELECT s.value AS v, count(DISTINCT coalesce('s' || source, '')) AS owners,
    count(DISTINCT concat(coalesce('s' || source, ''), '|', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS repositories,
    {alphabet.replace('value', 's.value')} AS k, len(list_distinct(string_split(s.value, ''))) AS variety FROM u GROUP BY s.value),
j AS (SELECT u.r, list_sort(list(struct_pack("start" := s."start", kind := s.kind, size := s.size,
      live := owners <= {secret_scan.OWNERS} AND repositories <= owners * {secret_scan.MANY}
        AND variety >= {secret_scan.RATE}::DOUBLE * (k * (1::DOUBLE - pow(1::DOUBLE - 1::DOUBLE / k, length(v))))))) AS spans FROM u JOIN w ON u.s.value = w.v GROUP BY u.r)
SELECT doc_id, CAST(len(list_filter(base, lambda s: s.kind = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda s: s.kind = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(base, lambda s: s.kind = 2)) AS BIGINT) AS n_hex, sha256({joined('base')}) AS base_sha256,
  {joined('list_filter(spans, lambda s: s.kind < 3 OR s.live)')} AS spans,
  CAST(coalesce(len(list_filter(spans, lambda s: s.live)), 0) AS BIGINT) AS n_live,
  CAST(coalesce(len(list_filter(spans, lambda s: NOT s.live AND s.kind < 3)), 0) AS BIGINT) AS n_copied
FROM f LEFT JOIN j ON f.r = j.r
"""


ORACLES["op3_secrets"] = _secret_sql()


@query
def op12_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster(read(spark, sf, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Full search in every round: a chain of assignments a0, a1, ... and centroids c0, c1, ..."""
    parts = [f"""ok AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM ok QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT ok.r, c{i}.c, list_sum(list_transform(range(1, 65), lambda j: (ok.v[j] - c{i}.v[j]) * (ok.v[j] - c{i}.v[j]))) AS d FROM ok, c{i}) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
      SELECT b.c AS c, j, sum(x) AS s, count(*) AS n FROM (
        SELECT b, unnest(range(1, 65)) AS j, unnest(v) AS x FROM a{i} JOIN ok ON a{i}.r = ok.r) GROUP BY 1, 2) GROUP BY c) m ON c{i}.c = m.c
)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN ok ON a{rounds}.r = ok.r JOIN c{rounds} f ON f.c = b.c
"""


ORACLES["op12_clustering"] = _clustering_sql()


@query
def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def _conversation_sql() -> str:
    """The same edits by plain dynamic programming, row after row: per state the cheapest (cost, audit) and its text.

    A move takes a state and a row's symbol to another state by some inserts and the row's own edit."""
    step = lambda s: 3 if s == 2 else 2
    moves = []
    for entry in range(4):
        state, inserts, said = entry, 0, ""
        for inserts in range(4):
            for symbol in range(9):
                own = [("D", 2, state, "")]
                if symbol != 8:
                    extra, role = 5 * (symbol // 4), symbol % 4
                    own.append(("R", 1 + extra, step(state), "assistant" if state == 2 else "user"))
                    if (role, state) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                        own.append(("K", extra, role + 1, "="))
                moves += [(entry, symbol, leave, 5 * inserts + price, "I" * inserts + letter, said, says) for letter, price, leave, says in own]
            said += "assistant:" if state == 2 else "user:"
            said += "|"
            state = step(state)
    best = {}
    for m in moves:
        k = m[:3]
        best[k] = min(best.get(k, m), m, key=lambda m: (m[3], m[4]))
    values = ", ".join(f"({e}, {s}, {x}, {c}, '{a}', replace('{said}', '|', chr(10)), '{says}')" for e, s, x, c, a, said, says in best.values())
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations
), lots AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda y, i: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS lot FROM k
), dmg AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0
), ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (
  SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS code
  FROM dmg JOIN ids ON dmg.conv_id IS NOT DISTINCT FROM ids.conv_id
), f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN i > min(i) OVER (PARTITION BY g, role, text) THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lag(code) OVER (PARTITION BY g ORDER BY i) AS before FROM o
), moves(e, symbol, x, price, letters, said, says) AS (VALUES {values}),
dp AS (
  SELECT g, 0::BIGINT AS i, 0 AS state, struct_pack(cost := 0::BIGINT, audit := '', txt := '') AS b FROM ids
  UNION ALL
  SELECT g, i, x, min(struct_pack(cost := cost, audit := audit, txt := txt)) FROM (
    SELECT dp.g, f.i, m.x, dp.b.cost + m.price AS cost, dp.b.audit || m.letters AS audit,
      dp.b.txt || m.said || CASE m.says WHEN '' THEN '' WHEN '=' THEN f.role || ':' || f.text || chr(10) ELSE m.says || ':' || f.text || chr(10) END AS txt
    FROM dp JOIN f ON f.g = dp.g AND f.i = dp.i + 1
      JOIN moves m ON m.e = dp.state AND m.symbol = CASE WHEN f.fault IN (1, 2) THEN 8 ELSE f.code + 4 * CAST(f.fault = 3 AS INTEGER) END) GROUP BY g, i, x
), counts AS (
  SELECT g, count(*) AS n, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND (before, code) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY g
), ends AS (
  SELECT dp.g, min(struct_pack(cost := b.cost + z.price, audit := b.audit || z.letters, txt := b.txt || replace(z.said, '|', chr(10)))) AS b
  FROM dp LEFT JOIN counts ON counts.g = dp.g
    JOIN (VALUES (0, 0, '', ''), (1, 10, 'II', 'user:|assistant:|'), (2, 5, 'I', 'assistant:|'), (3, 0, '', '')) AS z(state, price, letters, said) ON z.state = dp.state
  WHERE dp.i = coalesce(counts.n, 0) GROUP BY dp.g
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit,
  sha256(CASE WHEN length(b.txt) > 0 THEN substr(b.txt, 1, length(b.txt) - 1) ELSE '' END) AS repaired_sha256
FROM ids JOIN ends ON ends.g = ids.g LEFT JOIN counts ON counts.g = ids.g
"""


ORACLES["op11_conversations"] = _conversation_sql()


@query
def op13_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(read(spark, sf, "documents"))
