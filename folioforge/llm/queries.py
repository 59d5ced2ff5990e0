"""Registered queries of the training-data operators, and their SQL where SQL can say it.

Each query applies one operator with production parameters to its whole table and
derives the digest columns of its contract from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontaminate, funnels, langid, licences, lm, paritysketch, productcodes, quality, rlz, suffixes, superminhash, topk
from folioforge.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(spark, docs, langid.fit(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paritysketch.components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, table(spark, sf_dir, "documents"), vocabulary())


def op11_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return productcodes.compressed(spark, table(spark, sf_dir, "embeddings"))


def op13_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.counted(table(spark, sf_dir, "clicks"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_decontamination, op4_topk_search, op5_ngram_jaccard, op6_lm_scores, op7_substring_dedup, op8_quality, op9_suffix_dedup, op10_bpe_codec, op11_minhash_groups, op12_vector_codes, op13_ordered_funnels)}

# SQL for the operators that SQL expresses; ids are taken to be unique and not null there.
OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, need, array_to_string(w[p:p + need - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS need, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (SELECT doc_id, p, need, array_to_string(w[p:p + need - 1], ' ') AS k FROM t, (SELECT DISTINCT need FROM iw) WHERE p + need - 1 <= len(w)),
m AS (SELECT DISTINCT doc_id, p, dw.need, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.need = iw.need),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + need)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id),
tw AS MATERIALIZED (SELECT doc_id, p, w[p] AS word FROM t),
cf AS (SELECT word, count(*) AS cf FROM tw GROUP BY word),
bw AS (SELECT item_id, ws, need, 0 AS spare, unnest(range(ws, ws + need)) AS ip, w FROM (SELECT item_id, w, least(10, len(w)) AS need, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS ws FROM b WHERE len(w) > 0)),
rk AS MATERIALIZED (SELECT item_id, ws, need, spare, ip, w[ip] AS word, row_number() OVER (PARTITION BY item_id, ws ORDER BY coalesce(cf, 0), ip) AS nth FROM bw LEFT JOIN cf ON cf.word = w[ip]),
pv AS MATERIALIZED (SELECT tw.doc_id, tw.p, r.* FROM rk r JOIN tw USING (word) WHERE nth <= spare + 1),
ea AS MATERIALIZED (SELECT pv.doc_id, pv.item_id, pv.ws, pv.ip AS pip, pv.p, pv.need - pv.spare AS enough, rk.ip, rk.word, pv.p + rk.ip - pv.ip AS q FROM pv JOIN rk ON rk.item_id = pv.item_id AND rk.ws = pv.ws),
nr AS (SELECT DISTINCT doc_id, item_id FROM (SELECT ea.doc_id, item_id FROM ea JOIN tw ON tw.doc_id = ea.doc_id AND tw.word = ea.word AND abs(tw.p - q) <= 3 GROUP BY ea.doc_id, item_id, ws, pip, ea.p, enough HAVING count(DISTINCT ip) >= enough)),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
OP4 = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5
"""
def component_sql(n: int, percent: int, kept: str = "") -> str:
    return r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(SIZE, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(SIZE, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= PERCENT * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_idKEPT FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
""".replace("SIZE", str(n)).replace("PERCENT", str(percent)).replace("KEPT", kept)


OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, CASE WHEN i = 1 THEN NULL WHEN i = 2 THEN ' ' ELSE w[i - 2] END AS a, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS b, w[i] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT doc_id, c AS x FROM t UNION ALL SELECT doc_id, ' ' FROM d WHERE len(w) > 0),
f1 AS (SELECT x, count(*) AS n FROM u GROUP BY x), o1 AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY ALL),
f2 AS (SELECT b AS x, c AS y, count(*) AS n FROM t GROUP BY ALL), o2 AS (SELECT doc_id, b AS x, c AS y, count(*) AS n FROM t GROUP BY ALL),
f3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY ALL), o3 AS (SELECT doc_id, a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY ALL),
k AS (SELECT t.doc_id, t.a, f1c.n AS c1, f1b.n - o1.n AS l1, f2.n - o2.n AS l2, g2.n - p2.n AS ctx, f3.n - o3.n AS l3
  FROM t JOIN f1 AS f1c ON f1c.x = t.c JOIN f1 AS f1b ON f1b.x = t.b JOIN o1 ON o1.doc_id = t.doc_id AND o1.x = t.b
  JOIN f2 ON f2.x = t.b AND f2.y = t.c JOIN o2 ON o2.doc_id = t.doc_id AND o2.x = t.b AND o2.y = t.c
  LEFT JOIN f2 AS g2 ON g2.x = t.a AND g2.y = t.b LEFT JOIN o2 AS p2 ON p2.doc_id = t.doc_id AND p2.x = t.a AND p2.y = t.b
  LEFT JOIN f3 ON f3.a = t.a AND f3.b = t.b AND f3.c = t.c LEFT JOIN o3 ON o3.doc_id = t.doc_id AND o3.a = t.a AND o3.b = t.b AND o3.c = t.c),
v AS (SELECT doc_id, a, l3, ctx, CASE WHEN l2 > 0 THEN ln(l2 / l1) ELSE ln(0.4::DOUBLE) + ln(c1 / (SELECT count(*) FROM t)) END AS s2 FROM k),
s AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN a IS NULL THEN s2 WHEN l3 > 0 THEN ln(l3 / ctx) ELSE ln(0.4::DOUBLE) + s2 END) AS s FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(coalesce(s, 0.0) / greatest(coalesce(n, 0), 1), 6) AS per_word FROM d LEFT JOIN s USING (doc_id)
"""
OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM t WHERE p + 12 <= len(w)),
f AS (SELECT k.doc_id, p FROM k JOIN (SELECT k, min(doc_id) AS first FROM k GROUP BY k) USING (k) WHERE first < k.doc_id),
c AS (SELECT t.doc_id, t.p, t.w[t.p] AS word, coalesce(max(CASE WHEN f.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.p = t.p),
g AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
# Bytes as pairs of hexadecimal digits, so that offsets are those of bytes.
OP9 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM d)),
r AS MATERIALIZED (SELECT doc_id, p FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e) GROUP BY doc_id, run),
k AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) AS b FROM (SELECT g.doc_id, a, b, n FROM g JOIN d USING (doc_id) UNION ALL SELECT doc_id, -1, 0, n FROM d)),
t AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) WHERE b > a GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op12_sql() -> str:
    q = productcodes
    near = "SELECT v.vec_id, v.label, v.part, v.x, c.entry, d FROM (SELECT v.vec_id, v.part, min({'d': d, 'entry': entry}) AS best FROM (SELECT v.vec_id, v.part, c.entry, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)]) AS BIGINT) AS d FROM p v JOIN c{r} c USING (part)) v GROUP BY ALL) b, p v, LATERAL (SELECT best.entry AS entry, best.d AS d) c WHERE v.vec_id = b.vec_id AND v.part = b.part"
    parts = []
    for r in range(q.ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.replace('{r}', str(r))})")
        if r < q.ROUNDS:
            parts.append(f"m{r} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, (SELECT w FROM width) + 1) g(i) GROUP BY ALL) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({q.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(x)) // {q.PARTS} AS w FROM v),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * w + 1:(part + 1) * w] AS x FROM v, width, range({q.PARTS}) g(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {q.ENTRIES})),
{", ".join(parts)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{q.ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{q.ROUNDS}) AS codebooks_sha256 FROM e
"""


def op13_sql() -> str:
    parts, rows = [], []
    for f in funnels.FUNNELS:
        name = f.name.lower()
        parts.append(f"{name}1 AS (SELECT client_id, t AS first, t AS last FROM e WHERE kind = '{f.steps[0]}')")
        rows.append(f"SELECT '{f.name}' AS funnel, client_id, 1 AS step, 0 AS gap FROM {name}1")
        out = ", ".join(f"'{k}'" for k in f.excluded)
        for k, step in enumerate(f.steps[1:], 2):
            parts.append(
                f"{name}{k} AS MATERIALIZED (SELECT p.client_id, p.first, p.last AS before, p.t AS last FROM (SELECT p.client_id, p.first, p.last, min(n.t) AS t FROM {name}{k - 1} p JOIN e n ON n.client_id = p.client_id AND n.kind = '{step}' AND n.t > p.last AND n.t <= p.first + {funnels.WITHIN} GROUP BY ALL) p"
                f" WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.client_id = p.client_id AND x.kind IN ({out}) AND x.t > p.last AND x.t <= p.t))"
            )
            rows.append(f"SELECT '{f.name}', client_id, {k}, last - before FROM {name}{k}")
    return f"""
WITH e AS MATERIALIZED (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
{", ".join(parts)},
s AS ({" UNION ALL ".join(rows)}),
r AS (SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY gap) AS nth, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM s),
c AS (SELECT funnel, client_id, {", ".join(f"count(*) FILTER (step = {k}) AS n{k}" for k in range(1, 5))}, CAST(max(step) AS INTEGER) AS deepest, {", ".join(f"max(gap) FILTER (step = {k} AND nth = ({funnels.PERCENT} * n + 99) // 100) AS t{k}" for k in range(2, 5))} FROM r GROUP BY funnel, client_id)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM c
"""


ORACLE: dict[str, str] = {"op3_decontamination": OP3, "op4_topk_search": OP4, "op5_ngram_jaccard": component_sql(5, 80), "op6_lm_scores": OP6, "op7_substring_dedup": OP7, "op9_suffix_dedup": OP9, "op11_minhash_groups": component_sql(3, 85, ", d.doc_id = c.component_id AS kept"), "op12_vector_codes": op12_sql(), "op13_ordered_funnels": op13_sql()}
