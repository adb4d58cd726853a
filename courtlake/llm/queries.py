"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import new_path
    from .warc import archive_pages

    index = archive_pages(_read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(_read(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeats

    return repeats(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 24)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, pii_digest

    return pii_digest(find_pii(_read(spark, sf_dir, "documents")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_texts

    return near_texts(_read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify

    docs = _read(spark, sf_dir, "documents")
    judged = identify(docs, docs.where(~held_out("doc_id")))
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(_read(spark, sf_dir, "embeddings"))[0]


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_embeddings, op2_warc, op3_mixing, op4_suffixes, op5_tokens, op6_sharding, op7_decontamination, op8_pii, op9_jaccard, op10_language, op11_packing, op12_codes, op13_negatives, pipeline)}


_WALK = """, pairs AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, c) AS (SELECT id, id FROM node UNION SELECT pairs.b, reach.c FROM reach JOIN pairs ON pairs.a = reach.id WHERE reach.c < pairs.b),
part AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)
"""
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.id < b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
node AS (SELECT id FROM v)""" + _WALK + """
SELECT part.id AS vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = part.id) AS n_links, c AS component_id, part.id = c AS kept FROM part
"""
OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS g FROM (SELECT doc_id, b, unnest(generate_series(1, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY 1),
h AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (g) WHERE m < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
r AS (SELECT doc_id, min(i) AS s, max(i) + 49 AS e FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM r UNION ALL SELECT doc_id, 1000000000, max(e) + 1, 1000000000 FROM r GROUP BY 1),
t AS (SELECT p.doc_id, string_agg(CASE WHEN a <= least(z, n) THEN hex(b[a:least(z, n)]) ELSE '' END, '' ORDER BY s) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1),
u AS (SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
si AS (SELECT DISTINCT item_id, least(len(w), 5) AS length, unnest(list_transform(generate_series(1, len(w) - least(len(w), 5) + 1), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
ni AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1),
dw AS (SELECT doc_id, text, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
sd AS (SELECT DISTINCT doc_id, text, unnest(list_transform(generate_series(1, len(w) - length + 1), lambda i: array_to_string(w[i:i + length - 1], ' '))) AS g FROM dw, (SELECT DISTINCT length FROM si) WHERE len(w) >= length),
c AS (SELECT doc_id, text, item_id, count(*) / max(n) AS containment FROM sd JOIN si USING (g) JOIN ni USING (item_id) GROUP BY 1, 2, 3 HAVING count(*) / max(n) >= 0.8)
SELECT doc_id, count(*) AS n_items, list(item_id ORDER BY item_id) AS items, max(containment) AS containment FROM c GROUP BY doc_id, text
"""
OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
node AS (SELECT doc_id AS id FROM documents)""" + _WALK + """
SELECT s.doc_id, len(s) AS n_shingles, c AS component_id FROM s JOIN part ON part.id = s.doc_id
"""


_FINITE = "{0} IS NOT NULL AND len({0}) > 0 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ASSIGN = """, a{i} AS MATERIALIZED (SELECT vec_id, label, q.p, min_by(struct_pack(e := e, v := q.v, d := q.vv - 2 * list_dot_product(q.v, b{i}.v) + list_dot_product(b{i}.v, b{i}.v)), (q.vv - 2 * list_dot_product(q.v, b{i}.v) + list_dot_product(b{i}.v, b{i}.v), e)) AS s
  FROM q JOIN b{i} USING (p) GROUP BY 1, 2, 3)"""
_REPLACE = """, s{i} AS (SELECT p, e, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT p, s.e AS e, unnest(s.v) AS x, generate_subscripts(s.v, 1) AS j FROM a{i}) GROUP BY 1, 2, 3),
b{k} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b{i}.v) AS v FROM b{i} LEFT JOIN (SELECT p, e, list(CAST((t - ((t % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS v FROM s{i} GROUP BY 1, 2) m USING (p, e))"""
OP12_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_FINITE.format("embedding")}),
q AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM (SELECT vec_id, label, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS p))),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM q QUALIFY e < 256)
{"".join(_ASSIGN.format(i=i) + _REPLACE.format(i=i, k=i + 1) for i in range(4))}{_ASSIGN.format(i=4)},
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM b4)),
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', s.e), '' ORDER BY p) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a4 GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c, h
"""


OP13_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE.format("embedding")}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10
"""


def oracle_sql() -> dict:
    return {"op1_embeddings": OP1_SQL, "op2_warc": OP2_SQL, "op4_suffixes": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_jaccard": OP9_SQL, "op12_codes": OP12_SQL, "op13_negatives": OP13_SQL}
