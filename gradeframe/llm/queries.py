"""The registered queries of the operators, over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import (
    bpe, chat_format, importance, language_crf, mixing, near_dup, packing, permutation_index, pitman_yor, quality_gam,
    secret_scan, segment_search, vantage,
)
from gradeframe.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 and 150% of all words by Pareto order sampling."""
    taken = mixing.copies(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op2_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:13])::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS every FROM s),
l AS (
  SELECT *, (every - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN c IS NULL THEN most ELSE least(most, c * weight) END AS target
  FROM l, (SELECT arg_min(level, ratio) AS c FROM l WHERE level <= ratio)),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
q AS (
  SELECT *, floor(rate)::BIGINT AS certain, rate - floor(rate)::BIGINT AS rest,
         target - floor(rate)::BIGINT * source_size AS words_left FROM p),
o AS (
  SELECT d.doc_id, d.size, q.*,
         CASE WHEN rest > 0 THEN draw / (1 - draw) * ((1 - rest) / rest) END AS odds
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (
  SELECT *, coalesce(odds / (1 + odds), 1.0) AS rank FROM o),
g AS (
  SELECT source, rank, sum(size) AS words, any_value(words_left) AS words_left FROM k GROUP BY source, rank),
u AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank) - words / 2 <= words_left AS more FROM g)
SELECT k.doc_id, k.size, k.source_size, k.target,
       (k.size * (k.certain + CASE WHEN k.rest > 0 AND u.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.rank = u.rank
"""


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: rules and character Markov models trained on the corpus."""
    docs = table(spark, folder, "documents")
    found = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.train(secret_scan.labelled_samples(docs)))

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secret_scan.as_text("base"), 256).alias("base_sha256"), secret_scan.as_text("spans").alias("spans"))


@query
def op8_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Every reply as an example with all turns before it, read back from the formatted texts."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_prefixes(rows))


ORACLES["op8_chat_examples"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, length('### : </turn>') + 1 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g'))
              + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS chars,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(prefix) FILTER (role = 'assistant' OR i = turns)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


@query
def op4_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by an additive model with pairwise interactions."""
    docs = table(spark, folder, "documents")
    model = quality_gam.train(docs, table(spark, folder, "labels"))
    return docs.select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"),
        quality_gam.score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op5_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by a linear-chain conditional random field."""
    docs = table(spark, folder, "documents")
    found = language_crf.identify(F.col("text"), language_crf.train(docs))
    return docs.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"),
                       found.alias("found")).select("doc_id", "held_out", "found.*")


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by a public byte-level vocabulary and decoded again."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_minhash_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles at similarity 0.8."""
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=2, percent=80)


@query
def op1_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    """20 nearest found for every 20th vector, by inner product."""
    return permutation_index.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op7_segment_search(spark: SparkSession, folder: str) -> DataFrame:
    """5 largest integer inner products for every 50th vector."""
    return segment_search.search_integers(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op7_segment_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
"""


@query
def op6_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a hierarchical Pitman-Yor model."""
    return pitman_yor.score(table(spark, folder, "documents"), held_out(F.col("doc_id"), 1))


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# DuckDB has no crc32: a table of the 256 bytes' remainders, folded over a word's bytes, once per distinct word.
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE step AS (
  SELECT range AS byte, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
remainders AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
e AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
dw AS (SELECT row, unnest(words) AS word FROM d),
ew AS (SELECT unnest(words) AS word FROM e),
b AS (
  SELECT word, xor(list_reduce(list_transform(range(0, strlen(word)::BIGINT), lambda i:
             ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM ew), remainders),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM ew JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
           / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY row),
v AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN w USING (row)),
z AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
r AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM r
"""


@query
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, dominating sets first, the rest best-fit."""
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    placed = packing.pack(table(spark, folder, "documents"), encode, end=2, capacity=1024)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")


@query
def op13_vantage_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """8 centroids of the 64-component vectors after 10 rounds, in integers."""
    assigned, points = vantage.cluster(table(spark, folder, "embeddings"), k=8, width=64, scale=1024, rounds=10, seed=3)
    return vantage.described(assigned, points).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(rounds: int) -> str:
    """SQL of the rounds, each from the centroids before: nearest ones, then floors of means."""
    nearest = """
a{k} AS MATERIALIZED (
  SELECT row, vec_id, v.e, min(struct_pack(d := list_sum(list_transform(list_zip(v.e, c.e),
           lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.c)) AS best
  FROM v, c{k} c GROUP BY row, vec_id, v.e)"""
    moved = """,
m{k} AS (
  SELECT c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x
  FROM (SELECT best.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{k}) GROUP BY c, i),
c{n} AS MATERIALIZED (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{k} c
  LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM m{k} GROUP BY c) m USING (c)),"""
    return "".join(nearest.format(k=k) + (moved.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))


ORACLES["op13_vantage_clusters"] = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e
  FROM (SELECT *, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, e LIMIT 8),""" + _rounds(10) + """
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
       sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c10.e, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.c = best.c
"""
