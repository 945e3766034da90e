"""Queries over documents and embeddings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import micro, tokens
from linkloom.operators import retrieval, terms
from linkloom.sources.scratch import keep
from linkloom.sources.tables import articles, read


def _top(weighed: DataFrame) -> DataFrame:
    return weighed.where(F.col("rank") <= terms.TOP).select("doc_id", "lang", "term", "weight", (F.col("rank") - 1).alias("pos"))


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All weights of the articles whose id is divisible by 20, and the heaviest terms of all."""
    needed = keep(terms.weighed(articles(spark, d), (20, 0)))
    return needed.where("doc_id % 20 = 0").drop("rank"), _top(needed)


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequency(articles(spark, d)).select("doc_id", "lang", "term", "tf")


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.document_frequency(terms.term_frequency(articles(spark, d)))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return terms.corpus_stats(articles(spark, d)).select("lang", "n_docs", micro(F.col("avg_len")).alias("avg_len"))


def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    return terms.weighed(articles(spark, d)).select("doc_id", "term", "weight")


def topk_terms(spark: SparkSession, d: str) -> DataFrame:
    return _top(terms.weighed(articles(spark, d), (1, 1))).select("doc_id", "term", "pos")


def ngram_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.ngram_terms(articles(spark, d))


def field_bitmask(spark: SparkSession, d: str) -> DataFrame:
    return terms.field_bitmask(articles(spark, d))


def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every article whose id is divisible by 20, among all."""
    weighted, stored = _stored(spark, d)
    return retrieval.similar(weighted.where("doc_id % 20 = 0"), stored, 5)


def containing_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents that weigh most by the terms of each item, by all terms that they hold."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(tokens(F.col("text"))).alias("term"))
    return retrieval.containing(asked, terms.weighed(articles(spark, d)), 10).withColumnRenamed("query", "item_id")


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a tenth of an article's similarity to itself, or more."""
    _, stored = _stored(spark, d)
    asked = stored.where("doc_id % 20 = 0")
    pairs = retrieval.scores(asked, stored, least=F.expr("(sum(weight * weight) + 9) div 10"))
    return pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score")


def incoming_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold one of a target's first three terms, by their weights of these, filled up with similar ones to 100."""
    _, stored = _stored(spark, d)
    asked = stored.where("doc_id % 20 = 0")
    named = lambda near: near.select(F.col("src").alias("target"), F.col("dst").alias("origin"), "score")
    holds = keep(named(retrieval.similar(asked.where("pos < 3").withColumn("weight", F.lit(1)), stored, 100)))
    return retrieval.fill_up(holds, named(retrieval.similar(asked, stored, 100)), 100)


def incremental_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    tf = terms.term_frequency(articles(spark, d))
    old, new = (terms.document_frequency(tf.where(f"doc_id % 10 {op} 0"), 1) for op in ("<>", "="))
    return terms.merge_frequency(old, new).where(F.col("df") >= terms.MIN_DF)


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vector"))
    return retrieval.nearest(v, v.where("id % 20 = 0"), 10)


def rescaled_blend(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_vectors(spark, d)
    mixed = retrieval.blend(1.0 / F.col("rank"), retrieval.rescale(near, "src", "cosine"))
    return near.select("src", "dst", micro(mixed).alias("relevance"))


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of title and text, joined by a unit separator."""
    return articles(spark, d).select("doc_id", F.sha1(F.concat_ws("\x1f", "title", "text")).alias("hash"))


def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    """Cells that a spreadsheet would run as formulas are led by a quote."""
    return articles(spark, d).select("doc_id", F.when(F.substring("title", 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), "title")).otherwise(F.col("title")).alias("cell"))


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of a conversation: characters of user turns by 4, of others by 3.6, each turn rounded up."""
    turns = read(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(F.sum(F.ceil(F.length(F.coalesce("text", F.lit(""))) * 10 / F.when(F.col("role") == "user", 40).otherwise(36))).cast("long").alias("tokens"))


_TOK = r"'[\p{L}\p{N}\p{M}]+(?:[''’-][\p{L}\p{N}\p{M}]+)*'"
_TF = f"""t AS (SELECT doc_id, lang, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), {_TOK}) AS w FROM documents)),
tf AS (SELECT doc_id, lang, term, count(*) AS tf, min(place) AS first FROM t GROUP BY ALL)"""
_W = f"""{_TF},
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2),
st AS (SELECT lang, count(*) AS n, avg(len(regexp_extract_all(lower(text), {_TOK}))) AS a FROM documents GROUP BY lang),
ln AS (SELECT doc_id, sum(tf) AS l FROM tf GROUP BY doc_id),
w AS (SELECT doc_id, lang, term, CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (l / a)))) * 1e6 + 0.5) AS BIGINT) AS weight, first
  FROM tf JOIN df USING (lang, term) JOIN ln USING (doc_id) JOIN st USING (lang)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) - 1 AS pos FROM w QUALIFY pos < 40)"""
_COS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT a.vec_id AS src, b.vec_id AS dst, CAST(floor(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) * 1e6 + 0.5) AS BIGINT) AS cosine
  FROM v a JOIN v b USING (label) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS rank, cosine FROM near QUALIFY rank <= 10)"""

QUERIES = {f.__name__: f for f in (term_frequency, document_frequency, corpus_stats, bm25_weights, topk_terms, ngram_terms, field_bitmask, similar_documents, containing_terms, pair_similarity, incoming_candidates, incremental_equals_batch, nearest_vectors, rescaled_blend, content_fingerprint, csv_guard, token_cost)}
SQL = {
    "term_frequency": f"WITH {_TF} SELECT doc_id, lang, term, tf FROM tf",
    "document_frequency": f"WITH {_TF} SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2",
    "incremental_equals_batch": f"WITH {_TF} SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2",
    "corpus_stats": f"SELECT lang, count(*) AS n_docs, CAST(floor(avg(len(regexp_extract_all(lower(text), {_TOK}))) * 1e6 + 0.5) AS BIGINT) AS avg_len FROM documents GROUP BY lang",
    "bm25_weights": f"WITH {_W} SELECT doc_id, term, weight FROM w",
    "topk_terms": f"WITH {_W} SELECT doc_id, term, CAST(pos AS INTEGER) AS pos FROM top",
    "ngram_terms": f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}''’ -]+')) AS s FROM documents),
      r AS (SELECT doc_id, regexp_extract_all(s, {_TOK}) AS w FROM s),
      g AS (SELECT doc_id, w, unnest([1, 2, 3]) AS n FROM r),
      x AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM g WHERE len(w) >= n)
      SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS term, CAST(n AS INTEGER) AS n, count(*) AS tf FROM x GROUP BY ALL""",
    "field_bitmask": f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(string_split(text, chr(10))[1]), {_TOK})) AS term, 1 AS b FROM documents
      UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(text), {_TOK})), 4 FROM documents) SELECT doc_id, term, CAST(bit_or(b) AS INTEGER) AS field FROM p GROUP BY ALL""",
    "similar_documents": f"""WITH {_W}, s AS (SELECT a.doc_id AS src, b.doc_id AS dst, CAST(sum(a.weight * b.weight) AS BIGINT) AS score FROM w a JOIN top b USING (lang, term) WHERE a.doc_id <> b.doc_id AND a.doc_id % 20 = 0 GROUP BY ALL)
      SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 5""",
    "containing_terms": f"""WITH {_W}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM benchmark),
      s AS (SELECT item_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (term) GROUP BY ALL)
      SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 10""",
    "pair_similarity": f"""WITH {_W}, o AS (SELECT doc_id AS src, sum(weight * weight) AS own FROM top GROUP BY doc_id), s AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(sum(a.weight * b.weight) AS BIGINT) AS score FROM top a JOIN top b USING (lang, term) WHERE a.doc_id <> b.doc_id AND a.doc_id % 20 = 0 GROUP BY ALL)
      SELECT a, b, score FROM s JOIN o ON src = a WHERE 10 * score >= own""",
    "incoming_candidates": f"""WITH {_W}, h AS (SELECT a.doc_id AS target, b.doc_id AS origin, sum(b.weight) AS score FROM top a JOIN top b USING (lang, term) WHERE a.doc_id <> b.doc_id AND a.doc_id % 20 = 0 AND a.pos < 3 GROUP BY ALL),
      l AS (SELECT a.doc_id AS target, b.doc_id AS origin, sum(a.weight * b.weight) AS score FROM top a JOIN top b USING (lang, term) WHERE a.doc_id <> b.doc_id AND a.doc_id % 20 = 0 GROUP BY a.doc_id, b.doc_id
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, origin) <= 100),
      u AS (SELECT target, origin, 0 AS branch, score FROM h UNION ALL SELECT target, origin, 1, score FROM l ANTI JOIN h USING (target, origin))
      SELECT target, origin, CAST(branch AS INTEGER) AS branch, CAST(row_number() OVER (PARTITION BY target ORDER BY branch, score DESC, origin) AS INTEGER) AS rank FROM u QUALIFY rank <= 100""",
    "nearest_vectors": f"WITH {_COS} SELECT src, dst, CAST(rank AS INTEGER) AS rank, cosine FROM best",
    "rescaled_blend": f"""WITH {_COS}, m AS (SELECT *, min(cosine) OVER (PARTITION BY src) AS lo, max(cosine) OVER (PARTITION BY src) AS hi FROM best)
      SELECT src, dst, CAST(floor((0.5 * (1.0 / CAST(rank AS DOUBLE)) + 0.5 * CASE WHEN hi = lo THEN 1.0 ELSE CAST(cosine - lo AS DOUBLE) / (hi - lo) END) * 1e6 + 0.5) AS BIGINT) AS relevance FROM m""",
    "content_fingerprint": "SELECT doc_id, sha1(string_split(text, chr(10))[1] || chr(31) || text) AS hash FROM documents",
    "csv_guard": "SELECT doc_id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, string_split(text, chr(10))[1] AS c FROM documents)",
    "token_cost": "SELECT conv_id, CAST(sum(ceil(length(text) * 10 / CASE WHEN role = 'user' THEN 40 ELSE 36 END)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
}
