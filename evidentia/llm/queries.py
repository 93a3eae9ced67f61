"""Queries of the training-data operators, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import batches, cooccur, dressed, leaks, neighbours, spans, tokenise


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.neighbours(_table(spark, d, "idx_thesis")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All history is stored once; then each batch is held against the table, and its new lines join it."""
    table = batches.PivotTable(spark)
    lines = _table(spark, d, "thesis_batches")
    table.append(_table(spark, d, "thesis_out"))
    numbers = sorted((r.batch_no for r in lines.select("batch_no").distinct().collect()), key=lambda n: (n is not None, n or 0))
    found = [batches.admit(table, lines.where(F.col("batch_no").eqNullSafe(F.lit(n)))) for n in numbers]
    return reduce(DataFrame.unionByName, found) if found else lines.select("id").where("false")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return dressed.copies(_table(spark, d, "thesis_out"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dressed.collapsed(_table(spark, d, "thesis_out"))


def _surprise(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.surprise(_table(spark, d, "thesis_out"), "source_id", "idea_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _surprise(spark, d).select(F.col("item_a").alias("idea_a"), F.col("item_b").alias("idea_b"))


def p5_surprise(spark: SparkSession, d: str) -> DataFrame:
    return _surprise(spark, d).withColumnRenamed("item_a", "idea_a").withColumnRenamed("item_b", "idea_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The countable columns of the surprise."""
    return p5_surprise(spark, d).select("idea_a", "idea_b", "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_column(_table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_by_join(spark: SparkSession, d: str) -> DataFrame:
    """The same leaks by the route of large test collections, which are joined instead of broadcast."""
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), item_bytes=0)


def p7_half(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item, in runs of five words."""
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), n=5, containment=0.5)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Two batches are appended to the index, and compacted, before it is searched."""
    docs = _table(spark, d, "documents")
    index = spans.SpanIndex(spark)
    index.append(docs.where("doc_id % 2 = 0"))
    index.append(docs.where("doc_id % 2 <> 0"))
    index.compact()
    found = index.shared_spans(docs)
    index.drop()
    return found


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "from_word", "to_word")


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_words(_spans(spark, d), _table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_collapsed, p5_found, p5_pairs, p5_surprise, p6_ids, p7_by_join, p7_found, p7_half, p7_leaks, p8_found, p8_share)}

_FIELDS = r"""
WITH leaf AS (
  SELECT id, list_sort(list_filter(list_transform(regexp_split_to_array(text, '[;|]'), lambda f: lower(regexp_replace(f, '[^\p{L}\p{N}]', '', 'g'))), lambda g: g <> '')) AS f
  FROM thesis_out WHERE id IS NOT NULL AND text IS NOT NULL),
one AS (SELECT DISTINCT id, f FROM leaf WHERE len(f) > 0),
grouped AS (SELECT id, min(id) OVER (PARTITION BY f) AS id_kept FROM one)
"""

_PAIRS = """
WITH inc AS (SELECT DISTINCT source_id AS s, idea_id AS i FROM thesis_out WHERE source_id IS NOT NULL AND idea_id IS NOT NULL),
often AS (SELECT i, count(*) AS k FROM inc GROUP BY i),
total AS (SELECT count(DISTINCT s) AS n FROM inc),
pairs AS (SELECT a.i AS idea_a, b.i AS idea_b, count(*) AS n_ab FROM inc a JOIN inc b ON a.s = b.s AND a.i < b.i GROUP BY 1, 2)
SELECT {columns} FROM pairs JOIN often x ON x.i = idea_a JOIN often y ON y.i = idea_b, total
WHERE n_ab >= 4 AND n_ab * n >= 3 * x.k * y.k
"""

_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
s AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
"""

_HALF = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS size FROM s GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, size HAVING count(*) >= 0.5 * size
"""

_SPANS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, k AS pos, md5(array_to_string(w[k + 1:k + 40], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 39)) AS k FROM d WHERE len(w) >= 40)),
sh AS (SELECT g FROM win GROUP BY g HAVING min(doc_id) <> max(doc_id)),
st AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 40 THEN 1 ELSE 0 END AS gap FROM win SEMI JOIN sh USING (g)),
isl AS (SELECT doc_id, pos, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM st),
spans AS (SELECT doc_id, min(pos) AS from_word, max(pos) + 39 AS to_word FROM isl GROUP BY doc_id, island)
"""

ORACLE = {
    "p4_found": _FIELDS + "SELECT DISTINCT id_kept, id AS id_copy FROM grouped WHERE id <> id_kept",
    "p4_collapsed": _FIELDS + "SELECT id_kept, count(DISTINCT id) AS copies FROM grouped GROUP BY id_kept",
    "p5_found": _PAIRS.format(columns="idea_a, idea_b"),
    "p5_pairs": _PAIRS.format(columns="idea_a, idea_b, x.k AS n_a, y.k AS n_b, n_ab, n, round(n_ab * n / (x.k * y.k), 6) AS lift"),
    "p7_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM ds JOIN s USING (g)",
    "p7_leaks": _LEAKS + "SELECT doc_id, item_id, count(DISTINCT g) AS shared FROM ds JOIN s USING (g) GROUP BY 1, 2",
    "p7_by_join": _LEAKS + "SELECT doc_id, item_id, count(DISTINCT g) AS shared FROM ds JOIN s USING (g) GROUP BY 1, 2",
    "p7_half": _HALF,
    "p8_found": _SPANS + "SELECT doc_id, from_word, to_word FROM spans",
    "p8_share": _SPANS
    + """, sums AS (SELECT doc_id, sum(to_word - from_word + 1) AS s FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(s, 0) AS BIGINT) AS shared_words,
  round(CASE WHEN coalesce(len(w), 0) > 0 THEN coalesce(s, 0) / len(w) ELSE 0 END, 6) AS share
FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id) LEFT JOIN sums USING (doc_id)""",
}
