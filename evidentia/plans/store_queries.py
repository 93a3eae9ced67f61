"""Queries over the store: traversals, counts, audits, graph, ingest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.vectors import norm, problem
from evidentia.functions.words import SPACE
from evidentia.operators import audit, graph, ingest, synthesis
from evidentia.plans import model
from evidentia.plans.model import sql
from evidentia.plans.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


@query("SELECT l.id, l.source_id, l.idea_id, s.type AS kind, s.title, i.trust_score FROM leaf l JOIN src s ON s.id = l.source_id JOIN idea i ON i.id = l.idea_id")
def leaf_traversal(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaf_traversal(model.sources(spark, d), model.leaves(spark, d), model.ideas(spark, d)).select("id", "source_id", "idea_id", "kind", "title", "trust_score")


@query("SELECT i.id, count(l.id) AS n_leaves, coalesce(string_agg(l.id, ',' ORDER BY l.id), '') AS leaves FROM idea i LEFT JOIN (SELECT DISTINCT id, idea_id FROM leaf) l ON l.idea_id = i.id GROUP BY i.id")
def ideas_with_leaves(spark: SparkSession, d: str) -> DataFrame:
    return graph.ideas_with_leaves(model.ideas(spark, d), model.leaves(spark, d, "id", "idea_id")).withColumn("leaves", F.array_join("leaves", ","))


@query("""WITH f AS (SELECT id, source_id, idea_id, text FROM leaf WHERE idea_id = (SELECT min(idea_id) FROM thesis_out WHERE idea_id LIKE 'idea%'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 20 OFFSET 0""")
def leaf_page(spark: SparkSession, d: str) -> DataFrame:
    rows = model.leaves(spark, d, "id", "source_id", "idea_id", "text")
    wanted = table(spark, d, "thesis_out").where(F.col("idea_id").startswith("idea")).agg(F.min("idea_id")).first()[0]
    return graph.leaf_page(rows, wanted, None, 0, 20)


@query("""SELECT id, source_id, idea_id FROM leaf WHERE source_id = (SELECT min(source_id) FROM thesis_out) AND idea_id = (SELECT min(idea_id) FROM thesis_out WHERE source_id = (SELECT min(source_id) FROM thesis_out))""")
def leaves_of_both(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of one source and one idea of it."""
    rows = table(spark, d, "thesis_out")
    source = rows.agg(F.min("source_id")).first()[0]
    idea = rows.where(F.col("source_id") == source).agg(F.min("idea_id")).first()[0]
    return graph.leaves_of(model.leaves(spark, d, "id", "source_id", "idea_id", "text", "created_at", "run_success"), idea, source).select("id", "source_id", "idea_id")


@query("SELECT id, url, title FROM src ORDER BY TRY_CAST(nullif(trim(retrieved_at), '') AS TIMESTAMPTZ) NULLS LAST, id LIMIT 50 OFFSET 25")
def page_sources(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.functions.times import instant

    return model.sources(spark, d).orderBy(F.asc_nulls_last(instant(F.col("retrieved_at"))), "id").offset(25).limit(50).select("id", "url", "title")


@query("SELECT 'sources' AS what, count(*) AS n FROM src UNION ALL SELECT 'ideas', count(*) FROM idea UNION ALL SELECT 'theses', count(*) FROM leaf l JOIN src s ON s.id = l.source_id JOIN idea i ON i.id = l.idea_id UNION ALL SELECT 'edges', count(*) FROM edge")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    s, i, l = model.sources(spark, d), model.ideas(spark, d), model.leaves(spark, d)
    return audit.counts(sources=s, ideas=i, theses=graph.leaf_traversal(s, l, i), edges=graph.both_directions(graph.cocitation(l)))


@query("SELECT DISTINCT id FROM idea WHERE id NOT IN (SELECT l.idea_id FROM leaf l JOIN src s ON s.id = l.source_id WHERE l.idea_id IS NOT NULL)")
def orphan_ideas(spark: SparkSession, d: str) -> DataFrame:
    return audit.ideas_without_leaves(model.ideas(spark, d), model.leaves(spark, d), model.sources(spark, d))


@query("SELECT DISTINCT id FROM leaf ANTI JOIN idx_thesis x ON x.thesis_id = leaf.id")
def index_missing(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_missing(model.leaves(spark, d), model.index(spark, d))


@query("SELECT DISTINCT l.id, l.idea_id, x.idea_id AS indexed_idea FROM leaf l JOIN idx_thesis x ON x.thesis_id = l.id WHERE l.idea_id IS DISTINCT FROM x.idea_id")
def stale_links(spark: SparkSession, d: str) -> DataFrame:
    return audit.stale_links(model.leaves(spark, d), model.index(spark, d))


@query("SELECT id, CASE WHEN b IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT id, 1 AS a FROM leaf) FULL JOIN (SELECT DISTINCT thesis_id AS id, 1 AS b FROM idx_thesis) USING (id) WHERE a IS NULL OR b IS NULL")
def leaf_symdiff(spark: SparkSession, d: str) -> DataFrame:
    return audit.symmetric_difference(model.leaves(spark, d), model.index(spark, d).select(F.col("thesis_id").alias("id")), "id")


@query("""SELECT leaves, indexed, missing, extra, stale, missing + extra + stale = 0 AS in_sync FROM
 (SELECT count(DISTINCT id) AS leaves FROM leaf), (SELECT count(DISTINCT thesis_id) AS indexed FROM idx_thesis),
 (SELECT count(DISTINCT id) AS missing FROM leaf WHERE id NOT IN (SELECT thesis_id FROM idx_thesis)),
 (SELECT count(DISTINCT thesis_id) AS extra FROM idx_thesis WHERE thesis_id NOT IN (SELECT id FROM leaf)),
 (SELECT count(DISTINCT l.id) AS stale FROM leaf l JOIN idx_thesis x ON x.thesis_id = l.id WHERE l.idea_id IS DISTINCT FROM x.idea_id)""")
def health_sync(spark: SparkSession, d: str) -> DataFrame:
    return audit.health(model.leaves(spark, d), model.index(spark, d))


@query("SELECT idea_id, count(DISTINCT id) AS n FROM leaf WHERE idea_id IS NOT NULL GROUP BY 1")
def leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.leaf_counts(table(spark, d, "thesis_out"))


@query("SELECT idea_id, count(DISTINCT id) AS n FROM leaf WHERE idea_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 16")
def over_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return audit.over_ceiling(table(spark, d, "thesis_out"))


@query("SELECT i.id, n, n - rederived_at_leaf_count AS since FROM idea i JOIN (SELECT idea_id, count(DISTINCT id) AS n FROM leaf GROUP BY 1) l ON l.idea_id = i.id WHERE dirty AND n - rederived_at_leaf_count >= 3")
def rederive_due(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rederive_due(model.ideas(spark, d), model.leaves(spark, d, "id", "idea_id"))


@query("SELECT count(*) AS ideas, CAST(sum(CAST(s >= 2 AS INT)) AS BIGINT) AS multi, round(avg(CAST(s >= 2 AS INT)), 3) AS share FROM (SELECT idea_id, count(DISTINCT source_id) AS s FROM leaf WHERE idea_id IS NOT NULL GROUP BY 1)")
def multi_source_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.multi_source_share(table(spark, d, "thesis_out"))


@query("SELECT coalesce(least(8, CAST(round_even(trust_score * 10, 0) AS INT)), -1) AS bucket, count(*) AS n FROM idea GROUP BY 1")
def trust_hist(spark: SparkSession, d: str) -> DataFrame:
    return audit.trust_histogram(model.ideas(spark, d))


@query("SELECT * FROM cocited")
def cocitation(spark: SparkSession, d: str) -> DataFrame:
    return graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id"))


@query("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight FROM edge GROUP BY 1, 2")
def undirected_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(_edges(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id")))


def _start(spark: SparkSession, d: str) -> DataFrame:
    """The idea that is asked for: the least one that shares a source with another."""
    return _edges(spark, d).agg(F.min("source_id").alias("id"))


@query("SELECT source_id, target_id, weight, 1 AS hop FROM edge WHERE source_id = (SELECT min(source_id) FROM edge)")
def neighbors_1(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _start(spark, d), 1)


@query("""WITH s AS (SELECT min(source_id) AS id FROM edge), h1 AS (SELECT e.*, 1 AS hop FROM edge e JOIN s ON e.source_id = s.id),
f AS (SELECT DISTINCT target_id AS id FROM h1 WHERE target_id NOT IN (SELECT id FROM s))
SELECT source_id, target_id, weight, hop FROM h1 UNION ALL SELECT e.source_id, e.target_id, e.weight, 2 FROM edge e JOIN f ON e.source_id = f.id""")
def neighbors_2(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _start(spark, d), 2)


@query("SELECT source_id, target_id, weight FROM edge WHERE weight >= 2")
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where(F.col("weight") >= 2)


@query("""WITH p AS (SELECT DISTINCT id, unnest(string_split(regexp_extract(url, '^synthesis/([^/]+)', 1), '+')) AS parent FROM sources WHERE url LIKE 'synthesis/%')
SELECT id, parent FROM p WHERE parent <> ''""")
def parse_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parse_parents(table(spark, d, "sources")).select("id", "parent").distinct()


@query("""WITH p AS (SELECT DISTINCT id, unnest(string_split(regexp_extract(url, '^synthesis/([^/]+)', 1), '+')) AS parent FROM sources WHERE url LIKE 'synthesis/%')
SELECT id AS source_id, parent AS target_id, 1.0::DOUBLE AS weight, parent NOT IN (SELECT id FROM ideas) AS missing FROM p WHERE parent <> ''""")
def derived_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.derived_from(graph.parse_parents(table(spark, d, "sources")), model.ideas(spark, d))


@query("""SELECT row_id, CASE WHEN vec IS NULL THEN 'missing' WHEN len(vec) <> 384 THEN 'dimension' ELSE 'norm' END AS problem,
 CASE WHEN vec IS NOT NULL THEN round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) END AS norm FROM idx_thesis
 WHERE vec IS NULL OR len(vec) <> 384 OR abs(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) - 1.0) > 1e-3""")
def vector_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = model.index(spark, d).select("row_id", problem(F.col("vec"), 384).alias("problem"), F.round(norm(F.col("vec")), 6).alias("norm"))
    return rows.where(F.col("problem").isNotNull())


@query("""WITH x AS (SELECT id, source_id, idea_id, created_at, run_success IS NULL AS unmeasured FROM (SELECT DISTINCT id, source_id, idea_id, created_at, run_success FROM leaf WHERE idea_id IS NOT NULL))
SELECT idea_id, id, row_number() OVER (PARTITION BY idea_id ORDER BY unmeasured, coalesce(created_at, ''), id) AS place FROM x QUALIFY place <= 16""")
def judge_leaves(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judge_leaves(table(spark, d, "thesis_out")).withColumn("place", F.col("place").cast("long"))


@query(f"""SELECT id, source_id, md5(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) AS hash FROM leaf WHERE text IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source_id, md5(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) ORDER BY id) = 1""")
def dedup_leaf(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedup_leaves(model.leaves(spark, d, "id", "source_id", "text"), "id").select("id", "source_id", "hash")


@query("""WITH n AS (SELECT batch_no, line_no, row_number() OVER (PARTITION BY batch_no ORDER BY line_no) AS n FROM (SELECT DISTINCT batch_no, line_no FROM thesis_batches WHERE text IS NOT NULL AND text <> ''))
SELECT batch_no, CAST(coalesce(max(CASE WHEN line_no = n THEN line_no END), 0) AS BIGINT) AS cursor FROM n GROUP BY 1""")
def contiguous_cursor(spark: SparkSession, d: str) -> DataFrame:
    return ingest.contiguous_prefix(table(spark, d, "thesis_batches").where(F.col("text") != ""), "batch_no", "line_no")


@query("""WITH n AS (SELECT batch_no, line_no, row_number() OVER (PARTITION BY batch_no ORDER BY line_no) AS n FROM (SELECT DISTINCT batch_no, line_no FROM thesis_batches WHERE text IS NOT NULL AND text <> '')),
c AS (SELECT batch_no, coalesce(max(CASE WHEN line_no = n THEN line_no END), 0) AS cursor FROM n GROUP BY 1)
SELECT batch_no, count(*) AS lines, CAST(sum(CAST(line_no <= coalesce(cursor, 0) AS INT)) AS BIGINT) AS ingested FROM thesis_batches LEFT JOIN c USING (batch_no) GROUP BY 1""")
def staging_state(spark: SparkSession, d: str) -> DataFrame:
    return ingest.staging_state(table(spark, d, "thesis_batches"), contiguous_cursor(spark, d), "batch_no", "line_no")


@query("""WITH a AS (SELECT id, idea_id, source_id, row_number() OVER (PARTITION BY source_id, idea_id ORDER BY id) AS in_section FROM (SELECT DISTINCT id, source_id, idea_id FROM leaf WHERE source_id IS NOT NULL)),
b AS (SELECT *, CAST(sum(CAST(in_section <= 6 AS INT)) OVER (PARTITION BY source_id ORDER BY idea_id NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_doc FROM a)
SELECT id, source_id, idea_id, in_section, in_doc, in_section <= 6 AND in_doc <= 30 AS kept FROM b""")
def doc_ceiling(spark: SparkSession, d: str) -> DataFrame:
    rows = model.leaves(spark, d, "id", "source_id", "idea_id").where(F.col("source_id").isNotNull())
    out = ingest.ceilings(rows, "source_id", "idea_id", "id")
    return out.select("id", "source_id", "idea_id", F.col("in_section").cast("long").alias("in_section"), F.col("in_doc").cast("long").alias("in_doc"), "kept")


@query("""SELECT leaf_id, 'twice' AS problem FROM (SELECT thesis_id AS leaf_id FROM idx_thesis) GROUP BY 1 HAVING count(*) > 1
 UNION ALL SELECT DISTINCT thesis_id, 'stolen' FROM idx_thesis WHERE thesis_id NOT IN (SELECT id FROM leaf)""")
def split_guard(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_guard(model.index(spark, d).select(F.col("thesis_id").alias("leaf_id")), model.leaves(spark, d, "id").withColumnRenamed("id", "leaf_id"))


@query("""WITH n AS (SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS n FROM (SELECT DISTINCT id FROM idea WHERE origin IS DISTINCT FROM 'synthesized'))
SELECT n // 2 AS pair_no, min_by(id, n) AS a, max_by(id, n) AS b FROM n WHERE n < 100 GROUP BY 1 HAVING count(*) = 2""")
def idea_pairs(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.random_pairs(synthesis.parent_pool(model.ideas(spark, d)), "id", 50, 7)


@query("SELECT id, origin, trust_score FROM idea WHERE origin IS DISTINCT FROM 'synthesized' AND coalesce(trust_score, 0) >= 0.5")
def parent_pool(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.parent_pool(model.ideas(spark, d), 0.5).select("id", "origin", "trust_score")


@query("SELECT id, text, created_at FROM idea WHERE dirty ORDER BY created_at NULLS FIRST, id LIMIT 50")
def dirty_ideas(spark: SparkSession, d: str) -> DataFrame:
    return model.ideas(spark, d).where("dirty").orderBy("created_at", "id").limit(50).select("id", "text", "created_at")


@query()
def split_ideas(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.split import split_ideas as run

    rows = model.unit_vectors(spark, d).where(F.col("idea_id").isNotNull())
    return run(rows, "idea_id", "row_id", "vec")


@query("SELECT idea_id AS id, source_id, CAST(sum(n) OVER (PARTITION BY idea_id) AS BIGINT) AS leaves, n FROM (SELECT idea_id, source_id, count(*) AS n FROM leaf WHERE idea_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2)")
def leaves_by_source(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = model.leaves(spark, d).where(F.col("idea_id").isNotNull() & F.col("source_id").isNotNull()).groupBy(F.col("idea_id").alias("id"), "source_id").agg(F.count("*").alias("n"))
    return per.withColumn("leaves", F.sum("n").over(W.partitionBy("id")))


