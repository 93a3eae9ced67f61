"""Queries of retrieval and ranking. Every index row whose id is divisible by 50 is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.vectors import problem
from evidentia.functions.words import SPACE
from evidentia.operators import graph, pairs, rank, search
from evidentia.plans import model
from evidentia.plans.model import sql
from evidentia.scratch import materialise, release

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_SEARCH = r"""
WITH q AS (SELECT row_id AS query_id, text AS query, vec AS qvec FROM unit WHERE row_id % 50 = 0),
tok AS (SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM idx_thesis WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
tf AS (SELECT row_id, len(t) AS len, term, count(*) AS tf FROM (SELECT row_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM q),
bm AS (SELECT query_id, row_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS bm25
  FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, row_id) AS bm25_rank FROM bm QUALIFY bm25_rank <= 50),
cos AS (SELECT query_id, row_id, round(list_dot_product(vec::DOUBLE[], qvec::DOUBLE[]), 6) AS cosine FROM unit, q),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS vec_rank FROM cos QUALIFY vec_rank <= 50),
fused AS (SELECT query_id, row_id, bm25_rank, vec_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0), 6) AS score
  FROM (SELECT query_id, row_id, bm25_rank FROM lex) FULL JOIN (SELECT query_id, row_id, vec_rank FROM near) USING (query_id, row_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM fused QUALIFY rank <= 50),
lifted AS (SELECT query_id, idea_id, max(score) AS raw_score FROM hits JOIN idx_thesis USING (row_id) WHERE idea_id IS NOT NULL GROUP BY 1, 2),
normed AS (SELECT *, round(CASE WHEN max(raw_score) OVER w = min(raw_score) OVER w THEN 1.0 ELSE (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) END, 6) AS norm FROM lifted WINDOW w AS (PARTITION BY query_id)),
scored AS (SELECT query_id, idea_id, raw_score, norm, coalesce(j.trust, 0) AS trust, norm AS score FROM normed JOIN judged j USING (idea_id)),
walked AS (SELECT *, row_number() OVER d AS position, trust <> 0 OR sum(CAST(trust = 0 AS INT)) OVER (d ROWS UNBOUNDED PRECEDING) <= 1 AS accepted FROM scored WINDOW d AS (PARTITION BY query_id ORDER BY score DESC, idea_id)),
placed AS (SELECT *, CASE WHEN accepted THEN CAST(sum(CAST(accepted AS INT)) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS place FROM walked),
taken AS (SELECT *, coalesce(place <= 5, false) AS took, 5 - sum(CAST(coalesce(place <= 5, false) AS INT)) OVER (PARTITION BY query_id) AS free FROM placed),
target AS (SELECT p.query_id, e.target_id AS idea_id, min(p.position) AS first_at FROM placed p JOIN edge e ON e.source_id = p.idea_id GROUP BY 1, 2),
topup AS (SELECT t.query_id, t.idea_id, j.trust, row_number() OVER (PARTITION BY t.query_id ORDER BY first_at, t.idea_id) AS n
  FROM target t JOIN (SELECT idea_id, coalesce(trust, 0) AS trust FROM judged) j USING (idea_id) WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.query_id = t.query_id AND p.idea_id = t.idea_id)),
edges AS (SELECT u.*, f.free FROM topup u JOIN (SELECT DISTINCT query_id, free FROM taken) f USING (query_id) WHERE u.n <= f.free),
pads AS (SELECT t.*, free - coalesce(m, 0) AS room, sum(CAST(NOT took AS INT)) OVER (PARTITION BY t.query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS pad_no
  FROM taken t LEFT JOIN (SELECT query_id, count(*) AS m FROM edges GROUP BY 1) e USING (query_id)),
answer AS (SELECT query_id, idea_id, score, raw_score, trust, CASE WHEN took THEN 'thesis' WHEN pad_no <= room THEN 'padding' ELSE 'cut_off' END AS via, position FROM pads
  UNION ALL SELECT query_id, idea_id, 0.0, 0.0, trust, 'edge', n FROM edges)
"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(_SEARCH + oracle)
        return f

    return add


def _queries(spark: SparkSession, d: str) -> DataFrame:
    asked = model.index(spark, d).where("row_id % 50 = 0").where(problem(F.col("vec"), 384).isNull())
    return asked.select(F.col("row_id").alias("query_id"), F.col("text").alias("query"), F.col("vec").alias("qvec"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(model.index(spark, d), _queries(spark, d), "row_id", "text")


def _vector(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_topk(model.unit_vectors(spark, d), _queries(spark, d), "row_id", "vec")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(_lexical(spark, d), _vector(spark, d), "row_id")


def _lifted(spark: SparkSession, d: str) -> DataFrame:
    return rank.lift_max(_hits(spark, d).join(model.index(spark, d).select("row_id", "idea_id"), "row_id"))


@query("SELECT query_id, row_id, bm25, bm25_rank FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


@query("SELECT query_id, row_id, cosine, vec_rank FROM near")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d)


@query("SELECT row_id, round(list_dot_product(vec::DOUBLE[], (SELECT vec FROM unit ORDER BY row_id LIMIT 1)::DOUBLE[]), 6) AS cosine FROM unit")
def cosine_all(spark: SparkSession, d: str) -> DataFrame:
    rows = model.unit_vectors(spark, d)
    one = rows.orderBy("row_id").limit(1).select(F.lit(0).alias("query_id"), F.col("vec").alias("qvec"))
    return search.cosine(rows, one, "row_id", "vec").select("row_id", "cosine")


@query("""SELECT query_id, round(quantile_cont(cosine, 0.5), 4) AS median, round(quantile_cont(cosine, 0.9), 4) AS p90, round(quantile_cont(cosine, 0.99), 4) AS p99, round(max(cosine), 4) AS max FROM cos GROUP BY 1""")
def cosine_percentiles(spark: SparkSession, d: str) -> DataFrame:
    row = search.cosine_quantiles(model.unit_vectors(spark, d), _queries(spark, d), "vec", (0.5, 0.9, 0.99))
    return row.select("query_id", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("median", "p90", "p99"))), F.round("top", 4).alias("max"))


@query("SELECT * FROM hits")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query("""SELECT query_id, row_id, round(0.5 * CASE WHEN bm25_rank IS NULL THEN 0 WHEN max(bm25_rank) OVER w <= 1 THEN 1 ELSE (max(bm25_rank) OVER w - bm25_rank) / (max(bm25_rank) OVER w - 1) END
 + 0.5 * CASE WHEN vec_rank IS NULL THEN 0 WHEN max(vec_rank) OVER w <= 1 THEN 1 ELSE (max(vec_rank) OVER w - vec_rank) / (max(vec_rank) OVER w - 1) END, 6) AS fused FROM hits WINDOW w AS (PARTITION BY query_id)""")
def minmax_fuse(spark: SparkSession, d: str) -> DataFrame:
    return search.minmax_fuse(_hits(spark, d)).select("query_id", "row_id", "fused")


@query("SELECT query_id, row_id, thesis_id, idea_id, score, rank FROM hits JOIN idx_thesis USING (row_id)")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).join(model.index(spark, d).select("row_id", "thesis_id", "idea_id"), "row_id").select("query_id", "row_id", "thesis_id", "idea_id", "score", "rank")


@query("SELECT * FROM lifted")
def lift_max(spark: SparkSession, d: str) -> DataFrame:
    return _lifted(spark, d)


@query("SELECT * FROM normed")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return rank.minmax_norm(_lifted(spark, d))


@query("SELECT query_id, idea_id, score, trust, position, accepted, place FROM placed")
def trust_quota(spark: SparkSession, d: str) -> DataFrame:
    return rank.apply_quota(rank.score(_lifted(spark, d), model.scored_ideas(spark, d)), 5).select("query_id", "idea_id", "score", "trust", "position", "accepted", "place")


def _answer(spark: SparkSession, d: str) -> DataFrame:
    # Used several times in the plan below; written tables keep the search from running again.
    lifted = materialise(_lifted(spark, d), "lifted")
    edges = materialise(graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id"))), "edges")
    ideas = materialise(model.scored_ideas(spark, d), "trust")
    return rank.retrieve(lifted, ideas, edges, 5)


@query("SELECT query_id, idea_id, score, raw_score, trust, via, row_number() OVER (PARTITION BY query_id ORDER BY CASE via WHEN 'thesis' THEN 1 WHEN 'edge' THEN 2 WHEN 'padding' THEN 3 ELSE 4 END, position) AS rank FROM answer")
def retrieve_rank(spark: SparkSession, d: str) -> DataFrame:
    return _answer(spark, d)


@query("""SELECT query_id, idea_id, score, raw_score, trust, via, row_number() OVER (ORDER BY CASE via WHEN 'thesis' THEN 1 WHEN 'edge' THEN 2 WHEN 'padding' THEN 3 ELSE 4 END, position) AS rank FROM answer WHERE query_id = (SELECT min(query_id) FROM q)""")
def retrieve_one(spark: SparkSession, d: str) -> DataFrame:
    """One question, the first: what a single call costs."""
    asked = _queries(spark, d).orderBy("query_id").limit(1)
    lexical = search.bm25(model.index(spark, d), asked, "row_id", "text")
    hits = search.rrf(lexical, search.cosine_topk(model.unit_vectors(spark, d), asked, "row_id", "vec"), "row_id")
    lifted = materialise(rank.lift_max(hits.join(model.index(spark, d).select("row_id", "idea_id"), "row_id")), "lifted")
    edges = graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id")))
    return rank.retrieve(lifted, model.scored_ideas(spark, d), edges, 5)


@query("SELECT query_id, query, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(n, 0) AS ideas, best FROM q LEFT JOIN (SELECT query_id, count(*) AS n, max(score) AS best FROM answer WHERE via <> 'cut_off' GROUP BY 1) USING (query_id)")
def request_log(spark: SparkSession, d: str) -> DataFrame:
    return rank.request_log(_queries(spark, d), _answer(spark, d))


@query("SELECT DISTINCT query_id, idea_id FROM hits JOIN idx_thesis USING (row_id) WHERE idea_id IS NOT NULL AND idea_id NOT IN (SELECT id FROM idea)")
def index_divergence(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).join(model.index(spark, d).select("row_id", "idea_id"), "row_id")
    return rank.divergence(hits, model.ideas(spark, d).select(F.col("id").alias("idea_id")))


@query(""", p AS (SELECT round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS cosine, x.source_id = y.source_id AS same FROM unit a JOIN unit b ON a.idea_id = b.idea_id AND a.row_id < b.row_id
 JOIN (SELECT row_id, min(source_id) AS source_id FROM idx_thesis i JOIN (SELECT DISTINCT id, source_id FROM leaf) l ON l.id = i.thesis_id GROUP BY 1) x ON x.row_id = a.row_id
 JOIN (SELECT row_id, min(source_id) AS source_id FROM idx_thesis i JOIN (SELECT DISTINCT id, source_id FROM leaf) l ON l.id = i.thesis_id GROUP BY 1) y ON y.row_id = b.row_id WHERE x.source_id IS NOT NULL AND y.source_id IS NOT NULL),
t AS (SELECT unnest(range(0, 20)) / 20.0::DOUBLE AS threshold)
SELECT threshold, round((coalesce(avg(CASE WHEN same THEN CAST(cosine >= threshold AS INT) END), 0) + coalesce(avg(CASE WHEN NOT same THEN CAST(cosine < threshold AS INT) END), 0)) / 2, 6) AS balanced FROM p, t GROUP BY 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy of "one source" by similarity, at each threshold."""
    return pairs.threshold_sweep(_labelled_pairs(spark, d), [i / 20 for i in range(20)])


@query("SELECT query_id, idea_id, n FROM (SELECT query_id, idea_id, n FROM topup) WHERE n <= 5")
def retrieve_edge_topup(spark: SparkSession, d: str) -> DataFrame:
    lifted = materialise(_lifted(spark, d), "lifted")
    edges = graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id")))
    scored = materialise(rank.apply_quota(rank.score(lifted, model.scored_ideas(spark, d)), 5), "scored")
    release(lifted)
    return rank.edge_topup(scored, edges, model.scored_ideas(spark, d), 5)


@query("""SELECT query_id, idea_id, thesis_id, best, hits, best * hits AS price, row_number() OVER (PARTITION BY query_id ORDER BY best * hits, best) AS place
 FROM (SELECT query_id, idea_id, min(rank) AS best, count(*) AS hits, min_by(thesis_id, rank) AS thesis_id FROM hits JOIN idx_thesis USING (row_id) WHERE rank <= 30 AND idea_id IS NOT NULL GROUP BY 1, 2)""")
def first_per_idea(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where("rank <= 30").join(model.index(spark, d).select("row_id", "thesis_id", "idea_id").where("idea_id is not null"), "row_id")
    return rank.first_per_idea(hits.select("query_id", "idea_id", "thesis_id", F.col("rank").alias("pos")))


@query("""SELECT idea_id, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY idea_id)), 6) AS v FROM
 (SELECT idea_id, i, avg(CAST(vec[i] AS DOUBLE)) AS m FROM (SELECT idea_id, vec, unnest(range(1, 385)) AS i FROM unit WHERE idea_id IS NOT NULL) GROUP BY 1, 2)""")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = model.unit_vectors(spark, d).where("idea_id is not null").select("idea_id", F.posexplode("vec").alias("i", "x"))
    mean = rows.groupBy("idea_id", (F.col("i") + 1).cast("long").alias("i")).agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("idea_id")))
    return mean.select("idea_id", "i", F.round(F.when(size > 0, F.col("m") / size).otherwise(0.0), 6).alias("v"))


_PAIRS = """SELECT a.idea_id, a.row_id AS a, b.row_id AS b, round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS cosine
 FROM unit a JOIN unit b ON a.idea_id = b.idea_id AND a.row_id < b.row_id"""


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every two leaves of one idea."""
    return pairs.within(model.unit_vectors(spark, d), "idea_id", "row_id", "vec")


QUERIES["pair_similarity"] = pair_similarity
ORACLE["pair_similarity"] = sql(_PAIRS)


def _labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within ideas, of one source and of two, by similarity: at most two million steps at six decimals."""
    src = model.index(spark, d).select("row_id", "thesis_id").join(model.leaves(spark, d, "id", "source_id").withColumnRenamed("id", "thesis_id"), "thesis_id").groupBy("row_id").agg(F.min("source_id").alias("s"))
    rows = model.unit_vectors(spark, d).select("idea_id", "row_id", "vec").join(src.where("s is not null"), "row_id")
    return pairs.agreement(rows, "idea_id", "row_id", "vec", "s")


def auc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How well similarity tells leaves of one source from others, within ideas: area under the curve, ties counting half."""
    by = _labelled_pairs(spark, d)
    below = F.coalesce(F.sum("neg").over(W.orderBy("cosine").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    area = by.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).agg(F.sum("wins").alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return area.select("pos", "neg", F.round(F.col("w") / (F.col("pos").cast("double") * F.col("neg")), 6).alias("auc"))


QUERIES["auc_pairs"] = auc_pairs
ORACLE["auc_pairs"] = sql(
    f"""WITH p AS ({_PAIRS}),
s AS (SELECT row_id, min(source_id) AS s FROM idx_thesis x JOIN (SELECT DISTINCT id, source_id FROM leaf) l ON l.id = x.thesis_id GROUP BY 1),
r AS (SELECT cosine, x.s = y.s AS same FROM p JOIN s x ON x.row_id = p.a JOIN s y ON y.row_id = p.b WHERE x.s IS NOT NULL AND y.s IS NOT NULL),
g AS (SELECT cosine, sum(CAST(same AS INT)) AS pos, sum(CAST(NOT same AS INT)) AS neg FROM r GROUP BY 1),
w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY cosine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS win FROM g)
SELECT CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, round(sum(win) / (sum(pos) * sum(neg)), 6) AS auc FROM w"""
)


def dial_points(spark: SparkSession, d: str) -> DataFrame:
    """Every index row around one query, the first unit vector."""
    rows = model.unit_vectors(spark, d)
    first = rows.orderBy("row_id").limit(1).select("vec").collect()
    if not first:
        return rows.select("row_id", F.lit(0.0).alias("cosine"), F.lit(0.0).alias("angle"))
    return search.dial(rows, list(first[0].vec), "row_id", "vec")


QUERIES["dial_points"] = dial_points


def link_batch(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on the arriving lines; vectors of lines and index are those of a hashing encoder."""
    from evidentia.functions.identity import text_hash
    from evidentia.operators import link
    from evidentia.operators.models import HashingEncoder, OverlapArbiter, encoded
    from evidentia.plans.tables import table

    lines = table(spark, d, "thesis_batches").where("text <> '' and source_id is not null")
    turn = F.col("batch_no").cast("long") * 1_000_000_000 + F.col("line_no")
    encoder = HashingEncoder(64)
    rows = materialise(lines.select("source_id", turn.alias("line"), "text", text_hash(F.col("text")).alias("hash"), encoded(F.col("text"), encoder).alias("vec")), "staged")
    asked = rows.select(F.concat_ws(":", "source_id", F.col("line").cast("string")).alias("query_id"), F.col("text").alias("query"), F.col("vec").alias("qvec"), "source_id", "line")
    index = model.index(spark, d).where("idea_id is not null").select("row_id", "thesis_id", "idea_id", "text")
    index = materialise(index.withColumn("vec", F.when(F.col("text").isNotNull(), encoded(F.col("text"), encoder))), "encoded")
    hits = search.hybrid(index, index, asked, "row_id", "text", "vec", 30).join(index.select("row_id", "idea_id", "thesis_id"), "row_id")
    found = materialise(link.stored_candidates(hits.select("query_id", "idea_id", "thesis_id", F.col("rank").alias("pos"))), "candidates")
    release(index)
    full = rows.join(found.join(asked.select("query_id", "source_id", "line"), "query_id").drop("query_id"), ["source_id", "line"], "left")
    stored = model.leaves(spark, d, "source_id", "text").select("source_id", text_hash(F.col("text")).alias("hash"))
    ideas = model.ideas(spark, d).select(F.col("id").alias("idea_id"), "text")
    arbiter = OverlapArbiter(0.3)
    decided = materialise(link.link_batch(full, ideas, stored, arbiter), "decided")
    order = rows.groupBy("source_id").agg(F.min("line").alias("turn"))
    return link.join_across(decided, rows, order, arbiter)


def link_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The arriving lines whose text is stored under their source, as the linking decides."""
    from evidentia.functions.identity import text_hash
    from evidentia.plans.tables import table

    turn = F.col("batch_no").cast("long") * 1_000_000_000 + F.col("line_no")
    lines = table(spark, d, "thesis_batches").select("source_id", turn.alias("line"), text_hash(F.col("text")).alias("hash"))
    stored = model.leaves(spark, d, "source_id", "text").select("source_id", text_hash(F.col("text")).alias("hash"))
    again = link_batch(spark, d).where("decision = 'duplicate'").join(lines, ["source_id", "line"])
    return again.join(stored, ["source_id", "hash"], "left_semi").select("source_id", "line")


_HASH = f"md5(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))))"
QUERIES["link_duplicates"] = link_duplicates
ORACLE["link_duplicates"] = sql(f"""WITH b AS (SELECT source_id, CAST(batch_no AS BIGINT) * 1000000000 + line_no AS line, {_HASH} AS hash FROM thesis_batches WHERE text <> '' AND source_id IS NOT NULL),
 s AS (SELECT DISTINCT source_id, {_HASH} AS hash FROM thesis_out WHERE text IS NOT NULL AND source_id IS NOT NULL)
SELECT source_id, line FROM b SEMI JOIN s USING (source_id, hash)""")
QUERIES["link_batch"] = link_batch


def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    """The lexical arm over stems: tokens without accents, suffixes stripped."""
    from evidentia.functions.stem import stemmed_text

    index = model.index(spark, d).select("row_id", stemmed_text(F.col("text")).alias("text"))
    asked = _queries(spark, d).select("query_id", stemmed_text(F.col("query")).alias("query"))
    return search.bm25(index, asked, "row_id", "text")


QUERIES["bm25_porter"] = bm25_porter
