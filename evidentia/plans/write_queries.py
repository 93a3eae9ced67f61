"""Queries of the write path: what the store holds after a write, notes, hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import safety, web
from evidentia.functions.identity import text_hash, with_sequence
from evidentia.functions.times import instant
from evidentia.operators import ingest, research, runlog, synthesis, trust, vault
from evidentia.operators.models import CountingJudge, JoiningCombiner
from evidentia.plans import model
from evidentia.plans.model import sql
from evidentia.plans.tables import table
from evidentia.plans.text_queries import _NORM, _SLUG
from evidentia.sources import store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


@query("""WITH p AS (SELECT id, title, TRY_CAST(nullif(trim(retrieved_at), '') AS TIMESTAMPTZ) AS t FROM sources),
o AS (SELECT id, min_by(title, (t, title)) AS title, row_number() OVER (ORDER BY id) AS seq FROM (SELECT id, coalesce(title, '') AS title, t FROM p WHERE t < TIMESTAMPTZ '2025-10-01 00:00:00+00') GROUP BY id),
n AS (SELECT id, max_by(title, (t, title)) AS title FROM (SELECT id, coalesce(title, '') AS title, t FROM p WHERE t >= TIMESTAMPTZ '2025-10-01 00:00:00+00') GROUP BY id),
f AS (SELECT id, title, row_number() OVER (ORDER BY id) + (SELECT max(seq) FROM o) AS seq FROM n WHERE id NOT IN (SELECT id FROM o))
SELECT o.id, coalesce(n.title, o.title) AS title, o.seq FROM o LEFT JOIN n ON n.id = o.id UNION ALL SELECT id, title, seq FROM f""")
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources posted until a day are stored; later posts replace them, and new ones are numbered on."""
    posts = table(spark, d, "sources").select("id", F.coalesce("title", F.lit("")).alias("title"), instant(F.col("retrieved_at")).alias("t"))
    day = F.lit("2025-10-01T00:00:00Z").cast("timestamp")
    old = posts.where(F.col("t") < day).groupBy("id").agg(F.min_by("title", F.struct("t", "title")).alias("title"))
    new = posts.where(F.col("t") >= day).groupBy("id").agg(F.max_by("title", F.struct("t", "title")).alias("title"))
    return store.upsert(with_sequence(old, 0, "id").select("id", "title", "seq"), new.withColumn("seq", F.lit(0)), "id")


@query(f"""WITH b AS (SELECT id, source_id, md5({_NORM}) AS hash FROM thesis_batches WHERE text IS NOT NULL), s AS (SELECT DISTINCT source_id, md5({_NORM}) AS hash FROM thesis_out WHERE text IS NOT NULL)
SELECT b.id, b.source_id FROM b SEMI JOIN s ON s.source_id = b.source_id AND s.hash = b.hash""")
def already_stored(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda name: table(spark, d, name).where("text is not null").select("id", "source_id", text_hash(F.col("text")).alias("hash"))
    return ingest.already_stored(hashed("thesis_batches"), hashed("thesis_out").drop("id")).select("id", "source_id")


@query("""SELECT id, source_id, batch_no FROM thesis_batches WHERE batch_no > 4 UNION ALL
SELECT id, source_id, batch_no FROM thesis_batches WHERE batch_no <= 4 AND NOT EXISTS (SELECT 1 FROM thesis_batches n WHERE n.batch_no > 4 AND n.source_id = thesis_batches.source_id)""")
def staged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Four batches are staged; a later delivery of a source replaces its rows."""
    rows = table(spark, d, "thesis_batches").select("id", "source_id", "batch_no")
    return ingest.replace_by_source(rows.where("batch_no <= 4"), rows.where("batch_no > 4"))


_SWEEP = """WITH x AS (SELECT id, source_id, idea_id, created_at, run_success IS NULL AS unmeasured FROM (SELECT DISTINCT id, source_id, idea_id, created_at, run_success FROM leaf WHERE idea_id IS NOT NULL)),
shown AS (SELECT idea_id, id FROM (SELECT DISTINCT idea_id, id, unmeasured, created_at FROM x) QUALIFY row_number() OVER (PARTITION BY idea_id ORDER BY unmeasured, coalesce(created_at, ''), id) <= 16),
told AS (SELECT idea_id AS id, count(*) AS n FROM shown JOIN (SELECT DISTINCT id, text FROM leaf) USING (id) GROUP BY 1),
swept AS (SELECT i.id, row_number() OVER (ORDER BY created_at NULLS FIRST, i.id) <= 50 AS now, n FROM idea i LEFT JOIN told ON told.id = i.id WHERE dirty),
judged_now AS (SELECT id, CASE WHEN now THEN least(coalesce(n, 0), 10) / 10.0::DOUBLE END AS trust, CASE WHEN now THEN 'scored' ELSE 'deferred' END AS outcome FROM swept)
"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    leaves = ingest.judge_leaves(table(spark, d, "thesis_out")).join(model.leaves(spark, d, "id", "text"), "id")
    return trust.sweep(model.ideas(spark, d), leaves, CountingJudge())


@query(_SWEEP + "SELECT id, trust, outcome FROM judged_now")
def trust_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d)


@query(_SWEEP + "SELECT count(*) AS due, CAST(sum(CAST(outcome = 'scored' AS INT)) AS BIGINT) AS scored, 0 AS failed, CAST(sum(CAST(outcome = 'deferred' AS INT)) AS BIGINT) AS deferred, round(avg(trust), 3) AS mean FROM judged_now")
def trust_summary(spark: SparkSession, d: str) -> DataFrame:
    return trust.summary(_swept(spark, d))


@query(_SWEEP + "SELECT j.id, count(DISTINCT l.id) AS leaves FROM judged_now j JOIN leaf l ON l.idea_id = j.id WHERE outcome = 'scored' GROUP BY 1 HAVING count(DISTINCT l.id) > 16")
def trust_capped(spark: SparkSession, d: str) -> DataFrame:
    return trust.capped(_swept(spark, d), model.leaves(spark, d, "id", "idea_id"))


@query(_SWEEP + "SELECT i.id, coalesce(j.trust, i.trust_score) AS trust_score, dirty AND j.trust IS NULL AS dirty FROM idea i LEFT JOIN judged_now j USING (id)")
def trust_written(spark: SparkSession, d: str) -> DataFrame:
    """Ideas after a pass of the judge: scored ones are clean, the others as they were."""
    scores = _swept(spark, d).where("outcome = 'scored'").select("id", "trust")
    return store.set_trust(model.ideas(spark, d), scores).select("id", "trust_score", "dirty")


_MOVED = "CASE WHEN ('0x' || substr(md5(id), 1, 2))::INT % 5 = 0 THEN idea_id || '_b' ELSE idea_id END"


@query(f"SELECT DISTINCT id, {_MOVED} AS idea_id FROM (SELECT id, min(idea_id) AS idea_id FROM leaf WHERE idea_id IS NOT NULL GROUP BY 1)")
def split_written(spark: SparkSession, d: str) -> DataFrame:
    """Leaves after a fifth of each idea's moved to a new one."""
    leaves = model.leaves(spark, d, "id", "idea_id").where("idea_id is not null").groupBy("id").agg(F.min("idea_id").alias("idea_id"))
    moves = leaves.where(F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 5 == 0).select("id", F.concat("idea_id", F.lit("_b")).alias("new_idea"))
    return store.apply_split(leaves, moves)


@query("SELECT id, dirty OR id IN (SELECT idea_id FROM thesis_batches WHERE idea_id IS NOT NULL) AS dirty FROM idea")
def dirty_after_batch(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_dirty(model.ideas(spark, d), table(spark, d, "thesis_batches").where("idea_id is not null")).select("id", "dirty")


@query("""WITH u AS (SELECT thesis_id, min(row_id) AS row_id FROM unit GROUP BY 1), f AS (SELECT thesis_id, idea_id, text, row_id FROM unit JOIN u USING (thesis_id, row_id))
SELECT thesis_id, idea_id, text FROM f""")
def index_inserted(spark: SparkSession, d: str) -> DataFrame:
    """An index of two thirds of the rows, after the last two thirds come in: a third is replayed."""
    first = model.unit_vectors(spark, d).withColumn("n", F.row_number().over(W.partitionBy("thesis_id").orderBy("row_id"))).where("n = 1").select("thesis_id", "idea_id", "text", "vec", F.col("row_id") % 3)
    rows = first.toDF("thesis_id", "idea_id", "text", "vec", "third")
    return store.index_insert(rows.where("third < 2").drop("third"), rows.where("third > 0").drop("third")).select("thesis_id", "idea_id", "text")


@query("""SELECT id, list_sort(list_distinct(list_filter([regexp_extract(url, '([^/]+)$', 1), regexp_extract(url, '^run://([^/]+)', 1)] || string_split(coalesce(title, ''), ' '), lambda t: length(t) >= 3))) AS terms FROM src WHERE url LIKE 'run://%'""".replace("AS terms", "::VARCHAR AS terms"))
def run_terms(spark: SparkSession, d: str) -> DataFrame:
    """What generalised texts of a run may not say: its program, its name, and the words of its title in place of names from code."""
    rows = model.sources(spark, d).where(F.col("url").startswith("run://"))
    program, run = F.regexp_extract("url", "([^/]+)$", 1), F.regexp_extract("url", "^run://([^/]+)", 1)
    none = F.lit(None).cast("string")
    terms = runlog.leak_terms(program, run, none, none, F.split(F.coalesce("title", F.lit("")), " ", -1))
    return rows.select("id", F.concat(F.lit("["), F.array_join(terms, ", "), F.lit("]")).alias("terms"))


@query("""SELECT DISTINCT 'web_' || substr(sha1(lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) || CASE WHEN rtrim(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '/') END), 1, 16) AS id, url, 1.0::DOUBLE AS score
 FROM sources WHERE url LIKE 'https://%' OR url LIKE 'http://%'""")
def web_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Recorded searches, each with an address, the same with a fragment and a worse score, and an inner one."""
    hit = lambda u, s: F.struct(u.alias("url"), u.alias("title"), F.lit(s).cast("double").alias("score"))
    u = F.col("url")
    body = F.to_json(F.struct(F.array(hit(u, None), hit(F.concat(u, F.lit("#x")), 0.25), hit(F.lit("http://10.0.0.1/"), 9.0)).alias("results")))
    return research.discover(table(spark, d, "sources").select(body.alias("body"))).select("id", "url", "score")


@query("""SELECT url, CASE WHEN host IN ('arxiv.org', 'www.arxiv.org') AND paper <> '' THEN 'https://arxiv.org/pdf/' || paper || '.pdf' ELSE url END AS file, regexp_matches(lower(path), '[^/]\\.pdf/*$') OR contains(lower(path), '/pdf/') OR host IN ('arxiv.org', 'www.arxiv.org') AS paper
 FROM (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*/abs/+([^?#]*)', 1), '/') AS paper FROM
 (SELECT DISTINCT url FROM sources WHERE url IS NOT NULL UNION SELECT unnest(['https://arxiv.org/abs/2406.04824v2/', 'https://www.arxiv.org/list/cs', 'https://ex.org/a.PDF', 'https://ex.org/pdf/x', 'https://ex.org/abs/1', 'https://ex.org/.pdf'])))""")
def paper_files(spark: SparkSession, d: str) -> DataFrame:
    fixed = ["https://arxiv.org/abs/2406.04824v2/", "https://www.arxiv.org/list/cs", "https://ex.org/a.PDF", "https://ex.org/pdf/x", "https://ex.org/abs/1", "https://ex.org/.pdf"]
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed))).alias("url"))
    rows = table(spark, d, "sources").select("url").dropna().unionByName(given).distinct()
    return rows.select("url", web.paper_url(F.col("url")).alias("file"), web.is_paper(F.col("url")).alias("paper"))


@query(r"""SELECT DISTINCT id, substr(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), 1, 80) AS line FROM ideas WHERE text IS NOT NULL""")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ideas").where("text is not null").select("id", safety.one_line(F.col("text"), 80).alias("line")).distinct()


_PAIRS = """WITH n AS (SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS n FROM (SELECT DISTINCT id FROM idea WHERE origin IS DISTINCT FROM 'synthesized')),
p AS (SELECT n // 2 AS pair_no, min_by(id, n) AS a, max_by(id, n) AS b FROM n WHERE n < 100 GROUP BY 1 HAVING count(*) = 2),
c AS (SELECT pair_no, a, b, coalesce(x.text, '') AS ta, coalesce(y.text, '') AS tb, CASE WHEN starts_with(coalesce(x.text, ''), coalesce(y.text, '')) OR starts_with(coalesce(y.text, ''), coalesce(x.text, '')) THEN 'reject' ELSE 'combine' END AS decision FROM p JOIN idea x ON x.id = a JOIN idea y ON y.id = b),
h AS (SELECT *, a || '+' || b AS parents, 'idea_' || substr(sha1(a || '+' || b || '|2026-01-01T00:00:00Z'), 1, 12) AS idea_id FROM c WHERE decision = 'combine')
"""


def _combined(spark: SparkSession, d: str) -> DataFrame:
    ideas = model.ideas(spark, d)
    return synthesis.combined(synthesis.random_pairs(synthesis.parent_pool(ideas), "id", 50, 7), ideas, JoiningCombiner())


@query(_PAIRS + """SELECT idea_id, 'synthesized' AS origin, ta || ' / ' || tb AS text, 'synthesis/' || parents || '/' || idea_id AS url, substr(sha1('synthesis/' || parents || '/' || idea_id || '2026-01-01T00:00:00Z'), 1, 16) AS source_id, 'synthesis: ' || parents AS title,
 ta || ' / ' || tb || chr(10) || chr(10) || 'Applies: where both apply (' || length(ta) || ', ' || length(tb) || ')' AS leaf_text, 'unverified' AS effect, 'synthesis/' || parents AS locator FROM h""")
def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.hypotheses(_combined(spark, d), "2026-01-01T00:00:00Z")


@query(_PAIRS + "SELECT c.pair_no, c.a, c.b, c.decision, idea_id IS NOT NULL AS persisted, idea_id FROM c LEFT JOIN (SELECT pair_no, idea_id FROM h WHERE pair_no % 2 = 0) USING (pair_no)")
def merge_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of a run of which every other hypothesis was written."""
    decided = _combined(spark, d)
    made = synthesis.hypotheses(decided, "2026-01-01T00:00:00Z").withColumn("ab", F.regexp_replace("locator", "^synthesis/", ""))
    stored = decided.where("pair_no % 2 = 0").withColumn("ab", F.concat("a", F.lit("+"), "b")).join(made.select("ab", "idea_id"), "ab").select("pair_no", "idea_id")
    return synthesis.merge_log(decided, stored)


def _name(text: str, key: str) -> str:
    s = _SLUG.replace("text", text)
    cut = f"CASE WHEN length({s}) > 40 THEN regexp_replace(regexp_replace(substr({s}, 1, 40), '-[^-]*$', ''), '-+$', '') ELSE {s} END"
    return f"CASE WHEN {cut} = '' THEN {key} ELSE {cut} || '-' || {key} END"


_NAMES = f"""WITH nm AS (SELECT DISTINCT 'source' AS kind, id, {_name("title", "id")} AS name FROM src UNION ALL SELECT DISTINCT 'idea', id, {_name("text", "id")} FROM idea UNION ALL SELECT DISTINCT 'leaf', id, {_name("text", "id")} FROM leaf)
"""


@query(_NAMES + "SELECT kind, id, name FROM nm")
def note_names(spark: SparkSession, d: str) -> DataFrame:
    return vault.names(model.sources(spark, d), model.ideas(spark, d), model.leaves(spark, d, "id", "text"))


@query(_NAMES + """, e AS (SELECT DISTINCT l.id, n.name, l.idea_id, l.source_id FROM leaf l JOIN nm n ON n.kind = 'leaf' AND n.id = l.id),
i AS (SELECT e.name, e.idea_id AS target, nm.name AS there FROM e LEFT JOIN nm ON nm.kind = 'idea' AND nm.id = e.idea_id WHERE e.idea_id IS NOT NULL UNION ALL SELECT e.name, e.source_id, nm.name FROM e LEFT JOIN nm ON nm.kind = 'source' AND nm.id = e.source_id WHERE e.source_id IS NOT NULL)
SELECT DISTINCT name AS from_name, coalesce(there, target) AS to_name, there IS NULL AS broken FROM i UNION SELECT there, name, false FROM i WHERE there IS NOT NULL""")
def note_links(spark: SparkSession, d: str) -> DataFrame:
    leaves = model.leaves(spark, d, "id", "text", "source_id", "idea_id")
    return vault.links(leaves, vault.names(model.sources(spark, d), model.ideas(spark, d), leaves))


@query("""WITH l AS (SELECT DISTINCT l.id FROM leaf l JOIN src s ON s.id = l.source_id JOIN idea i ON i.id = l.idea_id)
SELECT 'leaf' AS type, count(*) AS n FROM l UNION ALL SELECT 'idea', count(*) FROM idea UNION ALL SELECT 'source', count(*) FROM src UNION ALL SELECT 'page', 1""")
def note_counts(spark: SparkSession, d: str) -> DataFrame:
    """All notes are rendered, and counted by the type their heads name."""
    leaves = table(spark, d, "thesis_out").select("id", "source_id", "idea_id", "text", "context", "effect", "locator").distinct()
    found = vault.notes(model.sources(spark, d), model.ideas(spark, d), leaves)
    kind = F.regexp_extract("body", r"\A---\ntype: (\w+)\n", 1)
    return found.groupBy(F.when(kind == "", "page").otherwise(kind).alias("type")).agg(F.count("*").alias("n"))
