"""Queries of the service around the store: queue, registers, lookups, patches, repairs, reports, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import leakage, web
from evidentia.functions.vectors import problem
from evidentia.operators import audit, graph, ingest, jobs, research, runlog
from evidentia.plans import model
from evidentia.plans.model import sql
from evidentia.plans.tables import table
from evidentia.sources import readers, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


# A user's events are the log of one job: views ask for it, clicks claim it, signups stage it, purchases finish it, errors fail it.
_KIND = {"view": "enqueue", "click": "claim", "signup": "stage", "purchase": "finish", "error": "fail"}


def _job_log(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in _KIND.items() for x in pair))
    at = F.struct("ts", "event_id")
    return _events(spark, d).select(F.col("user_id").alias("job"), at.alias("seq"), F.try_element_at(kinds, F.col("event_type")).alias("event"), (F.col("event_id") % 7 == 0).alias("permanent"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id % 7 = 0 AS permanent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'new' AS status, 1 AS phase, 0 AS attempts FROM e
 UNION ALL
 SELECT r.user_id, e.n,
  CASE WHEN r.status = 'new' AND event_type = 'view' THEN 'queued' WHEN r.status IN ('queued', 'staged') AND event_type = 'click' THEN 'running' WHEN r.status = 'running' AND event_type = 'signup' THEN 'staged' WHEN r.status = 'running' AND event_type = 'purchase' THEN 'ok'
   WHEN r.status = 'running' AND event_type = 'error' THEN CASE WHEN permanent OR attempts >= 3 THEN 'failed' WHEN phase = 2 THEN 'staged' ELSE 'queued' END ELSE r.status END,
  CASE WHEN r.status = 'running' AND event_type = 'signup' THEN 2 WHEN r.status = 'new' AND event_type = 'view' THEN 1 ELSE phase END,
  CASE WHEN r.status IN ('queued', 'staged') AND event_type = 'click' THEN attempts + 1 WHEN r.status = 'running' AND event_type = 'signup' THEN 0 ELSE attempts END
 FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id AS job, arg_max(status, n) AS status, CAST(arg_max(phase, n) AS INT) AS phase, CAST(arg_max(attempts, n) AS INT) AS attempts FROM run GROUP BY 1""".replace("WITH RECURSIVE", "WITH", 1))
def job_fsm(spark: SparkSession, d: str) -> DataFrame:
    return jobs.replay(_job_log(spark, d))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS at, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
run AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS recent, 0::BIGINT AS in_window, false AS allowed FROM (SELECT DISTINCT event_type FROM e)
 UNION ALL
 SELECT r.event_type, e.n, e.event_id, CASE WHEN len(w) < 2 THEN list_append(w, e.at) ELSE w END, len(w), len(w) < 2
 FROM run r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1, LATERAL (SELECT list_filter(r.recent, lambda t: e.at - t < 300000000) AS w) x)
SELECT event_id, in_window, allowed FROM run WHERE n > 0""")
def rate_limit_allowed(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rate_limit(_events(spark, d), "event_type", "ts", "event_id", 2, 300)


@query("""WITH e AS (SELECT *, coalesce(sum(CAST(event_type IN ('purchase', 'error') AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS term FROM events),
r AS (SELECT *, row_number() OVER w AS n, first(event_id) OVER w AS job, first(props) OVER w AS p FROM e WHERE event_type NOT IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id, term ORDER BY ts, event_id))
SELECT event_id, job, CASE WHEN n = 1 THEN 'accepted' WHEN props <> p THEN 'conflict' ELSE 'replay' END AS outcome FROM r""")
def enqueue_live(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).withColumn("ends", F.col("event_type").isin("purchase", "error"))
    return jobs.enqueue_live(log, "user_id", "props", "ends", "ts", "event_id").select("event_id", "job", "outcome")


_JOBS = "SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'staged' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS status FROM events"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "staged").when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    return _events(spark, d).select("user_id", "ts", "event_id", status.alias("status"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS INT) AS worker, event_id FROM ({_JOBS}) WHERE status = 'queued' QUALIFY row_number() OVER (ORDER BY ts, event_id) <= 4")
def job_claims(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claims(_jobs(spark, d), "queued", 4, "ts", "event_id").select("worker", "event_id")


@query(f"SELECT CAST(sum(CAST(status IN ('queued', 'running', 'staged') AS INT)) AS BIGINT) AS waiting, sum(CAST(status IN ('queued', 'running', 'staged') AS INT)) >= 100 AS full FROM (SELECT * FROM ({_JOBS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)")
def queue_backlog(spark: SparkSession, d: str) -> DataFrame:
    return jobs.backlog(jobs.last_event(_jobs(spark, d), "user_id", "ts", "event_id"))


@query(f"""WITH a AS (SELECT user_id, status, ts, event_id FROM ({_JOBS}) WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT user_id, status, ts, event_id FROM ({_JOBS}) WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, status, event_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a)) ORDER BY ts DESC, user_id LIMIT 50""")
def merged_registers(spark: SparkSession, d: str) -> DataFrame:
    """Two registers of jobs, one durable, that both know most users' jobs."""
    part = lambda cond: jobs.last_event(_jobs(spark, d).where(cond), "user_id", "ts", "event_id")
    return jobs.merged_registers(part("event_id % 3 = 0"), part("event_id % 3 <> 0"), "user_id", "ts", 50).select("user_id", "status", "event_id")


_WANTED = "SELECT row_number() OVER (ORDER BY md5(id), id) AS pos, id FROM (SELECT DISTINCT idea_id AS id FROM thesis_out WHERE idea_id IS NOT NULL)"


@query(f"SELECT pos, id, text, trust_score FROM ({_WANTED}) JOIN idea USING (id)")
def lookup_ideas(spark: SparkSession, d: str) -> DataFrame:
    """All ideas that leaves name, some unknown, asked for in an order of the caller's."""
    from evidentia.functions.identity import with_sequence

    ids = table(spark, d, "thesis_out").select(F.col("idea_id").alias("id")).dropna().distinct().withColumn("o", F.md5("id"))
    wanted = with_sequence(ids, 0, "o", "id").withColumnRenamed("seq", "pos")
    return store.lookup(model.ideas(spark, d), wanted).select("pos", "id", "text", "trust_score")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch per idea: new limits, a null differentiation, now and then something that may not be written."""
    n = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 6
    none = F.lit(None).cast("string")
    pair = lambda *kv: F.create_map(*kv)
    fields = F.when(n == 0, pair(F.lit("limitations"), F.concat(F.lit("new: "), "id"), F.lit("differentiation"), none)).when(n == 1, pair(F.lit("trust_score"), F.lit("1"))).when(n == 2, pair(F.lit("text"), none)).when(n == 3, pair(F.lit("rederived_at_leaf_count"), F.lit("-1"))).when(n == 4, pair(F.lit("rederived_at_leaf_count"), F.lit("7")))
    return model.ideas(spark, d).select("id", fields.alias("fields"))


_N = "('0x' || substr(md5(id), 1, 4))::INT % 6"


@query(f"SELECT id, CASE {_N} WHEN 1 THEN 'unknown field' WHEN 2 THEN 'null' WHEN 3 THEN 'count' ELSE 'empty' END AS problem FROM idea WHERE {_N} IN (1, 2, 3, 5)")
def patch_problems(spark: SparkSession, d: str) -> DataFrame:
    return store.patch_problems(_patches(spark, d), model.ideas(spark, d))


@query(f"""SELECT id, text, CASE WHEN {_N} = 0 THEN 'new: ' || id ELSE limitations END AS limitations, CASE WHEN {_N} = 0 THEN NULL ELSE differentiation END AS differentiation,
 CAST(CASE WHEN {_N} = 4 THEN 7 ELSE rederived_at_leaf_count END AS INT) AS rederived_at_leaf_count FROM idea""")
def patched_ideas(spark: SparkSession, d: str) -> DataFrame:
    patches, ideas = _patches(spark, d), model.ideas(spark, d)
    good = patches.join(store.patch_problems(patches, ideas).select("id"), "id", "left_anti")
    return store.apply_patches(ideas, good).select("id", "text", "limitations", "differentiation", "rederived_at_leaf_count")


@query("""SELECT DISTINCT id, CASE WHEN there IS NULL THEN 'insert' WHEN own IS NULL THEN 'drop' WHEN idea_id IS DISTINCT FROM other THEN 'relink' ELSE 'keep' END AS action
 FROM (SELECT DISTINCT id, idea_id, 1 AS own FROM leaf) FULL JOIN (SELECT DISTINCT thesis_id AS id, idea_id AS other, 1 AS there FROM idx_thesis) USING (id)""")
def index_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return store.reconcile(model.leaves(spark, d, "id", "idea_id"), model.index(spark, d))


@query("""WITH v AS (SELECT thesis_id AS id, min_by(text, row_id) AS text, min(row_id) AS row_id FROM unit WHERE text IS NOT NULL GROUP BY 1)
SELECT l.id AS thesis_id, min(l.idea_id) AS idea_id, any_value(v.text) AS text, any_value(v.row_id) AS row_id FROM leaf l JOIN v ON v.id = l.id WHERE l.idea_id IS NOT NULL GROUP BY 1""")
def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The index made anew from the leaves of the store whose vectors are valid."""
    v = model.unit_vectors(spark, d).where("text is not null").groupBy(F.col("thesis_id").alias("id")).agg(F.min_by(F.struct("text", "vec", "row_id"), "row_id").alias("v")).select("id", "v.*")
    own = model.leaves(spark, d, "id", "idea_id").where("idea_id is not null").groupBy("id").agg(F.min("idea_id").alias("idea_id"))
    rows = own.join(v, "id")
    return store.rebuild_index(rows).join(rows.select(F.col("id").alias("thesis_id"), "row_id"), "thesis_id").select("thesis_id", "idea_id", "text", "row_id")


@query("""WITH b AS (SELECT DISTINCT source_id, idea_id, text_hash FROM thesis_batches WHERE source_id IS NOT NULL AND text_hash IS NOT NULL),
n AS (SELECT source_id, text_hash, count(*) AS n FROM b GROUP BY 1, 2)
SELECT source_id, text_hash, CASE WHEN source_id NOT IN (SELECT id FROM src) THEN 'source is missing' WHEN idea_id IS NULL OR idea_id NOT IN (SELECT id FROM idea) THEN 'idea is missing'
 WHEN EXISTS (SELECT 1 FROM thesis_out t WHERE t.source_id = b.source_id AND t.text_hash = b.text_hash) THEN 'stored already' WHEN n > 1 THEN 'delivered twice' END AS problem FROM b JOIN n USING (source_id, text_hash) WHERE problem IS NOT NULL""")
def append_problems(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "thesis_batches").select("source_id", "idea_id", "text_hash").where("source_id is not null and text_hash is not null").distinct()
    return store.append_problems(table(spark, d, "thesis_out"), new, model.sources(spark, d), model.ideas(spark, d))


@query("""WITH e AS (SELECT source_id, target_id FROM edge WHERE ('0x' || substr(md5(source_id || target_id), 1, 2))::INT % 10 <> 0 UNION ALL SELECT id, id FROM idea)
SELECT DISTINCT source_id, target_id, CASE WHEN source_id = target_id THEN 'loop' WHEN source_id NOT IN (SELECT id FROM idea) OR target_id NOT IN (SELECT id FROM idea) THEN 'end is missing'
 WHEN NOT EXISTS (SELECT 1 FROM e f WHERE f.source_id = e.target_id AND f.target_id = e.source_id) THEN 'one direction' END AS problem FROM e WHERE problem IS NOT NULL""")
def edge_problems(spark: SparkSession, d: str) -> DataFrame:
    """Edges of which a tenth were lost, and loops."""
    edges = graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id"))).select("source_id", "target_id")
    some = edges.where(F.conv(F.substring(F.md5(F.concat("source_id", "target_id")), 1, 2), 16, 10).cast("int") % 10 != 0)
    loops = model.ideas(spark, d).select(F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    return graph.edge_problems(some.unionByName(loops), model.ideas(spark, d))


@query("SELECT id, count(DISTINCT other) AS degree FROM (SELECT source_id AS id, target_id AS other FROM edge UNION ALL SELECT target_id, source_id FROM edge) WHERE id <> other GROUP BY 1")
def idea_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id"))))


@query("""SELECT DISTINCT kind, from_id, to_id, CAST(weight AS DOUBLE) AS weight FROM (SELECT 'YIELDS' AS kind, source_id AS from_id, id AS to_id, 1.0 AS weight FROM leaf UNION ALL SELECT 'HAS_LEAF', idea_id, id, 1.0 FROM leaf UNION ALL SELECT 'RELATED', source_id, target_id, weight FROM edge)
 WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id""")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    rows = model.leaves(spark, d, "id", "source_id", "idea_id")
    return graph.exported(rows, graph.both_directions(graph.cocitation(rows)))


@query("SELECT lower(trim(type)) AS type, count(*) AS n FROM src GROUP BY 1")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    return audit.counts_by(model.sources(spark, d).select(F.lower(F.trim("type")).alias("type")), "type")


@query("""WITH l AS (SELECT l.id, l.source_id, l.idea_id FROM leaf l JOIN src s ON s.id = l.source_id JOIN idea i ON i.id = l.idea_id),
o AS (SELECT id, origin FROM idea WHERE id NOT IN (SELECT idea_id FROM l))
SELECT (SELECT count(DISTINCT source_id) FROM l) AS sources, (SELECT count(DISTINCT id) FROM l) AS theses, (SELECT count(*) FROM idea) AS ideas,
 (SELECT round(avg(CAST(n >= 2 AS INT)), 3) FROM (SELECT count(DISTINCT source_id) AS n FROM l GROUP BY idea_id)) AS multi_source,
 (SELECT count(*) FROM o WHERE origin IS DISTINCT FROM 'synthesized') AS broken, (SELECT count(*) FROM o WHERE origin = 'synthesized') AS hypotheses,
 (SELECT count(*) FROM (SELECT idea_id FROM l GROUP BY 1 HAVING count(DISTINCT id) > 16)) AS over_ceiling""")
def phase_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.phase_report(model.sources(spark, d), model.ideas(spark, d), model.leaves(spark, d, "id", "source_id", "idea_id"))


_LEAKS = r"""list_intersect(list_distinct(regexp_extract_all(coalesce(effect, ''), '\d+(?:[.,]\d+)*')), list_distinct(regexp_extract_all(text, '\d+(?:[.,]\d+)*')))"""
_FLAT = r"' ' || regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_-]+', ' ', 'g') || ' '"


@query(rf"""WITH r AS (SELECT DISTINCT id, text, effect, source_type, CASE WHEN json_valid(run_meta) THEN run_meta::JSON->>'archetype' END AS term FROM thesis_out WHERE text IS NOT NULL),
v AS (SELECT lower(source_type) AS source_type, len({_LEAKS}) > 0 OR coalesce(length(term) >= 3 AND contains({_FLAT.format("text")}, {_FLAT.format("term")}), false) AS leaks FROM r)
SELECT source_type, count(*) AS n, CAST(sum(CAST(leaks AS INT)) AS BIGINT) AS leaked, round(avg(CAST(leaks AS INT)), 3) AS share FROM v GROUP BY 1""")
def leakage_share(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaves of each type, how many still say a number of their effect or the archetype of their run."""
    rows = table(spark, d, "thesis_out").where("text is not null").select("id", "text", "effect", "source_type", F.get_json_object("run_meta", "$.archetype").alias("term")).distinct()
    terms = F.when(F.col("term").isNotNull(), F.array("term"))
    found = leakage.violations(F.col("text"), F.col("effect"), F.array().cast("array<string>"), terms)
    return audit.share_by(rows.select(F.lower("source_type").alias("source_type"), (F.size(found) > 0).alias("leaks")), "source_type", "leaks").withColumnRenamed("hit", "leaked")


_GATE = r"CASE WHEN coalesce(trim(url), '') = '' THEN 'empty' WHEN regexp_matches(trim(url), '(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/\d{4}\.\d{4,5}(?:v\d+)?(?:\.pdf)?/?$') THEN 'accepted' WHEN regexp_matches(trim(url), '(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/[a-z-]+(?:\.[a-z-]+)?/\d{7}') THEN 'old_style' ELSE 'not_article' END"


@query(f"SELECT {_GATE} AS kind, count(*) AS n FROM sources GROUP BY 1")
def refusal_counts(spark: SparkSession, d: str) -> DataFrame:
    return research.refusals(table(spark, d, "sources").select(F.coalesce(web.url_refusal(F.col("url")), F.lit("accepted")).alias("kind")))


_PROBES = {
    "https://ex.org/a": True, "http://ex.org.": True, "http://localhost.": False, "http://service.internal./x": False, "https://ex.org:8080/": False, "https://ex.org:443/": True, "http://ex.org:0080": True, "http://100.64.0.1": False,
    "http://198.18.0.1": False, "http://240.0.0.1": False, "http://192.0.2.1": False, "http://10.example.com": True, "http://0.example.org": True, "http://[2606:4700::1111]/": True, "http://[::1]:80/": False, "http://[fe80::1]": False,
    "http://127.0.0.1": False, "http://8.8.8.8": True, "http://172.15.0.1": True, "http://172.16.0.1": False, "http://192.0.0.9": True, "http://192.0.0.8": False, "http://u:p@ex.org": False, "ftp://ex.org": False, "http://": False,
    "HTTP://EX.ORG": True, "http://a.localhost": False, "http://mylocal": True, "http://256.1.1.1": True, "http://metadata.google.internal": False, "http://ex.org:x": False, "http://224.0.0.1": True,
}


@query("SELECT url, public FROM (VALUES " + ", ".join(f"('{u}', {str(p).lower()})" for u, p in _PROBES.items()) + ") t(url, public) UNION SELECT url, regexp_matches(url, '^https?://') FROM sources WHERE url IS NOT NULL")
def is_public(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every kind, what is right being stated for each, and those of the sources, which are ordinary."""
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, _PROBES))).alias("url"))
    rows = given.unionByName(table(spark, d, "sources").select("url").dropna()).distinct()
    return rows.select("url", web.is_public(F.col("url")).alias("public"))


@query("""SELECT source_id, min(line) AS first_line, count(*) AS lines, row_number() OVER (ORDER BY min(line)) AS place FROM (SELECT source_id, CAST(batch_no AS BIGINT) * 1000000000 + line_no AS line FROM thesis_batches WHERE source_id IS NOT NULL) GROUP BY 1""")
def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "thesis_batches").select("source_id", (F.col("batch_no").cast("long") * 1_000_000_000 + F.col("line_no")).alias("line"))
    return ingest.by_first_appearance(rows.where("source_id is not null"), "source_id", "line")


@query("""WITH a AS (SELECT id, source_id, coalesce(idea_id, '') AS section, row_number() OVER (PARTITION BY source_id, idea_id ORDER BY id) AS n FROM (SELECT DISTINCT id, source_id, idea_id FROM leaf WHERE source_id IS NOT NULL)),
s AS (SELECT source_id, section, count(*) FILTER (WHERE n <= 6) AS found FROM a GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(found) OVER (PARTITION BY source_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT source_id, section, CAST(CASE WHEN before >= 30 THEN 0 ELSE found END AS BIGINT) AS found, CAST(CASE WHEN before >= 30 THEN 0 ELSE greatest(0, before + found - 30) END AS BIGINT) AS dropped, before < 30 AS parsed FROM b""")
def section_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaves as drafts, their ideas as sections: how many each section yields, what the document's ceiling drops, what is never parsed."""
    rows = model.leaves(spark, d, "id", "source_id", "idea_id").where("source_id is not null").select("id", "source_id", F.coalesce("idea_id", F.lit("")).alias("section"))
    return ingest.section_report(rows, "source_id", "section", "id")


@query("""WITH s AS (SELECT md5(text) AS section_hash, md5('extract, please') AS prompt_hash, doc_id FROM documents WHERE text IS NOT NULL AND text <> ''),
c AS (SELECT DISTINCT md5(text) AS section_hash FROM documents WHERE doc_id % 3 = 0 AND text <> '')
SELECT section_hash, prompt_hash, count(*) AS sections, bool_or(section_hash IN (SELECT section_hash FROM c)) AS cached FROM s GROUP BY 1, 2""")
def extract_cache(spark: SparkSession, d: str) -> DataFrame:
    """Calls an extraction of all texts needs, when every third text was extracted before with the same prompt."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    cache = ingest.cache_keys(docs.where("doc_id % 3 = 0"), "text", "extract, please")
    return ingest.extraction_calls(docs, "text", "extract, please", cache)


@query(r"""SELECT doc_id, n AS pos, title, md5(body) AS body FROM (SELECT doc_id, title, body, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM
 (SELECT doc_id, unnest(range(1, len(h) + 1)) AS k, regexp_replace(regexp_extract(h[k], '^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t]*$', 1), '^\s+|\s+$', '', 'g') AS title, regexp_replace(b[k + 1], '^\s+|\s+$', '', 'g') AS body FROM
 (SELECT doc_id, regexp_extract_all(text, '(?m)^[ \t]{0,3}#{1,6}[ \t]+.+?[ \t]*$') AS h, regexp_split_to_array(text, '(?m)^[ \t]{0,3}#{1,6}[ \t]+.+?[ \t]*$') AS b FROM documents WHERE text IS NOT NULL)) WHERE body <> '')""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.functions import sections

    found = sections.sections(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.substring("id", 2, 9).cast("long").alias("pos"), "title", F.md5("text").alias("body"))


@query("""SELECT doc_id, coalesce(nullif(trim(fit), ''), nullif(trim(raw), ''), nullif(trim(plain), '')) AS content FROM
 (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title ELSE ' ' END AS fit, CASE WHEN doc_id % 2 = 0 THEN title END AS raw, kind AS plain FROM documents)""")
def payload_content(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a provider, whose markdown is an object with several forms, or a text."""
    t = F.col("title")
    body = F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 3 == 0, t).otherwise(" ").alias("fit_markdown"), F.when(F.col("doc_id") % 2 == 0, t).alias("raw_markdown")).alias("markdown"), F.col("kind").alias("text")))
    return readers.payload_content(table(spark, d, "documents").select("doc_id", body.alias("body")), "body").select("doc_id", "content")


@query("SELECT id, CASE WHEN left(trim(e), 1) = '[' THEN len(from_json(e, '[\"VARCHAR\"]')) WHEN e IS NULL OR e = '' THEN 0 ELSE 1 END AS records FROM (SELECT DISTINCT id, CASE WHEN rederived_at_leaf_count % 2 = 0 THEN to_json(failure_modes)::VARCHAR ELSE effect_claimed END AS e FROM idea)")
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that older rows hold as one value and newer ones as a list."""
    e = F.when(F.col("rederived_at_leaf_count") % 2 == 0, F.coalesce(F.to_json("failure_modes"), F.lit(None))).otherwise(F.col("effect_claimed"))
    return model.ideas(spark, d).select("id", e.alias("e")).distinct().select("id", F.size(readers.evidence_list(F.col("e"))).cast("long").alias("records"))


_IDS = ["run-1", "A.b_c-9", ".hidden", "..", "a/b", "", "x" * 64, "x" * 65, "-a", "ü"]


@query(f"SELECT id, regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,63}}') AS valid FROM (SELECT unnest({_IDS!r}) AS id UNION SELECT DISTINCT version FROM sources WHERE version IS NOT NULL)")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, _IDS))).alias("id"))
    rows = given.unionByName(table(spark, d, "sources").select(F.col("version").alias("id")).dropna()).distinct()
    return rows.select("id", runlog.valid_run_id(F.col("id")).alias("valid"))


@query("""SELECT event_id, CASE WHEN parsed IS NOT NULL THEN parsed::JSON->>'archetype' ELSE raw::JSON->>'archetype' END AS archetype FROM
 (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"archetype": "given", "changes": []}' WHEN event_id % 4 = 1 THEN '{"archetype": "half"}' END AS parsed, CASE WHEN event_id % 2 = 0 THEN '{"archetype": "raw", "changes": []}' ELSE '{"changes": []}' END AS raw FROM events)
 WHERE CASE WHEN parsed IS NOT NULL THEN json_exists(parsed, '$.archetype') AND json_exists(parsed, '$.changes') ELSE json_exists(raw, '$.archetype') AND json_exists(raw, '$.changes') END""")
def mutation_output(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    parsed = F.when(n % 4 == 0, '{"archetype": "given", "changes": []}').when(n % 4 == 1, '{"archetype": "half"}')
    raw = F.when(n % 2 == 0, '{"archetype": "raw", "changes": []}').otherwise('{"changes": []}')
    return _events(spark, d).select("event_id", runlog.parse_output(raw, parsed).alias("o")).where("o is not null").select("event_id", F.col("o.archetype").alias("archetype"))


_MUTANT = """
WITH m AS (SELECT 'p' || event_id AS program_id, CASE WHEN event_type = 'error' THEN -1000.0 WHEN event_type = 'signup' THEN NULL ELSE value END AS fitness,
  lag(event_id) OVER w AS p1, lag(event_id, 2) OVER w AS p2, event_type, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT program_id, fitness FROM m WHERE fitness IS NOT NULL AND fitness <> -1000.0),
p AS (SELECT m.program_id, max(k.fitness) AS parent_fitness FROM m JOIN k ON k.program_id IN ('p' || m.p1, 'p' || m.p2) GROUP BY 1),
g AS (SELECT m.*, parent_fitness, round(fitness - parent_fitness, 6) AS delta FROM m JOIN p USING (program_id) WHERE fitness IS NOT NULL AND fitness <> -1000.0 AND event_id % 5 <> 0)
"""


def _mutants(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fitness = F.when(F.col("event_type") == "error", F.lit(runlog.DEAD)).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("value"))
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("p"), c.cast("string")))
    rows = _events(spark, d).select(name(F.col("event_id")).alias("program_id"), fitness.alias("fitness"), F.array(name(F.lag("event_id").over(w)), name(F.lag("event_id", 2).over(w))).alias("parent_ids"), "event_type", "event_id")
    changes = F.when(F.col("event_id") % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"description": "first of '), "program_id", F.lit('"}, {"description": "second"}]')))
    output = F.concat(F.lit('{"archetype": "'), "event_type", F.lit('", "changes": '), changes, F.lit("}"))
    return rows.select("program_id", "fitness", F.filter("parent_ids", lambda x: x.isNotNull()).alias("parent_ids"), output.alias("mutation_output"), F.lit("m-1").alias("mutation_model"))


@query(_MUTANT + """SELECT substr(sha1('run://r_seed3/' || program_id || program_id), 1, 16) AS source_id, delta > 0 AS run_success, delta, CASE n WHEN 0 THEN 'first of ' || program_id ELSE 'second' END AS text,
 event_type || ' · r · m-1' AS context, 'r_seed3:' || program_id || '#changes[' || n || ']' AS locator FROM g, (SELECT unnest([0, 1]) AS n)""")
def runlog_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Events as mutants with up to two parents each: the leaves their log yields."""
    return runlog.convert(_mutants(spark, d), "r_seed3").select("source_id", "run_success", "delta", "text", "context", "locator")


@query("""WITH s AS (SELECT min(source_id) AS id FROM edge), h1 AS (SELECT e.*, 1 AS hop FROM edge e JOIN s ON e.source_id = s.id),
f1 AS (SELECT DISTINCT target_id AS id FROM h1 WHERE target_id NOT IN (SELECT id FROM s)), h2 AS (SELECT e.*, 2 AS hop FROM edge e JOIN f1 ON e.source_id = f1.id),
f2 AS (SELECT DISTINCT target_id AS id FROM h2 WHERE target_id NOT IN (SELECT id FROM s) AND target_id NOT IN (SELECT id FROM f1)), h3 AS (SELECT e.*, 3 AS hop FROM edge e JOIN f2 ON e.source_id = f2.id)
SELECT source_id, target_id, weight, hop FROM h1 UNION ALL SELECT source_id, target_id, weight, hop FROM h2 UNION ALL SELECT source_id, target_id, weight, hop FROM h3""")
def neighbors_3(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.scratch import materialise

    edges = materialise(graph.both_directions(graph.cocitation(model.leaves(spark, d, "id", "source_id", "idea_id"))), "edges")
    return graph.neighbours(edges, edges.agg(F.min("source_id").alias("id")), 3)


@query("SELECT event_id, user_id, value FROM events JOIN (SELECT event_id AS log_id, value AS v FROM events WHERE event_type <> 'error') l ON l.log_id = event_id - 1")
def logged_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses that name the log line before theirs; failures have no line."""
    from evidentia.operators import rank

    log = _events(spark, d).where("event_type <> 'error'").select(F.col("event_id").alias("log_id"))
    return rank.logged_responses(_events(spark, d).select((F.col("event_id") - 1).alias("log_id"), "event_id", "user_id", "value"), log).select("event_id", "user_id", "value")


@query("SELECT path, count(*) AS n FROM (SELECT id, unnest(CASE WHEN length(text) = 400 THEN ['text'] ELSE [] END || CASE WHEN length(context) = 40 THEN ['meta.context'] ELSE [] END || list_distinct(list_transform(list_filter([effect, locator], lambda x: length(x) = 20), lambda x: 'meta.notes'))) AS path FROM (SELECT DISTINCT id, text, context, effect, locator FROM thesis_out)) GROUP BY 1")
def truncated_paths(spark: SparkSession, d: str) -> DataFrame:
    """How many answers were cut, by the path of the field, at any depth."""
    rows = model.leaves(spark, d, "id", "text", "context", "effect", "locator").select("id", "text", F.struct("context", F.array("effect", "locator").alias("notes")).alias("meta"))
    found = rows.select("id", F.explode(audit.truncated(rows.schema, {"text": 400, "meta.context": 40, "meta.notes": 20})).alias("path"))
    return found.groupBy("path").agg(F.count("*").alias("n"))
