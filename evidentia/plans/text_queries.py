"""Queries over texts, pages, urls, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import identity, leakage, notes, safety, sections, web
from evidentia.functions.words import SPACE
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


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_WS = SPACE + "+"
_NORM = f"lower(trim(regexp_replace(text, '{_WS}', ' ', 'g')))"


@query(f"SELECT doc_id, md5({_NORM}) AS hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", identity.text_hash(F.col("text")).alias("hash"))


@query("SELECT DISTINCT url, version, substr(sha1(url || version), 1, 16) AS source_id FROM sources")
def source_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("url", "version", identity.source_id(F.col("url"), F.col("version")).alias("source_id")).distinct()


_PAGE = "'<html><head><script>var x = \"<article>\";</script></head><body><nav>n</nav>' || CASE doc_id % 3 WHEN 0 THEN '<article class=\"a\">' || text || '</article>' WHEN 1 THEN '<main>' || text || '</main>' ELSE text END || '</body></html>'"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages around the documents' texts: in an article, in a main part, or bare."""
    t = F.col("text")
    inner = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<article class="a">'), t, F.lit("</article>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<main>"), t, F.lit("</main>"))).otherwise(t)
    head = F.lit('<html><head><script>var x = "<article>";</script></head><body><nav>n</nav>')
    return _docs(spark, d).where(t.isNotNull()).select("doc_id", F.concat(head, inner, F.lit("</body></html>")).alias("html"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(html, '(?is)<article\\b[^>]*>.*</article>') THEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article>', 1)
 WHEN regexp_matches(html, '(?is)<main\\b[^>]*>.*</main>') THEN regexp_extract(html, '(?is)<main\\b[^>]*>(.*)</main>', 1) ELSE html END AS body FROM (SELECT doc_id, {_PAGE} AS html FROM documents WHERE text IS NOT NULL)""")
def html_article(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", web.article_body(F.col("html")).alias("body"))


@query(rf"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '</?[A-Za-z][^<>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '{_WS}', ' ', 'g')) AS plain FROM (SELECT doc_id, {_PAGE} AS html FROM documents WHERE text IS NOT NULL)""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", web.strip_tags(F.col("html")).alias("plain"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, unnest(range(1, greatest(1, CAST(ceil((len(t) - 100) / 1400.0) AS INT)) + 1)) AS chunk_no FROM t WHERE len(t) > 0)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(len(t[(chunk_no - 1) * 1400 + 1:(chunk_no - 1) * 1400 + 1500]) AS INT) AS n_tokens, array_to_string(t[(chunk_no - 1) * 1400 + 1:(chunk_no - 1) * 1400 + 1500], ' ') AS text FROM c""")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunks(_docs(spark, d), "doc_id", "text")


@query()
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(_docs(spark, d), "doc_id", "text")


@query(r"""SELECT url, nullif(lower(regexp_extract(trim(url), '(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?/?$', 1)), '') AS article_id,
 CASE WHEN coalesce(trim(url), '') = '' THEN 'empty' WHEN regexp_matches(trim(url), '(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?/?$') THEN NULL
 WHEN regexp_matches(trim(url), '(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/[a-z-]+(?:\.[a-z-]+)?/\d{7}') THEN 'old_style' ELSE 'not_article' END AS refusal
 FROM (SELECT DISTINCT url FROM sources UNION SELECT unnest(['https://arxiv.org/abs/2406.04824v2', 'http://www.arxiv.org/pdf/2406.04824V2.pdf', 'https://arxiv.org/html/2406.04824/', 'https://arxiv.org/abs/hep-th/9901001', 'https://arxiv.org/list/cs', 'arxiv.org/abs/2406.04824', 'https://export.arxiv.org/abs/2406.04824/', 'arxiv.org/abs/hep-th/9901001', 'https://arxiv.org/abs/cond-mat.stat-mech/0012345v3', 'https://arxiv.org/abs/2406.04824?x=1', '2406.04824', ' ', NULL]) UNION
 SELECT DISTINCT replace(replace(url, 'preprints.', ''), regexp_extract(url, '^https://preprints\.([a-z]+\.example)', 1) || '/abs/', 'arxiv.org/abs/2406.0') FROM sources WHERE url LIKE 'https://preprints.%')""")
def url_gate(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "sources").select("url")
    fixed = ["https://arxiv.org/abs/2406.04824v2", "http://www.arxiv.org/pdf/2406.04824V2.pdf", "https://arxiv.org/html/2406.04824/", "https://arxiv.org/abs/hep-th/9901001", "https://arxiv.org/list/cs", "arxiv.org/abs/2406.04824", "https://export.arxiv.org/abs/2406.04824/", "arxiv.org/abs/hep-th/9901001", "https://arxiv.org/abs/cond-mat.stat-mech/0012345v3", "https://arxiv.org/abs/2406.04824?x=1", "2406.04824", " ", None]
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed))).alias("url"))
    host = F.regexp_extract("url", r"^https://preprints\.([a-z]+\.example)", 1)
    made = urls.where(F.col("url").startswith("https://preprints.")).select(F.replace(F.replace("url", F.lit("preprints."), F.lit("")), F.concat(host, F.lit("/abs/")), F.lit("arxiv.org/abs/2406.0")).alias("url"))
    rows = urls.unionByName(given).unionByName(made).distinct()
    return rows.select("url", web.article_id(F.col("url")).alias("article_id"), web.url_refusal(F.col("url")).alias("refusal"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?'"


@query(rf"""SELECT DISTINCT url, lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) || CASE WHEN regexp_replace(regexp_extract(url, {_URL}, 3), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, {_URL}, 3), '/+$', '') END
 || CASE WHEN regexp_extract(url, {_URL}, 4) = '?' THEN '' ELSE regexp_extract(url, {_URL}, 4) END AS canonical FROM (SELECT url FROM sources UNION SELECT upper(url) || '/#x' FROM sources UNION SELECT url || '?a=1' FROM sources)""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "sources").select("url")
    rows = u.unionByName(u.select(F.concat(F.upper("url"), F.lit("/#x")).alias("url"))).unionByName(u.select(F.concat("url", F.lit("?a=1")).alias("url"))).distinct()
    return rows.select("url", web.canonical(F.col("url")).alias("canonical"))


@query(r"""SELECT DISTINCT id, coalesce(array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(effect, '\d+(?:[.,]\d+)*')), list_distinct(regexp_extract_all(text, '\d+(?:[.,]\d+)*')))), ','), '') AS leaked FROM thesis_out WHERE effect IS NOT NULL AND text IS NOT NULL""")
def leak_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = model.leaves(spark, d, "id", "effect", "text").where("effect is not null and text is not null")
    return rows.select("id", F.array_join(leakage.leaked_numbers(F.col("effect"), F.col("text")), ",").alias("leaked")).distinct()


@query(r"""SELECT DISTINCT id, coalesce(contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_-]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(term), '[^\p{L}\p{N}_-]+', ' ', 'g') || ' '), false) AS leaks
 FROM (SELECT id, text, run_meta::JSON->>'archetype' AS term FROM thesis_out WHERE run_meta IS NOT NULL)""")
def leak_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = model.leaves(spark, d, "id", "text", "run_meta").where("run_meta is not null")
    return rows.select("id", leakage.mentions(F.col("text"), F.get_json_object("run_meta", "$.archetype")).alias("leaks")).distinct()


_CANDIDATES = ["api_key: abcdef", "password = hunter2 please", "ghp_0123456789abcdefXY", "sk-shortone", "how do secrets: work?", "access-token:zzz", "plain question about search", "xoxb-12345678901234567"]


@query(rf"""SELECT q, regexp_matches(q, '(?i)(?:api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*\S+|(?:sk|ghp|xox[baprs])[-_][A-Za-z0-9_-]{{16,}}') AS secret, length(q) >= 8 AS long_enough
 FROM (SELECT unnest({_CANDIDATES!r}) AS q UNION SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)""")
def secret_filter(spark: SparkSession, d: str) -> DataFrame:
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, _CANDIDATES))).alias("q"))
    rows = given.unionByName(_docs(spark, d).select(F.col("title").alias("q")).dropna()).distinct()
    return rows.select("q", safety.has_secret(F.col("q")).alias("secret"), (F.length("q") >= safety.SHORTEST).alias("long_enough"))


_TOK = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]{{3,}}'))"


@query(f"""WITH t AS (SELECT id, {_TOK.format("text")} AS a, {_TOK.format("applicability_conditions || ' ' || coalesce(effect_claimed, '')")} AS b FROM ideas WHERE text IS NOT NULL AND applicability_conditions IS NOT NULL)
SELECT DISTINCT id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS jaccard FROM t""")
def query_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ideas").where("text is not null and applicability_conditions is not null")
    other = F.concat("applicability_conditions", F.lit(" "), F.coalesce("effect_claimed", F.lit("")))
    return rows.select("id", F.round(safety.jaccard(safety.token_set(F.col("text")), safety.token_set(other)), 6).alias("jaccard")).distinct()


_SLUG = "regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""SELECT id, CASE WHEN s = '' THEN id ELSE s || '-' || id END AS name FROM (SELECT id, CASE WHEN length(f) > 40 THEN regexp_replace(regexp_replace(substr(f, 1, 40), '-[^-]*$', ''), '-+$', '') ELSE f END AS s FROM (SELECT DISTINCT id, {_SLUG} AS f FROM leaf))""")
def slug_names(spark: SparkSession, d: str) -> DataFrame:
    return model.leaves(spark, d, "id", "text").select("id", notes.file_name(F.col("text"), F.col("id")).alias("name"))


def _one(c: str) -> str:
    return rf"replace(replace(replace(trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g')), '[', '\['), ']', '\]'), '|', '\|')"


@query(f"""SELECT i.id, '# ' || {_one("i.text")} || chr(10) || chr(10) || '**Applies.** ' || {_one("i.applicability_conditions")} || chr(10) || '**Limits.** ' || {_one("i.limitations")} || chr(10) || chr(10) || '## Leaves (' || count(l.id) || ')'
 || coalesce(chr(10) || string_agg('- [[' || l.id || ']] ' || {_one("l.effect")}, chr(10) ORDER BY l.id, l.effect), '') AS body FROM idea i LEFT JOIN (SELECT DISTINCT id, idea_id, effect FROM thesis_out) l ON l.idea_id = i.id GROUP BY i.id, i.text, i.applicability_conditions, i.limitations""")
def note_render(spark: SparkSession, d: str) -> DataFrame:
    own = model.leaves(spark, d, "id", "idea_id", "effect").where("idea_id is not null")
    item = F.struct("id", "effect", F.concat(F.lit("- "), notes.link(F.col("id")), F.lit(" "), notes.one_line(F.col("effect"))).alias("line"))
    lists = own.groupBy(F.col("idea_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = model.ideas(spark, d).join(lists, "id", "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    n = F.when(F.col("items").isNull(), 0).otherwise(n)
    tail = F.when(n > 0, F.concat(F.lit("\n"), F.array_join(F.col("items.line"), "\n"))).otherwise("")
    body = F.concat(F.lit("# "), notes.one_line(F.col("text")), F.lit("\n\n**Applies.** "), notes.one_line(F.col("applicability_conditions")), F.lit("\n**Limits.** "), notes.one_line(F.col("limitations")), F.lit("\n\n## Leaves ("), n.cast("string"), F.lit(")"), tail)
    return rows.select("id", body.alias("body"))


@query("SELECT DISTINCT id, length(text) = 400 AS text_cut, length(context) = 40 AS context_cut, length(effect) = 20 AS effect_cut FROM thesis_out WHERE text IS NOT NULL AND context IS NOT NULL AND effect IS NOT NULL")
def truncation_audit(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.audit import at_limit

    rows = model.leaves(spark, d, "id", "text", "context", "effect").dropna()
    return rows.select("id", at_limit(F.col("text"), 400).alias("text_cut"), at_limit(F.col("context"), 40).alias("context_cut"), at_limit(F.col("effect"), 20).alias("effect_cut")).distinct()


@query()
def code_names(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", leakage.code_names_udf(F.col("text")).alias("names"))


@query()
def context_names(spark: SparkSession, d: str) -> DataFrame:
    return model.leaves(spark, d, "id", "text").select("id", leakage.names_udf(F.col("text")).alias("names"))
