import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import identity, leakage, notes, safety, sections, vectors, web
from evidentia.functions.words import WORD_RE, run_hashes, sliding_min, words


def _col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


TEXTS = ["Hello  World\n", " a b　", None, "", "\x0b\x1cx\x85y", "ÄÖ ß_1 ½ x²"]


def test_normalise_as_python_does(spark):
    want = [None if t is None else re.sub(r"\s+", " ", t).strip().lower() for t in TEXTS]
    assert _col(spark, TEXTS, identity.normalise) == want
    assert _col(spark, TEXTS, identity.text_hash) == [None if w is None else hashlib.md5(w.encode()).hexdigest() for w in want]


def test_words_as_python_does(spark):
    assert _col(spark, TEXTS, words) == [None if t is None else WORD_RE.findall(t.lower()) for t in TEXTS]


def test_rolling_hashes_and_minima():
    x = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    h = run_hashes(x, 3, 12345)
    seen = {}
    for i in range(398):
        assert seen.setdefault(tuple(x[i : i + 3]), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)
    for w in (1, 2, 5, 7):
        assert (sliding_min(h, w) == [h[i : i + w].min() for i in range(398 - w + 1)]).all()
    assert len(run_hashes(x[:2], 3, 1)) == 0


def test_vector_problems(spark):
    values = [[1.0, 0.0], [0.6, 0.8], [1.0], None, [2.0, 0.0]]
    assert _col(spark, values, lambda c: vectors.problem(c, 2), "array<float>") == [None, None, "dimension", "missing", "norm"]


@pytest.mark.parametrize(
    ("url", "article", "refusal"),
    [("https://arxiv.org/abs/2406.04824v2", "2406.04824v2", None), (" http://www.arxiv.org/PDF/2406.04824V2.pdf ", "2406.04824v2", None), ("https://arxiv.org/abs/hep-th/9901001", None, "old_style"), ("https://x.org/abs/2406.04824", None, "not_article"), ("", None, "empty"), (None, None, "empty")],
)
def test_url_gate(spark, url, article, refusal):
    assert _col(spark, [url], lambda c: F.struct(web.article_id(c), web.url_refusal(c))) == [(article, refusal)]


def test_addresses_of_articles(spark):
    good = {"https://arxiv.org/abs/2406.04824": "2406.04824", "http://arxiv.org/abs/2406.04824v2": "2406.04824v2", "https://www.arxiv.org/pdf/2406.04824v2.pdf": "2406.04824v2", "https://arxiv.org/html/2406.04824v1": "2406.04824v1", "https://export.arxiv.org/abs/2406.04824/": "2406.04824", "https://arxiv.org/abs/2406.04824V2": "2406.04824v2", "  https://arxiv.org/abs/1706.03762  ": "1706.03762"}
    bad = ["https://arxiv.org/abs/", "https://arxiv.org/list/cs.LG/2406", "https://example.com/abs/2406.04824", "https://arxiv.org.evil.com/abs/1", "https://arxiv.org/abs/../../etc/passwd", "2406.04824", "https://arxiv.org/abs/2406.04824?x=1", "https://arxiv.org/abs/x#s1", "https://openreview.net/forum?id=x"]
    old = ["arxiv.org/abs/hep-th/9901001", "https://arxiv.org/abs/cond-mat.stat-mech/0012345v3"]
    assert _col(spark, list(good), web.article_id) == list(good.values())
    assert set(_col(spark, bad, web.url_refusal)) == {"not_article"} and set(_col(spark, old, web.url_refusal)) == {"old_style"}


def test_first_matching_section(spark):
    text = "# Abstract\nshort\n   ## Limitations of it\nnone known\n## Limits\nlater"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(sections.markdown_sections_udf("t").alias("s"))
    got = [tuple(r) for r in df.select(sections.first_body(F.col("s"), "limit"), sections.first_body(F.col("s"), "abstract"), sections.first_body(F.col("s"), "method")).collect()]
    assert got == [("none known", "short", ""), ("", "", "")]


def test_pages_of_discovered_addresses(spark):
    from evidentia.operators.research import extracted

    wanted = spark.createDataFrame([("http://Ex.org/a/",), ("http://ex.org/a",), ("http://ex.org/b",)], "url string")
    pages = spark.createDataFrame([("http://ex.org/a", "text"), ("http://ex.org/b", " "), ("http://ex.org/c", "x")], "url string, content string")
    assert [r.content for r in extracted(wanted, pages).collect()] == ["text"]
    assert _col(spark, ["<p>" + "ab " * 900 + "</p>"], web.abstract_of) == [("ab " * 400)]


def test_what_a_text_still_says(spark):
    names = F.array(F.lit("ImageNet"), F.lit("Adam"))
    got = _col(spark, ["on imagenet up 70 by helper_fn", "clean"], lambda c: leakage.violations(c, F.lit("-70 %"), names, F.array(F.lit("helper_fn"), F.lit("up"))))
    assert [[tuple(x) for x in row] for row in got] == [[("number", "70"), ("name", "ImageNet"), ("term", "helper_fn")], []]


def test_markup_of_pages(spark):
    page = "<!DOCTYPE html><h2 id='a'>T &eacute;</h2><p>it&#8217;s&nbsp;5 &amp;lt; 6</p><style>x</style><h3>U</h3>b<!-- c -->"
    assert _col(spark, [page], web.strip_tags) == ["T éit’s 5 < 6Ub"]
    assert _col(spark, [page], lambda c: web.strip_tags(c, True)) == ["## T é\nit’s 5 < 6\n\n### U\nb"]


def test_urls(spark):
    got = _col(spark, ["HTTP://Ex.org/A/?q=1#f", "https://ex.org", "https://ex.org/a//"], web.canonical)
    assert got == ["http://ex.org/A?q=1", "https://ex.org/", "https://ex.org/a"]
    public = _col(spark, ["https://ex.org/a", "http://127.0.0.1/", "http://10.1.1.1", "ftp://ex.org", "http://u@ex.org", "http://localhost:8000", "http://172.20.1.1", None], web.is_public)
    assert public == [True, False, False, False, False, False, False, False]


def test_pages(spark):
    page = '<p>a</p><ARTICLE class="x">b <script>z</script><b>c</b> &amp; d</ARTICLE>'
    assert _col(spark, [page, "<main>m</main>", "plain < 3", None], lambda c: web.strip_tags(web.article_body(c))) == ["b c & d", "m", "plain < 3", None]


def test_chunks(spark):
    df = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n))) for n in (0, 1, 10, 11, 19, 20, 55)] + [(99, None)], "k int, text string")
    got = {}
    for r in sections.chunks(df, "k", "text", 10, 2).orderBy("k", "chunk_no").collect():
        got.setdefault(r.k, []).append(r.text.split())
    assert 0 not in got and 99 not in got
    for n, parts in got.items():
        want, start = [], 0
        while True:
            want.append([f"t{i}" for i in range(start, min(n, start + 10))])
            if start + 10 >= n:
                break
            start += 8
        assert parts == want


def test_sections(spark):
    text = "intro\n# One\n\nbody\n## Two\n\n# Three \nx\ny"
    assert [(s["title"], s["text"]) for s in sections.markdown_sections(text)] == [("One", "body"), ("Three", "x\ny")]
    assert sections.markdown_sections(None) == []
    html = '<div class="ltx_abstract"><p>abs</p></div><section class="ltx_section"><h2>T</h2><p>a</p><section class="ltx_subsection"><h3>s</h3>b</section></section><section class="ltx_bibliography"><h2>R</h2>c</section>'
    assert [(s["kind"], s["title"], s["text"]) for s in sections.article_sections(html)] == [("abstract", "", "abs"), ("section", "T", "asb"), ("bibliography", "R", "c")]
    df = spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "k int, text string")
    assert [r.title for r in sections.sections(df, "k", "text").orderBy("id").collect()] == ["One", "Three"]


def test_leakage(spark):
    assert _col(spark, ["up 3.5 from 2 and 3.5"], lambda c: leakage.leaked_numbers(F.lit("2 -> 3.5, 9"), c)) == [["2", "3.5"]]
    assert _col(spark, ["the MAP works", "mapping", "map-elites", None, "a map."], lambda c: leakage.mentions(c, F.lit("map"))) == [True, False, False, False, True]
    assert leakage.names("Evaluated on ImageNet with Adam. Then GSM8K, bert.") == ["Adam", "GSM8K", "ImageNet"]
    code = "def entry_point():\n    x = helper(1)\n    return {'system_prompt': 'You MUST answer (an integer)', 'n': someThing}\n"
    assert leakage.code_names(code) == ["entry_point", "helper", "someThing"]
    assert "broken_fn" in leakage.code_names("def broken_fn(:\n  '''")
    assert leakage.code_names("# note_one\nx = 'no_name' + \"other_one\" # last_one\nMUST = fooBar") == ["fooBar"]
    assert leakage.code_names('"""doc_string\nmore_doc"""\ncall_me (1); run(2)') == ["call_me", "run"]
    assert leakage.code_names("it's the some_name\nhere") == ["some_name"]
    assert leakage.code_names(None) == []


def test_notes(spark):
    assert _col(spark, ["a [[b]] | c\n d", None], notes.one_line) == ["a \\[\\[b\\]\\] \\| c d", ""]
    long = "Some Very long title that goes on and on for ever and more"
    assert _col(spark, [long, "!!", None], notes.slug) == ["some-very-long-title-that-goes-on-and", "", ""]
    assert _col(spark, ["x"], lambda c: notes.file_name(c, F.lit("../up"))) == [None]
    assert _col(spark, ['say "hi": [x]\n\x07'], notes.scalar) == ['"say \\"hi\\": \\\\[x\\\\]\\n"']
    assert _col(spark, ["v"], lambda c: notes.frontmatter({"a": c, "b": F.lit(None).cast("string")})) == ["---\na: v\n---\n"]


def test_safety(spark):
    assert _col(spark, ["api_key: xyz", "nothing", None, "ghp_0123456789abcdefXY"], safety.has_secret) == [True, False, False, True]
    pair = lambda c: safety.jaccard(safety.token_set(c), safety.token_set(F.lit("alpha beta gamma")))
    assert _col(spark, ["Alpha beta", "of", ""], pair) == [2 / 3, 0.0, 0.0]


def test_stems_of_the_published_examples():
    from evidentia.functions.stem import plain, stem

    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit digitizer digit vietnamization vietnam operator oper feudalism feudal hopefulness hope triplicate triplic electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt effective effect rate rate cease ceas controll control roll roll"
    w = pairs.split()
    assert [stem(a) for a in w[::2]] == w[1::2]
    assert plain("Éàü") == "Eau" and plain(None) is None and stem("x2") == "x2"
