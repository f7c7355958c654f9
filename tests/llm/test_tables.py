"""Conversations, pages, the registered queries and the pipeline."""

import hashlib
import html as markup
import random
import re
import time
from collections import Counter

import corpus_pipeline
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from pagequarry.llm.chat import PART, format_turns, read_back, read_turn, text_part
from pagequarry.llm.components import connected
from pagequarry.llm.pages import LEAST_PAGES, LENGTH, main_text, parse
from pagequarry.llm.queries import ORACLE, QUERIES

TURNS = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- chat


def test_turns_read_back(spark):
    texts = ["", None, "\\### Assistant: </turn> ok", "\\l\\b\\h\\0 <image> # \\", "a\nb", "é😀"]
    rows = [(i % 4 or None, i // 3, ("user", "assistant", None, "a: <#\\")[i % 4], texts[i % 6]) for i in range(48)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit(1))
    turns = format_turns(df.withColumn("parts", text_part(F.col("text"))))
    assert Counter(read_turn(r.piece) for r in turns.collect()) == Counter((r[2], r[3] or "") for r in rows)
    got = {r.conv_id: r for r in read_back(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        learned = [r[3] or "" for r in own if r[2] == "assistant"]
        assert got[conv].n_turns == len(own)
        assert got[conv].loss_chars == sum(map(len, learned))
    only = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None)], TURNS)
    r = read_back(format_turns(only.withColumn("parts", text_part(F.col("text"))))).first()
    assert r.turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert r.loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert read_back(format_turns(df.limit(0).withColumn("parts", text_part(F.col("text"))))).collect() == []


def test_typed_parts(spark):
    parts = [
        ("text", "see <image> ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None),
        ("audio", None, "a.wav", None, None, 1.01, None), ("document", None, "d.pdf", None, None, None, 3),
        ("video", None, "v", None, None, None, None), None, ("text", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{PART}>")
    one, two = format_turns(df).orderBy("turn").collect()
    assert one.piece == "### assistant: see \\limage> <image><audio><document><other></turn>\n"
    assert [tuple(a) for a in one.attachments] == [("s3://i", "image", 3), ("a.wav", "audio", 26), ("d.pdf", "document", 1536), ("v", "video", None)]
    assert one.expanded_tokens == 3 + 26 + 1536
    assert one.piece[one.loss_start : one.loss_end] == "see \\limage> <image><audio><document><other>"
    assert two.piece == "### user: </turn>\n" and two.loss_start is None and two.expanded_tokens == 0


# ---------------------------------------------------------------- pages


def test_parse():
    page = (
        "<html><body class='has-sidebar'><div class='sidebar wrap'><header>top</header><div class='cookie-notice'>we</div>"
        "<article><header><h1>T&amp;t</h1></header>A  b\n c<b>d</b><br>e<script>var x='</p>'</script><aside>q</aside>"
        "<form>f</form><section id='comments'><article class='comment'>no</article></section><p>last</article><div>rest</div>"
    )
    assert [b[0] for b in parse(page) if b[1]] == ["T&t", "A b cd e", "last"]
    assert [b[0] for b in parse(page) if b[2]] == ["rest"]
    assert parse(None) == [] and parse("<![if x]><p>y") == [("y", False, True)]


def test_wrappers_of_whole_pages_hide_nothing():
    def shown(page):
        return [b[0] for b in parse(page) if b[1] or b[2]]

    form = "<body><form><header>top</header>{}<button>Send</button></form><footer>end</footer></body>"
    assert shown(form.format("<main><h1>T</h1><p>text</p><form>mail</form></main>")) == ["T", "text"]
    assert shown("<nav><ul><li>Home</ul><article><p>text</p></article>") == ["text"]
    long = " ".join(f"word{i}" for i in range(30))
    assert shown(form.format(f"<div>{long}</div>")) == [long]
    assert shown(form.format("<label>Name</label>")) == []
    assert shown(f"<form><article>card</article></form><article>{long}</article>") == [long]
    assert shown(f"<form><p>{long}</p></form><p>text</p>") == ["text"]


@pytest.mark.parametrize("page", ["<div>" * 8000 + "x" + "</p>" * 100_000, "<b>" * 20_000 + "<div>x</b></div>" * 20_000])
def test_end_tags_without_a_match_cost_little(page):
    begin = time.perf_counter()
    assert {b[0] for b in parse(page)} == {"x"}
    assert time.perf_counter() - begin < 20


def test_repeated_strings_go_from_open_pages(spark):
    common = "All rights reserved by the example company of this site in the year of writing."
    pages = [
        (i, f"http://h.org/{i}", f"<div>{common}</div><div>Own{i} words number{i} of page{i} and more{i}</div><ul><li><a href=x>Home page</a></ul>")
        for i in range(2 * LEAST_PAGES)
    ]
    pages += [(90, "http://other.org/", f"<p>{common}</p>"), (91, None, None), (92, "x", ""), (91, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("text", F.lit(1))
    got = sorted((r.page_id, r.text) for r in main_text(df).collect())
    want = [(i, f"Own{i} words number{i} of page{i} and more{i}") for i in range(2 * LEAST_PAGES)]
    assert got == [*want, (90, common), (91, ""), (91, ""), (92, "")]
    assert main_text(df.limit(0)).collect() == []


def test_repeated_strings_do_not_depend_on_the_size_of_the_host(spark):
    notice = "This section of the paper is brought to you by the friends of the old town library."
    for others in (0, 60):
        pages = [(i, f"http://h.org/{i}", f"<div>{notice}</div><div>Own{i} words number{i}</div>") for i in range(2 * LEAST_PAGES)]
        pages += [(100 + i, f"http://h.org/{100 + i}", f"<div>Other{i} words without{i} any{i} notice{i}</div>") for i in range(others)]
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = {r.page_id: r.text for r in main_text(df).collect()}
        assert [got[i] for i in range(2 * LEAST_PAGES)] == [f"Own{i} words number{i}" for i in range(2 * LEAST_PAGES)]


def test_strings_that_articles_repeat_go_and_text_beside_teasers_stays(spark):
    notice = "Support our work: become a member of the club for a small sum each month!"
    pages = [
        (i, f"http://h.org/{i}", f"<article><p>Own{i} text{i} of{i} this{i}. {notice} More{i} text{i}</p></article><div>Beside{i} it{i}</div>")
        for i in range(2 * LEAST_PAGES)
    ]
    whole = "A page that is stored in many copies keeps its text, whatever number of copies there are."
    pages += [(50, "http://h.org/50", f"<article>{whole}</article>")] * (2 * LEAST_PAGES)
    pages += [(60, "http://h.org/60", "<div>The real text of this page is in a plain element.</div><article>Teaser</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in main_text(df).collect())
    want = [(i, f"Own{i} text{i} of{i} this{i}. More{i} text{i} Beside{i} it{i}") for i in range(2 * LEAST_PAGES)]
    assert got == [*want, *[(50, whole)] * (2 * LEAST_PAGES), (60, "The real text of this page is in a plain element. Teaser")]


def test_strings_of_hosts_in_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("pagequarry.llm.pages.SHARD_BYTES", 1000)
    rng = random.Random(3)
    lines = [" ".join(f"{rng.choice('abcde')}{rng.randrange(99)}é" for _ in range(rng.randrange(3, 30))) for _ in range(40)]
    pages = [(i, f"http://h{i % 3}.org/", "\n".join(rng.sample(lines, 4) + [f"p{i} q{i}"])) for i in range(90)]
    df = spark.createDataFrame([(i, u, "<p>" + t.replace("\n", "<p>")) for i, u, t in pages], "page_id long, url string, html string")

    def strings(text):
        t = text.encode()
        words = list(re.finditer(rb"\S+", t))
        places = {m.start() for m in words} | {m.end() - LENGTH for m in words}
        return {a: t[a : a + LENGTH] for a in places if 0 <= a <= len(t) - LENGTH}

    count = Counter((u, s) for _, u, t in pages for s in set(strings(t).values()))
    got = {r.page_id: r.text for r in main_text(df).collect()}
    for i, u, t in pages:
        gone = {b for a, s in strings(t).items() if count[u, s] >= LEAST_PAGES for b in range(a, a + LENGTH)}
        words = [m for m in re.finditer(rb"\S+", t.encode()) if not set(range(*m.span())) <= gone]
        assert got[i] == " ".join(m.group().decode() for m in words)
    assert len({len(t) for t in got.values()}) > 3


def test_pages_stay_where_they_were_parsed(spark):
    notice = "This section of the paper is brought to you by the friends of the old town library."
    own = [" ".join(f"w{i}x{k}" for k in range(3000)) for i in range(520)]  # three parts in one task
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<p>{t}</p><p>{notice}</p>") for i, t in enumerate(own)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tables = spark.conf.get(name, None), spark.catalog.listTables()
    texts = main_text(df)
    assert (spark.conf.get(name, None), spark.catalog.listTables()) == (before, tables)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # only what was found moves
    for _ in range(2):
        assert {r.page_id: r.text for r in texts.collect()} == dict(enumerate(own))


def test_articles_of_given_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in main_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        assert got[r.page_id].text == " ".join(markup.unescape(text).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


# ---------------------------------------------------------------- components, queries, pipeline


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (7, 7), (3, 200)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 50: 50, 70: 50, 100: 50}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], sf) is None


def test_stages(spark, docs, no_docs, sf):
    for table in (docs.drop("quality"), no_docs):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()


def test_pipeline_on_given_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaks = {r.doc_id for r in QUERIES["op6_benchmark_leaks"](spark, sf).collect()}
    good = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, sf).collect() if r.kept}
    assert ids and ids <= good and not ids & leaks
    assert sorted(r.start for r in out)[0] == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    assert docs.count() > len(ids)
