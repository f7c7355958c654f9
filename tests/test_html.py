"""The JVM page parser against the standard library, on real and broken pages."""

import random

from pyspark.sql import functions as F

from html_oracle import parse_tree
from pagequarry.functions.html import element_text
from pagequarry.operators.extract import nodes, shred

HAND_WRITTEN = [
    "<html><p>a</p><p>b<b>c</p>d</html>",
    "<p>no root</p>",
    "<html><p>one<p>two</html>",
    "<html></p>stray<i>x</i></b></html>",
    "<html><br>a<br/>b</br>c<img src=x>d<hr/></html>",
    '<html><a title="a>b" href=\'x y\' data-x=1 disabled>t</a></html>',
    "<html><script>var t='</p><b>';</script><style>p > a {}</style><p>x</p></html>",
    "<html><script src=a.js></script>z<SCRIPT>1</Script>y</html>",
    "<html><!-- <p>no</p> --><p>yes</p><!----><!doctype x><?php a ?>t</html>",
    "<html><p>&amp;&lt;&copy;&nbsp;&eacute;&#65;&#x41;&#150;&bogus;&amp x &copy2 &notit;</p></html>",
    '<html><a href="?a=1&amp;b=2&copy=3&notit;&#x26;x&bogus;">q</a></html>',
    "<html><div>  <p>a</p>   \n  <p> b </p></div></html>",
    "<html><pre>  <b> </b>  </pre>  <i> </i>  <textarea>   </textarea>   </html>",
    "<html><template>t<p>in</p></template><ruby>k<rt>r</rt><rp>(</rp></ruby>x</html>",
    "<html><div/>a<span class='a  b'/>b</html>",
    "<html><p a=1 a=2 A=3>dup</p></html>",
    "<html><p>1 < 2 <3 a<b c</p></html>",
    "<html><p>cut here <b>and the",
    "<html><p>cut in tag <b class='x",
    "<html><p>cut in entity &am",
    "<html><p>entity at end &amp",
    "<html><![CDATA[ raw <b> ]]><p>x</p></html>",
    "<html><a href=foo/>x</a><a href=foo />y</html>",
    "<HTML><BODY><P CLASS=Big>U</P></BODY></HTML>",
    "<html></ p>x</html ><p/ >q",
    "<html><p it's>quote</p><p =x>eq</p><p/a/b=c>slash</p></html>",
    "",
    "plain text only &amp; more",
]
PIECES = (
    ["<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", "<br>", "<br/>", "<i/>", "<li>"]
    + ["</li>", "<ul>", "</ul>", "<!-- c <b> -->", "<script>a</b></script>", "<style>x</style>"]
    + ["<pre>", "</pre>", "<template>", "</template>", "<rt>", "</rt>", "&amp;", "&lt;", "&#65;"]
    + [" ", "\n  ", "text", "a < b", "é", "<a href=\"/x?a=1&amp;b\">", "</a>", "<img alt='>'>"]
    + ["</nope>", "<?pi?>", "<!x>", "</>", "&bogus;", "<p id=1 id=2>", "<textarea>", "</textarea>"]
)


def fuzz(count: int) -> list[str]:
    rnd = random.Random(7)
    return [
        "<html>" + "".join(rnd.choices(PIECES, k=rnd.randint(1, 60))) for _ in range(count)
    ]


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string").repartition(4)
    rows = (
        shred(df)
        .select(
            "page_id",
            F.transform(
                "dom.nodes",
                lambda e: F.struct(
                    e["tag"].alias("tag"),
                    e["depth"].alias("depth"),
                    e["attrs"].alias("attrs"),
                    element_text(F.col("dom.texts"), e).alias("text"),
                ),
            ).alias("nodes"),
        )
        .collect()
    )
    return {r.page_id: [n.asDict() for n in r.nodes] for r in rows}


def check(spark, texts):
    got = parsed(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == parse_tree(t), t


def test_hand_written_pages(spark):
    check(spark, HAND_WRITTEN)


def test_random_markup(spark):
    check(spark, fuzz(400))


def test_all_given_pages(spark, sf):
    check(spark, [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])


def test_large_and_deep_pages(spark):
    wide = "<html>" + "<p>x</p>" * 20000
    deep = "<html>" + "<p>x" * 300 + "</html>"
    got = parsed(spark, [wide, deep])
    assert len(got[0]) == 20001 and got[0][0]["text"] == "x" * 20000
    assert [n["depth"] for n in got[1]] == list(range(301))


def test_node_table_intervals(spark):
    page = "<html><ul><li>a</li><li>b<i>c</i></li></ul><p>d</p></html>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = nodes(df).select("n", "last", "parent", "tag").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [
        (0, 5, -1, "html"),
        (1, 4, 0, "ul"),
        (2, 2, 1, "li"),
        (3, 4, 1, "li"),
        (4, 4, 3, "i"),
        (5, 5, 0, "p"),
    ]
