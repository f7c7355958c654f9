"""Selector trees, CSS, extractors, modifiers and edge values."""

import json
from datetime import datetime, timezone

import pytest
from pagequarry.functions.jsonpath import json_matches
from pagequarry.functions.modifiers import regex_modifier
from pagequarry.operators.extract import components, extract, shred_for
from pagequarry.plans.spec import SpecError, parse_selector, resolve
from pyspark.sql import functions as F

def leaf(key, css=None, **kw):
    return {"key": key, **({"selector": css} if css else {}), **kw}


ALL = {"select": "all"}
DATE = {"modifiers": [{"type": "iso_date_parser"}]}


def jp(key, path, **kw):
    return leaf(key, "pre", extract={"type": "jsonpath", "path": path}, **kw)


def regex(*patterns, **kw):
    return {"type": "regex", "regex": list(patterns), **kw}


FIRST = {"return": "first"}

#: A recipe: lists in sections, one section inside another.
RECIPE = """<html><body><h1>Flat <i>bread</i></h1>
<section class="steps"><ol><li>Mix <b>flour</b> and water</li><li>Rest 20 min</li></ol><aside>Serves 4</aside></section>
<section class="tips"><ul><li>Keeps 3 days</li></ul><section><ol><li>Bake at 240</li></ol></section></section>
</body></html>"""
RECIPE_TREES = [
    (leaf("title", "h1"), "Flat bread"),
    (leaf("step", "ol li", **ALL), ["Mix flour and water", "Rest 20 min", "Bake at 240"]),
    (leaf("part", "section", child=leaf("line", "li")), {"line": "Mix flour and water"}),
    # a section's lines hold those of the section in it
    (
        leaf("part", "section", **ALL, child=leaf("line", "li", **ALL)),
        [{"line": ["Mix flour and water", "Rest 20 min"]}, {"line": ["Keeps 3 days", "Bake at 240"]}, {"line": ["Bake at 240"]}],
    ),
    # parts without a find leave nothing behind
    (leaf("part", "section", **ALL, child=leaf("bold", "b")), [{"bold": "flour"}]),
    (leaf("part", "section", **ALL, child=leaf("image", "img")), None),
    # blocks in page order, whatever the order in the selector; an element is below itself only with include_self
    (
        leaf("block", "aside, ol", **ALL, children=[leaf("last", "li:last-child"), leaf("note", "aside", include_self=True)]),
        [{"last": "Rest 20 min"}, {"note": "Serves 4"}, {"last": "Bake at 240"}],
    ),
    (leaf("block", "aside", **ALL, children=[leaf("note", "aside")]), None),
    # the wrapper is a div of its own, the element's ancestors are out of sight
    (leaf("bold", "li b", child=leaf("word", "div > b", include_self="true")), {"word": "flour"}),
    (leaf("bold", "li b", child=leaf("word", "ol b", include_self=True)), None),
    (
        leaf("tips", ".tips", **ALL, children=[leaf("tip", "ul li"), leaf("inner", "section", **ALL, children=[leaf("heat", "li", **ALL)])]),
        [{"tip": "Keeps 3 days"}, {"inner": [{"heat": ["Bake at 240"]}]}],
    ),
    # children of a first selector look at the whole page, if it has a match
    (leaf("tips", ".tips", children=[leaf("line", "section li", **ALL), leaf("title", "h1")]),
     [{"line": ["Mix flour and water", "Rest 20 min", "Keeps 3 days", "Bake at 240"]}, {"title": "Flat bread"}]),
    (leaf("tips", ".tricks", children=[leaf("title", "h1")]), None),
    (leaf("twice", "ol", children=[leaf("li", "ul li"), leaf("li", "aside")]), [{"li": "Keeps 3 days"}, {"li": "Serves 4"}]),
]

LEDGER = """<html><table><tr><td>INV-0042 paid</td><td>12,50 EUR</td></tr><tr><td>INV-77 open</td><td>n/a</td></tr>
<tr><td>credit [note] é1</td><td>-3 EUR</td></tr></table></html>"""
LEDGER_TREES = [
    # without a selector: every element; without a result mode: the first of them, the table
    (leaf("any"), "INV-0042 paid12,50 EURINV-77 openn/a\ncredit [note] é1-3 EUR"),
    (leaf("no", "td:first-child", **ALL, modifiers=[regex(r"^INV-\d+")]), ["INV-0042 paid", "INV-77 open"]),
    (leaf("no", "td:first-child", **ALL, modifiers=[regex(r"\d{3,}", r"\d+", **FIRST)]), ["0042", "77", "1"]),
    # patterns count in the order of the list, not of the text; what is no pattern is passed over
    (leaf("sum", "td + td", modifiers=[regex("*x", "(", "EUR$", r"\d+", **FIRST)]), "EUR"),
    (leaf("no", "td:first-child", **ALL, modifiers=[regex(r"INV-\d+", **FIRST), regex("7")]), ["INV-77"]),
    (leaf("no", "td", **ALL, modifiers=[regex("USD")]), None),
    (leaf("note", "tr:last-child td", modifiers=[regex(r"(?P<open>[[])\w+\] \w(?P=open)?\d", **FIRST)]), "[note] é1"),
]

HARBOUR = r"""<html><pre>{"berths": [{"ship": {"name": "Ida", "t": 310.50}, "free": false}, {"ship": null, "free": true},
 {"ship": {"name": "Q\"\u00fc", "t": 1e21, "crew": [{"name": 4}]}}], "tide": [5, 8, 13, 21], "port": {"code": "NOR"}}</pre></html>"""
HARBOUR_TREES = [
    (jp("code", "$.port.code"), "NOR"),
    (jp("code", "$['port']['code']"), "NOR"),
    (jp("name", "$..name"), ["Ida", 'Q"ü', "4"]),
    (jp("name", "$.berths[*].ship.name"), ["Ida", 'Q"ü']),
    (jp("name", "$.berths..name", modifiers=[regex("^I")]), ["Ida"]),
    (jp("tide", "$.tide[2]"), "13"),
    (jp("tide", "$.tide[-1]"), "21"),
    (jp("tide", "$.tide[1:3]"), ["8", "13"]),
    (jp("tide", "tide[*]"), ["5", "8", "13", "21"]),
    (jp("free", "$.berths[*].free"), ["False", "True"]),
    (jp("ship", "$.berths[1].ship"), "None"),
    (jp("load", "$.berths[?(@.free = false)].ship.t"), "310.5"),
    (jp("load", "$.berths[2].ship.t"), "1e+21"),
    (jp("port", "$.port"), '{"code":"NOR"}'),
    (jp("none", "$.berths[7]"), None),
]

PAGES_OF_TREES = {"recipe": (RECIPE, RECIPE_TREES), "ledger": (LEDGER, LEDGER_TREES), "harbour": (HARBOUR, HARBOUR_TREES)}

CASES = {
    "jsonpath on bad json": ("<html><pre>{a:</pre></html>", jp("m", "$.a"), None),
    "attribute": (
        "<html><a href=' /x ' rel='a b' class=' c  d '>t</a><b rel='a b'>u</b><i class=''>v</i></html>",
        leaf("k", children=[
            leaf("href", "a", extract={"type": "attribute", "key": "href"}),
            leaf("class", "a", extract={"type": "attribute", "key": "class"}),
            leaf("rel", "a", extract={"type": "attribute", "key": "rel"}),
            leaf("plain", "b", extract={"type": "attribute", "key": "rel"}),
            leaf("empty", "i", extract={"type": "attribute", "key": "class"}),
            leaf("none", "a", extract={"type": "attribute", "key": "id"}),
            leaf("all", "a, b", **ALL, extract={"type": "attribute", "key": "rel"}),
        ]),
        {"k": [
            {"href": "/x"}, {"class": ["c", "d"]}, {"rel": ["a", "b"]}, {"plain": "a b"},
            {"all": [["a", "b"], "a b"]},
        ]},
    ),
    "html": (
        "<html><div b=2 a='x\"y'>t &amp; <i>&lt;u</i><br><!-- c --><p>open<img src=x></div></html>",
        leaf("h", "div", extract={"type": "html"}),
        {"h": '<div a=\'x"y\' b="2">t &amp; <i>&lt;u</i><br/><!-- c --><p>open<img src="x"/></p></div>'},
    ),
    "html of script and empty": (
        "<html><div><script>a<b</script><i/><b></b></div></html>",
        leaf("h", "div", extract={"type": "html"}),
        {"h": "<div><script>a<b</script><i></i><b></b></div>"},
    ),
    "empty text stays": ("<html><p> </p><p>x</p></html>", leaf("k", "p", **ALL), {"k": ["", "x"]}),
    "no html element": ("<p>x</p>", leaf("k", "p"), None),
    "unicode blanks": ("<html><p>   a  b　</p></html>", leaf("k", "p"), {"k": "a  b"}),
    "script text on its own": ("<html><div>a<script>b</script>c</div></html>", leaf("k", "div"), {"k": "ac"}),
}


def run(spark, html, raw):
    selector = parse_selector(raw)
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    row = extract(df, selector, as_json=True).collect()[0]
    return None if row.components is None else json.loads(row.components)


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    html, raw, want = CASES[name]
    assert run(spark, html, raw) == want


@pytest.mark.parametrize("name", PAGES_OF_TREES)
def test_trees_of_a_page(spark, name):
    html, trees = PAGES_OF_TREES[name]
    for raw, want in trees:
        assert run(spark, html, raw) == (None if want is None else {raw["key"]: want}), raw


def test_date_modifiers(spark):
    """Times of a page in several forms, cut out by a pattern first; numbers are in the session's zone."""
    at = datetime(2019, 3, 9, 17, 45, 30)
    texts = {
        "iso": (at.isoformat() + "+03:00", "2019-03-09T17:45:30+03:00"),
        "words": (f"{at:%d %B %Y %H:%M}", "2019-03-09T17:45:00"),
        "zone": (f"{at:%d %b %Y %H:%M} PST", "2019-03-09T17:45:00-08:00"),
        "short": (str(int(at.replace(tzinfo=timezone.utc).timestamp())), "2019-03-09T20:45:30"),
        "long": (f"{int(at.replace(tzinfo=timezone.utc).timestamp())}999", "2019-03-09T20:45:30"),
        "none": ("soon", None),
    }
    html = "<html>" + "".join(f"<b class='{k}'>No. 7 | {t}</b>" for k, (t, _) in texts.items()) + "</html>"
    mods = [regex("(?<=[|] ).*", **FIRST), {"type": "iso_date_parser"}]
    raw = leaf("at", "b", children=[leaf(k, f".{k}", modifiers=mods) for k in texts])
    spark.conf.set("spark.sql.session.timeZone", "Etc/GMT-3")
    try:
        assert run(spark, html, raw) == {"at": [{k: want} for k, (_, want) in texts.items() if want]}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


PAGE = (
    '<html><head><title>t</title></head><body id="b">'
    '<div class="x y" id="d1"><p>1</p><p>2</p><span>3</span><p>4</p></div>'
    '<div class="y" data-k="abc-def" lang="en-US"><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul>'
    '<div class="z"><p>5<b>6</b></p></div></div>'
    '<p>7</p><h2>h</h2><p>8</p><em>e</em><p>9</p><INPUT TYPE="Text" value="">'
    "</body></html>"
)
CSS = {
    "div.y > p": ["1", "2", "4"],
    ".x p": ["1", "2", "4"],
    ".x.y > span": ["3"],
    "div div p": ["56"],
    "body > div p": ["1", "2", "4", "56"],
    "#d1 > p, li": ["1", "2", "4", "a", "b", "c", "d"],
    "p:first-of-type": ["1", "56", "7"],
    "div#d1 p:nth-of-type(2)": ["2"],
    "li:nth-child(odd)": ["a", "c"],
    "li:nth-child(2n)": ["b", "d"],
    "li:nth-child(-n+2)": ["a", "b"],
    "li:nth-last-child(2)": ["c"],
    "li:last-child": ["d"],
    "p:last-of-type": ["4", "56", "9"],
    "span:only-of-type": ["3"],
    "li:not(:first-child)": ["b", "c", "d"],
    "h2 + p": ["8"],
    "h2 ~ p": ["8", "9"],
    "h2 ~ em + p": ["9"],
    "p + p": ["2"],
    "[data-k]": ["abcd56"],
    "[data-k=abc-def] li:first-child": ["a"],
    "[data-k^=abc] b": ["6"],
    "[data-k$='def'] b": ["6"],
    "[data-k*='c-d'] b": ["6"],
    "[class~=x] span": ["3"],
    "[class*=z] p": ["56"],
    "[lang|=en] b": ["6"],
    "[type=text]": [""],
    "p:has(b)": ["56"],
    "div:has(> ul) li:first-child": ["a"],
    "p:has(+ span)": ["2"],
    "h2:has(~ em)": ["h"],
    ":is(h2, em)": ["h", "e"],
    "body :not(div):not(ul) > b": ["6"],
    "body *:is(.x, .z) > p": ["1", "2", "4", "56"],
    "article p": None,
    "html p": ["1", "2", "4", "56", "7", "8", "9"],
}


def test_css(spark):
    page = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    names = list(CSS)
    for start in range(0, len(names), 8):
        part = names[start : start + 8]
        trees = [parse_selector(leaf("k", css, **ALL)) for css in part]
        df = shred_for(page, *trees)
        cols = [components("dom", t).alias(f"v{i}") for i, t in enumerate(trees)]
        row = df.select(*cols).collect()[0]
        for i, css in enumerate(part):
            assert row[f"v{i}"] == CSS[css], css


def test_typed_result(spark):
    s = parse_selector(leaf("part", "section", **ALL, child=leaf("line", "li")))
    df = spark.createDataFrame([(1, RECIPE)], "page_id int, html string")
    out = extract(df, s)
    assert out.schema["components"].dataType.simpleString() == "array<struct<c0:string>>"
    assert [r.c0 for r in out.collect()[0].components] == ["Mix flour and water", "Keeps 3 days", "Bake at 240"]


def test_common_selector(spark):
    common = {"a": parse_selector({"common_selector": "b"}), "b": parse_selector(leaf("k", "[id='1']"))}
    s = resolve(parse_selector({"common_selector": "a"}), common)
    df = spark.createDataFrame([(1, "<html><p id=1>x</p></html>")], "page_id int, html string")
    assert extract(df, s, as_json=True).collect()[0].components == '{"k":"x"}'


def test_shop_page(spark):
    """A tree with hooks, positions and nested lists, over a page of offers."""
    html = """<html><body><ol class="offers wide">
      <li data-sku="a-1"><a href="/lamp">Lamp &amp; bulb</a><dl><dt>Price<dd><em>12</em> <s>15</s></dd></dl>
        <ul><li><img src="l1.png" alt="front"></li><li><img src="l2.png"></li></ul><time>4 June 2019 18:30</time></li>
      <li data-sku="b-2"><a href="/desk"> Desk </a><dl><dt>Price<dd><em>90</em></dd></dl></li>
    </ol><p class=note>Two <i>offers</i>.</p></body></html>"""
    raw = leaf("offer", "ol.offers > li[data-sku]", select="all", children=[
        leaf("name", "a:first-child"),
        leaf("to", "a", extract={"type": "attribute", "key": "href"}),
        leaf("old", "dl s:last-child"),
        leaf("price", "[class*=none], dd > em:nth-of-type(1)"),
        leaf("pictures", "ul li", select="all", children=[
            leaf("src", "img", extract={"type": "attribute", "key": "src"}),
            leaf("alt", "img[alt]", extract={"type": "attribute", "key": "alt"}),
        ]),
        leaf("until", "time", **DATE),
    ])
    assert run(spark, html, raw) == {"offer": [
        {"name": "Lamp & bulb"}, {"to": "/lamp"}, {"old": "15"}, {"price": "12"},
        {"pictures": [{"src": "l1.png"}, {"alt": "front"}, {"src": "l2.png"}]}, {"until": "2019-06-04T18:30:00"},
        {"name": "Desk"}, {"to": "/desk"}, {"price": "90"},
    ]}


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [
        ('{"a":1,"a":2}', "$.a", ["2"]),
        ('{"a":2,"b":NaN}', "$.a", ["2"]),
        ('{"a":"NaN -Infinity","b":[NaN,-Infinity,Infinity]}', "$.b[*]", ["nan", "-inf", "inf"]),
        ('{"a":"NaN -Infinity","b":NaN}', "$.a", ["NaN -Infinity"]),
        ('{"a":1,"a":[3]}', "$.a[0]", ["3"]),
        ("{a:NaN", "$.a", None),
        ("", "$.a", None),
    ],
)
def test_unusual_json(spark, text, path, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(json_matches(F.col("t"), path).alias("m")).first().m == want


PATTERNS = ["{.*}", '{"a"', "a{,3}b", r"\0", r"\U0001F600", r"x\vy", r"\x41{2}", "a{2,}", r"[{}]+", "}", r"\101", "x{,}", "é{1}"]


def test_patterns_agree_with_python(spark):
    import re

    texts = ['var x = {"a": 1};', "aab b", "\0", "😀", "x\vy", "x\ny", "AA", "a{,}", "ééé", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for p in PATTERNS:
        found = df.select("i", regex_modifier(F.col("t"), [p], "first").alias("m")).collect()
        want = {i: m.group() if (m := re.search(p, t)) else None for i, t in enumerate(texts)}
        assert {r.i: r.m for r in found} == want, p
    with pytest.raises(SpecError):
        regex_modifier(F.col("t"), ["(x)?(?(1)a|y)"])
