"""Selector trees as one nested expression per page.

``extract`` is a narrow projection: it parses the HTML of a row and evaluates
the selector tree with array functions.  No row leaves its task, so the cost
grows with the text alone and no key can be hot.

The result type follows the tree: a leaf is a string or an array of strings, a
child a struct, a list of children an array of structs with exactly one
non-null field each.  Fields are named by position (``c0``, ``c1``, ...),
because sibling keys may repeat; ``to_json_text`` writes them under their keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import at, let, null_if_empty, per_application, with_once
from ..functions.css import Matcher, uses_attributes
from ..functions.html import (
    ALL_TEXT,
    ATTRIBUTES,
    LIST_ATTRIBUTES,
    MARKUP,
    NODE_TYPE,
    TEXTS,
    VOID,
    attribute_words,
    element_text,
    is_list_attribute,
    parse,
)
from ..functions.jsonpath import json_matches
from ..functions.modifiers import apply_modifiers
from ..functions.text import escape_markup, strip
from ..functions.time import instant
from ..plans.spec import Selector


def walk(selector: Selector):
    yield selector
    if selector.child is not None:
        yield from walk(selector.child)
    for c in selector.children or ():
        yield from walk(c)


def needs(*selectors: Selector) -> frozenset[str]:
    """What a parse must provide for these trees."""
    out = set()
    for s in (x for tree in selectors for x in walk(tree)):
        if uses_attributes(s.css):
            out.add(ATTRIBUTES)
        if s.is_leaf:
            kind = s.extract.type
            out |= {
                "text": {TEXTS},
                "jsonpath": {TEXTS},
                "attribute": {ATTRIBUTES},
                "html": {TEXTS, ATTRIBUTES, MARKUP},
            }[kind]
    return frozenset(out)


def value_shape(s: Selector) -> str:
    """What one extracted value of a leaf is: 'string', 'list', or 'mixed' (decided per row)."""
    if s.extract.type == "jsonpath":
        return "mixed"
    if s.extract.type == "attribute" and s.extract.key in LIST_ATTRIBUTES:
        return "list" if LIST_ATTRIBUTES[s.extract.key] is None else "mixed"
    return "string"


class Page:
    """The element array a selector is evaluated on.

    Usually the whole page; inside ``include_self`` the detached subtree.
    ``flags`` holds the match flags of selectors that need other elements.
    """

    def __init__(self, nodes: Column, texts: Column, markup: Column | None, flags: dict):
        self.nodes, self.texts, self.markup, self.flags = nodes, texts, markup, flags

    def with_flags(self, css: str, then: Callable[["Page", Matcher], Column]) -> Column:
        m = Matcher(css)
        if m.local or css in self.flags:
            return then(self, m)
        return let(
            m.flags(self.nodes),
            lambda f: then(Page(self.nodes, self.texts, self.markup, {**self.flags, css: f}), m),
        )

    def matches(self, scope: Column, m: Matcher) -> Column:
        """Matching elements below ``scope``, in document order."""
        below = F.slice(self.nodes, scope["n"] + 2, scope["last"] - scope["n"])
        return F.filter(below, lambda e: m.test(e, self.flags.get(m.css)))

    def wrapped(self, scope: Column, then: Callable[["Page", Column], Column]) -> Column:
        """``scope`` below a fresh ``div``; what is outside is out of sight."""
        shift = scope["n"] - 1
        fields = [f.split(":")[0] for f in NODE_TYPE[len("struct<") : -1].split(",")[:-2]]
        fields = [f for f in fields if f in ("n", "last", "parent", "depth", "tag", "t0", "t1")]

        def moved(e: Column) -> Column:
            new = {
                "n": e["n"] - shift,
                "last": e["last"] - shift,
                "parent": F.greatest(e["parent"] - shift, F.lit(0)),
            }
            cols = [new.get(f, e[f]).alias(f) for f in fields]
            return F.struct(*cols, e["attrs"].alias("attrs"), e["raw"].alias("raw"))

        div = F.struct(
            F.lit(0).alias("n"),
            (scope["last"] - shift).alias("last"),
            F.lit(-1).alias("parent"),
            (scope["depth"] - 1).alias("depth"),
            F.lit("div").alias("tag"),
            (scope["t0"] - 1).alias("t0"),
            (scope["t1"] + 1).alias("t1"),
            F.create_map().cast("map<string,string>").alias("attrs"),
            F.lit(None).cast("string").alias("raw"),
        )
        sub = F.slice(self.nodes, scope["n"] + 1, scope["last"] - scope["n"] + 1)
        nodes = F.concat(F.array(div), F.transform(sub, moved))
        return let(
            nodes,
            lambda ns: then(Page(ns, self.texts, self.markup, {}), F.get(ns, F.lit(0))),
        )


def _attribute_markup(attrs: Column) -> Column:
    def one(kv: Column) -> Column:
        words = F.when(
            kv["key"].isin([k for k, on in LIST_ATTRIBUTES.items() if on is None]),
            F.array_join(attribute_words(kv["value"]), " "),
        ).otherwise(kv["value"])
        text = escape_markup(words)
        quoted = (
            F.when(~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"')))
            .when(~text.contains("'"), F.concat(F.lit("'"), text, F.lit("'")))
            .otherwise(
                F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit('"'))
            )
        )
        return F.concat(F.lit(" "), kv["key"], F.lit("="), quoted)

    return F.array_join(F.transform(F.sort_array(F.map_entries(attrs)), one), "")


def element_html(page: Page, e: Column) -> Column:
    """The element written back as HTML, with all end tags in place."""

    def piece(pos: Column, rank: Column, text: Column) -> Column:
        return F.struct(pos.alias("pos"), rank.alias("rank"), text.alias("text"))

    sub = F.slice(page.nodes, e["n"] + 1, e["last"] - e["n"] + 1)

    def opening(x: Column) -> Column:
        void = x["tag"].isin(VOID)
        head = F.concat(
            F.lit("<"), x["tag"], _attribute_markup(x["attrs"]),
            F.when(void, F.lit("/>")).otherwise(F.lit(">")),
            F.when(x["tag"].isin("script", "style"), F.coalesce(x["raw"], F.lit(""))).otherwise(F.lit("")),
        )
        return piece(x["t0"], 2 * x["n"], head)

    def closing(x: Column) -> Column:
        # inner elements end first; an element that ends where it starts ends after its start
        rank = F.when(x["t0"] == x["t1"], 2 * x["n"] + 1).otherwise(-x["n"] - 1)
        return piece(x["t1"], rank, F.concat(F.lit("</"), x["tag"], F.lit(">")))

    count = F.greatest(e["t1"] - e["t0"] - 1, F.lit(0))
    start = e["t0"] + 2
    texts = F.transform(
        F.arrays_zip(F.slice(page.texts, start, count), F.slice(page.markup, start, count)),
        lambda t, i: piece(
            e["t0"] + 1 + i,
            F.lit(0),
            F.concat(escape_markup(t["0"]), t["1"]),
        ),
    )
    ends = F.transform(F.filter(sub, lambda x: ~x["tag"].isin(VOID)), closing)
    parts = F.sort_array(F.concat(F.transform(sub, opening), ends, texts))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def _extracted(page: Page, e: Column, s: Selector, as_of: Column | None) -> Column:
    """One leaf value after trimming and modifiers: string, list, or ``struct<is_list, vals>``."""
    kind = s.extract.type

    def cleaned(x: Column) -> Column:
        return apply_modifiers(strip(x), s.modifiers, as_of)

    def cleaned_list(values: Column) -> Column:
        return let(
            F.filter(F.transform(values, cleaned), lambda v: v.isNotNull()), null_if_empty
        )

    if kind == "text":
        return cleaned(element_text(page.texts, e))
    if kind == "html":
        return cleaned(element_html(page, e))
    if kind == "jsonpath":
        found = json_matches(element_text(page.texts, e), s.extract.path)
        return let(found, lambda m: _mixed(F.size(m) > 1, cleaned_list(m)))

    value = F.try_element_at(e["attrs"], F.lit(s.extract.key))
    shape = value_shape(s)
    if shape == "string":
        return cleaned(value)
    words = cleaned_list(attribute_words(value))
    if shape == "list":
        return words
    as_list = is_list_attribute(s.extract.key, e["tag"])
    one = F.filter(F.array(cleaned(value)), lambda v: v.isNotNull())
    return _mixed(as_list, F.when(as_list, words).otherwise(null_if_empty(one)))


def _mixed(is_list: Column, vals: Column) -> Column:
    return let(
        vals,
        lambda v: F.when(v.isNotNull(), F.struct(is_list.alias("is_list"), v.alias("vals"))),
    )


def evaluate(
    s: Selector, page: Page, scope: Column, as_of: Column | None = None
) -> Column:
    """The value of one selector below ``scope``; null if there is none."""
    if s.include_self:
        return page.wrapped(scope, lambda p, div: _evaluate(s, p, div, as_of))
    return _evaluate(s, page, scope, as_of)


def _evaluate(s: Selector, page: Page, scope: Column, as_of: Column | None) -> Column:
    def on_matches(p: Page, m: Matcher) -> Column:
        found = p.matches(scope, m)

        if s.children is not None:
            names = [f"c{i}" for i in range(len(s.children))]

            def keyed(element: Column) -> Column:
                """One struct per non-null child, with only that child's field set."""
                values = [evaluate(c, p, element, as_of) for c in s.children]
                return _one_per_child(names, values)

            if not s.children:
                return F.lit(None).cast("array<struct<none:string>>")
            if s.select == "first":
                # the match is only a condition; the children look at the outer element
                results = keyed(scope)
                return F.when(F.size(found) > 0, let(results, null_if_empty))
            return let(F.flatten(F.transform(found, keyed)), null_if_empty)

        if s.child is not None:
            def inside(element: Column) -> Column:
                value = evaluate(s.child, p, element, as_of)
                return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("c0"))))
        else:
            def inside(element: Column) -> Column:
                return _extracted(p, element, s, as_of)

        if s.select == "first":
            return let(
                at(found, 0), lambda e: F.when(e.isNotNull(), inside(e))
            )
        values = F.filter(F.transform(found, inside), lambda v: v.isNotNull())
        return let(values, null_if_empty)

    return page.with_flags(s.css, on_matches)


def _one_per_child(names: list[str], values: list[Column]) -> Column:
    def expand(all_values: Column) -> Column:
        rows = [
            F.struct(*[(all_values[n] if n == own else F.when(F.lit(False), all_values[n])).alias(n) for n in names])
            for own in names
        ]
        tagged = F.array(
            *[F.when(all_values[n].isNotNull(), row) for n, row in zip(names, rows)]
        )
        return F.filter(tagged, lambda r: r.isNotNull())

    return let(F.struct(*[v.alias(n) for n, v in zip(names, values)]), expand)


@per_application
def components(dom: str, s: Selector, as_of: datetime | None = None) -> Column:
    """Value of a resolved selector tree on the parsed page in column ``dom``.

    Null without an ``html`` element.
    """
    now = instant(as_of)

    def run(d: Column) -> Column:
        root = at(F.filter(d["nodes"], lambda e: e["tag"] == "html"), 0)
        markup = d["markup"] if MARKUP in needs(s) else None
        flags = {css: F.col(FLAGS)[css] for css in page_wide(s)}
        page = Page(d["nodes"], d["texts"], markup, flags)
        return let(root, lambda r: F.when(r.isNotNull(), evaluate(s, page, r, now)))

    return run(F.col(dom))


@per_application
def components_json(dom: str, s: Selector, as_of: datetime | None = None) -> Column:
    """The same as JSON text ``{"key": value}``."""
    return let(components(dom, s, as_of), lambda v: to_json_text(s, v))


FLAGS = "selector_flags"


def page_wide(*selectors: Selector) -> list[str]:
    """The CSS selectors that need the whole page, each once; detached subtrees flag their own."""
    wanted: list[str] = []

    def collect(x: Selector) -> None:
        if x.include_self:
            return
        if not Matcher(x.css).local and x.css not in wanted:
            wanted.append(x.css)
        for c in ([x.child] if x.child else []) + list(x.children or ()):
            collect(c)

    for s in selectors:
        collect(s)
    return wanted


@per_application
def _flag_columns(wanted: tuple[str, ...]) -> Column:
    nodes_ = F.col("dom")["nodes"]
    return F.struct(*[Matcher(css).flags(nodes_).alias(css) for css in wanted])


def _json_string(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def _json_value(s: Selector, v: Column) -> Column:
    """JSON text of a value produced by ``evaluate``."""

    def joined(parts: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))

    if s.children is not None:
        def entry(row: Column) -> Column:
            return F.coalesce(
                *[
                    F.when(row[f"c{i}"].isNotNull(), to_json_text(c, row[f"c{i}"]))
                    for i, c in enumerate(s.children)
                ]
            )

        return joined(F.transform(v, entry)) if s.children else F.lit("[]")
    if s.child is not None:
        if s.select == "first":
            return to_json_text(s.child, v["c0"])
        return joined(F.transform(v, lambda r: to_json_text(s.child, r["c0"])))

    shape = value_shape(s)

    def one(x: Column) -> Column:
        if shape == "string":
            return _json_string(x)
        if shape == "list":
            return F.to_json(x)
        return F.when(x["is_list"], F.to_json(x["vals"])).otherwise(
            _json_string(F.get(x["vals"], F.lit(0)))
        )

    return one(v) if s.select == "first" else joined(F.transform(v, one))


def to_json_text(s: Selector, value: Column) -> Column:
    """``{"key": value}`` as JSON text; null for a null value."""
    head = F.lit("{" + json.dumps(s.key, ensure_ascii=False) + ":")
    return F.when(value.isNotNull(), F.concat(head, _json_value(s, value), F.lit("}")))


def shred(
    pages: DataFrame, wanted: frozenset[str] = ALL_TEXT, html: str = "html"
) -> DataFrame:
    """Add the parsed page as column ``dom``; evaluated once per row."""
    _allow_deep_expressions(pages.sparkSession)
    return with_once(pages, "dom", parse(html, wanted))


def shred_for(pages: DataFrame, *selectors: Selector) -> DataFrame:
    """``dom`` with what the trees need, and the flags of their page-wide selectors.

    Keeps all other columns but ``html``.
    """
    parsed = shred(pages, needs(*selectors)).drop("html")
    wanted = tuple(page_wide(*selectors))
    return with_once(parsed, FLAGS, _flag_columns(wanted)) if wanted else parsed


def _allow_deep_expressions(spark: SparkSession) -> None:
    """Nested lambdas are resolved one level per round; long selectors need more than 100."""
    conf = "spark.sql.analyzer.maxIterations"
    if int(spark.conf.get(conf, "100")) < 1000:
        spark.conf.set(conf, "1000")


def nodes(
    pages: DataFrame, key: str = "page_id", wanted: frozenset[str] = ALL_TEXT
) -> DataFrame:
    """The node table: one row per element, with its interval and its own attributes."""
    return shred(pages, wanted).select(key, F.inline("dom.nodes"))


def extract(
    pages: DataFrame, selector: Selector, as_of: datetime | None = None, as_json: bool = False
) -> DataFrame:
    """Add ``components``, typed after the tree or as JSON text; drop the HTML.

    Rows without a result keep a null.
    """
    rest = [c for c in pages.columns if c != "html"]
    parsed = shred_for(pages, selector)
    value = (components_json if as_json else components)("dom", selector, as_of)
    return with_once(parsed, "components", value).select(*rest, "components")
