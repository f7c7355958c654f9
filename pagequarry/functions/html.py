"""HTML text to an array of element nodes, as one JVM expression per page.

``parse(html)`` gives ``struct<nodes, texts[, markup]>``.  ``nodes`` holds the
elements in document order; ``n`` is the position in that order and ``last``
the position of the last descendant, so the descendants of ``e`` are exactly
``slice(nodes, e.n + 2, e.last - e.n)``.  ``t0``/``t1`` are the positions of
the opening and closing token; ``texts`` is aligned with the tokens and holds
the decoded character data (empty for tags), so the text of ``e`` is the join
of the slice between the two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, empty, let, outermost, per_application, scan, scan_in_blocks, splice
from .text import decode_attribute, decode_text

# Elements without content, raw-text elements, elements whose text is
# not part of the text around them, elements that keep blank text as it is.
VOID = (
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer"
).split()
RAW = ["script", "style"]
OWN_TEXT = ["template", "rt", "rp"]
PRESERVE = ["pre", "textarea"]

# Attributes that hold a list of words: on every element, or only on some.
LIST_ATTRIBUTES = {
    "class": None,
    "accesskey": None,
    "dropzone": None,
    "rel": ["a", "link", "area"],
    "rev": ["a", "link"],
    "headers": ["td", "th"],
    "accept-charset": ["form"],
    "archive": ["object"],
    "sizes": ["icon"],
    "sandbox": ["iframe"],
    "for": ["output"],
}

_ATTR = (
    r"""(?<=['"\s/])([^\s/>][^\s/=>]*+)"""
    r"""(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?+"""
)
_OPEN_BODY = r"(?:\s++|/(?!>)|" + _ATTR.replace("([^", "(?:[^", 1).replace("(\"", "(?:\"", 1) + ")*+"
_OPEN = r"<[a-zA-Z][^\s/>]*+" + _OPEN_BODY + "/?+>"
_RAW = (
    r"<(script|style)(?=[\s/>])" + _OPEN_BODY + r"(?<!/)>(?s:.*?)(?=</\s*+\1\s*+>|\z)"
)
_TEXT = r"(?:[^<]++|<(?![a-zA-Z/!?])|</>)++"
_SILENT = (
    r"<!--(?s:.*?)--\s*+>"  # comment
    r"|<!(?!--|\[cdata\[)[^>]*+>|<\?[^>]*+>"  # declaration, instruction
    r"|</(?!\s*+[a-z]|>)[^>]*+>"  # nameless end tag
)
_CDATA = r"<!\[cdata\[(?s:.*?)\]\s*+\]\s*+>"
_CLOSE = r"</\s*+[a-zA-Z][^>]*+>"
_JUNK = r"<[^>]*+>|<[^<]*+"
_TOKEN = "(?i)" + "|".join([_TEXT, _CLOSE, _RAW, _OPEN, _CDATA, _SILENT, _JUNK])

_NODE = "n:int,last:int,parent:int,depth:int,tag:string,t0:int,t1:int"
NODE_TYPE = f"struct<{_NODE},attrs:map<string,string>,raw:string>"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def _open_tag(token: Column) -> Column:
    """The tag itself, without the raw text that a script or style token carries."""
    return F.regexp_extract(token, "^" + _OPEN, 0)


def _attributes(tag: Column) -> Column:
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(1)), F.lower)

    def value(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        bare = F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return let(bare, decode_attribute)

    values = F.transform(F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(2)), value)

    def to_map(p: Column) -> Column:
        ks, vs = p["ks"], p["vs"]
        last_wins = F.filter(
            F.arrays_zip(ks, vs),
            lambda kv, i: ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), kv["ks"]),
        )
        return F.when(
            F.size(F.array_distinct(ks)) == F.size(ks), F.map_from_arrays(ks, vs)
        ).otherwise(F.map_from_entries(last_wins))

    return let(F.struct(names.alias("ks"), values.alias("vs")), to_map)


_NO_ATTRIBUTES = "map<string,string>"


# token classes
_TEXTUAL, _NOTHING, _OPENS, _CLOSES, _ALONE, _CDATA_TEXT = -1, 0, 1, 2, 3, 4


def _classify(toks: Column) -> Column:
    """One ``struct<p, k, t>`` per token: position, class, tag name."""

    def row(p: Column, k: Column, t: Column) -> Column:
        return F.struct(p.alias("p"), k.alias("k"), t.alias("t"))

    def tag_class(tok: Column, t: Column) -> Column:
        # '/>' that belongs to an unquoted value does not close
        self_closed = tok.endswith("/>") & ~tok.rlike(r"=\s*+[^\s\"'>/][^\s>\"']*/>$")
        # only stray quotes can keep a '<name' from being a tag
        quoted = tok.contains('"') | tok.contains("'")
        is_raw = t.isin(RAW)
        return (
            F.when(
                tok.startswith("</"), F.when(t.isin(VOID), _NOTHING).otherwise(F.lit(_CLOSES))
            )
            .when(quoted & ~tok.rlike("^(?i)" + _OPEN), F.lit(_TEXTUAL))
            .when(t.isin(VOID), F.lit(_ALONE))
            .when(is_raw & (_open_tag(tok) != tok), F.lit(_OPENS))
            .when(self_closed, F.lit(_ALONE))
            .otherwise(F.lit(_OPENS))
        )

    def marked_up(tok: Column, p: Column) -> Column:
        other = (
            F.when(tok.rlike("^(?i:" + _CDATA + ")"), F.lit(_CDATA_TEXT))
            .when(tok.rlike("^(?i:" + _SILENT + ")"), F.lit(_NOTHING))
            .otherwise(F.lit(_TEXTUAL))
        )
        name = F.lower(F.regexp_extract(tok, r"^</?\s*+([a-zA-Z][^\s/>]*+)", 1))
        return let(
            name,
            lambda t: F.when(t != "", row(p, tag_class(tok, t), t)).otherwise(row(p, other, t)),
        )

    return F.transform(
        toks,
        lambda tok, p: F.when(tok.startswith("<"), marked_up(tok, p)).otherwise(
            row(p, F.lit(_TEXTUAL), F.lit(""))
        ),
    )


def _tree(classes: Column, n_tokens: Column) -> Column:
    """Match opening and closing tags with a stack; one pass over the tags.

    A closing tag closes the nearest open element of that name and everything
    opened since; without such an element it is ignored.  Elements still open
    at the end are closed there.
    """
    tags = F.filter(classes, lambda c: c["k"].between(_OPENS, _ALONE))
    return let(tags, lambda t: _match(t, n_tokens))


def _match(tags: Column, n_tokens: Column) -> Column:
    """The fold behind ``_tree``.

    The stack (innermost element first) has two parts: what was opened before
    the current block of tags, and what was opened in it.  Only the second part
    and the number of elements dropped from the first change from tag to tag,
    so thousands of elements that are never closed do not slow the fold down.
    """
    entry = "struct<n:int,parent:int,depth:int,t0:int,tag:string>"
    node = "struct<n:int,last:int,parent:int,depth:int,t0:int,t1:int>"

    def state(n: Column, stack: Column) -> Column:
        return F.struct(n.alias("n"), stack.alias("stack"))

    def local(n: Column, stack: Column, gone: Column) -> Column:
        return F.struct(n.alias("n"), stack.alias("stack"), gone.alias("gone"))

    def ended(e: Column, last: Column, t1: Column) -> Column:
        return F.struct(
            e["n"].alias("n"),
            last.alias("last"),
            e["parent"].alias("parent"),
            e["depth"].alias("depth"),
            e["t0"].alias("t0"),
            t1.alias("t1"),
        )

    def pop(elements: Column, n: Column, t1: Column) -> Column:
        return F.transform(elements, lambda e: ended(e, n - 1, t1))

    def step(st: Column, out: Column, tag: Column, then, before: Column) -> Column:
        outer = before["stack"]
        depth = F.size(st["stack"]) + F.size(outer) - st["gone"]
        inner_most = F.coalesce(at(st["stack"], 0)["n"], F.get(outer, st["gone"])["n"])
        opened = F.struct(
            st["n"].alias("n"),
            F.coalesce(inner_most, F.lit(-1)).alias("parent"),
            depth.alias("depth"),
            tag["p"].alias("t0"),
            tag["t"].alias("tag"),
        )

        def nearest(elements: Column) -> Column:
            return at(F.filter(elements, lambda e: e["tag"] == tag["t"]), 0)["depth"]

        def close_here(k: Column) -> Column:
            rest = F.slice(st["stack"], k + 1, F.size(st["stack"]))
            ends = pop(F.slice(st["stack"], F.lit(1), k), st["n"], tag["p"])
            return then(local(st["n"], rest, st["gone"]), F.concat(out, ends))

        def close_outer(k: Column) -> Column:
            ends = pop(F.slice(outer, st["gone"] + 1, k), st["n"], tag["p"])
            return then(
                local(st["n"], empty(entry), st["gone"] + k),
                F.concat(out, pop(st["stack"], st["n"], tag["p"]), ends),
            )

        remaining = F.slice(outer, st["gone"] + 1, F.size(outer))
        return (
            F.when(
                tag["k"] == _OPENS,
                then(
                    local(st["n"] + 1, F.concat(F.array(opened), st["stack"]), st["gone"]), out
                ),
            )
            .when(
                tag["k"] == _ALONE,
                then(
                    local(st["n"] + 1, st["stack"], st["gone"]),
                    F.concat(out, F.array(ended(opened, st["n"], tag["p"]))),
                ),
            )
            .otherwise(
                let(
                    depth - nearest(st["stack"]),
                    lambda here: F.when(here.isNotNull(), close_here(here)).otherwise(
                        let(
                            F.size(outer) - st["gone"] - nearest(remaining),
                            lambda there: F.when(there.isNotNull(), close_outer(there)).otherwise(
                                then(st, out)
                            ),
                        )
                    ),
                )
            )
        )

    def leave(before: Column, st: Column) -> Column:
        outer = before["stack"]
        kept = F.slice(outer, st["gone"] + 1, F.size(outer))
        return state(st["n"], F.concat(st["stack"], kept))

    found = scan_in_blocks(
        tags,
        state(F.lit(0), empty(entry)),
        lambda before: local(before["n"], empty(entry), F.lit(0)),
        step,
        leave,
        node,
        lambda st, out: F.sort_array(F.concat(out, pop(st["stack"], st["n"], n_tokens))),
    )
    # the n-th element is the n-th opening tag, which also knows its name
    opens = F.transform(F.filter(tags, lambda g: g["k"] != 2), lambda g: g["t"])
    fields = [f.split(":")[0] for f in _NODE.split(",")]

    def named(o: Column) -> Column:
        return F.transform(
            found,
            lambda e: F.struct(
                *[(F.get(o, e["n"]) if f == "tag" else e[f]).alias(f) for f in fields]
            ),
        )

    return let(opens, named)


def _character_data(toks: Column, classes: Column) -> Column:
    """Decoded text per token, empty for tags, comments and raw text."""
    cdata = r"(?is)^<!\[cdata\[(.*?)\]\s*\]\s*>$"

    def one(tok: Column, i: Column) -> Column:
        at_end = i == F.size(toks) - 1
        # '</>' is skipped without ending the text around it
        whole = F.when(
            tok.contains("</>"),
            let(
                F.replace(tok, F.lit("</>"), F.lit("")), lambda t: decode_text(t, at_end=at_end)
            ),
        ).otherwise(decode_text(tok, at_end=at_end))
        k = F.get(classes, i)["k"]
        return (
            F.when(k == _TEXTUAL, whole)
            .when(k == _CDATA_TEXT, F.regexp_extract(tok, cdata, 1))
            .otherwise(F.lit(""))
        )

    return F.transform(toks, one)


def _collapse_blank(texts: Column) -> Column:
    """A run of nothing but blanks becomes one newline or one space."""
    return F.transform(
        texts,
        lambda t: F.when(
            t.rlike(r"^[ \t\n\f\r]++$"),
            F.when(t.contains("\n"), F.lit("\n")).otherwise(F.lit(" ")),
        ).otherwise(t),
    )


def _spans(nodes: Column, tags: list[str]) -> Column:
    """Token ranges of the outermost elements with one of these tags."""
    span = "struct<lo:int,hi:int>"
    inner = F.transform(
        F.filter(nodes, lambda e: e["tag"].isin(tags)),
        lambda e: F.struct((e["t0"] + 1).alias("lo"), F.greatest(e["t1"], e["t0"] + 1).alias("hi")),
    )
    return outermost(inner, span, "lo", "hi")


def _innermost(tree: Column, n_tokens: Column) -> Column:
    """Per token the tag of the innermost element that owns its text, or ''."""
    owners = F.filter(tree, lambda e: e["tag"].isin(OWN_TEXT))
    open_type = "struct<tag:string,t1:int>"

    def run(own: Column) -> Column:
        def step(st: Column, out: Column, i: Column, then) -> Column:
            still = F.filter(st["open"], lambda o: o["t1"] > i)
            nxt = F.get(own, st["k"])
            starts = F.coalesce(nxt["t0"] == i, F.lit(False))
            opened = F.struct(nxt["tag"].alias("tag"), nxt["t1"].alias("t1"))
            stack = F.when(starts, F.concat(F.array(opened), still)).otherwise(still)
            state = F.struct((st["k"] + starts.cast("int")).alias("k"), stack.alias("open"))
            tag = F.coalesce(at(still, 0)["tag"], F.lit(""))
            return then(state, F.concat(out, F.array(tag)))

        init = F.struct(F.lit(0).alias("k"), empty(open_type).alias("open"))
        every = F.sequence(F.lit(0), n_tokens - 1)
        return scan(every, init, step, "string", lambda st, out: out)

    return let(owners, run)


def _has(nodes: Column, tags: list[str]) -> Column:
    return F.exists(nodes, lambda e: e["tag"].isin(tags))


def _between(arr: Column, e: Column) -> Column:
    return F.slice(arr, e["t0"] + 2, F.greatest(e["t1"] - e["t0"] - 1, F.lit(0)))


# what a parse can provide besides the tree of tags
TEXTS, ATTRIBUTES, MARKUP = "texts", "attributes", "markup"
ALL_TEXT = frozenset({TEXTS, ATTRIBUTES})


def parse(html: Column | str, needs: frozenset[str] = ALL_TEXT) -> Column:
    """The DOM of one page: ``struct<nodes, texts[, markup]>``.

    Only what is in ``needs`` is computed; the rest stays empty.  ``MARKUP``
    keeps comments and the like, needed only to write elements back as HTML.
    """
    return _parse_named(html, needs) if isinstance(html, str) else _parse(html, needs)


@per_application
def _parse_named(name: str, needs: frozenset[str]) -> Column:
    return _parse(F.col(name), needs)


def _parse(html: Column, needs: frozenset[str]) -> Column:
    no_attributes = F.create_map().cast(_NO_ATTRIBUTES)
    no_text = F.lit(None).cast("string")

    def node(e: Column, attrs: Column, raw: Column) -> Column:
        names = [f.split(":")[0] for f in _NODE.split(",")]
        return F.struct(*[e[f].alias(f) for f in names], attrs.alias("attrs"), raw.alias("raw"))

    def attributes(e: Column, toks: Column) -> Column:
        if ATTRIBUTES not in needs:
            return no_attributes
        tok = F.get(toks, e["t0"])
        tag = F.when(e["tag"].isin(RAW), _open_tag(tok)).otherwise(tok)
        bare = F.length(tok) == F.length(e["tag"]) + 2
        return F.when(bare, no_attributes).otherwise(let(tag, _attributes))

    def without_texts(b: Column) -> Column:
        full = F.transform(b["tree"], lambda e: node(e, attributes(e, b["toks"]), no_text))
        return F.struct(full.alias("nodes"), empty("string").alias("texts"))

    def build(b: Column) -> Column:
        toks, tree = b["toks"], b["tree"]
        data = _character_data(toks, b["classes"])

        def with_texts(texts: Column) -> Column:
            # blank text is kept as it is inside <pre> and <textarea>
            return F.when(
                _has(tree, PRESERVE),
                let(_spans(tree, PRESERVE), lambda s: splice(_collapse_blank(texts), texts, s)),
            ).otherwise(_collapse_blank(texts))

        def finish(t: Column) -> Column:
            texts, owner = t["texts"], t["owner"]

            def own_text(e: Column) -> Column:
                both = F.arrays_zip(
                    _between(texts, e).alias("text"), _between(owner, e).alias("tag")
                )
                mine = F.filter(both, lambda x: x["tag"] == e["tag"])
                return F.array_join(F.transform(mine, lambda x: x["text"]), "")

            def full(e: Column) -> Column:
                tok = F.get(toks, e["t0"])
                raw = F.when(
                    e["tag"].isin(RAW), F.substr(tok, F.length(_open_tag(tok)) + 1)
                ).when(e["tag"].isin(OWN_TEXT), own_text(e))
                return node(e, attributes(e, toks), raw)

            shown = F.when(
                owner.isNotNull(),
                F.zip_with(texts, owner, lambda x, o: F.when(o == "", x).otherwise(F.lit(""))),
            ).otherwise(texts)
            fields = [F.transform(tree, full).alias("nodes"), shown.alias("texts")]
            if MARKUP in needs:
                kept = F.transform(
                    toks,
                    lambda t: F.when(
                        t.rlike("^(?i:<!--(?s:.*?)--\\s*+>|" + _CDATA + "|<\\?[^>]*+>)"), t
                    ).otherwise(F.lit("")),
                )
                fields.append(kept.alias("markup"))
            return F.struct(*fields)

        owner = F.when(_has(tree, OWN_TEXT), _innermost(tree, F.size(toks)))
        return let(
            F.struct(let(data, with_texts).alias("texts"), owner.alias("owner")), finish
        )

    def with_tree(b: Column) -> Column:
        tree = _tree(b["classes"], F.size(b["toks"]))
        parts = [b["toks"].alias("toks"), b["classes"].alias("classes"), tree.alias("tree")]
        return let(F.struct(*parts), build if TEXTS in needs else without_texts)

    return let(
        tokens(html),
        lambda toks: let(
            F.struct(toks.alias("toks"), _classify(toks).alias("classes")), with_tree
        ),
    )


def element_text(texts: Column, e: Column) -> Column:
    """All character data inside an element, without separators."""
    return F.coalesce(e["raw"], F.array_join(_between(texts, e), ""))


def attribute_words(value: Column) -> Column:
    """An attribute value as its list of words."""
    return F.regexp_extract_all(value, F.lit(r"(?U)\S+"), F.lit(0))


def is_list_attribute(key: str, tag: Column) -> Column:
    on = LIST_ATTRIBUTES.get(key, [])
    return F.lit(True) if on is None else tag.isin(on)
