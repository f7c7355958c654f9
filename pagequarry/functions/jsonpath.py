"""JSONPath over JSON text, using the same interval array as for HTML.

``shred_json`` turns a text into its values in document order; the values
below ``v`` are ``slice(values, v.n + 2, v.last - v.n)``.  Each path step is a
filter over such a slice, so recursive descent has no depth limit.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, empty, let, scan

_TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[{}\[\],]|[^\s{}\[\],"]++'
_VALUE = "struct<n:int,last:int,parent:int,key:string,kind:string,t0:int,t1:int>"

_STEP = re.compile(
    r"(?P<deep>\.\.)?\s*(?:\.?\s*(?P<name>[A-Za-z_@\u0080-￿][\w@\-\u0080-￿]*|\*)"
    r"|\.?\s*(?P<quoted>'[^']*'|\"[^\"]*\")"
    r"|\.?\[\s*(?P<body>(?:'[^']*'|\"[^\"]*\"|[^\]'\"])*)\])\s*"
)
_SLICE = re.compile(r"(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?)?$")
_CONDITION = re.compile(
    r"(?:@\s*\.?)?\s*(?P<path>(?:[\w.\-]|\[\d+\])*)\s*"
    r"(?:(?P<op>==|!=|<=|>=|=~|=|<|>)\s*(?P<value>'[^']*'|\"[^\"]*\"|[^\s&]+))?\s*$"
)


def compile_path(path: str) -> list[tuple]:
    """Steps of a path; ``ValueError`` on what is not supported."""
    text = path.strip()
    steps: list[tuple] = []
    i = 1 if text.startswith("$") else 0
    if i == 0 and not text:
        raise ValueError("empty JSON path")
    while i < len(text):
        m = _STEP.match(text, i)
        if not m or m.end() == i:
            raise ValueError(f"unsupported JSON path {path!r} at {i}")
        if m["name"] == "*":
            step = ("wild",)
        elif m["name"]:
            step = ("child", (m["name"],))
        elif m["quoted"]:
            step = ("child", (m["quoted"][1:-1],))
        else:
            step = _bracket(m["body"].strip(), path)
        steps.append(("descend",)) if m["deep"] else None
        steps.append(step)
        i = m.end()
    return steps


def _bracket(body: str, path: str) -> tuple:
    if body == "*":
        return ("slice", None, None, 1)
    if re.fullmatch(r"-?\d+", body):
        return ("index", int(body))
    if m := _SLICE.match(body):
        start, stop, step = (None if g is None else int(g) for g in m.groups())
        if step is not None and step < 1:
            raise ValueError(f"unsupported slice step in {path!r}")
        return ("slice", start, stop, step or 1)
    if body.startswith("?"):
        return ("filter", _conditions(body[1:].strip(), path))
    names = [n.strip() for n in re.split(r",(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", body)]
    if all(re.fullmatch(r"'[^']*'|\"[^\"]*\"|[A-Za-z_][\w\-]*", n) for n in names) and body:
        return ("child", tuple(n[1:-1] if n[0] in "\"'" else n for n in names))
    raise ValueError(f"unsupported JSON path {path!r}: [{body}]")


def _conditions(body: str, path: str) -> list[tuple]:
    if body.startswith("(") and body.endswith(")"):
        body = body[1:-1]
    out = []
    for part in re.split(r"&(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", body):
        m = _CONDITION.match(part.strip())
        if not m:
            raise ValueError(f"unsupported filter in {path!r}: {part!r}")
        value: object = m["value"]
        if value is not None:
            if value[0] in "\"'":
                value = value[1:-1]
            elif value in ("true", "false"):
                value = value == "true"
            else:
                try:
                    value = json.loads(value)
                except json.JSONDecodeError:
                    value = m["value"]
        out.append((compile_path("$" + ("." + m["path"] if m["path"] else "")), m["op"], value))
    return out


def shred_json(text: Column) -> Column:
    """``struct<toks, vals>`` of one JSON text; null if the text is not JSON."""

    def state(n: Column, stack: Column, key: Column) -> Column:
        return F.struct(n.alias("n"), stack.alias("stack"), key.alias("key"))

    no_key = F.lit(None).cast("string")

    def value(st: Column, kind: Column, i: Column) -> Column:
        return F.struct(
            st["n"].alias("n"),
            st["n"].alias("last"),
            F.coalesce(at(st["stack"], 0)["n"], F.lit(-1)).alias("parent"),
            st["key"].alias("key"),
            kind.alias("kind"),
            i.alias("t0"),
            i.alias("t1"),
        )

    def step(st: Column, out: Column, tok: Column, then) -> Column:
        t, i = tok["t"], tok["i"]
        top = at(st["stack"], 0)
        done = F.struct(
            top["n"].alias("n"),
            (st["n"] - 1).alias("last"),
            top["parent"].alias("parent"),
            top["key"].alias("key"),
            top["kind"].alias("kind"),
            top["t0"].alias("t0"),
            i.alias("t1"),
        )
        opened = value(st, F.when(t == "{", F.lit("o")).otherwise(F.lit("a")), i)
        scalar = value(st, F.when(t.startswith('"'), F.lit("s")).otherwise(F.lit("v")), i)
        key = F.regexp_extract(t, r'(?s)^(".*")\s*:$', 1)
        return (
            F.when(t == ",", then(st, out))
            .when(
                t.isin("{", "["),
                then(state(st["n"] + 1, F.concat(F.array(opened), st["stack"]), no_key), out),
            )
            .when(
                t.isin("}", "]"),
                then(
                    state(st["n"], F.slice(st["stack"], F.lit(2), F.size(st["stack"])), no_key),
                    F.concat(out, F.array(done)),
                ),
            )
            .when(
                t.startswith('"') & t.endswith(":"),
                then(state(st["n"], st["stack"], _unquote(key)), out),
            )
            .otherwise(
                then(state(st["n"] + 1, st["stack"], no_key), F.concat(out, F.array(scalar)))
            )
        )

    def build(toks: Column) -> Column:
        numbered = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        init = state(F.lit(0), empty(_VALUE), no_key)
        vals = scan(numbered, init, step, _VALUE, lambda st, out: F.sort_array(out))
        return F.struct(toks.alias("toks"), vals.alias("vals"))

    toks = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.when(_is_json(text), let(toks, build))


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _is_json(text: Column) -> Column:
    """Whether a text is JSON, also with repeated keys, ``NaN`` or ``Infinity``, at any length.

    What a variant can hold is tested as such, the rest by a parser that
    streams, after the numbers that it does not know are replaced.
    """
    known = F.regexp_replace(text, rf"(?s)\G((?:{_STRING}|[^\"NI\-]|-(?!Infinity))*+)(?:NaN|-?Infinity)", "$10")
    return F.coalesce(
        F.when(F.try_parse_json(text).isNotNull(), F.lit(True)), F.get_json_object(known, "$").isNotNull()
    )


def _unquote(tok: Column) -> Column:
    decoded = F.get(F.from_json(F.concat(F.lit("["), tok, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(tok.contains("\\"), decoded).otherwise(
        F.substr(tok, F.lit(2), F.length(tok) - 2)
    )


def _number(tok: Column) -> Column:
    """A JSON number the way Python prints it."""
    v = tok.cast("double")
    size = F.abs(v)
    plain = F.regexp_replace(v.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    sci = F.regexp_replace(v.cast("string"), r"(?:\.0)?E(-?)(\d+)$", "e$1$2")
    sci = F.regexp_replace(sci, r"e(\d)", "e+$1")
    sci = F.regexp_replace(sci, r"e([+-])(\d)$", "e${1}0$2")
    return (
        F.when(tok.rlike(r"^-?\d+$"), F.when(tok == "-0", F.lit("0")).otherwise(tok))
        .when((size == 0) & tok.startswith("-"), F.lit("-0.0"))
        .when(size == 0, F.lit("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(sci)
    )


def _special(tok: Column) -> Column:
    """Python's names of the numbers that JSON does not have."""
    return F.when(tok == "NaN", F.lit("nan")).otherwise(F.replace(F.lower(tok), F.lit("infinity"), F.lit("inf")))


def _as_text(doc: Column, v: Column) -> Column:
    """A matched value as a string; objects and arrays as compact JSON text."""
    tok = F.get(doc["toks"], v["t0"])
    whole = F.array_join(
        F.transform(
            F.slice(doc["toks"], v["t0"] + 1, v["t1"] - v["t0"] + 1),
            lambda t: F.regexp_replace(t, r"\s+:$", ":"),
        ),
        "",
    )
    return (
        F.when(v["kind"] == "s", _unquote(tok))
        .when(v["kind"].isin("o", "a"), whole)
        .when(tok == "true", F.lit("True"))
        .when(tok == "false", F.lit("False"))
        .when(tok == "null", F.lit("None"))
        .when(tok.isin("NaN", "Infinity", "-Infinity"), _special(tok))
        .otherwise(_number(tok))
    )


def _below(doc: Column, v: Column) -> Column:
    return F.slice(doc["vals"], v["n"] + 2, v["last"] - v["n"])


def _children(doc: Column, v: Column) -> Column:
    return F.filter(_below(doc, v), lambda c: c["parent"] == v["n"])


def _field(doc: Column, v: Column, name: str) -> Column:
    """The value of a key; of several, the last."""
    same = F.filter(_children(doc, v), lambda c: c["key"] == name)
    return F.try_element_at(same, F.lit(-1))


def _optional(v: Column) -> Column:
    return F.filter(F.array(v), lambda x: x.isNotNull())


def _compare(doc: Column, v: Column, op: str, want: object) -> Column:
    text = _as_text(doc, v)
    if op == "=~":
        return (v["kind"] == "s") & text.rlike("^(?:" + str(want) + ")")
    if isinstance(want, bool):
        have, lit = text, F.lit(str(want))
    elif isinstance(want, int):
        have, lit = F.floor(text.try_cast("double")), F.lit(want)
    elif isinstance(want, float):
        have, lit = text.try_cast("double"), F.lit(want)
    else:
        have, lit = F.when(v["kind"] == "s", text), F.lit(want)
    test = {
        "==": have == lit, "=": have == lit, "!=": have != lit,
        "<": have < lit, "<=": have <= lit, ">": have > lit, ">=": have >= lit,
    }[op]
    return F.coalesce(test, F.lit(False))


def _step(doc: Column, matches: Column, step: tuple) -> Column:
    kind = step[0]

    def each(v: Column) -> Column:
        if kind == "child":
            found = [_optional(_field(doc, v, name)) for name in step[1]]
            return F.concat(*found)
        if kind == "wild":
            return F.filter(_children(doc, v), lambda c: v["kind"] == "o")
        if kind == "descend":
            return F.slice(doc["vals"], v["n"] + 1, v["last"] - v["n"] + 1)
        if kind == "index":
            i = step[1]
            where = F.lit(i + 1) if i >= 0 else F.lit(i)
            items = F.filter(_children(doc, v), lambda c: v["kind"] == "a")
            return _optional(F.try_element_at(items, where))
        if kind == "slice":
            items = F.when(v["kind"] == "a", _children(doc, v)).otherwise(F.array(v))
            return let(items, lambda a: _sliced(a, *step[1:]))
        return F.filter(
            _children(doc, v),
            lambda c: _all([_holds(doc, c, cond) for cond in step[1]]),
        )

    return F.flatten(F.transform(matches, each))


def _sliced(items: Column, start: int | None, stop: int | None, step: int) -> Column:
    size = F.size(items)

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.lit(x) if x >= 0 else size + x

    lo, hi = bound(start, F.lit(0)), bound(stop, size)
    return F.filter(
        items,
        lambda _, i: (i >= lo) & (i < hi) & (F.pmod(i - F.greatest(lo, F.lit(0)), F.lit(step)) == 0),
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _holds(doc: Column, v: Column, condition: tuple) -> Column:
    steps, op, want = condition
    found = F.array(v)
    for s in steps:
        found = _step(doc, found, s)
    if op is None:
        return F.size(found) > 0
    return F.exists(found, lambda x: _compare(doc, x, op, want))


def _direct_path(steps: list[tuple]) -> str | None:
    """The path as Spark's own variant path, if it only names keys and positions."""
    out = "$"
    for kind, *args in steps:
        if kind == "child" and len(args[0]) == 1 and not re.search(r"['\\]", args[0][0]):
            out += f"['{args[0][0]}']"
        elif kind == "index" and args[0] >= 0:
            out += f"[{args[0]}]"
        else:
            return None
    return out if steps else None


def json_matches(text: Column, path: str) -> Column:
    """All matches of a path as strings; null without a match or on bad JSON.

    A plain path to a string, integer, boolean or null is a variant lookup.
    Everything else goes through the array of values, which keeps the order of
    keys and the way numbers are written.
    """
    steps = compile_path(path)
    direct = _direct_path(steps)
    if direct is None:
        return _search(text, steps)

    def look(doc: Column) -> Column:
        return F.struct(
            doc.isNull().alias("other"),
            F.schema_of_variant(F.try_variant_get(doc, direct, "variant")).alias("kind"),
            F.try_variant_get(doc, direct, "string").alias("text"),
        )

    def result(found: Column) -> Column:
        kind = found["kind"]
        return (
            F.when(found["other"], _search(text, steps))
            .when(kind.isNull(), F.lit(None).cast("array<string>"))
            .when(kind.isin("STRING", "BIGINT"), F.array(found["text"]))
            .when(kind == "BOOLEAN", F.array(F.initcap(found["text"])))
            .when(kind == "VOID", F.array(F.lit("None")))
            .otherwise(_search(text, steps))
        )

    return let(let(F.try_parse_json(text), look), result)


def _search(text: Column, steps: list[tuple]) -> Column:
    def run(doc: Column) -> Column:
        found = F.slice(doc["vals"], F.lit(1), F.lit(1))
        for s in steps:
            found = _step(doc, found, s)
        texts = F.transform(found, lambda v: _as_text(doc, v))
        return let(texts, lambda t: F.when(F.size(t) > 0, t))

    return let(shred_json(text), run)
