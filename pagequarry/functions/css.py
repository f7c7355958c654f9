"""CSS selectors as boolean expressions over the element array.

A compound selector (``div.x[a=v]``) tests one element.  Combinators never
compare pairs of elements: ``A B`` marks the ranges covered by the outermost
``A`` elements, ``A > B`` looks up the flag of the parent, and sibling rules
rank the elements sorted by parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import covered, let, marked, outermost, scan
from .html import attribute_words, is_list_attribute, LIST_ATTRIBUTES

# Pseudo-classes that stand for an+b patterns.
_POSITIONS = {
    "first-child": ("nth-child", 0, 1),
    "last-child": ("nth-last-child", 0, 1),
    "first-of-type": ("nth-of-type", 0, 1),
    "last-of-type": ("nth-last-of-type", 0, 1),
}
_IDENT = r"(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.))(?:[\w\-\u0080-\U0010ffff]|\\.)*"
_ATTR = re.compile(
    rf"\[\s*(?P<name>{_IDENT})\s*"
    rf"(?:(?P<op>[~|^$*!]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*(?P<flag>[iIsS])?\s*)?\]"
)
_NTH = re.compile(r"\s*(?:(?P<a>[+-]?\d*)n\s*(?:(?P<s>[+-])\s*(?P<b>\d+))?|(?P<c>[+-]?\d+))\s*$", re.I)


class CssError(ValueError):
    pass


@dataclass
class Compound:
    tag: str | None = None
    tests: list[Callable[[Column], Column]] = field(default_factory=list)
    # (kind, argument): rules that need the other elements of the page
    structural: list[tuple] = field(default_factory=list)


@dataclass
class Complex:
    """Compounds from left to right; ``combinators[i]`` stands before ``parts[i]``."""

    parts: list[Compound]
    combinators: list[str]


def _unescape(ident: str) -> str:
    return re.sub(r"\\(.)", r"\1", ident)


def _attribute_value(e: Column, name: str) -> Column:
    value = F.try_element_at(e["attrs"], F.lit(name))
    if name in LIST_ATTRIBUTES:
        joined = F.array_join(attribute_words(value), " ")
        return F.when(is_list_attribute(name, e["tag"]), joined).otherwise(value)
    return value


def _attribute_test(m: re.Match) -> Callable[[Column], Column]:
    name, op = _unescape(m["name"]).lower(), m["op"]
    if op is None:
        return lambda e: F.try_element_at(e["attrs"], F.lit(name)).isNotNull()
    want = m["value"]
    want = want[1:-1] if want[0] in "\"'" else _unescape(want)
    flag = (m["flag"] or "").lower()
    fold = flag == "i" or (name == "type" and flag != "s")

    def test(e: Column) -> Column:
        have = _attribute_value(e, name)
        have, v = (F.lower(have), want.lower()) if fold else (have, want)
        if op == "=":
            hit = have == v
        elif op == "!=":
            return ~F.coalesce(have == v, F.lit(False))
        elif op == "|=":
            hit = (have == v) | have.startswith(v + "-")
        elif op == "~=":
            if v == "" or re.search(r"\s", v):
                return F.lit(False)
            hit = F.array_contains(attribute_words(have), v)
        elif v == "":
            return F.lit(False)
        elif op == "^=":
            hit = have.startswith(v)
        elif op == "$=":
            hit = have.endswith(v)
        else:
            hit = have.contains(v)
        return F.coalesce(hit, F.lit(False))

    return test


def _class_test(name: str) -> Callable[[Column], Column]:
    def test(e: Column) -> Column:
        words = attribute_words(F.coalesce(F.try_element_at(e["attrs"], F.lit("class")), F.lit("")))
        return F.array_contains(words, name)

    return test


def _id_test(name: str) -> Callable[[Column], Column]:
    return lambda e: F.coalesce(
        F.try_element_at(e["attrs"], F.lit("id")) == name, F.lit(False)
    )


def _nth(text: str) -> tuple[int, int]:
    word = text.strip().lower()
    if word in ("odd", "even"):
        return (2, 1) if word == "odd" else (2, 0)
    m = _NTH.match(text)
    if not m:
        raise CssError(f"bad position: {text!r}")
    if m["c"] is not None:
        return 0, int(m["c"])
    a = {"": 1, "+": 1, "-": -1}.get(m["a"])
    a = int(m["a"]) if a is None else a
    return a, int((m["s"] or "+") + (m["b"] or "0"))


def _argument(css: str, start: int) -> int:
    """Position of the parenthesis that closes the one just before ``start``."""
    depth, quote, i = 1, "", start
    while i < len(css):
        c = css[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise CssError(f"unclosed parenthesis in {css!r}")


def _pseudo(c: Compound, name: str, arg: str | None) -> None:
    if name in _POSITIONS:
        kind, a, b = _POSITIONS[name]
        c.structural.append((kind, a, b))
    elif name in ("only-child", "only-of-type"):
        kind = name.removeprefix("only-")
        c.structural += [(f"nth-{kind}", 0, 1), (f"nth-last-{kind}", 0, 1)]
    elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type") and arg:
        c.structural.append((name, *_nth(arg)))
    elif name == "root":
        c.tests.append(lambda e: e["parent"] == -1)
    elif name in ("not", "is", "where", "matches", "any") and arg is not None:
        c.structural.append(("not" if name == "not" else "is", parse_css(arg)))
    elif name == "has" and arg:
        c.structural.append(("has", _parse(arg, relative=True)))
    else:
        raise CssError(f"unsupported pseudo-class :{name}")


def _parse(css: str, relative: bool = False) -> list[Complex]:
    out: list[Complex] = []
    parts: list[Compound] = []
    combs: list[str] = []
    current: Compound | None = None
    pending: str | None = None
    i, n = 0, len(css)
    css = css.rstrip()
    n = len(css)

    def flush() -> None:
        nonlocal current, pending
        if current is not None:
            parts.append(current)
            combs.append(pending or (" " if parts[1:] or relative else ""))
            current, pending = None, None

    def end_selector() -> None:
        flush()
        if not parts or pending is not None:
            raise CssError(f"incomplete selector: {css!r}")
        out.append(Complex(list(parts), list(combs)))
        parts.clear()
        combs.clear()

    while i < n:
        ch = css[i]
        if ch.isspace() or ch in ">+~,":
            m = re.compile(r"\s*([>+~,])?\s*").match(css, i)
            i = m.end()
            flush()
            if m[1] == ",":
                end_selector()
            elif m[1]:
                if pending is not None or (not parts and not relative):
                    raise CssError(f"misplaced combinator in {css!r}")
                pending = m[1]
            continue
        current = current or Compound()
        if ch == "*":
            i += 1
        elif ch in ".#":
            m = re.compile(_IDENT if ch == "." else r"(?:[\w\-\u0080-\U0010ffff]|\\.)+").match(css, i + 1)
            if not m:
                raise CssError(f"bad name at {i} in {css!r}")
            name = _unescape(m.group())
            current.tests.append(_class_test(name) if ch == "." else _id_test(name))
            i = m.end()
        elif ch == "[":
            m = _ATTR.match(css, i)
            if not m:
                raise CssError(f"bad attribute test at {i} in {css!r}")
            current.tests.append(_attribute_test(m))
            i = m.end()
        elif ch == ":":
            m = re.compile(r":([a-zA-Z-]+)(\()?").match(css, i)
            if not m:
                raise CssError(f"bad pseudo-class at {i} in {css!r}")
            arg, i = None, m.end()
            if m[2]:
                close = _argument(css, i)
                arg, i = css[i:close], close + 1
            _pseudo(current, m[1].lower(), arg)
        else:
            m = re.compile(_IDENT).match(css, i)
            if not m or current.tag or current.tests or current.structural:
                raise CssError(f"unexpected {ch!r} at {i} in {css!r}")
            current.tag = _unescape(m.group()).lower()
            i = m.end()
    end_selector()
    return out


def parse_css(css: str) -> list[Complex]:
    """Parse a selector list; raises ``CssError`` on what is not supported."""
    return _parse(css)


def uses_attributes(css: str) -> bool:
    """Whether any part of a selector looks at attributes."""

    def look(complexes: list[Complex]) -> bool:
        return any(
            p.tests or any(isinstance(rule[1], list) and look(rule[1]) for rule in p.structural)
            for c in complexes
            for p in c.parts
        )

    return bool(look(parse_css(css)))


def _is_local(complexes: list[Complex]) -> bool:
    """True if each element can be tested on its own."""
    return all(
        len(c.parts) == 1 and all(s[0] in ("is", "not") and _is_local(s[1]) for s in p.structural)
        for c in complexes
        for p in c.parts
    )


def _local(c: Compound, e: Column) -> Column:
    test = F.lit(True) if c.tag is None else e["tag"] == c.tag
    for t in c.tests:
        test = test & t(e)
    return test


def _local_any(complexes: list[Complex], e: Column) -> Column:
    test = F.lit(False)
    for c in complexes:
        p = c.parts[0]
        one = _local(p, e)
        for kind, arg in p.structural:
            inner = _local_any(arg, e)
            one = one & (~inner if kind == "not" else inner)
        test = test | one
    return test


def _positions(nodes: Column, of_type: bool, backwards: bool) -> Column:
    """1-based rank of each element among its siblings (of the same tag)."""
    row = "struct<n:int,rank:int>"
    order = F.transform(
        nodes,
        lambda e: F.struct(
            e["parent"].alias("parent"),
            (e["tag"] if of_type else F.lit("")).alias("tag"),
            (-e["n"] if backwards else e["n"]).alias("n"),
        ),
    )
    state = F.struct(
        F.lit(-2).alias("parent"), F.lit("").alias("tag"), F.lit(0).alias("rank")
    )

    def step(st: Column, out: Column, e: Column, then) -> Column:
        same = (st["parent"] == e["parent"]) & (st["tag"] == e["tag"])
        rank = F.when(same, st["rank"] + 1).otherwise(F.lit(1))
        nxt = F.struct(e["parent"].alias("parent"), e["tag"].alias("tag"), rank.alias("rank"))
        return then(nxt, F.concat(out, F.array(F.struct(F.abs(e["n"]).alias("n"), rank.alias("rank")))))

    ranked = scan(F.sort_array(order), state, step, row, lambda st, out: F.sort_array(out))
    return F.transform(ranked, lambda r: r["rank"])


def _nth_flags(nodes: Column, kind: str, a: int, b: int) -> Column:
    ranks = _positions(nodes, kind.endswith("of-type"), "last" in kind)

    def hit(r: Column) -> Column:
        if a == 0:
            return r == b
        k = (r - b) / a
        return (F.pmod(r - b, F.lit(abs(a))) == 0) & (k >= 0)

    return F.transform(ranks, hit)


def _siblings_after(nodes: Column, flags: Column, adjacent: bool) -> Column:
    """Elements that follow a flagged sibling (directly, if ``adjacent``)."""
    order = F.sort_array(
        F.transform(
            nodes,
            lambda e: F.struct(
                e["parent"].alias("parent"), e["n"].alias("n"), F.get(flags, e["n"]).alias("f")
            ),
        )
    )
    state = F.struct(F.lit(-2).alias("parent"), F.lit(False).alias("seen"))

    def step(st: Column, out: Column, e: Column, then) -> Column:
        before = (st["parent"] == e["parent"]) & st["seen"]
        seen = e["f"] if adjacent else (e["f"] | before)
        nxt = F.struct(e["parent"].alias("parent"), seen.alias("seen"))
        return then(nxt, F.when(before, F.concat(out, F.array(e["n"]))).otherwise(out))

    hits = scan(order, state, step, "int", lambda st, out: out)
    return let(hits, lambda h: marked(h, F.size(nodes)))


def _inside(nodes: Column, flags: Column) -> Column:
    """Elements below a flagged one."""
    roots = F.transform(
        F.filter(nodes, lambda e: F.get(flags, e["n"])),
        lambda e: F.struct((e["n"] + 1).alias("lo"), (e["last"] + 1).alias("hi")),
    )
    spans = outermost(roots, "struct<lo:int,hi:int>", "lo", "hi")
    return let(spans, lambda s: covered(s, F.size(nodes)))


def _has_flags(nodes: Column, complexes: list[Complex]) -> Column:
    """``:has(...)``: relative selectors, evaluated from the far end back to the element."""

    def ends(c: Complex) -> Column:
        def back(k: int, flags: Column) -> Column:
            # flags: elements matching parts[k:]; result: elements standing left of combinators[k]
            comb = c.combinators[k]
            if comb == " ":
                left = _containing(nodes, flags)
            elif comb == ">":
                parents = F.transform(
                    F.filter(nodes, lambda e: F.get(flags, e["n"]) & (e["parent"] >= 0)),
                    lambda e: e["parent"],
                )
                left = marked(parents, F.size(nodes))
            else:
                left = _siblings_before(nodes, flags, adjacent=comb == "+")
            if k == 0:
                return left
            return let(left, lambda f: _both(nodes, f, c.parts[k - 1], lambda m: back(k - 1, m)))

        last = len(c.parts) - 1
        return _compound_flags(nodes, c.parts[last], lambda f: back(last, f))

    return _any([ends(c) for c in complexes])


def _both(nodes: Column, flags: Column, part: Compound, then: Callable) -> Column:
    return _compound_flags(
        nodes, part, lambda own: let(F.zip_with(flags, own, lambda x, y: x & y), then)
    )


def _containing(nodes: Column, flags: Column) -> Column:
    """Elements with a flagged element below them."""
    hits = F.transform(
        F.filter(nodes, lambda e: F.get(flags, e["n"])), lambda e: e["n"]
    )

    def counted(h: Column) -> Column:
        # number of hits at or before each position
        def step(st: Column, out: Column, e: Column, then) -> Column:
            now = st + F.get(flags, e["n"]).cast("int")
            return then(now, F.concat(out, F.array(now)))

        upto = scan(nodes, F.lit(0), step, "int", lambda st, out: out)
        return let(
            upto,
            lambda u: F.transform(nodes, lambda e: F.get(u, e["last"]) > F.get(u, e["n"])),
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, counted(h)).otherwise(F.transform(nodes, lambda e: F.lit(False))))


def _siblings_before(nodes: Column, flags: Column, adjacent: bool) -> Column:
    order = F.sort_array(
        F.transform(
            nodes,
            lambda e: F.struct(
                e["parent"].alias("parent"), (-e["n"]).alias("n"), F.get(flags, e["n"]).alias("f")
            ),
        )
    )
    state = F.struct(F.lit(-2).alias("parent"), F.lit(False).alias("seen"))

    def step(st: Column, out: Column, e: Column, then) -> Column:
        after = (st["parent"] == e["parent"]) & st["seen"]
        seen = e["f"] if adjacent else (e["f"] | after)
        nxt = F.struct(e["parent"].alias("parent"), seen.alias("seen"))
        return then(nxt, F.when(after, F.concat(out, F.array(-e["n"]))).otherwise(out))

    hits = scan(order, state, step, "int", lambda st, out: out)
    return let(hits, lambda h: marked(h, F.size(nodes)))


def _any(flag_arrays: list[Column]) -> Column:
    out = flag_arrays[0]
    for f in flag_arrays[1:]:
        out = F.zip_with(out, f, lambda x, y: x | y)
    return out


def _compound_flags(nodes: Column, c: Compound, then: Callable[[Column], Column]) -> Column:
    """Flags of one compound, bound once and handed to ``then``."""
    flags = F.transform(nodes, lambda e: _local(c, e))
    for rule in c.structural:
        if rule[0] in ("is", "not"):
            other = _flags(nodes, rule[1])
            if rule[0] == "not":
                other = F.transform(other, lambda x: ~x)
        elif rule[0] == "has":
            other = _has_flags(nodes, rule[1])
        else:
            other = _nth_flags(nodes, *rule)
        flags = F.zip_with(flags, other, lambda x, y: x & y)
    return let(flags, then)


def _complex_flags(nodes: Column, c: Complex) -> Column:
    def advance(k: int, flags: Column) -> Column:
        if k == len(c.parts):
            return flags
        comb = c.combinators[k]
        if comb == " ":
            reach = _inside(nodes, flags)
        elif comb == ">":
            reach = F.transform(
                nodes, lambda e: F.coalesce(F.get(flags, e["parent"]), F.lit(False))
            )
        else:
            reach = _siblings_after(nodes, flags, adjacent=comb == "+")
        return let(reach, lambda r: _both(nodes, r, c.parts[k], lambda m: advance(k + 1, m)))

    return _compound_flags(nodes, c.parts[0], lambda f: advance(1, f))


def _flags(nodes: Column, complexes: list[Complex]) -> Column:
    return _any([_complex_flags(nodes, c) for c in complexes])


class Matcher:
    """A parsed selector list, ready to test elements of a page."""

    def __init__(self, css: str):
        self.css = css
        self.complexes = parse_css(css)
        self.local = _is_local(self.complexes)

    def flags(self, nodes: Column) -> Column:
        """One boolean per element; ``nodes`` must be a bound variable or column."""
        return _flags(nodes, self.complexes)

    def test(self, e: Column, flags: Column | None) -> Column:
        if self.local:
            return _local_any(self.complexes, e)
        return F.get(flags, e["n"])
