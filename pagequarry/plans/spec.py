"""The extraction spec: what to read, which links to follow, what to pull out.

A spec is a small JSON or YAML document.  It is checked here, on the driver,
before any job starts; the selector trees then become DataFrame expressions.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..functions.css import CssError, parse_css
from ..functions.jsonpath import compile_path

VERSION = "1.0.0"
EXTRACTORS = ("text", "html", "attribute", "jsonpath")
MODIFIERS = ("iso_date_parser", "regex")


class SpecError(ValueError):
    """The spec breaks a rule; ``rule`` is its short name, ``where`` the place."""

    def __init__(self, rule: str, where: str, message: str):
        super().__init__(f"{where}: {message}")
        self.rule, self.where = rule, where


class Problems(list):
    """Broken rules found so far; each ``attempt`` covers one independent part of a spec."""

    @contextmanager
    def attempt(self):
        try:
            yield
        except SpecError as e:
            self.append(e)

    def raise_first(self) -> None:
        if self:
            raise self[0]


@dataclass(frozen=True)
class Extract:
    type: str = "text"
    key: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class Modifier:
    type: str
    regex: tuple[str, ...] = ()
    returns: str = "original"


@dataclass(frozen=True)
class Selector:
    """One node of a selector tree.

    Exactly one of ``ref`` (name of a common selector), ``child``,
    ``children`` or the leaf part (``extract``, ``modifiers``) is meaningful.
    """

    key: str = ""
    css: str = "*"
    select: str = "first"
    include_self: bool = False
    child: "Selector | None" = None
    children: "tuple[Selector, ...] | None" = None
    extract: Extract = Extract()
    modifiers: tuple[Modifier, ...] = ()
    ref: str | None = None

    @property
    def is_leaf(self) -> bool:
        return self.child is None and self.children is None


@dataclass(frozen=True)
class PageGroup:
    urls: tuple[str, ...]
    url_selectors: Selector
    selectors: Selector
    metadata: dict | None = field(default=None, hash=False)


def _need(ok: bool, rule: str, where: str, message: str) -> None:
    if not ok:
        raise SpecError(rule, where, message)


def _typed(value, kind: type, rule: str, where: str):
    _need(isinstance(value, kind), rule, where, f"must be a {kind.__name__}, got {value!r}")
    return value


def _filled(value, kind: type, rule: str, where: str):
    _need(len(_typed(value, kind, rule, where)) > 0, rule, where, "must not be empty")
    return value


def _one_of(value, allowed: tuple, rule: str, where: str):
    _typed(value, str, rule, where)
    _need(value in allowed, rule, where, f"must be one of {list(allowed)}, got {value!r}")
    return value


def _strings(value, rule: str, where: str) -> tuple[str, ...]:
    for item in _filled(value, list, rule, where):
        _typed(item, str, rule, where)
    return tuple(value)


def _extract(raw, where: str) -> Extract:
    if raw is None:
        return Extract()
    _typed(raw, dict, "extract", where)
    kind = raw.get("type")
    kind = "text" if kind is None else _one_of(kind, EXTRACTORS, "extract.type", where)
    if kind == "attribute":
        return Extract(kind, key=_typed(raw.get("key"), str, "extract.key", where))
    if kind == "jsonpath":
        path = _typed(raw.get("path"), str, "extract.path", where)
        try:
            compile_path(path)
        except ValueError as e:
            raise SpecError("extract.path", where, str(e)) from e
        return Extract(kind, path=path)
    return Extract(kind)


def _modifier(raw, where: str) -> Modifier:
    _typed(raw, dict, "modifier", where)
    kind = _one_of(raw.get("type"), MODIFIERS, "modifier.type", where)
    if kind != "regex":
        return Modifier(kind)
    patterns = _strings(raw.get("regex"), "modifier.regex", where)
    returns = raw.get("return")
    if returns is None:
        return Modifier(kind, patterns)
    allowed = ("original", "first")
    return Modifier(kind, patterns, _one_of(returns, allowed, "modifier.return", where))


def parse_selector(raw, where: str = "selector") -> Selector:
    """A selector tree from its JSON form; the first broken rule is raised."""
    problems = Problems()
    selector = _selector(raw, where, problems)
    problems.raise_first()
    return selector


def _css(css: str, where: str) -> str:
    """A selector list that can be evaluated."""
    try:
        parse_css(css)
    except CssError as e:
        raise SpecError("selector.css", where, str(e)) from None
    return css


def _selector(raw, where: str, problems: Problems) -> Selector:
    if not isinstance(raw, dict):
        problems.append(SpecError("selector", where, f"must be a dict, got {raw!r}"))
        return Selector()
    ref = raw.get("common_selector")
    if ref is not None:
        with problems.attempt():
            return Selector(ref=_typed(ref, str, "common_selector", where))
        return Selector()

    key, css, select, own = "", raw.get("selector"), raw.get("select"), raw.get("include_self")
    with problems.attempt():
        key = _typed(raw.get("key"), str, "key", where)
    where = f"{where}/{key}"
    with problems.attempt():
        css = "*" if css is None else _css(_typed(css, str, "selector.css", where), where)
    with problems.attempt():
        select = "first" if select is None else _one_of(select, ("first", "all"), "select", where)
    with problems.attempt():
        _need(own in (None, True, "true"), "include_self", where, "must be 'true' or true")

    base = Selector(key=key, css=css, select=select, include_self=own is not None)
    if raw.get("child") is not None:
        return replace(base, child=_selector(raw["child"], where, problems))
    if raw.get("children") is not None:
        items = []
        with problems.attempt():
            items = _typed(raw["children"], list, "children", where)
        return replace(base, children=tuple(_selector(c, where, problems) for c in items))
    extract, listed, mods = Extract(), raw.get("modifiers"), []
    with problems.attempt():
        extract = _extract(raw.get("extract"), where)
    if listed is not None:
        with problems.attempt():
            _filled(listed, list, "modifiers", where)
            for m in listed:
                with problems.attempt():
                    mods.append(_modifier(m, where))
    return replace(base, extract=extract, modifiers=tuple(mods))


def resolve(selector: Selector, common: dict[str, Selector], path: tuple = ()) -> Selector:
    """Replace every reference by what it names; a cycle is an error."""
    if selector.ref is not None:
        name = selector.ref
        _need(name in common, "unknown_reference", name, "no such common selector")
        _need(name not in path, "reference_loop", name, "selector loop: " + " > ".join(path + (name,)))
        return resolve(common[name], common, path + (name,))
    if selector.child is not None:
        return replace(selector, child=resolve(selector.child, common, path))
    if selector.children is not None:
        return replace(
            selector, children=tuple(resolve(c, common, path) for c in selector.children)
        )
    return selector


def _check_links(selector: Selector, where: str) -> None:
    """Links must come out as one list: a leaf, or 'first' single children down to a leaf."""
    node = selector
    while node.child is not None:
        _need(node.select == "first", "url_selectors.shape", where, "only 'first' may have a child")
        node = node.child
    _need(node.is_leaf, "url_selectors.shape", where, "must end in a leaf, not in 'children'")


def _group(raw, index: int, common: dict[str, Selector], problems: Problems) -> PageGroup:
    where = f"pages[{index}]"
    if not isinstance(raw, dict):
        problems.append(SpecError("pages.item", where, f"must be a dict, got {raw!r}"))
        return PageGroup((), Selector(), Selector())
    metadata, urls = raw.get("metadata"), ()
    with problems.attempt():
        metadata is None or _typed(metadata, dict, "metadata", where)
    with problems.attempt():
        urls = _strings(raw.get("urls"), "urls", where)

    def tree(name: str, check) -> Selector:
        found = Problems()
        out = Selector()
        with found.attempt():
            body = check(raw.get(name), dict, name, where)
            out = _selector(body, f"{where}.{name}", found)
        if not found:
            with found.attempt():
                out = resolve(out, common)
                if name == "url_selectors":
                    _check_links(out, f"{where}.{name}")
        problems.extend(found)
        return out

    return PageGroup(urls, tree("url_selectors", _filled), tree("selectors", _typed), metadata)


@dataclass(frozen=True)
class Spec:
    groups: tuple[PageGroup, ...]
    common: dict[str, Selector] = field(default_factory=dict, hash=False)

    @staticmethod
    def from_dict(raw: dict) -> "Spec":
        spec, problems = check_spec(raw)
        problems.raise_first()
        return spec

    @staticmethod
    def from_json(text: str) -> "Spec":
        return Spec.from_dict(json.loads(text))

    @staticmethod
    def from_yaml(text: str) -> "Spec":
        import yaml

        return Spec.from_dict(yaml.safe_load(text))

    @staticmethod
    def from_file(path: str) -> "Spec":
        if path.endswith(".json"):
            return Spec.from_json(Path(path).read_text())
        if path.endswith(".yaml"):
            return Spec.from_yaml(Path(path).read_text())
        raise SpecError("file", path, "spec file must end in .json or .yaml")


def check_spec(raw) -> tuple[Spec, Problems]:
    """The spec and every rule it breaks."""
    problems = Problems()
    if not isinstance(raw, dict):
        problems.append(SpecError("spec", "spec", f"must be a dict, got {raw!r}"))
        return Spec(()), problems
    pages, listed = [], raw.get("common_selectors")
    with problems.attempt():
        _one_of(raw.get("version"), (VERSION,), "version", "version")
    with problems.attempt():
        pages = _filled(raw.get("pages"), list, "pages", "pages")
    common: dict[str, Selector] = {}
    if listed is not None:
        with problems.attempt():
            for item in _filled(listed, list, "common_selectors", "common_selectors"):
                with problems.attempt():
                    _typed(item, dict, "common_selectors", "common_selectors")
                    name = _typed(
                        item.get("name"), str, "common_selectors.name", "common_selectors"
                    )
                    where = f"common:{name}"
                    body = _typed(item.get("selector"), dict, "common_selectors.selector", where)
                    common[name] = _selector(body, where, problems)
    groups = tuple(_group(g, i, common, problems) for i, g in enumerate(pages))
    return Spec(groups, common), problems


def _character(pattern: str, i: int) -> tuple[int, int] | None:
    """Code and end of an escaped character at ``i`` that Java writes another way."""
    if m := re.compile(r"\\(?:U([0-9A-Fa-f]{8})|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))").match(pattern, i):
        return int(m[1] or m[2] or m[3], 16), m.end()
    if m := re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{2})").match(pattern, i):
        return int(m[1], 8), m.end()
    return (11, i + 2) if pattern.startswith("\\v", i) else None


def _compiles_in_java(pattern: str) -> bool:
    """Ask the JVM, if there is one."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def java_regex(pattern: str) -> str | None:
    """A Python pattern in Java's dialect; None if it is not a valid pattern.

    What Java cannot say, such as a choice that depends on a group, is a ``SpecError``.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if found := _character(pattern, i):
                code, i = found
                out.append(f"\\x{{{code:X}}}")
                continue
            nxt = pattern[i + 1]
            out.append("\\z" if nxt == "Z" and not in_class else c + nxt)
            i += 2
            continue
        if c in "{}" and not in_class:
            count = re.compile(r"\{(\d*)(,?)(\d*)\}").match(pattern, i)
            if count and (count[1] or count[2]):
                out.append("{" + (count[1] or "0") + count[2] + count[3] + "}")
                i = count.end()
            else:
                out.append("\\" + c)
                i += 1
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[" or pattern.startswith("&&", i):
                out.append("\\")
        elif c == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:]).group()
            out.append(head.replace("]", "\\]"))
            i += len(head)
            continue
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append("\\k<" + pattern[i + 4 : end] + ">")
            i = end + 1
            continue
        out.append(c)
        i += 1
    java = "(?dU)" + "".join(out)
    if not _compiles_in_java(java):
        raise SpecError("modifiers.regex", "modifiers", f"no like in Java for the pattern {pattern!r}")
    return java


def may_match_empty(pattern: str) -> bool:
    """Whether a valid pattern can match without taking a character."""
    return re._parser.parse(pattern).getwidth()[0] == 0
