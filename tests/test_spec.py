import copy
import json

import pytest

from pagequarry.functions.css import CssError, parse_css
from pagequarry.operators.quality import broken_rules
from pagequarry.plans.spec import Spec, SpecError, java_regex, may_match_empty, parse_selector

GOOD = {
    "version": "1.0.0",
    "pages": [
        {
            "metadata": {"a": 1},
            "urls": ["http://h.com/"],
            "url_selectors": {"key": "u", "selector": "a", "select": "all"},
            "selectors": {"common_selector": "x"},
        }
    ],
    "common_selectors": [
        {"name": "x", "selector": {"key": "k", "child": {"common_selector": "y"}}},
        {"name": "y", "selector": {"key": "l", "selector": "p"}},
    ],
}


def changed(path, value):
    spec = copy.deepcopy(GOOD)
    at = spec
    for p in path[:-1]:
        at = at[p]
    if value is None:
        at.pop(path[-1])
    else:
        at[path[-1]] = value
    return spec


G = ("pages", 0)
SEL = (*G, "selectors")
BAD = {
    "version": (("version",), "2.0.0"),
    "pages": (("pages",), []),
    "urls": ((*G, "urls"), []),
    "metadata": ((*G, "metadata"), "x"),
    "url_selectors": ((*G, "url_selectors"), {}),
    "selectors": (SEL, None),
    "key": (SEL, {"selector": "p"}),
    "selector.css": (SEL, {"key": "k", "selector": "a:hover"}),
    "select": (SEL, {"key": "k", "select": "some"}),
    "include_self": (SEL, {"key": "k", "include_self": False}),
    "extract.type": (SEL, {"key": "k", "extract": {"type": "x"}}),
    "extract.key": (SEL, {"key": "k", "extract": {"type": "attribute"}}),
    "extract.path": (SEL, {"key": "k", "extract": {"type": "jsonpath", "path": "$.["}}),
    "modifiers": (SEL, {"key": "k", "modifiers": []}),
    "modifier.type": (SEL, {"key": "k", "modifiers": [{"type": "x"}]}),
    "modifier.regex": (SEL, {"key": "k", "modifiers": [{"type": "regex", "regex": []}]}),
    "modifier.return": (
        SEL,
        {"key": "k", "modifiers": [{"type": "regex", "regex": ["a"], "return": "last"}]},
    ),
    "unknown_reference": (SEL, {"common_selector": "nope"}),
    "url_selectors.shape": ((*G, "url_selectors"), {"key": "k", "select": "all", "child": {"key": "a"}}),
    "common_selectors": (("common_selectors",), []),
}


@pytest.mark.parametrize("rule", BAD)
def test_broken_rules(rule):
    with pytest.raises(SpecError) as e:
        Spec.from_dict(changed(*BAD[rule]))
    assert e.value.rule == rule


def test_all_broken_rules_are_reported(spark):
    bad = changed(("version",), "9")
    bad["pages"][0]["urls"] = []
    bad["pages"][0]["selectors"] = {"key": "k", "children": [{"select": "x"}, {"key": "m", "modifiers": [{"type": "regex"}]}]}
    df = spark.createDataFrame([(1, json.dumps(bad)), (2, json.dumps(GOOD)), (3, "{")], "id int, spec string")
    got = sorted((r.id, r.rule) for r in broken_rules(df, "id", "spec").collect())
    assert got == [(1, "key"), (1, "modifier.regex"), (1, "select"), (1, "urls"), (1, "version"), (3, "json")]


def test_good_spec_in_all_forms(tmp_path):
    spec = Spec.from_dict(GOOD)
    assert spec.groups[0].selectors.child.css == "p"
    assert Spec.from_json(json.dumps(GOOD)) == spec
    (tmp_path / "s.yaml").write_text(json.dumps(GOOD))
    (tmp_path / "s.json").write_text(json.dumps(GOOD))
    assert Spec.from_file(str(tmp_path / "s.yaml")) == spec
    assert Spec.from_file(str(tmp_path / "s.json")) == spec
    with pytest.raises(SpecError):
        Spec.from_file(str(tmp_path / "s.toml"))


def test_reference_loops_and_reuse():
    loop = changed(("common_selectors", 1, "selector"), {"common_selector": "x"})
    with pytest.raises(SpecError) as e:
        Spec.from_dict(loop)
    assert e.value.rule == "reference_loop"
    own = changed(("common_selectors", 0, "selector"), {"common_selector": "x"})
    with pytest.raises(SpecError):
        Spec.from_dict(own)
    twice = changed(SEL, {"key": "m", "children": [{"common_selector": "x"}, {"common_selector": "x"}]})
    assert len(Spec.from_dict(twice).groups[0].selectors.children) == 2


def test_node_precedence():
    s = parse_selector({"key": "k", "child": {"key": "c"}, "children": [], "extract": {"type": "html"}})
    assert s.child is not None and s.children is None and s.extract.type == "text"
    assert parse_selector({"common_selector": "x", "key": 5}).ref == "x"


def test_css_errors():
    for bad in ["", "p >", "> p", "p:nope", "[a=", "p::before", ":not(", "a,,b"]:
        with pytest.raises(CssError):
            parse_css(bad)


def test_regex_dialect():
    assert java_regex("(") is None
    assert java_regex(r"(?P<a>x)(?P=a)\Z") == r"(?dU)(?<a>x)\k<a>\z"
    assert java_regex("[[a&&b]") == r"(?dU)[\[a\&&b]"
    assert may_match_empty("a*") and not may_match_empty("a+")
