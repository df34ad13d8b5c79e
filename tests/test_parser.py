import pytest

from nestql.errors import QueryError
from nestql.plans.parser import EnumValue, Field, Spread, Variable, parse


def test_values_and_aliases():
    doc = parse('query Q($a: [Int!]! = [1], $b: String) { x: f(i: -3, d: 1.5e2, s: "a\\"\\u00e9", t: true, n: null, e: RED, l: [1, $b], o: {k: "v"}) { id } } # end')
    op = doc.operations[0]
    f = op.selections[0]
    assert (op.name, op.variables, op.required) == ("Q", {"a": [1]}, set())
    assert (f.alias, f.name) == ("x", "f")
    assert f.args == {"i": -3, "d": 150.0, "s": 'a"é', "t": True, "n": None, "e": EnumValue("RED"), "l": [1, Variable("b")], "o": {"k": "v"}}
    assert f.selections == [Field("id", "id")]


def test_fragments_and_directives():
    doc = parse("{ ...F @include(if: true) ... on T { a } ... @skip(if: $x) { b } on } fragment F on U { c }")
    one, two, three, four = doc.operations[0].selections
    assert one.name == "F" and one.directives == {"include": {"if": True}}
    assert isinstance(two, Spread) and two.on == "T"
    assert three.on is None and three.directives == {"skip": {"if": Variable("x")}}
    assert four.name == "on"
    assert doc.fragments["F"].on == "U"


@pytest.mark.parametrize("text", ["{", "{ a(", "{ a(x: ) }", "mutation { a }", "{ a ? }", "{ a } }"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)
