import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.functions import filters as f
from canopy.functions import names, url
from canopy.model import DirectoryError, FilterParseError, Scope


@pytest.mark.parametrize(
    "text, node",
    [
        ("(foo=bar)", f.equal("foo", "bar")),
        ("foo=b", f.equal("foo", "b")),
        ("(foo~=bar)", f.approximate("foo", "bar")),
        ("(foo>=1)", f.at_least("foo", "1")),
        ("(foo<=1)", f.at_most("foo", "1")),
        ("(foo=*)", f.present("foo")),
        ("(foo=bar*)", f.starts_with("foo", "bar")),
        ("(foo=*bar)", f.ends_with("foo", "bar")),
        ("(foo=*bar*)", f.contains("foo", "bar")),
        ("(foo=this*is*a*filter)", f.Substring("foo", "this", ("is", "a"), "filter")),
        ("givenName:=Chad", f.extensible("givenName", "Chad")),
        (":dn:1.2.3:=Chad", f.Extensible("Chad", None, "1.2.3", True)),
        ("o:dn:=Chad", f.Extensible("Chad", "o", None, True)),
        ("(cn:1.2.3:=x)", f.Extensible("x", "cn", "1.2.3", False)),
        ("(&(a=1)(|(b=2)(!(c=3))))", f.all_of(f.equal("a", "1"), f.any_of(f.equal("b", "2"), f.negate(f.equal("c", "3"))))),
        (r"(cn=Lu\c4\8di\c4\87)", f.equal("cn", "Lučić")),
        (r"(cn=a\2ab)", f.equal("cn", "a*b")),
    ],
)
def test_accepted(text, node):
    assert f.parse(text) == node


@pytest.mark.parametrize(
    "text",
    ["", "(foo=)", "foo=", "(=bar)", "(foo>4)", "(&)", "(&", "foo=bar)", "(foo=bar)foo", "(foo=bar)(foo)", "(!(&(foo=bar)))",
     "(&(foo=bar)(|(&(foo=bar)))", ":dn::=Chad", "&^]:=Chad", "?:=Chad", ":dn:=Chad", "(foo=**)"],
)
def test_rejected(text):
    with pytest.raises(FilterParseError):
        f.parse(text)


def test_any_size_and_depth():
    text = "(&(|" * 2500 + "(a=1)" + "))" * 2500
    assert f.show(f.parse(text)) == text
    wide = "(|" + "".join(f"(a={k})" for k in range(20_000)) + ")"
    assert len(f.parse(wide)) == 20_000 and str(f.parse(wide)) == wide
    for wrong in ("(&" * 5000, "(&" * 5000 + "(a=1)", "(|(a=1)" * 3000 + ")" * 2999):
        with pytest.raises(FilterParseError):
            f.parse(wrong)


def test_containers_are_edited_as_new_ones():
    a, b, c = (f.equal(x, "1") for x in "abc")
    node = f.all_of(a, b)
    assert node.has(a) and not node.has(c) and len(node) == 2 and list(node) == [a, b]
    assert node.added(c).removed(a) == f.all_of(b, c) and node.replaced(c) == f.all_of(c) and node == f.all_of(a, b)
    assert f.any_of() or False


def test_url_extensions():
    parsed = url.parse("ldap:///dc=x????!e-bindname=cn=a%2cdc=b,x,y=1")
    assert parsed.extensions == (url.Extension("e-bindname", "cn=a,dc=b", True), url.Extension("x"), url.Extension("y", "1"))
    assert url.parse(str(parsed)) == parsed
    with pytest.raises(DirectoryError):
        url.parse_extension("!")


def test_lenient_negation():
    assert f.parse("(!(&(a=1)(b=2)))", strict=False) == f.negate(f.all_of(f.equal("a", "1"), f.equal("b", "2")))


names_ = st.from_regex(r"[a-zA-Z][a-zA-Z0-9-]{0,8}", fullmatch=True)
values = st.text(min_size=1, max_size=8).filter(lambda v: not re.fullmatch(r"(\\[0-9a-fA-F]{2})*", v) and v.encode("utf-8", "ignore").decode() == v)
items = st.one_of(
    st.builds(f.Compare, names_, st.sampled_from(["=", "~=", ">=", "<="]), values),
    st.builds(f.Present, names_),
    st.builds(f.Substring, names_, values, st.lists(values, max_size=2).map(tuple), st.none() | values),
    st.builds(f.Extensible, values, names_, st.none() | st.just("2.5.13.2"), st.booleans()),
)
nodes = st.recursive(
    items,
    lambda inner: st.one_of(
        st.builds(f.And, st.lists(inner, min_size=1, max_size=3).map(tuple)), st.builds(f.Or, st.lists(inner, min_size=1, max_size=3).map(tuple)), st.builds(f.Not, inner)
    ),
    max_leaves=6,
)


@settings(max_examples=200, deadline=None)
@given(nodes)
def test_parse_of_print(node):
    assert f.parse(str(node), strict=False) == node


def test_names():
    assert names.parts(r"cn=fo\,o, dc=local,dc=example") == [r"cn=fo\,o", "dc=local", "dc=example"]
    assert names.parent(r"cn=fo\,o, dc=local,dc=example") == "dc=local,dc=example"
    assert names.parts("") == [] and names.parent("") is None and names.parent("dc=a") is None
    assert names.parts("cn=a\\\\,dc=b") == ["cn=a\\\\", "dc=b"]
    assert names.is_valid("cn=foo,dc=bar=dc=foo") and not names.is_valid("foo")
    assert names.pairs(r"CN=a\2cb+x=1,dc=c") == [("cn", "a,b"), ("dc", "c")]
    with pytest.raises(DirectoryError):
        names.pairs("foo")
    assert names.escape_value("# a, b ") == r"\23 a\2c b\20"
    assert names.escape_assertion("a(b)*\\") == r"a\28b\29\2a\5c"
    assert names.escape_all("fo") == r"\66\6f"


def test_urls():
    parsed = url.parse("ldap://host:389/o=x%2c,c=US?cn,sn?sub?(cn=a%20b)?!e=1")
    assert (parsed.host, parsed.port, parsed.base, parsed.attributes, parsed.scope, parsed.filter) == ("host", 389, "o=x,,c=US", ("cn", "sn"), "sub", "(cn=a b)")
    request = url.parse("ldap:///dc=a??one?(x=1)").request()
    assert request.scope == Scope.ONE and request.base == "dc=a" and request.filter == "(x=1)"
    assert url.parse("ldap://h").request().scope == Scope.BASE
    for text in ("ldap://h/dc=a??one?(x=1)", "ldaps://h:636/", "ldap:///dc=a?cn"):
        assert str(url.parse(text)) == text
    with pytest.raises(DirectoryError):
        url.parse("http://h/")
