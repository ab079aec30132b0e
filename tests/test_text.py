from attestry.functions import text as tx
from attestry.functions import web


def test_clean_text(values):
    got = values(tx.clean_text, ["  a–b  c ", "ﬁne\x07", " \x1f ", "", "x²", "é"])
    assert got == ["a-b c", "fine", None, None, "x2", "é"]


def test_placeholders(values):
    got = values(lambda c: tx.is_placeholder(tx.clean_text(c)), ["-- Unbranded --", " - ", "N/A", "Unknown Industries LLC", None])
    assert got == [True, True, True, False, True]


def test_entity_key(values):
    names = ["3M", "3M Company", "Acme Corp.", "ACME LLC", "B & D Co Inc", "Vendor Name (123)", "Company"]
    assert values(tx.entity_key, names) == ["3m", "3m", "acme", "acme", "b and d", "vendor name", ""]


def test_classification_query(values):
    got = values(tx.classification_query, [
        ("Hammer AB.1+ drill display  only", "ab.1+"), ("Cut N Grind Disc", None), ("Patio Dr Low-E", "zz"), ("24 in blade fan", "q")])
    assert got == ["Hammer drill", "abrasive cutting grinding disc", "patio door Low-E glass door", "24 in blade fan ceiling fan"]


def test_official_host_is_suffix_safe(values):
    got = values(web.is_official, [("https://shop.maker.com/x", "maker.com"), ("https://maker.com.evil.org", "maker.com"),
                                   ("https://notmaker.com", "maker.com"), ("http://WWW.Maker.com.:80", "https://maker.com/a"), ("", "maker.com")])
    assert got == [True, False, False, True, False]


def test_unescape_one_pass_and_rare_entities(values):
    assert values(web.whole_text, ["<b>A</b>&amp;lt;&copy;", "x&eacute;y &#8212; z"]) == ["A &lt;©", "xéy — z"]


def test_redirects(values):
    got = values(web.unwrap_redirect, ["//d.g/l/?uddg=https%3A%2F%2Fa.com%2Fp%3Fx%3D1&amp;rut=2", "https://b.com/?q=1"])
    assert got == ["https://a.com/p?x=1", "https://b.com/?q=1"]
