"""Personal data: the plain patterns as they are written down, and disguises at their source places."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import frame, sha, tuples

from wildtally.llm import pii


def base(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            spans.append(("card", *m.span()))
    return spans + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "-", " ", "a", "b.c", "1", "23", "255", "256", "+", "(", ")", "4111111111111111", "é", "@@", "a@b.c", "+1 (234) 555-1234"]), max_size=25))
def test_plain(parts):
    text = "".join(parts)
    assert pii.plain(text) == base(text)


def test_disguised():
    cases = {
        "write to jane.doe (at) mail [dot] example (dot) com now": [("email", "jane.doe (at) mail [dot] example (dot) com")],
        "write to jane at example dot com now": [("email", "jane at example dot com")],
        "call plus one two three four five five five one two three four please": [("phone", "plus one two three four five five five one two three four")],
        "card ４１１１ １１１１ １１１１ １１１１ ok": [("card", "４１１１ １１１１ １１１１ １１１１")],
        "host one nine two dot one six eight dot one dot nine up": [("ip", "one nine two dot one six eight dot one dot nine")],
        "mail jоhn@exаmple.cоm": [("email", "jоhn@exаmple.cоm")],
        "mail me@exam​ple.com": [("email", "me@exam​ple.com")],
    }
    for text, expected in cases.items():
        found = [(k, text[a:b]) for k, a, b in pii.disguised(text, [s for s in pii.plain(text) if False])]
        assert found == expected, text
    for clean in ["we met at the dot and at home", "one two buckle my shoe", "look at this. dot com boom", "seven of nine", "a price of one, two or three"]:
        assert pii.plain(clean) == [] and pii.disguised(clean, []) == []


def test_each_disguise_alone():
    cases = {
        "ask john.smith at example.com": [("email", "john.smith at example.com")],
        "ask john.smith at example . com": [("email", "john.smith at example . com")],
        "ask john.smith@example . com": [("email", "john.smith@example . com")],
        "ask john.smith @ example.com": [("email", "john.smith @ example.com")],
        "ask john@mail dot example dot it": [("email", "john@mail dot example dot it")],
        "ask john at example dot it": [("email", "john at example dot it")],
        "ask john at example dot museum today": [("email", "john at example dot museum")],
        "ask jo (at) b.it": [("email", "jo (at) b.it")],
        "one point two point three point four": [("ip", "one point two point three point four")],
        "call plus 4 nine 1 five 1 two 3 four 5 six now": [("phone", "plus 4 nine 1 five 1 two 3 four 5 six")],
        "four-1-one-1-one-1-one-1-one-1-one-1-one-1-one-1": [("card", "four-1-one-1-one-1-one-1-one-1-one-1-one-1-one-1")],
    }
    for text, expected in cases.items():
        for around in ("{}", "{} and (at) last", "{} é"):
            found = [(k, around.format(text)[a:b]) for k, a, b in pii.disguised(around.format(text), [])]
            assert found == expected, text
    for clean in ["look at the dot in the middle", "met me at noon dot dot dot then", "stay at this dot and go", " " * 300_000, "a.b@" * 20_000, "a at " + "b." * 50_000]:
        assert pii.disguised(clean, []) == []


def test_places_are_no_addresses():
    links = ["Visit us at example.com", "The code is available at github.com", "Read it at www.example.org", "He works at home.de", "contact us at example.com", "see the page at docs.example.org now"]
    for text in links:
        assert pii.plain(text) == [] and pii.disguised(text, []) == [], text
        assert pii.redacted(text, pii.disguised(text, [])) == text
    cases = {
        "mail john at example.com": "john at example.com",
        "Contact sales at example.com today": "sales at example.com",
        "e-mail: jane at example.org": "jane at example.org",
        "my address is jane at example.org": "jane at example.org",
        "so ask j.doe at example.com": "j.doe at example.com",
        "so ask doe7 at example.com": "doe7 at example.com",
        "so ask doe at example . com": "doe at example . com",
        "so ask doe at example dot com": "doe at example dot com",
    }
    for text, span in cases.items():
        assert [(k, text[a:b]) for k, a, b in pii.disguised(text, [])] == [("email", span)], text


def test_rows(spark):
    rows = [(1, "a@b.cd and 10.0.0.1, x (at) y (dot) zz"), (2, None), (3, ""), (None, "+1 (234) 555-1234"), (1, "clean"), (4, "1" * 50_000 + "@" + "." * 50_000)]
    found = {(r.doc_id, r.spans): r for r in pii.find(frame(spark, rows)).collect()}
    assert set(found) == {(1, "email:0:6,email:21:38,ip:11:19"), (2, ""), (3, ""), (None, "phone:0:17"), (1, ""), (4, "")}
    row = found[1, "email:0:6,email:21:38,ip:11:19"]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0) and row.base_sha256 == sha("email:0:6,ip:11:19")
    clean = pii.redact(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns
    assert ("[EMAIL] and [IP], [EMAIL]", 25) in tuples(clean, "text", "n_chars") and (None, None) in tuples(clean, "text", "n_chars")
    assert pii.find(frame(spark, [])).collect() == []
