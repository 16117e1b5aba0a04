import hashlib
import random
import re

import pytest

from loomgraph.llm import pii


def plain(text):
    """The base rules as they are written."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_rules_on_random_texts():
    rnd = random.Random(1)
    for _ in range(6000):
        text = "".join(rnd.choice(["a", "B", "@", ".", "1", "25", "300", "-", " ", "+", "(", ")", "4111111111111111", "é", "_", "٣"]) for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain(text), text


DISGUISED = [
    ("write to john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("john(at)example.com", "email", "john(at)example.com"),
    ("mail jane {at} mail {dot} example {dot} org!", "email", "jane {at} mail {dot} example {dot} org"),
    ("mail joe AT example DOT net", "email", "joe AT example DOT net"),
    ("mail jоhn@еxample.com", "email", "jоhn@еxample.com"),
    ("mail john＠example．com", "email", "john＠example．com"),
    ("x jo​hn@exam​ple.com y", "email", "jo​hn@exam​ple.com"),
    ("jan @ example . org", "email", "jan @ example . org"),
    ("host 10 dot 0 dot 0 dot 1 is up", "ip", "10 dot 0 dot 0 dot 1"),
    ("host 192[.]168[.]1[.]20 is up", "ip", "192[.]168[.]1[.]20"),
    ("host １９２.168.1.20 is up", "ip", "１９２.168.1.20"),
    ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("card 4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
    ("call plus four nine one five one two three four five six seven now", "phone", "plus four nine one five one two three four five six seven"),
    ("call +four nine 151 234 five six seven now", "phone", "+four nine 151 234 five six seven"),
    ("ruf +vier neun eins fünf eins zwei drei vier fünf sechs an", "phone", "+vier neun eins fünf eins zwei drei vier fünf sechs"),
    ("call +４９ 151 2345678", "phone", "+４９ 151 2345678"),
    ("card 4lll 1111 IIII 1111 ok", "card", "4lll 1111 IIII 1111"),
    ("call +49 l5l 2345 67O now", "phone", "+49 l5l 2345 67O"),
    ("host 1O.0.0.l", "ip", "1O.0.0.l"),
    ("mail john_at_example_dot_com", "email", "john_at_example_dot_com"),
    ("courriel jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
]


@pytest.mark.parametrize(("text", "kind", "what"), DISGUISED)
def test_disguises(text, kind, what):
    base, spans = pii.find("é " * 300 + text)
    found = [(k, ("é " * 300 + text)[a:b]) for k, a, b in spans]
    assert (kind, what) in found, found
    assert all(s in spans for s in base)


@pytest.mark.parametrize("text", ["Meet me at home. Dot your i and at last. one two three, and four dogs", "the dot at the end of the line. At noon.", "un deux trois. Un homme et un chien", "a point at issue dot dot dot", "look at it . then go", "version 1 dot 2", "тест текст", "at", "(at) (dot) [.]", "see chapter 1 . 2 . 3", "Il a 1 I 2 O 3 ou", "10 o 12 l 14 of 300 I", "it was at page.Next line"])
def test_prose_has_no_span(text):
    assert pii.find(text) == ([], [])


def test_no_disguise_adds_nothing():
    text = "a@b.co 1.2.3.4, 4111 1111 1111 1111, +49 151 2345678"
    base, spans = pii.find(text)
    assert base == spans and [s[0] for s in base] == ["email", "ip", "card", "phone"]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "one " * 60_000, " at " * 60_000, "a.b" * 60_000 + " at x", "а" * 100_000, "1 dot " * 40_000):
        pii.find(text)


def test_scan(spark):
    rows = [(1, "a@b.co"), (2, None), (3, ""), (1, "a@b.co"), (4, "x [at] y [dot] de"), (None, "1.2.3.4")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.scan(df).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 1, 0, 0, 0, h("email:0:6"), "email:0:6"), (2, 0, 0, 0, 0, h(""), ""), (3, 0, 0, 0, 0, h(""), ""), (4, 0, 0, 0, 0, h(""), "email:0:17"), (None, 0, 1, 0, 0, h("ip:0:7"), "ip:0:7")}
    assert pii.scan(df).count() == 6 and pii.scan(df.limit(0)).count() == 0


def test_redacted():
    assert pii.redacted("to a [at] b [dot] org, 1.2.3.4") == "to [EMAIL], [IP]" and pii.redacted(None) == ""


def test_no_span_begins_inside_a_number_that_fails():
    """A mark far off must not cut a long run of digits: its tail is no card, and parts of a dotted run keep their places."""
    for text in ("4" * 40 + " w" * 71 + " слово", "4" * 40 + " 4" * 90 + " w" * 20 + " слово", "слово" + " w" * 75 + " 4444" * 30, "300" + ".7" * 79 + " слово", "слово " + "7." * 100 + "300"):
        base, spans = pii.find(text)
        assert spans == base, text[:60]


def test_stretches_end_between_tokens():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["w", "слово", " ", "  ", "4444", "a.b", "-", "\n", "5 5", "(at)", "x" * 170]) for _ in range(rnd.randint(1, 60)))
        at = 0
        for a, b in pii._stretches(text):
            assert at <= a < b <= len(text) and (a == 0 or text[a - 1].isspace() or text[a].isspace()) and (b == len(text) or text[b].isspace() or text[b - 1].isspace())
            before, after = text[:a].rstrip(), text[b:].lstrip()
            assert a == at or not before or before[-1] not in pii.NUMERIC
            assert not after or after[0] not in pii.NUMERIC
            at = b
        for k, c in enumerate(text):
            assert c.isascii() or any(a <= k < b for a, b in pii._stretches(text))
