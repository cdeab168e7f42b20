import random
import re

from ironlift.llm.pii import find, find_pii, iban_valid, luhn, redact_pii, redacted

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "phone" and 10 <= len(digits) <= 15 or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
            ok = ok or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
            if ok:
                out.append((kind, *m.span()))
    order = list(RULES)
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def base(text):
    return [s for s in find(text) if s[0] in RULES]


def test_random_texts_match_the_expressions():
    rnd = random.Random(5)
    for alphabet in ("a@.b-1", "12.5 -+()", "0123456789", "1. -", "a1@+.() -", "4 -"):
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert base(text) == brute(text), text


def test_whole_table(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert base(r.text) == brute(r.text)


def test_added_kinds():
    assert find("see https://bob:secret@host/x now")[0][0] == "url"
    assert find("IBAN: DE89 3704 0044 0532 0130 00 thanks") [-1][0] == "iban" and iban_valid("DE89370400440532013000")
    assert ("account", 13, 21) in find("Account no.: 12345678.")


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co", "x"), (3, "a@b.co", "x"), (4, "é a@b.co " * 5000, None)]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert out[1].spans_ == [] and out[2].spans_ == [] and [tuple(s) for s in out[3].spans_] == [("email", 0, 6)] and len(out[4].spans_) == 5000
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clean = {r.doc_id: r.text for r in redact_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "<EMAIL>" and "@" not in clean[4]
    assert redacted("x 1 y", [("ip", 2, 3)]) == "x <IP> y"
