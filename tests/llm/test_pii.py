import re

from pyspark.sql import functions as F

from attestry.llm.pii import BASE, find, redact, scores

from oddrows import rows

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def model(text):
    out = []
    for rank, kind in enumerate(BASE):
        for m in re.finditer(PLAIN[kind], text or ""):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), rank, m.end(), kind, v))
    return sorted(out)


TEXTS = ["1.2.3.4.5.6.7.8.9", "0001.2.3.255 1.2.3.256", "a@b.c.d. x@y", "a@b.c_d@e.f", "x@-y.z@q.r", "+1 (2) 345-6789-0 +12 3", "4111-1111-1111-1111 2",
         "1 2 3 4 5 6 7 8 9 0 1 2 3", "79927398713 4 2", "é +49 30 1234567 +", "4" * 19 + " " + "4" * 16, "1.1.1.1@a.b", "00000000000000", "9@9.9.9.9.9", "+1234567890123456"]


def test_base_spans(spark, odd, none):
    for text_rows in (TEXTS, [r[1] for r in rows()]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(text_rows)], "doc_id int, text string")
        for r in find(df).collect():
            got = [(s.start, s.rank, s.end, s.kind, s.value) for s in r.spans if s.kind in BASE]
            assert got == model(text_rows[r.doc_id]), text_rows[r.doc_id]
    assert find(none).collect() == [] and find(odd).count() == len(rows())


def test_random_texts(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789 .-+()@ab1234") for _ in range(rng.randint(0, 120))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in find(df).collect():
        assert [(s.start, s.rank, s.end, s.kind, s.value) for s in r.spans if s.kind in BASE] == model(texts[r.doc_id]), texts[r.doc_id]


def test_account_numbers_context_and_redaction(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00!", "DE88 3704 0044 0532 0130 00", "xGB82WEST12345698765432", "GB82WEST12345698765432",
             "version 1.2.3.4", "host 1.2.3.4", "a@b.cd, +1 555 123 4567 é", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find(df).collect()}
    assert ("iban", 5, 32) in spans[0] and not [s for s in spans[1] + spans[2] if s[0] == "iban"] and spans[3][0] == ("iban", 0, 22)
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[4] == "version 1.2.3.4" and clean[5] == "host [IP]" and clean[6] == "[EMAIL], [PHONE] é" and clean[7] is None


def test_context_words_move_the_score(spark):
    """Raised by a word of the kind, lowered by one of the opposite sense, both within the window before the span only."""
    texts = ["1.2.3.4", "host 1.2.3.4", "version 1.2.3.4", "server version 1.2.3.4", "version" + " " * 40 + "1.2.3.4", "1.2.3.4 version",
             "call +1 555 123 4567 or mail a@b.cd", "VERSION\n1.2.3.4", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r[0]: r[1] for r in find(df).select("doc_id", scores(F.col("spans"))).collect()}
    assert got == {0: "600", 1: "800", 2: "300", 3: "500", 4: "600", 5: "600", 6: "800,1000", 7: "300", 8: "", 9: ""}
