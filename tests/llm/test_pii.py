"""Personal data against its definition, match by match."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from carecycle.llm import pii, queries

FOLDER = "/root/testdata/sf0.001"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_base(text):
    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_base_spans(spark):
    rng = random.Random(3)
    parts = [
        "a.b+c@d-e.f.g", "x@y", "@", "a@b.c@d.e", "_x@y.z_x@y.z.", "1.2.3.4", "256.1.1.1", "000255.0.0.01", "1.2.3.4.5.6.7.8",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 14, "0" * 20, "3 3", "+1 (974) 555-3436", "+49 30 1234567", "++12",
        "+1+1(2)3", "é", "ü\U0001f600", " ", "-", ".", "+", "9", "12.", "\n", "tel ", "no. ", "(", ")",
    ]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (None, "a@b.c"), (5002, "a@b.c"), (5002, "a@b.c"), (5003, "x@y.z 1.2.3.4 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    base = F.filter("spans", lambda s: s["base"])
    found = pii.find(df).select("doc_id", "text", pii.listed(base).alias("base"), "spans").collect()
    want = sorted(((str(i), t or "", ",".join(plain_base(t or ""))) for i, t in rows))
    assert sorted((str(r.doc_id), r.text, r.base) for r in found) == want
    for r in found:
        assert all(r.text[s.start : s.end] == s.text and 0 <= s.score <= 1 for s in r.spans)
        assert [(s.start, s.order) for s in r.spans] == sorted((s.start, s.order) for s in r.spans)
    assert pii.find(df.filter("false")).count() == 0


def spans_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = pii.find(df).withColumn("masked", pii.masked(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    return [([(s.kind, s.text, s.score) for s in r.spans], r.masked) for r in found]


def test_checks_and_context(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    found = spans_of(
        spark, f"Zahle auf {iban} bitte", iban.replace(" ", ""), "DE88 3704 0044 0532 0130 00", "X" + iban,
        "GB82WEST12345698765432.", "my SSN: 123-45-6789.", "part 123-45-6789", "SSN 000-45-6789", "SSN 1123-45-6789",
        "card 4111111111111111", "order 4111111111111111", "4111111111111111", "version 1.2.3.4", "host 1.2.3.4",
        "a@b.c und 1.2.3.4 é", "card 49927398716 000 4111111111111111 x",
    )
    kinds = [[k for k, _, _ in spans] for spans, _ in found]
    assert kinds[:9] == [["iban"], ["iban"], [], [], ["iban"], ["ssn"], [], [], []]
    assert found[0] == ([("iban", iban, 0.875)], "Zahle auf <iban> bitte")
    assert [spans[0][2] for spans, _ in found[9:12]] == [0.875, 0.375, 0.625]
    assert [spans[0][2] for spans, _ in found[12:14]] == [0.25, 0.75]
    assert found[14][1] == "<email> und <ip> é"
    assert [k for k in kinds[15]] == []  # one match of 30 digits fails; nothing inside it is tried


def test_giant_texts(spark):
    """Runs in which each place could begin a match, and very many matches, take time in proportion."""
    runs = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@b" + ".c" * 150_000, "1." * 150_000, "+1" * 150_000, "+1" + " (" * 150_000]
    many = "me@x.org 10.0.0.1 " * 60_000
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*runs, many])], "doc_id int, text string").repartition(8)
    got = {r.doc_id: r.n for r in pii.find(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 37_500, 5: 0, 6: 0, 7: 120_000}


def test_pii_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_pii(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = plain_base(r.text or "")
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and g.spans == ",".join(want)
        counts = [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == counts
