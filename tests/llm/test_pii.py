"""Spans against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re
import time

from casefile.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def keep(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text: str | None) -> list[str]:
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text or "")
        if keep(kind, m.group())
    ]


def made_texts() -> list[str | None]:
    rng = random.Random(5)
    texts = [
        None, "", "a@b.c_d@e.f", "a@b.c@d.e.f", "x@y..z", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.001 1.2.3",
        "4539 1488 0343 6467", "4539-1488-0343-6467 and 45391488034364670", "+1 (692) 555-7565.", "+12 +1234567",
        "é\U0001f600 me@x.org é", "@@@ a@ @b.c", "9" * 5000, "a" * 20000, "1 " * 4000, "+1" * 50, "a.b+c%d@h-1.co.uk",
        "((+49 30.1234-567))", "1.1.1.1", "0000000000000000",
    ]
    for alphabet in ("ab.@1-_", "0129. -+()", "+1()5 -", "4 0-5"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return texts


def test_base_spans_match_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for row in pii.digest(docs.repartition(8)).collect():
        expected = brute(texts[row.doc_id])
        base = [s for s in row.spans.split(",") if s and s.split(":")[0] in BASE]
        assert base == expected, texts[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(s.startswith(k + ":") for s in expected) for k in BASE
        )


def test_added_kinds_and_redaction(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = {
        1: f"Konto {iban} end", 2: iban.replace("89", "88"), 3: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x',
        4: "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 5: "mail é me@x.org, ip 1.2.3.4", 6: None, 7: "plain",
    }
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] * 2, "doc_id int, text string, pii int")
    rows = pii.with_spans(docs).select(
        "doc_id", pii.span_text(pii.F.col("pii")).alias("spans"), pii.redacted(pii.F.col("text"), pii.F.col("pii")).alias("clean")
    ).collect()
    assert len(rows) == 14
    found = {r.doc_id: (r.spans, r.clean) for r in rows}
    assert found[1] == ("iban:6:33", "Konto [IBAN] end")
    assert found[2] == ("", texts[2])
    assert found[3] == ("secret:9:49", 'token = "[SECRET]" x')
    assert found[4] == ("", texts[4])
    assert found[5] == ("email:7:15,ip:20:27", "mail é [EMAIL], ip [IP]")
    assert found[6] == ("", None)
    assert found[7] == ("", "plain")


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_dense_texts_take_time_in_proportion(spark):
    """100,000 plain numbers and 20,000 addresses in one text; spans at the far end."""
    numbers = " ".join(str(1000 + i % 9000) for i in range(100_000))
    addresses = " ".join(f"a{i}@b{i}.org" for i in range(20_000))
    tail = " é call +49 30 1234567"
    docs = spark.createDataFrame([(1, numbers + tail), (2, addresses + tail)], "doc_id int, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert time.perf_counter() - began < 120
    places, place = [], 0
    for word in addresses.split():
        places.append(f"email:{place}:{place + len(word)}")
        place += len(word) + 1
    assert rows[2].spans.split(",")[:20_000] == places
    at = len(numbers) + len(" é call ")
    assert rows[1].spans == f"phone:{at}:{at + 14}"
    assert (rows[2].n_email, rows[2].n_phone) == (20_000, 1)
