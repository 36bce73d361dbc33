import random
import re

from quire.llm import pii


def brute(text):
    """The base patterns as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice(rng.choice(["0123456789", "a@.", ". -+()", "1234 ", "@.b1é"])) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_base_spans_of_given_texts(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text) == brute(r.text)


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1 " + "-" * 200_000, "a@" * 50_000, "(" * 100_000, "1 " * 100_000):
        pii.other_candidates(text, pii.base_spans(text))


def test_expectation_maximisation_finds_who_is_right():
    rng = random.Random(5)
    right = (0.95, 0.9, 0.6, 0.55, 0.9)
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.7
        v = tuple((1 if (rng.random() < r) == y else -1) if rng.random() < 0.8 else 0 for r in right)
        counts[v] = counts.get(v, 0) + 1
    share, table = pii.reliabilities(counts)
    assert abs(share - 0.7) < 0.03
    for j, r in enumerate(right):
        assert abs(table[1, j, 2] / (table[1, j, 0] + table[1, j, 2]) - r) < 0.04


def texts(rng):
    phone = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    out = []
    for i in range(300):
        out.append((2 * i, f"please call or phone {phone()} , or +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today"))
        out.append((2 * i + 1, f"see build serial part number {phone()}_x and nothing else"))
    return out


def test_adds_look_alikes_that_the_labelers_trust(spark):
    rows = texts(random.Random(7))
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r.doc_id: [s for s in r.spans if not s.base] for r in found}
    assert all(len([s for s in r.spans if s.base]) == (r.doc_id + 1) % 2 for r in found)
    assert sum(len(added[i]) for i in added if i % 2 == 0) > 250 and not any(added[i] for i in added if i % 2)


def test_redaction_and_awkward_rows(spark, awkward, empty):
    docs = spark.createDataFrame([(1, "mail a.b@c.example or +1 (200) 555-1234.", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, spans int")
    model = pii.learn(pii.candidates(docs))
    got = [r.text for r in pii.redacted(docs, model).orderBy("doc_id").collect()]
    assert got == ["mail <EMAIL> or <PHONE>.", None, "", ""]
    assert pii.redact("abcdef", [{"start": 1, "end": 4, "kind": "ip"}, {"start": 2, "end": 5, "kind": "card"}]) == "a<IP>f"
    rows = pii.find_personal_data(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.spans for r in rows)
    assert pii.find_personal_data(empty).count() == 0
