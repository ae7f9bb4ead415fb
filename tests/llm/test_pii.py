import hashlib
import random
import re
import time

from dayloom.llm import pii

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d) if d else False, "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(m.start(), i, m.end()) for i, k in enumerate(CONTRACT) for m in re.finditer(CONTRACT[k], text or "") if valid(k, m.group())]
    names = list(CONTRACT)
    said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(said.encode()).hexdigest(), said


def texts():
    rng = random.Random(5)
    out = [None, "", "a@b.c", "x a.b+c@mail.example.com. y", "a@b.c_d@e.f", "é😀 1.2.3.4 é", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.1.1.1 00.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (459) 555-7415 4406265717522065", "+1 2", "+12345678901234567", "12345678901234567890 4111111111111111", "@", "a@@b.c", "a@b", "a@b.", "a@-.-"]
    out += ["1" * 20_000, "a" * 20_000 + "@", "a." * 10_000 + "@b.c", "a@b" + ".c" * 10_000, "1 " * 10_000, "1.1.1.1 " * 1500, "+1" + " " * 20_000, "+" * 20_000, "1." * 10_000]
    pieces = ["a", "b.c", "@", ".", "1", "23", "255", "256", "-", " ", "+", "(", ")", "_", "é", "😀", "4111111111111111", "mail.com", "%", "\n"]
    out += ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(800)]
    out += ["".join(rng.choices("1 -.@a+", k=rng.randrange(40))) for _ in range(500)]
    return out


def test_base_spans(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.c"), (2, "a@b.c"), (2, "9.9.9.9")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    out = pii.find_private(df).collect()
    assert len(out) == len(rows)
    truth = {i: brute(t) for i, t in rows[: len(texts())]}
    for r in out:
        if r.doc_id is not None and r.doc_id != 2:
            counts, sha, said = truth[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, r.doc_id
            assert r.base_sha256 == sha and [s for s in r.spans.split(",") if s and not s.startswith("identifier")] == [s for s in said.split(",") if s]
    assert pii.find_private(df.limit(0)).collect() == []


def test_bootstrapping(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs = [(i, f"{word()} {word()} reach me at u{i}@mail.example.com {word()}") for i in range(20)]
    docs += [(100 + i, f"{word()} reach me at w{i}x@localhost {word()}") for i in range(3)]  # no base pattern knows these
    docs += [(200 + i, f"{word()} chapter {i}1{i} {word()} 12ab@cd") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_private(df).collect()}
    for i in range(3):
        text, value = docs[20 + i][1], f"w{i}x@localhost"
        at = text.index(value)
        assert out[100 + i].spans == f"identifier:{at}:{at + len(value)}" and out[100 + i].n_email == 0
    assert all(out[200 + i].spans == "" for i in range(20))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "@" not in clean[0] and "[EMAIL]" in clean[0] and "[ID]" in clean[100] and clean[205] == docs[28][1]


def test_redact(spark):
    rows = [(1, "a@b.c, 1.2.3.4 and 300.1.1.1 +1 (459) 555-7415 x 4111111111111111 é", "k"), (2, None, "k"), (3, "", None), (None, "x@y.z", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, email string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "[EMAIL], [IP] and 300.1.1.1 [PHONE] x [CARD] é" and out[1].email == "k"
    assert out[2].text is None and out[3].text == "" and out[None].text == "[EMAIL]"


def names(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]


def test_seeds_and_identifiers_without_digits(spark):
    """E-mails without a digit support their context; identifiers without one are found there, also in long tokens."""
    long = '{"' + "note\":\"" + "lorem/ipsum," * 20 + '","mail":"%s","end":"x"}'
    docs = [(i, f"{a} {b} write to {a}.{b}@mail.example.com {b}") for i, (a, b) in enumerate(zip(names(20, 1), names(20, 2), strict=True))]
    docs += [(50, "so write to jane@localhost today"), (51, "so write to @somehandle today"), (52, "so look at @somewhere today"), (53, "write to them today")]
    docs += [(100 + i, long % f"{a}@mail.example.com") for i, a in enumerate(names(20, 3))] + [(150, long % "jane@localhost"), (151, '{"a":"b","mail":"joan@localhost"}')]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.find_private(df).collect()}
    for i, value in ((50, "jane@localhost"), (51, "@somehandle"), (150, "jane@localhost"), (151, "joan@localhost")):
        at = dict(docs)[i].index(value)
        assert out[i] == f"identifier:{at}:{at + len(value)}", i
    assert out[52] == out[53] == "" and all(out[i].startswith("email:") and "," not in out[i] for i in (*range(20), *range(100, 120)))


def test_redact_rewrites_spans_only(spark):
    docs = [(i, f"{w} reach me at {w}@mail.example.com") for i, w in enumerate(names(20, 4))]
    docs += [(30, "so reach me at A123@x and see BA123@xyz, 9A123@x; A123@x stays"), (31, "reach me at 4567@x or j4567@x.com"), (32, "reach me at A1234@x now reach me at A123@x")]
    docs += [(33, "no private text 12 A123@x"), (34, "mail a@1.2.3.4 then +1 (459) 555-7415 é😀 1.2.3.4.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[30] == "so reach me at [ID] and see BA123@xyz, 9A123@x; A123@x stays"
    assert out[31] == "reach me at [ID] or [EMAIL]" and out[32] == "reach me at [ID] now reach me at [ID]"
    assert out[33] == docs[23][1] and out[34] == "mail [EMAIL] then [PHONE] é😀 [IP]."
    for r in pii.find_private(df).collect():
        assert out[r.doc_id].count("[") == len({s.split(":")[1] for s in r.spans.split(",") if s}) - (r.doc_id == 34)


def test_very_many_tokens_in_one_text(spark):
    """100,000 tokens that are no base match, and spans between them: time in proportion."""
    many = "".join(f"n{i} a{i}@b.c " if i % 100 == 0 else f"n{i} " for i in range(100_000))
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    start = time.time()
    out = pii.find_private(df).first()
    assert out.n_email == 1000 and [s for s in out.spans.split(",") if s.startswith("email")] == brute(many)[2].split(",")
    assert pii.redact(df).first().text.count("[EMAIL]") == 1000
    assert time.time() - start < 120


def test_long_contexts_are_told_apart(spark):
    """Context words beyond 80 characters count whole, by their hash."""
    tail = "z" * 100
    docs = [(i, f"xy {'a' * 50}{tail} {w}@mail.example.com") for i, w in enumerate(names(20, 6))]
    docs += [(50, f"xy {'a' * 50}{tail} jane@localhost"), (51, f"xy {'b' * 50}{tail} joan@localhost")]
    out = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[50].startswith("identifier:") and out[51] == ""
