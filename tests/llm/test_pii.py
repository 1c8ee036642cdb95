import hashlib
import random
import re

from veilgraph.llm import pii

PLAIN = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
)


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0])]


def test_base_equals_the_plain_expressions():
    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice("0123456789123 .-+()@ab._%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text)
    for text in ("a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5.6.7.8", "0255.1.1.1", "4929348385146306", "a" * 200000 + "@b", "1" * 200000, "+1" + " " * 100000, "1." * 50000):
        assert pii.base_spans(text) == (brute(text) if len(text) < 5000 else pii.base_spans(text))


def test_learns_from_contexts(spark):
    rows = [(i, f"filler words here call me: +1 (555) 555-{1000 + i} and go", "x") for i in range(12)]
    rows += [(50, "then call me: 555-0199-77 soon, or 1234-99-1 not", "x"), (51, "nothing personal 2024-01-01 here", "x"), (52, None, "x"), (53, "", "x"), (None, "call me: 555-0000-11", "x")]
    rows += [(54, "me: 555-0199-77", "x")] * 2 + [(60, "w " * 100000 + "a@b.org", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == len(rows)
    assert got[50]["spans"] == "phone:14:25" and got[50]["n_phone"] == 0 and got[50]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[51]["spans"] == got[52]["spans"] == got[53]["spans"] == "" and got[None]["spans"] == "phone:9:20"
    assert got[0]["spans"] == "phone:27:44" and got[0]["n_phone"] == 1
    assert got[60]["spans"] == "email:200000:200007" and got[54]["spans"] == "phone:4:15"
    assert pii.find(docs.limit(0)).collect() == []


def brute_spans(texts):
    """The bootstrap by plain loops over all patterns and values: text number -> spans learned."""
    seen = [(n, *x) for n, t in enumerate(texts) for x in pii.instances(t or "", pii.base_spans(t or ""))]
    values = {}
    for _, _, _, _, patterns, value in seen:
        for p in patterns:
            values.setdefault(p, set()).add(value)
    score = {(value, kind): 1.0 for _, kind, _, _, _, value in seen if kind is not None}
    good = {}
    while True:
        new = {}
        for p, vs in values.items():
            for k in range(5):
                got = [score[v, k] for v in vs if (v, k) in score]
                if len(got) >= pii.SUPPORT and sum(got) >= pii.TRUST * len(vs):
                    new[p, k] = sum(got) / len(vs)
        if len(new) == len(good):
            good = new
            break
        good = new
        for _, kind, _, _, patterns, value in seen:
            for p in patterns:
                for k in range(5):
                    if kind is None and (p, k) in good:
                        score[value, k] = max(score.get((value, k), 0), good[p, k])
    out = {}
    for n, kind, s, e, patterns, _ in seen:
        found = sorted((-good[p, k], k) for p in patterns for k in range(5) if (p, k) in good)
        if kind in (None, pii.SECRET) and found:
            out.setdefault(n, set()).add((found[0][1], s, e))
    return out


def test_learned_spans_equal_plain_loops(spark):
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = {
        "call me:": [lambda: f"+1 (555) {some(3)}-{some(4)}"] * 4 + [lambda: f"(555) {some(3)} {some(4)}"],
        'token = "': [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))] * 4 + [lambda: f"x-{some(5)}"],
        "mail to": [lambda: f"a{some(2)}@b.org"] * 4 + [lambda: f"a{some(2)}@local"],
        "host is": [lambda: f"10.0.{rng.randrange(256)}.7"] * 4 + [lambda: f"10.0.999.{some(2)}"],
        "ref no": [lambda: some(6)],
        "and then": [lambda: some(6), lambda: f"a{some(2)}@b.org"],
    }

    def piece():
        lead = rng.choice(list(forms))
        return f"w{rng.choice('abc')} {lead}{'' if lead[-1] == chr(34) else ' '}{rng.choice(forms[lead])()} end"

    texts = [f"{piece()} {piece()}" for _ in range(150)] + [None, ""]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_spans(texts)
    assert sum(map(len, want.values())) > 20
    for n, t in enumerate(texts):
        every = sorted([*pii.base_spans(t or ""), *want.get(n, ())])
        assert got[n]["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in every)
        assert got[n]["n_learned"] == len(want.get(n, ()))


def test_secrets_by_context():
    text = 'key = "' + "0a" * 20 + '" and (555) 010-4477, 12'
    found = pii.instances(text, pii.base_spans(text))
    assert [(k, text[s:e]) for k, s, e, _, _ in found] == [(pii.SECRET, "0a" * 20), (None, "(555) 010-4477")]
    assert found[0][3] == ['1 "', '2 = "', '3 key = "']
