import re

from llm_helpers import ODD, docs, frame, generator, prose
from sqlgauge.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


TEXTS = [
    *ODD,
    "mail a.b+c@x-y.example.org, or d@e.f_g@h.ij and k@l.m@n.o; not p@q nor @r.s",
    "ü😀 x@y.zz é 1.2.3.4 é",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 then 0000255.0.0.1 and 1.1.1.99999999999999999999",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111111111 5500000000000004",
    "4111  1111 1111 1111 1111 1111 1111 1111",
    "+1 (555) 123-4567 and +49.30.1234567- and +12 3 and ++44 20 7946 0958 +123456789012345678",
    "tel +1 555 010 9999 4111111111111111 end",
    "9" * 6000 + " a" * 10 + "b" * 9000 + "@" + "c" * 50 + ".d",
    "." * 500 + "@a.b " + "-" * 300 + "+1" + "-" * 300,
]


def test_base_spans_match_regular_expressions(spark):
    found = P.find_pii(docs(spark, TEXTS)).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        text = TEXTS[r.doc_id] or ""
        want = [
            (k + 1, m.start(), m.end())
            for k, kind in enumerate(P.KINDS)
            for m in re.finditer(PLAIN[kind], text)
            if passes(kind, m.group())
        ]
        base = [tuple(s) for s in r.base]
        assert base == want
        assert set(base) <= {tuple(s) for s in r.all}


def test_model_separates_and_threshold_holds(spark):
    rows = [
        (i, f"call +1 555 010 {1000 + i} or {i}{i + 7} or 10.0.{i % 250}.{i % 200} or 999.{i}.3.4", "s")
        for i in range(300)
    ]
    found = P.find_spans(frame(spark, rows).select("doc_id", "text"))
    features = P.with_features(found.selectExpr("doc_id", "_key", "inline(_candidates)"))
    model = P.fit_model(features, 500)
    scored = model.transform(P._assembled(features)).selectExpr("label", "prediction")
    wrong = scored.where("label != (prediction = 1.0)").count()
    assert wrong <= 0.02 * scored.count()


def test_digests_masks_nulls_and_nothing(spark):
    given = frame(spark, [(1, "a@b.cd and 10.0.0.1", "s"), (1, "a@b.cd and 10.0.0.1", "s"), (None, None, "s")])
    digests = P.digest_columns(P.find_pii(given)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in digests) == [
        ("1", 1, 1, "email:0:6,ip:11:19"), ("1", 1, 1, "email:0:6,ip:11:19"), ("None", 0, 0, ""),
    ]
    one = given.where("doc_id = 1").limit(1)
    assert P.redact(one, P.find_pii(one)).first().text == "[EMAIL] and [IP]"
    assert P.find_pii(given.where("false")).count() == 0


def test_planted_spans_beside_the_base_ones_are_added(spark):
    rng = generator(11)

    def card(prefix, length):
        body = prefix + "".join(str(rng.randrange(10)) for _ in range(length - len(prefix) - 1))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def number(n):
        return "".join(str(rng.randrange(10)) for _ in range(n))

    given, planted, decoys = [], [], []
    for i in range(400):
        amex, visa = card("37", 15), card("4", 16)
        kind, found = [
            ("email", f"{prose(rng, 1)}.{i} [at] mail{i % 7}.example.org"),
            ("phone", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"),
            ("card", f"{amex[:4]} {amex[4:10]} {amex[10:]}"),
            ("card", ".".join(visa[k : k + 4] for k in range(0, 16, 4))),
        ][i % 4]
        lead = "call" if kind == "phone" and i % 8 == 1 else "and"
        bad = [
            f"{1990 + i % 30}-0{1 + i % 9}-1{i % 9}", f"version {i % 9}.{i % 300}.{number(3)}.{number(3)}",
            number(20), f"user{i}@local", "id " + number(11),
        ][i % 5]
        text = f"{prose(rng, 5)} {lead} {found} {prose(rng, 3)} "
        planted.append((P.KINDS.index(kind) + 1, len(text) - len(text.split(found)[1]) - len(found)))
        decoys.append((len(text), len(text) + len(bad)))
        given.append(f"{text}{bad} {prose(rng, 3)} +1 555 010 {1000 + i} a{i}@b.org")
    frame_ = docs(spark, given)
    found = P.find_pii(frame_)
    hits = {kind: [0, 0] for kind in (1, 3, 4)}
    for r in found.collect():
        rank, start = planted[r.doc_id]
        added = {tuple(s) for s in r.all} - {tuple(s) for s in r.base}
        hits[rank][0] += any(s[:2] == (rank, start) for s in added)
        hits[rank][1] += 1
        assert {s[:2] for s in added} <= {(rank, start)}
        low, high = decoys[r.doc_id]
        assert not any(low < end and start < high for _, start, end in added), given[r.doc_id]
    assert all(n >= 0.9 * total for n, total in hits.values())
    clean = {r.doc_id: r.text for r in P.redact(frame_, found).collect()}
    assert sum("[at]" in text for text in clean.values()) <= 10


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rng = generator(1)
    lists = [[], [5], *([rng.randrange(9) for _ in range(n)] for n in (63, 64, 65, 130, 4096, 9000))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    for r in df.select("i", P.running_sums(F.col("v")).alias("s")).collect():
        want = [0]
        for v in lists[r.i]:
            want.append(want[-1] + v)
        assert r.s == want[:-1]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i % 256}.1.2.3 a{i}@b.cd" for i in range(20_000))
    found = P.find_spans(docs(spark, [text]).select("doc_id", "text")).first()
    for kind in ("ip", "email"):
        want = [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text) if passes(kind, m.group())]
        assert [tuple(s) for s in found[f"_{kind}"]] == want and len(want) == 20_000


def test_forms_that_no_rule_names(spark):
    rng = generator(21)

    def n(size, first="123456789"):
        return rng.choice(first) + "".join(str(rng.randrange(10)) for _ in range(size - 1))

    forms = {
        "bare 3-3-4": lambda: (4, f"{n(3)}-{n(3)}-{n(4)}"),
        "blanks": lambda: (4, f"{n(3)} {n(3)} {n(4)}"),
        "brackets": lambda: (4, f"({n(3)}) {n(3)} {n(4)}"),
        "words": lambda: (1, f"{prose(rng, 1)} at firm{n(2)} dot com"),
        "upper words": lambda: (1, f"{prose(rng, 1)}.{n(2)} AT shop{n(2)} DOT example DOT net"),
        "one sign": lambda: (1, f"{prose(rng, 1)}{n(1)}@mail{n(1)} dot org"),
    }
    decoys = [
        lambda: f"20{n(2)}-0{n(1)}-1{rng.randrange(10)}", lambda: f"v{n(1)}.{n(2)}.{n(3)}.{n(3)}",
        lambda: n(20), lambda: f"look at noon{n(1)}", lambda: f"id {n(11)}", lambda: f"user{n(3)}@local",
        lambda: f"1{n(1)}.0{n(1)}.19{n(2)}", lambda: f"order {n(4)}-{n(4)}-{n(4)}",
    ]
    given, planted = [], []
    for i in range(600):
        name = list(forms)[i % len(forms)]
        rank, form = forms[name]()
        lead = prose(rng, 5) + " "
        bad = rng.choice(decoys)()
        ip = f"10.{rng.randrange(256)}.{rng.randrange(256)}.1"
        start = len(lead)
        planted.append((name, rank, start, start + len(form), bad))
        tail = f"+1 ({n(3)}) 555-{n(4)} {prose(rng, 3)} {prose(rng, 1)}.{n(2)}@mail{n(1)}.example.com {ip}"
        given.append(f"{lead}{form}, {prose(rng, 3)} {bad} {prose(rng, 2)} {tail}")
    hits, wrong = {name: [0, 0] for name in forms}, 0
    for r in P.find_pii(docs(spark, given, 6)).collect():
        name, rank, start, end, bad = planted[r.doc_id]
        added = {tuple(s) for s in r.all} - {tuple(s) for s in r.base}
        hits[name][0] += any(s[0] == rank and s[1] < end and start < s[2] for s in added)
        hits[name][1] += 1
        low = given[r.doc_id].index(bad, end)
        wrong += any(s[1] < low + len(bad) and low < s[2] for s in added)
    assert all(found >= 0.9 * total for found, total in hits.values()), hits
    assert wrong <= 6, wrong


def test_masking_rows_that_share_an_id(spark):
    given = frame(spark, [(1, "a@b.cd", "s"), (1, "10.0.0.1 x", "s"), (1, "a@b.cd", "s"), (None, "a@b.cd", "s")])
    got = sorted(r.text for r in P.redact(given, P.find_pii(given)).collect())
    assert got == ["[EMAIL]", "[EMAIL]", "[EMAIL]", "[IP] x"]


def test_credentials_are_counted(spark):
    texts = ['a token = "04dbebab91ab85687d33", API_KEY:abcdEFGH12345678', "a token of 04dbebab91ab85687d33", None]
    found = P.digest_columns(P.find_pii(docs(spark, texts))).collect()
    assert {r.doc_id: (r.secrets, r.n_found) for r in found} == {0: (2, 2), 1: (0, 0), 2: (0, 0)}
