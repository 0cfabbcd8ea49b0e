import hashlib
import random
import re

from sievewright.llm import pii
from sievewright.llm.common import documents


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    found = []
    for k, (kind, regex, check) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ]
    ):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(regex, text) if check(m[0])]
    return [x[2] for x in sorted(found)]


ODD = [
    None, "", "a@b.c_x@d.e.f@g.h", "é@a.b ☃1.2.3.4 +1 (234) 555-0199.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 2", "+1234567890 12 +44",
    "x." * 3000 + "@a.b", "1" * 30000, "1." * 5000, "a" * 100000, "+1(((((", "a@b", "a@b.", "@a.b", "\U0001f600 q@w.e \U0001f600 1.1.1.1", "1 " * 4000, "a@" + "b." * 8000 + "c", "4111111111111111" * 3,
]


def test_base_kinds_against_python(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").collect()] + [(-k - 1, t) for k, t in enumerate(ODD)]
    rng = random.Random(2)
    rows += [(-1000 - k, "".join(rng.choice("1234@.+- ()ab%é\n") for _ in range(200))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as spans", "1 as free").repartition(4)
    got = {r.doc_id: r for r in pii.op4_pii(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base(text or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want[:5], r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("id:")] == want
    assert pii.op4_pii(df.where("false")).collect() == []


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'some words token = "{secret}" and more {rng.randrange(10**9, 10**10)}'))
    rows += [(100, 'x token = "User-Key-77-ZZTOP" y'), (101, "plain order 20240101-77 text"), (102, "no digits here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.patterns(df) == ['token = "']
    got = {r.doc_id: r.spans for r in pii.op4_pii(df).collect()}
    assert got[100] == "id:11:28" and got[101] == "" and "id:20:60" in got[0].split(",")
    clean = {r.doc_id: r.text for r in pii.replaced(df).collect()}
    assert clean[100] == 'x token = "[ID]" y' and clean[101] == rows[61][1]
    text = "mail a@b.c then 1.2.3.4 and +1 (234) 555-0199 end"
    assert pii.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "mail [EMAIL] then [IP] and [PHONE] end"


def test_rare_contexts_in_a_large_corpus(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, f'some words token = "{rng.getrandbits(160):040x}" end') for k in range(6)]
    rows += [(100 + k, " ".join(f"write to a{k}x{m}@b.co" for m in range(100))) for k in range(70)]  # over 1,000 times as many other seeds
    unseen = 'x token = "User-Key-77-ZZTOP" y'
    rows += [(50, unseen), (50, unseen), (None, unseen), (51, None), (52, "plain order 20240101-77 text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 'token = "' in pii.patterns(df)
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in pii.op4_pii(df).collect())
    assert [x for x in want if x[0] in (-1, 50, 51, 52)] == [(-1, "id:11:28"), (50, "id:11:28"), (50, "id:11:28"), (51, ""), (52, "")]
    clean = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in pii.replaced(df).collect())
    assert clean[0] == (-1, 'x token = "[ID]" y')
    monkeypatch.setattr(pii, "LITERALS", 0)  # the accepted patterns stay a table: broadcast, then shuffled
    for is_few in (True, False):
        monkeypatch.setattr(pii, "few", lambda df, is_few=is_few: is_few)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in pii.op4_pii(df).collect()) == want
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in pii.replaced(df).collect()) == clean
