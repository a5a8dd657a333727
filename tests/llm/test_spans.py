"""Personal data and secrets against Python's regular expressions, added spans, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import SF

from cellweave.llm import pii, queries, secrets, spans


def base_pii(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and (not 16 <= len(d) <= 19 or sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10):
                continue
            if k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def base_secrets(t):
    out = []
    for i, (k, p) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(p, t):
            if len(m[2] if k == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[k]:
                out.append((m.start(), i, k, m.end()))
    return [(k, s, e) for s, i, k, e in sorted(out)]


def noise(rnd, n):
    parts = ["a.b@c.d", "a@b", "@", "x@y.z_w@q.r", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "001.02.3.0000255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 555-5033", "+1", "+44.", "+", " ", "\n", "é", "🙂", "12", "-", ".", "abc", "token=token:abcdefgh", "PassWord = 'hunter22x'", "secret:ab", "api_key=\"a.b-c_d/e+f=\"", "apikey", "AKIA" + "Z" * 16, "AKIAAKIA" + "1" * 13, "AKIA12", "0123456789abcdef" * 2, "deadbeef", "A" * 30, "_"]
    return "".join(rnd.choice(parts) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    texts = [noise(rnd, rnd.randint(0, 25)) for _ in range(400)] + ["", "7" * 40_000, "a" * 40_000, "a.a" * 9_000 + "@b" + ".c" * 9_000, "+1" + "-2" * 20_000, "1." * 20_000, "f" * 50_000, "AKIA" * 8_000]
    return list(enumerate(texts)) + [(9_000, None), (None, "a@b.c"), (5, texts[5])]


def schema(df):
    return df.withColumnRenamed("x", "email")


@pytest.mark.parametrize("which", ["pii", "secrets"])
def test_base_spans_like_regex(spark, rows, which):
    df = spark.createDataFrame([(i, t, "k", "s", 1) for i, t in rows], "doc_id long, text string, email string, spans string, found int").repartition(4)
    find, want = (pii.detect, base_pii) if which == "pii" else (secrets.scan, base_secrets)
    got = find(df, keep=df.columns)
    assert got.columns.count("spans") == 1
    out = got.select("doc_id", "text", "spans").collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s.k, s.s, s.e) for s in r.spans if s.base] == want(r.text or ""), r.text
    assert find(df.limit(0), keep=["doc_id"]).count() == 0


def test_wider_spans_are_added_by_the_classifier(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        n = f"({rnd.randint(200, 999)}) {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}"
        rows.append((i, rnd.choice([f"please call +1 {n} today", f"my phone: {n} at home", f"tel. {n}.", "nothing here", "item 555-12"])))
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), keep=["text"]).collect()
    added = [(r.text, s) for r in got for s in r.spans if not s.base]
    assert added and all(re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", t[s.s : s.e]) and "+" not in t for t, s in added)
    assert all(s.base for r in got if "+" in r.text for s in r.spans)


def test_reliabilities_favour_agreeing_labelers():
    p = pii.reliabilities({("ip", False, (1, 1, 1, 1)): 80, ("ip", False, (0, 0, 2, 0)): 80, ("ip", False, (1, 1, 2, 1)): 20})
    assert p["ip", False, (1, 1, 1, 1)] > 0.9 > 0.1 > p["ip", False, (0, 0, 2, 0)]
    assert pii.reliabilities({}) == {}


WEAK_ID, WEAK_SECRET = "ASIA" + "Q7" * 8, "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY1"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"{WEAK_ID} alone", []),
        (f"{WEAK_SECRET} alone", []),
        (f"{WEAK_ID} and {WEAK_SECRET}", ["access", "assign"]),
        (f"{WEAK_ID} {'x ' * 300} {WEAK_SECRET}", []),
        (f"https://db.example.com {WEAK_SECRET}", ["assign"]),
        (f"https://db.example.com {WEAK_ID}", []),
        (f"{WEAK_ID} password=hunter22x", ["access", "assign"]),
    ],
)
def test_weak_parts_need_their_complement(spark, text, want):
    df = spark.createDataFrame([(1, text), (1, text), (2, "clean")], "doc_id long, text string")
    got = secrets.scan(df, keep=["doc_id"]).collect()
    assert sorted(sorted(s.k for s in r.spans) for r in got) == sorted([want, want, []])


@pytest.mark.parametrize("name", ["user: alice", '"username": "alice"', "user  = alice", "'user' = 'alice'", "USERNAME :alice", "Client_Id=alice"])
def test_identifiers_in_any_form(spark, name):
    end = name.index("alice") + 5
    texts = [f"{name} password=hunter22x", f"{name} password=hunter22x client_id=alice", f"{name} alone"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), keep=["doc_id"]).collect()
    added = {r.doc_id: [(s.k, s.e) for s in r.spans if not s.base] for r in got}
    assert added == {0: [("access", end)], 1: [("access", end), ("access", len(texts[1]))], 2: []}


def test_every_text_is_searched_for_every_pattern(spark):
    rnd = random.Random(9)
    names = ["user", "username", "Client_ID", "clientid", "passwd", "TOKEN", "api_key", "apikey", "x"]
    values = ["alice", "ab", WEAK_ID, "AKIA" + "Z" * 16, "AKIA" + "Z" * 13, "0123456789abcdef" * 2, WEAK_SECRET, "a.b-c_d/e+f=", "https://db.example.com:443", "é🙂"]

    def one():
        return "".join([rnd.choice(["", " ", "é", "x"]), rnd.choice(names), rnd.choice(["", "'", '"']), " " * rnd.randint(0, 2), rnd.choice(["", ":", "=", "s:"]), " " * rnd.randint(0, 2), rnd.choice(["", "'", '"']), rnd.choice(values)])

    texts = ["".join(one() for _ in range(rnd.randint(1, 2))) for _ in range(2_000)]
    patterns = secrets.BASE | secrets.WEAK
    rows = spans.with_matches(spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string"), "t", patterns).collect()
    assert len(rows) == len(texts) + 1
    for name, (_, pattern, _) in patterns.items():
        assert any(r[name] for r in rows)
        for r in rows:
            assert [(m.s, m.e, m.v) for m in r[name]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t or "", re.A)], (name, r.t)


@pytest.mark.parametrize("gap", [1, 10, 199, 200, 201])
@pytest.mark.parametrize("at", [0, 399, 400])
def test_long_parts_before_weak_ones(spark, at, gap):
    head, fill = "x " * (at // 2) + " " * (at % 2), " " * gap
    texts = [f"{head}{'0123456789abcdef' * 38}{fill}user=alice", f"{head}token={'ab.' * 198}{fill}user=alice", f"{head}https://{'db.' * 80}example.com{fill}{WEAK_SECRET}"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), keep=["doc_id"]).collect()
    added = {r.doc_id: [(s.s, s.e) for s in r.spans if not s.base] for r in got}
    last = [len("user=alice"), len("user=alice"), len(WEAK_SECRET)]
    assert added == {i: [(len(t) - n, len(t))] if gap <= 200 else [] for i, (t, n) in enumerate(zip(texts, last))}


@pytest.mark.parametrize("n", [128, 129, 50_000])
def test_weak_secrets_of_any_length(spark, n):
    blob = ("aB3" * n)[:n]
    texts = [f"{WEAK_ID} {blob}", f"https://db.example.com {blob}", blob]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), keep=["doc_id"]).collect()
    at = [len(t) - n for t in texts]
    assert {r.doc_id: [(s.k, s.s, s.e) for s in r.spans] for r in got} == {0: [("access", 0, at[0] - 1), ("assign", at[0], at[0] + n)], 1: [("assign", at[1], at[1] + n)], 2: []}


def test_masking(spark):
    df = spark.createDataFrame([(1, "é token=abcdef012345678901234567 end", "en", 99), (2, None, "en", 0), (3, "clean", "en", 5)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in secrets.masked(df).collect()}
    assert got[1].text == "é [SECRET] end" and got[1].n_chars == len(got[1].text) and got[1].spans == "en"
    assert got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5


@pytest.mark.parametrize("name,want", [("op8_pii", base_pii), ("op9_secrets", base_secrets)])
def test_contract_digest(spark, name, want):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = want(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in spans) <= set(r.spans.split(","))
