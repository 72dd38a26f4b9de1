"""Base findings against a plain search by characters, and literals of assignments in source and configuration."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from rows import DOCS, documents, odd_documents

from sparkloom.llm.leaks import find_literals, find_secrets, report_secrets

WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def lowered(c: str) -> str:
    return c.lower() if "A" <= c <= "Z" else c


def run_end(text: str, at: int, held) -> int:
    while at < len(text) and text[at] in held:
        at += 1
    return at


def assign_at(text: str, at: int) -> tuple[int, int] | None:
    """(start of group 2, end) of the assignment that starts here; the branches of the optional parts are tried greedily, then without."""
    for word in WORDS:
        if "".join(map(lowered, text[at : at + len(word)])) != word:
            continue
        k = at + len(word)
        for quote in ([1] if k < len(text) and text[k] in "\"'" else []) + [0]:
            j = run_end(text, k + quote, " ")
            if j < len(text) and text[j] in ":=":
                j = run_end(text, j + 1, " ")
                if j < len(text) and text[j] in "\"'":
                    j += 1
                if (end := run_end(text, j, VALUE)) > j:
                    return j, end
    return None


def base_findings(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    at = 0
    while at < len(text):
        hit = assign_at(text, at)
        if hit and hit[1] - hit[0] >= 8:
            found.append(("assign", at, hit[1]))
        at = hit[1] if hit else at + 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = run_end(text, at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end == at + 4:
            at += 1
            continue
        if end - at >= 16:
            found.append(("access", at, end))
        at = end
    at = 0
    while at < len(text):
        end = run_end(text, at, set("0123456789abcdef"))
        if end - at >= 32:
            found.append(("hex", at, end))
        at = max(end, at + 1)
    return sorted(found, key=lambda f: (f[1], ("assign", "access", "hex").index(f[0])))


def told(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def texts() -> list[str | None]:
    rng = random.Random(3)
    bits = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "=", ":", " = ", ": ", "\"", "'", " ", "\n", "abcdefgh", "abc", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "🙂", "Ä", "x/y+z_w.q=-", "\\", "ſecret=abcdefghij", "toKen=abcdefghij"]
    made = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(400)]
    return [*made, None, "", " ", "password='" + "a" * 50_000, "f" * 70_000 + "g" + "AKIA" + "Z" * 70_000]


def test_base_findings_equal_a_plain_search(spark):
    given = texts()
    rows = [(k, t, "xx", "s", 1, "c", 1, 2, 3) for k, t in enumerate(given)] + [(0, given[0], "xx", "s", 1, "c", 1, 2, 3)]
    out = report_secrets(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = base_findings(given[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[0] == k for f in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s and not s.startswith("literal")]
        assert kept == [s for s in told(want).split(",") if s]
        places = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert places == sorted(places)
        assert sum(s.startswith("literal") for s in r.spans.split(",")) == r.n_literal


def literals(text: str) -> list[str]:
    return [text[a:b] for a, b, *_ in find_literals(text, 7)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('password = "Tr0ub4dor&3x"', ["Tr0ub4dor&3x"]),
        ("db_password: 'S3cr3t!pass99'  # production", ["S3cr3t!pass99"]),
        ('{"user": "bob", "apiKey": "9f8g7h6j5k4l3m2n"}', ["9f8g7h6j5k4l3m2n"]),
        ('password: str = "Zx81kQ22pp"', ["Zx81kQ22pp"]),
        ("let jwtSecret: string = `aZ9kLmQ27tt`;", ["aZ9kLmQ27tt"]),
        ('conf["secret_key"] = "q8Zk1LmN44"', ["q8Zk1LmN44"]),
        ("$conf['secret_key'] => 'q8Zk1LmN44',", ["q8Zk1LmN44"]),
        ("export DB_PASSWORD=hunter2abcX", ["hunter2abcX"]),
        ("define('AUTH_KEY', 'kJ8#mm2Lpq91');", ["kJ8#mm2Lpq91"]),
        ("<password>Qw3rty!!99a</password>", ["Qw3rty!!99a"]),
        ('<add key="apiPassword" value="Qw3rty!!99a"/>', ["Qw3rty!!99a"]),
        ('"token":\n  "f00dBabe1234XyZ"', ["f00dBabe1234XyZ"]),
        ("don't tell: password = 'Ab12cd34ef!'", ["Ab12cd34ef!"]),
        # constants
        ('k1 = "a8F3kd92LmQ0"\nclient_secret = k1', ["a8F3kd92LmQ0"]),
        ('client_secret = k1\nk1 = "a8F3kd92LmQ0"', ["a8F3kd92LmQ0"]),
        ('A = "abcD3f"\nB = A + "9kLmN0p"\npassword = "${B}!"', ["abcD3f", "9kLmN0p", "!"]),
        ('x = "first0"\nx = "Zx81kQ22ppLm"\npassword = x', ["Zx81kQ22ppLm"]),
        ('password = "Zx81k"\npassword += "Q22ppLm"', ["Zx81k", "Q22ppLm"]),
        ("a = a + a\nb = c\nc = b\npassword = a\nsecret = b", []),
        # no secrets
        ('password = os.environ["DB_PASSWORD"]', []),
        ("password = getPassword()", []),
        ("password = config.password", []),
        ("password: changeme", []),
        ('token = "your-token-here1"', []),
        ('password_hint = "Your first pet 99x"', []),
        ("Password: the word that you choose", []),
        ("secret = none", []),
        ('color = "a8F3kd92LmQ0"', []),
        ("key insight: the token of friendship is 12:30", []),
    ],
)
def test_literals_of_assignments(text, expected):
    assert literals(text) == expected


def test_spans_are_code_points():
    text = "🙂Ä password = \"Tr0ub4dor&3x\""
    ((start, end, name, points),) = find_literals(text, 7)
    assert (text[start:end], name) == ("Tr0ub4dor&3x", "password") and points >= 7


@pytest.mark.parametrize(
    "text",
    [
        '\\"' * 300_000,
        'key x="' * 100_000,
        "".join(f"a{i}=a{i + 1}\n" for i in range(30_000)) + 'a30000="Ab12cd34ef!"\npassword=a0',
        "".join(f"p{i + 1} = p{i} + p{i}\n" for i in range(30_000)) + 'p0 = "Ab12cd34"\npassword = p30000',
        "key" * 200_000,
        "<a>" * 200_000,
        "key: a<" * 100_000,
        "password: a" + "|b" * 100_000 + '= "x"',
    ],
)
def test_time_is_linear(text):
    began = time.perf_counter()
    find_literals(text, 7)
    assert time.perf_counter() - began < 20


def test_a_long_chain_of_constants_is_followed():
    text = "".join(f"a{i}=a{i + 1}\n" for i in range(30_000)) + 'a30000="Ab12cd34ef!"\npassword=a0'
    assert literals(text) == ["Ab12cd34ef!"]


def test_empty_and_odd_tables(spark):
    assert report_secrets(spark.createDataFrame([], DOCS)).collect() == []
    rows = odd_documents()
    out = find_secrets(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    assert all(r.findings == [] for r in out)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    out = report_secrets(docs).collect()
    assert len(out) == len(held)
    for r in out:
        want = base_findings(held[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
        # A document without an assignment, a key or a long hexadecimal run has no finding.
        assert want or not r.spans
