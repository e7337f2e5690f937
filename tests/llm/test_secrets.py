import random
import re

from tickweave.llm.automata import Automaton
from tickweave.llm.secrets import BASE_RULES, MORE_RULES, Scanner, find_secrets, redact

PATTERNS = {
    "assign": (r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----", 0, 0),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
}


def brute(text):
    out = []
    for k, (kind, (p, g, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def texts(n):
    rnd = random.Random(3)
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", "\"", "'", " ", "  ", ":", "=", "abcdef", "AKIA", "AKIAAKIA", "Z9" * 9, "0123456789abcdef" * 2,
            "é", "\n", ",", "ghp_" + "a1" * 18, "xoxb-12345-abcde", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "xoxb-", "token=", "secret=toke", "x", "ſ", "K", "日本", "fffff", "ABCDEF123456789", "|"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_spans_against_finditer():
    scanner = Scanner(BASE_RULES + MORE_RULES)
    sample = texts(6000) + ["", "a" * 100000, "f" * 5000, "password=" + "p" * 3000, "token " * 3000 + "= abcdefg", "secret=token: abcdef", "f" * 300000, "ghp_ghp_" + "a" * 40, "token=" * 9000]
    for t, got in zip(sample, scanner.spans(sample)):
        assert got == brute(t), t
    assert scanner.spans([]) == [] and scanner.spans([""]) == [[]]


def test_automaton_is_minimal_and_exact():
    a = Automaton.compile([("a(b|c){2,3}d?", False), ("x+y", True)])
    import numpy as np

    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice("abcdxyXY") for _ in range(rnd.randint(0, 9)))
        data = np.frombuffer(s.encode(), np.uint8)
        hit = int(a.scan(data, np.array([0]), np.array([len(s)]))[0])
        assert (hit & 1 > 0) == bool(re.search("a(b|c){2,3}d?", s)) and (hit & 2 > 0) == bool(re.search("x+y", s, re.I)), s
    assert len(a.moves) < 30


def test_spark_rows(spark):
    sample = [None, "", "token = abcdefgh é", "é password: 'hunter22' and 0123456789abcdef0123456789"] * 2
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(sample)], "doc_id long, text string, secrets int")
    rows = {r.doc_id: r for r in find_secrets(df).collect()}
    for i, t in enumerate(sample):
        assert [(s.kind, s.start, s.end) for s in rows[i].secrets] == brute(t or "")
    clean = {r.doc_id: r.text for r in redact(find_secrets(df)).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "[assign] é" and clean[3] == "é [assign]' and [hex]"
    assert find_secrets(df.limit(0)).count() == 0
