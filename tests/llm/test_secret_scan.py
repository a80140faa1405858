import hashlib
import random
import re
import time

import pytest

from contactgrid.llm import secret_scan as scan


def brute(t):
    def either(word):
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)

    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


PIECES = ["password", "PassWD", "ſecret", "secret", "tOKen", "toKen", "api_key", "APIKEY", "=", ":", " ", "\t", '"', "'", "abcdef123456", "A1b2", "AKIA", "AKIAQ0123456789ABC", "0123456789abcdef", "é", "🙂", "\n", "-", "deadbeef", "K"]


def test_base_as_brute_force(spark, tmp_path):
    rng = random.Random(13)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += [None, "", "a" * 50_000, "token" * 20_000, "token=" * 20_000, "token = x" + "f" * 40_000, '\\"' * 50_000 + "token", "'" * 50_000 + "token", "token=\n" * 9000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = scan.op13_secret_scan(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [want.count(f"{k}:") for k in ("assign", "access", "hex")]
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("literal")) == want


def found(text):
    return {text[a:b] for a, b in scan.literals(text)}


@pytest.mark.parametrize(
    "text, want",
    [
        ('db_password = "hunter22x"', {"hunter22x"}),
        ("password: str = 'hunter22x'", {"hunter22x"}),
        ("let token: &str = 'hunter22x';", {"hunter22x"}),
        ('const char *passwd = "hunter22x";', {"hunter22x"}),
        ("export DB_PWD=hunter22x\nUSER=someone99", {"hunter22x"}),
        ('{"client_secret": "abc-DEF-123", "client_id": "abc-DEF-123"}', {"abc-DEF-123"}),
        ('connect(user="someone99", passphrase=\n  "hunter22x")', {"hunter22x"}),
        ('settings["api_key"] = "hunter22x"', {"hunter22x"}),
        ("define('DB_PASSWORD', 'hunter22x');", {"hunter22x"}),
        ("<password>hunter22x</password><name>hunter33x</name>", {"hunter22x"}),
        ("Authorization: Bearer abCD1234efgh==", {"abCD1234efgh=="}),
        ('privateKey = b"a1b2C3d4" + "e5f6g7h8"', {"a1b2C3d4", "e5f6g7h8"}),
        ('a = b = "hunter22x"\npassword = a', {"hunter22x"}),
        ('default = "hunter22x"\nother = "hunter33x"\nuser.password = default', {"hunter22x"}),
        ('x = "first111a"\npassword = x\nx = "second22b"', {"first111a"}),
        ("password: ${PW}\nPW=hunter22x", {"hunter22x"}),
        ('a = "hunter22x"\nb = a\nc = b\nsecret = c\nsecret = secret', {"hunter22x"}),
        ("name: str = 'someone99x'\npassword: str = 'hunter22x'", {"hunter22x"}),
        ("key = 'a8f5f167f44f4964e6c998dee827110c'", {"a8f5f167f44f4964e6c998dee827110c"}),
        ("password = 'say \\'hi\\' 22x'", set()),
        ("token: something in prose, the password: unknown", set()),
        ('password = "changeme"\nsecret: <your-secret>\ntoken = "${X}"\npwd = "xxxxxxxxxx"', set()),
        ('if password == "hunter22x": pass', set()),
        ('password_hint = "hunter22x"\nkey = "en_US_long_name"\nprimary_key: user_id', set()),
        ('password_file = "/etc/secret99"\nsecret = "/etc/secret99"\ntoken = "https://a.b/c9"', set()),
        ('x = "hunter22x:" +\n  "open\ntoken = x', {"hunter22x:"}),
        ("it's token isn't 'x1y2z3w4'", set()),
    ],
)
def test_literals_by_names(text, want):
    assert found(text) == want


def test_round_trip_of_places(spark):
    text = "é🙂 api_token = 'abCD1234'"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = {r.id: r.secrets for r in scan.find_secrets(docs).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in out[1]] == [("literal", "abCD1234")] and out[2] == out[3] == []
    none = spark.createDataFrame([], "doc_id long, text string, id int")
    assert scan.find_secrets(none).collect() == [] and scan.digests(none).collect() == []


@pytest.mark.parametrize("piece", ["token=", "a=", 'token="', "token='x", "\\\"", "token = a + ", "k:", "token=\n", "(token,", "a.b-", "= ", '"a"', "password: x = y\n", "<token>"])
def test_work_is_linear(piece):
    text = "secret " + piece * (400_000 // len(piece))
    began = time.process_time()
    scan.spans(text)
    assert time.process_time() - began < 6
