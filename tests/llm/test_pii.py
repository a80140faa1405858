import hashlib
import random
import re

from pyspark.sql import functions as F

from contactgrid.llm import pii


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PARTS = ["1", "2", "4", "45", "0", "255", "256", ".", "..", "@", "a.b", "+", "-", " ", "(", ")", "é", "🙂", "4111 1111 1111 1111", "+1 (202) 555-0123", "x@y.z", "1.2.3.4", "\n"]


def test_base_spans_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["1" * 20_000, "a" * 20_000 + "@b.c", "+" + "1 " * 20_000, None, "", "1." * 20_000, "a@" + "b." * 20_000, "a@b.c-d_e@f.g"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, pii_spans int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = pii.op6_pii(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in ("email", "ip", "card", "phone")]


def test_added_kinds(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 ok", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789", "part 123-45-6789", "call 202-555-0123 now", "no 202-555-0123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: {s.kind for s in r.pii_spans} - {"card"} for r in pii.with_spans(docs).collect()}
    assert kinds == {0: {"iban"}, 1: set(), 2: {"ssn"}, 3: set(), 4: {"tel"}, 5: set()}


def test_account_numbers_end_where_their_country_says(spark):
    texts = {
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": "iban:5:32",
        "DE89370400440532013000 BIC COBADEFFXXX": "iban:0:22",
        "NO93 8601 1117 947 AND MORE": "iban:0:18",
        "DE89 3704 0044 0532 0130 00": "iban:0:27",
        "DE89 3704 0044 0532 0130 00X": "",
        "DE88370400440532013000 BIC": "",
        "DE8937040044053201300": "",
        "ZZ33 1234 5678 9012 345": "iban:0:23",  # a country the registry lacks
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.written(F.filter("pii_spans", lambda s: s["kind"] == "iban"))
    assert {r.text: r.s for r in pii.with_spans(docs).select("text", spans.alias("s")).collect()} == texts


def test_context_of_lists_and_behind(spark):
    many = "call " + ", ".join(["202-555-0123"] * 6)
    texts = {
        "call 202-555-0123 or 202-555-0199": "tel:5:17,tel:21:33",
        "SSNs: 123-45-6789, 234-56-7890": "ssn:6:17,ssn:19:30",
        "123-45-6789 (SSN)": "ssn:0:11",
        "202-555-0123, 202-555-0199 (fax)": "tel:0:12,tel:14:26",
        "call 10.0.0.1 or a@b.c or 202-555-0123": "ip:5:13,email:17:22,tel:26:38",
        "call" + " " * 44 + "202-555-0123": "tel:48:60",
        "call" + " " * 45 + "202-555-0123": "",
        "202-555-0123" + " " * 45 + "fax": "tel:0:12",
        "202-555-0123" + " " * 46 + "fax": "",
        many: ",".join(f"tel:{5 + 14 * k}:{17 + 14 * k}" for k in range(4)),
        "é🙂 SSN 123-45-6789": "ssn:7:18",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.s for r in pii.with_spans(docs).select("text", pii.written(F.col("pii_spans")).alias("s")).collect()}
    assert got == texts
    long = spark.createDataFrame([(1, "call " + "202-555-0123 call " * 5000, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert "555" not in pii.redact_stage(spark, long, "").first().text


def test_redaction(spark):
    texts = ["é a@b.c, 1.2.3.4 end", "x a@b.c", None, "", "+4111 1111 1111 1111"]
    docs = spark.createDataFrame([(k, t, "en", "s", 5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pii.redact_stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "é [EMAIL], [IP] end" and rows[0].n_chars == len(rows[0].text)
    assert rows[2].text is None and rows[2].n_chars == 5 and rows[3].text == ""
    assert "1111" not in rows[4].text
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "h", "g", "p")], "doc_id long, text string, _hit0 string, _gap0 string, _span0 string")
    out = pii.with_spans(docs).first()
    assert (out._hit0, out._gap0, out._span0) == ("h", "g", "p") and len(out.pii_spans) == 1


def test_context_changes_scores_of_all_kinds(spark):
    texts = {"{} ok": 0, "mail, host, card, call, bank: {}": 1}
    found = ["a@b.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (202) 555-0123", "GB82 WEST 1234 5698 7654 32"]
    docs = spark.createDataFrame([(k, t.format(x)) for k, x in enumerate(found) for t in texts], "doc_id long, text string")
    for k in range(len(found)):
        low, high = sorted(max(s.score for s in r.pii_spans) for r in pii.with_spans(docs.where(f"doc_id = {k}")).collect())
        assert pii.BAR <= low < high <= 1


def brute_redacted(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out.append(f"{text[at:s.start]}[{s.kind.upper()}]")
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_redaction_as_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice([*PARTS, "words between " * 30]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["x é a@b.c " * 900, "1.2.3.4@b.c" * 300]
    docs = pii.with_spans(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = docs.withColumn("clean", pii.redacted(F.col("text"), F.col("pii_spans"))).collect()
    assert all(r.clean == brute_redacted(r.text, r.pii_spans) for r in rows)


def test_many_spans_of_one_text(spark):
    """Work grows with the spans, not with their square: ten times as many take less than forty times as long."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "é x@y.zz and 10.0.0.1 " * n, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
        began = time.time()
        out = pii.redact_stage(spark, docs, "").first().text
        assert out == "é [EMAIL] and [IP] " * n
        return time.time() - began

    seconds(500)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.2)
