"""Personal data, in DataFrame operations only.

Regular expressions propose spans, checksums (Luhn, modulo 97) and range checks confirm them, and
words of context near by adjust a score; proposals under the bar are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _iban(m: Column) -> Column:
    """The first four characters go to the end, letters count 10 to 35; the number is 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    code = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * F.when(c.between("0", "9"), 10).otherwise(100) + code(c), F.lit(97))))
    return F.length(s).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    """pattern must never match the empty string.  start: what precedes a match at its leftmost
    place, to save the search from every place of a long run; it never changes what is found.
    score: without context; bonus: what a context word in the REACH characters before or after adds."""

    name: str
    pattern: str
    check: object = None
    score: float = 1.0
    bonus: float = 0.0
    context: tuple[str, ...] = field(default=())
    need: str = ""


#: Words of context, fixed values of four languages.
_CALL = ("phone", "telefon", "teléfono", "téléphone", "tel.", "tel:", "call", "mobile", "fax")
_MAIL = ("mail", "contact", "kontakt", "correo", "courriel", "write to")
_HOST = ("ip", "host", "server", "address", "adresse", "dirección", "login")
_CARD = ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment")
_BANK = ("iban", "account", "konto", "compte", "cuenta", "bank")
_SSN = ("ssn", "social security", "tax id", "taxpayer")
#: Lengths of account numbers by country, fixed values of the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: A number ends where its country says, whatever word follows; of other countries it is as long as can be.
_IBAN = "|".join([*(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()), f"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"])
#: Found by form alone (with its checks), whatever the context: their own score passes the bar.
#: Possessive runs match what greedy ones do here, since nothing after them could take their characters.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.8, 0.2, _MAIL, "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, 0.3, _HOST, "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card, 0.7, 0.3, _CARD),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, 0.3, _CALL, "+"),
)
ADDED = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", _iban, 0.7, 0.3, _BANK),
    Kind("ssn", r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])", None, 0.3, 0.5, _SSN, "-"),
    Kind("tel", r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])", None, 0.3, 0.5, _CALL),
)
BAR = 0.5
REACH = 48
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
#: Running values are made in blocks of this many, texts cut in chunks of so many characters.
_BLOCK, _CHUNK = 128, 256


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running op, sum or maximum, of an array of integers: within blocks, and over their last values.
    An array that grows is copied with every value, so blocks keep the work near linear."""

    def last(x: Column) -> Column:
        return F.get(x, F.size(x) - 1)

    def short(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda out, v: F.array_append(out, F.when(F.size(out) > 0, op(last(out), v)).otherwise(v)))

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda k: short(F.slice(values, k * _BLOCK + 1, _BLOCK)))

    def joined(blocks: Column) -> Column:
        return _let(short(F.transform(blocks, last)), lambda tops: F.flatten(F.transform(blocks, lambda x, k: F.when(k > 0, F.transform(x, lambda v: op(F.get(tops, k - 1), v))).otherwise(x))))

    return F.when(F.size(values) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))


def _chunks(text: Column) -> Column:
    """A place in a text is found from its start, so what is read at many places is read from chunks."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text in chunks."""
    first = F.floor(start / _CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(end / _CHUNK).cast("int") - first + 1), "")
    return F.substring(some, start - first * _CHUNK + 1, end - start)


def _score(kind: Kind, chunks: Column, start: Column, end: Column) -> Column:
    """Its own score, and the bonus if a word of context is among the REACH characters before or after,
    whatever other spans those hold."""
    near = F.lower(F.concat(_part(chunks, F.greatest(start - REACH, F.lit(0)), start), F.lit("\n"), _part(chunks, end, end + REACH)))
    found = F.exists(F.array(*map(F.lit, kind.context)), lambda w: F.contains(near, w))
    return F.lit(kind.score) + F.when(found, kind.bonus).otherwise(0.0)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """The spans of a kind that pass its check and the bar, in code points: what lies between the matches
    and the matches themselves add up to the places where they end."""

    def of_matches(found: Column) -> Column:
        gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: gap + F.length(m))
        placed = _let(_scan_of(steps), lambda ends: F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))))
        if kind.check is not None:
            placed = F.filter(placed, lambda s: kind.check(s["match"]))
        return F.when(F.size(found) > 0, _let(placed, of_placed)).otherwise(none)

    def of_placed(placed: Column) -> Column:
        def span(chunks: Column) -> Callable[[Column], Column]:
            return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), _score(kind, chunks, s["start"], s["end"]).cast("double").alias("score"))

        scored = _let(_chunks(text), lambda chunks: F.transform(placed, span(chunks)).cast(SPAN))
        return F.when(F.size(placed) > 0, F.filter(scored, lambda s: s["score"] >= BAR)).otherwise(none)

    none = F.array().cast(SPAN)
    some = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.need:
        some = F.when(F.contains(text, F.lit(kind.need)), some).otherwise(F.array().cast("array<string>"))
    return _let(some, of_matches)


def _scan_of(steps: Column) -> Column:
    return _let(steps, lambda x: _scan(x, lambda a, b: a + b))


def spans_of(text: Column) -> Column:
    """All spans of a text, by start, then by kind as listed above.  Null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_spans(text, kind, k) for k, kind in enumerate((*BASE, *ADDED)))))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the column pii_spans: spans by start, then by kind as listed above.

    A null or empty text has none.  Spans of different kinds may overlap; those of one kind don't.
    Base kinds are found by form and check alone, context only changes their score; added ones need the
    score BAR.  Every other column stays as it is; a column named pii_spans is replaced.  The work grows
    with the text and its spans, not with their product."""
    return docs.withColumn("pii_spans", spans_of(F.col(text_col)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch of overlapping spans replaced by its first kind in brackets.

    spans are ordered by start; one opens a stretch if it starts at or behind the furthest end before it."""

    def write(tops: Column, chunks: Column) -> Column:
        before = lambda k: F.coalesce(F.get(tops, k - 1), F.lit(0))
        opening = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: F.get(spans, k)["start"] >= before(k))
        piece = lambda k: F.concat(_part(chunks, before(k), F.get(spans, k)["start"]), F.lit("["), F.upper(F.get(spans, k)["kind"]), F.lit("]"))
        rest = _part(chunks, F.get(tops, F.size(tops) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(opening, piece), ""), rest)

    tops = _let(F.transform(spans, lambda s: s["end"]), lambda ends: _scan(ends, F.greatest))
    return F.when(F.size(spans) > 0, _let(tops, lambda t: _let(_chunks(text), lambda c: write(t, c)))).otherwise(text)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs).drop("text")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and n_chars counted anew; a null text stays null."""
    text = redacted(F.col("text"), F.col("pii_spans"))
    out = with_spans(docs).withColumn("text", text).drop("pii_spans")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
