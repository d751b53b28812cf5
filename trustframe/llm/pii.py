"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans, a validator confirms them (address parts, Luhn,
digit counts, mod-97), and words within ``CONTEXT`` characters raise or lower
the score.  Spans are code points, end exclusive, leftmost and
non-overlapping within a kind.

The patterns match what their plain forms match.  They are written with
possessive repeats, which never backtrack, and start a run only at its first
character (a match that fails there fails from every later character of the
run too), so a text of any length is read in linear time and stack.

An IBAN is as long as its country's (``IBAN_LENGTHS``), whatever follows it.
Its pattern matches the empty text before the number, so a proposal that fails
mod-97 hides none that starts inside it, and every valid number is a span.

Positions come from the pieces between matches: lengths are summed in blocks,
so a text with very many matches costs no quadratic copying.  Null and empty
texts have no spans.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
BLOCK = 256

# fixed values: kinds in output order with pattern, base score, words that raise or lower it
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC NI", 33: "RU",
}


def _iban_pattern() -> str:
    """Group 1, looked ahead at, is the number; codes of no list may have any length."""
    forms = []
    for n in sorted(IBAN_LENGTHS, reverse=True):
        fours, rest = divmod(n - 4, 4)
        forms.append(rf"(?:{IBAN_LENGTHS[n].replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}"
                     + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9])")
    listed_codes = "|".join(sorted({c for v in IBAN_LENGTHS.values() for c in v.split()}))
    forms.append(rf"(?!{listed_codes})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+"
                 r"(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({'|'.join(forms)}))"


IBAN = _iban_pattern()
IBAN_REACH = 9         # a number has at most 42 characters, and two starts are 5 or more apart


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_ip(m: Column) -> Column:
    # a part of more than 3 digits is too large unless it starts with zeros
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        "^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _is_iban(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.length(s).between(15, 34) & (rest == 1)


KINDS = {
    "email": (EMAIL, lambda m: F.lit(True), 0.9, "mail|contact|write|address", "example|noreply"),
    "ip": (IP, _is_ip, 0.6, r"\bip\b|host|server|address|login", "version|release|section"),
    "card": (CARD, _is_card, 0.8, "card|visa|master|amex|credit|pay", "order|invoice|isbn|serial"),
    "phone": (PHONE, _is_phone, 0.7, "phone|call|tel|mobile|fax|whatsapp", "order|part|serial"),
    "iban": (IBAN, _is_iban, 0.9, "iban|bank|account|transfer", "serial|licen[cs]e"),
}
BASE = ("email", "ip", "card", "phone")
# characters without which a kind cannot occur
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _valid(kind: str, m: Column) -> Column:
    return KINDS[kind][1](m)


def _present(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)


def _found(kind: str, text: Column) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.coalesce(F.when(_present(kind, text),
                             F.regexp_extract_all(text, F.lit(KINDS[kind][0]),
                                                  F.lit(int(kind == "iban")))), none,
                      F.array().cast("array<string>"))


def _pieces(kind: str, text: Column) -> Column:
    """The text before, between and after the matches; an IBAN begins its piece."""
    if kind != "iban":
        return F.split(text, KINDS[kind][0], -1)
    # without a character before it, an empty match at the start would cut nothing
    led = F.split(F.concat(F.lit(" "), text), KINDS[kind][0], -1)
    return F.transform(led, lambda p, i: F.when(i == 0, F.substr(p, F.lit(2))).otherwise(p))


def _gaps(kind: str, found: Column, pieces: Column) -> Column:
    return F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(
        F.length(p).alias("skip"), (F.lit(0) if kind == "iban" else F.length(m)).alias("len")))


def _starts(gaps: Column) -> Column:
    """Running sums before each element of array<struct<skip, len>>, plus its skip.

    Blocks of ``BLOCK`` elements are summed on their own, then shifted by the
    totals of the blocks before them.
    """
    empty = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("sum"), empty.alias("at"))

    def add(acc: Column, g: Column) -> Column:
        start = acc["sum"] + g["skip"]
        return F.struct((start + g["len"]).alias("sum"),
                        F.concat(acc["at"], F.array(start)).alias("at"))

    n = F.ceil(F.size(gaps) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda b: F.aggregate(F.slice(gaps, b * BLOCK + 1, F.lit(BLOCK)), zero, add))

    def shift(blocks: Column) -> Column:
        before = F.aggregate(blocks, zero, lambda acc, b: F.struct(
            (acc["sum"] + b["sum"]).alias("sum"),
            F.concat(acc["at"], F.array(acc["sum"])).alias("at")))["at"]
        return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(
            b["at"], lambda x: x + s)))

    return let(blocks, shift)


def _score(kind: str, before: Column, after: Column) -> Column:
    _, _, base, good, bad = KINDS[kind]
    near = F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "),
                            F.left(after, F.lit(CONTEXT))))
    return F.round(F.lit(base) + F.when(near.rlike(good), 0.1).otherwise(0.0)
                   - F.when(near.rlike(bad), 0.3).otherwise(0.0), 3)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, rank, end, kind, score>> of the valid spans of one kind."""
    rank = list(KINDS).index(kind)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")

    def after(m: Column, piece: Column) -> Column:
        return F.substr(piece, F.length(m) + 1) if kind == "iban" else piece

    def spans(found: Column, pieces: Column) -> Column:
        gaps = _gaps(kind, found, pieces)
        return let(let(gaps, _starts), lambda at: F.filter(F.transform(
            found, lambda m, i: F.when(_valid(kind, m), F.struct(
                F.get(at, i).alias("start"), F.lit(rank).alias("rank"),
                (F.get(at, i) + F.length(m)).alias("end"), F.lit(kind).alias("kind"),
                _score(kind, F.get(pieces, i), after(m, F.get(pieces, i + 1))).alias("score")))),
            lambda s: s.isNotNull()))

    def of(found: Column) -> Column:
        some = F.exists(found, lambda m: _valid(kind, m))
        return F.when(some, let(_pieces(kind, text), lambda p: spans(found, p))
                      ).otherwise(none)

    return let(_found(kind, text), of)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``pii``: all spans by start, then kind as listed in ``KINDS``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", F.array_sort(F.concat(*(spans_of(k, t) for k in KINDS))))


def of_kind(kind: str) -> Column:
    """The spans of one kind in the column ``pii``."""
    return F.filter("pii", lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every valid span of ``text`` replaced by its kind in brackets.

    Kinds follow each other, the enclosing ones first, each on the text that
    the one before left.  A masked address can leave digits that were too many
    before and are a phone or card number now, so these two are masked again.
    A null text stays null.
    """
    def ibans(found: Column, pieces: Column) -> Column:
        """Numbers that overlap become one label."""
        def ends(at: Column) -> Column:
            return F.transform(found, lambda m, i: F.when(
                _valid("iban", m), F.get(at, i) + F.length(m)).otherwise(0))

        def cut(at: Column, end: Column) -> Column:
            def part(p: Column, i: Column) -> Column:
                before = F.coalesce(F.array_max(F.slice(
                    end, F.greatest(i - IBAN_REACH, F.lit(1)), F.least(i - 1, F.lit(IBAN_REACH)))),
                    F.lit(0))
                start = F.get(at, i - 1)
                reach = F.greatest(before, F.get(end, i - 1))
                label = F.when((F.get(end, i - 1) > 0) & (before <= start), "[IBAN]").otherwise("")
                return F.concat(label, F.substr(p, F.greatest(reach - start, F.lit(0)) + 1))

            return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(
                part(p, i))), "")

        return let(let(_gaps("iban", found, pieces), _starts),
                   lambda at: let(ends(at), lambda end: cut(at, end)))

    def mask(kind: str, value: Column) -> Column:
        def of(found: Column) -> Column:
            if kind == "iban":
                return F.when(F.exists(found, lambda m: _valid(kind, m)), let(
                    _pieces(kind, value), lambda p: ibans(found, p))).otherwise(value)
            kept = F.transform(found, lambda m: F.when(
                _valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m))
            joined = F.array_join(F.zip_with(
                F.split(value, KINDS[kind][0], -1), kept,
                lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
            return F.when(F.exists(found, lambda m: _valid(kind, m)), joined).otherwise(value)

        return let(_found(kind, value), of)

    value = F.col(text)
    for kind in ("email", "phone", "iban", "card", "ip", "phone", "card"):
        value = let(value, partial(mask, kind))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), value))
