"""Personal data: regular expressions propose, checksums confirm, context scores.

All positions are code points; everything runs in DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``find`` (Java regex, no groups) proposes spans leftmost and non-overlapping;
    ``likely`` is a cheap test of a whole text; ``valid`` is SQL over the match ``m``;
    a valid span scores ``prior``, and ``bonus`` more if a word of ``context`` stands
    within ``near`` characters before it. Base kinds stay at any score. ``whole``: no
    letter or digit may touch the span."""

    name: str
    find: str
    likely: str
    valid: str
    prior: float
    bonus: float
    context: str
    base: bool = True
    whole: bool = False


DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = f"""aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + transform(array(cast(substr(reverse({DIGITS}), i, 1) as int)),
    d -> case when i % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end)[0]) % 10 = 0"""
PART = "regexp_replace({}, '^0+(?=[0-9])', '')"
IP_OK = "forall(split(m, '\\\\.'), p -> length({0}) <= 3 and cast({0} as int) <= 255)".format(PART.format("p"))
PLAIN = "regexp_replace(m, ' ', '')"
MOD97 = f"""aggregate(split(concat(substr({PLAIN}, 5), substr({PLAIN}, 1, 4)), '(?!^)'), 0, (a, c) ->
    case when c = '' then a when c rlike '[0-9]' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"""

# Characters of an IBAN by country, as registered under ISO 13616.
IBAN_SIZES = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 "
    "RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
IBAN_OK = f"instr('{IBAN_SIZES}', concat(substr({PLAIN}, 1, 2), length({PLAIN}))) > 0"

#: Characters of tokens. A run of them is a match whole, and only with a letter and a digit.
SAFE = "[A-Za-z0-9_+/=-]"

#: An email's local part begins where its run of characters begins, or at the end of
#: the last match, so that a long run is tried once and not from each of its characters.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "instr(t, '@') > 0", "true", 0.9, 0.1, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"t rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", IP_OK, 0.6, 0.3, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9](?:[ -]?[0-9]){15}'", f"length({DIGITS}) between 16 and 19 and case when length({DIGITS}) between 16 and 19 then {LUHN} else false end", 0.8, 0.2, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(t, '+') > 0", f"length({DIGITS}) between 8 and 15", 0.7, 0.2, "phone|tel|call|mobile"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", "t rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", f"case when {IBAN_OK} then {MOD97} else false end", 0.8, 0.2, "iban|bank|account|konto", False, True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "m not rlike '^(000|666|9)' and m not rlike '^...-00|-0000$'", 0.4, 0.5, "ssn|social security", False),
    Kind("secret", rf"(?<!{SAFE})(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z]){SAFE}{{20,}}+", f"t rlike '{SAFE}{{20}}'", "true", 0.3, 0.5, "token|secret|key|api_key|apikey|passw|bearer|authorization", False),
)
#: Score from which a span of the added kinds counts, and characters of context.
LEAST, NEAR = 0.75, 40


def _spans(kind: Kind) -> str:
    """SQL for the array of (kind, lo, hi, score) of one kind in text ``t``.

    One pass of the expression puts a mark on either side of each match; between marks,
    gaps and matches take turns. Their lengths are summed by pieces of the square root of
    their number, so that no array grows by one element for each match of a text.
    """
    q = lambda s: s.replace("\\", "\\\\")
    # the mark is a control character, which no pattern or context word asks for
    parts = rf"split(regexp_replace(translate(t, '\u0001', '\u0002'), '{q(kind.find)}', '\u0001$0\u0001'), '\u0001')"
    chunk = "slice(p, k * c + 1, c)"
    sums = f"transform(sequence(0, (size(p) - 1) div c), k -> aggregate({chunk}, 0, (a, x) -> a + length(x)))"
    ahead = f"""aggregate({sums}, named_struct('at', 0, 'got', cast(array() as array<int>)),
        (a, x) -> named_struct('at', a.at + x, 'got', concat(a.got, array(a.at)))).got"""
    none = "cast(array() as array<struct<s: int, e: int, m: string, b: string, z: string>>)"
    # the characters before come along, as a substring of a long text is found from its start;
    # of every two parts one has a character at least
    last = f"right(array_join(slice(p, greatest(k * c - {2 * NEAR}, 0) + 1, least(k * c, {2 * NEAR})), ''), {NEAR})"
    after = "left(concat(p[a.i + 1], coalesce(get(p, a.i + 2), '')), 1)" if kind.whole else "''"
    walk = f"""aggregate({chunk}, named_struct('at', o[k], 'i', k * c, 'b', {last}, 'got', {none}), (a, x) -> named_struct('at', a.at + length(x), 'i', a.i + 1,
        'b', right(concat(a.b, x), {NEAR}), 'got', case when a.i % 2 = 1 then
        concat(a.got, array(named_struct('s', a.at, 'e', a.at + length(x), 'm', x, 'b', a.b, 'z', {after}))) else a.got end)).got"""
    found = f"""transform(array({parts}), p -> transform(array(cast(ceil(sqrt(size(p))) as int)), c -> transform(array({ahead}), o ->
        flatten(transform(sequence(0, size(o) - 1), k -> {walk})))[0])[0])[0]"""
    near = f"lower(x.b) rlike '(^|[^a-z])({kind.context})'"
    valid = f"transform(array(x.m), m -> {kind.valid})[0]"
    if kind.whole:
        valid += " and not concat(right(x.b, 1), ' ', x.z) rlike '[A-Za-z0-9]'"
    scored = f"transform(filter({found}, x -> {valid}), x -> struct('{kind.name}' as kind, x.s as lo, x.e as hi, {kind.prior}D + case when {near} then {kind.bonus}D else 0D end as score))"
    if not kind.base:
        scored = f"filter({scored}, x -> x.score >= {LEAST}D)"
    return f"case when {kind.likely} then {scored} else cast(array() as array<struct<kind: string, lo: int, hi: int, score: double>>) end"


def find_pii(docs: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """``docs`` plus one array column ``pii_<kind>`` per kind: kind, lo, hi (exclusive), score.

    Null and empty texts have no spans; no row is dropped or moved, as a row's spans
    need that row only. Input columns with the added names are replaced.
    """
    docs = docs.drop(*[c for c in ("t", *(f"pii_{k.name}" for k in kinds)) if c != text_col])
    df = docs.withColumn("t", F.coalesce(F.col(text_col), F.lit("")))
    return df.select("*", *[F.expr(_spans(k)).alias(f"pii_{k.name}") for k in kinds]).drop("t")


def span_list(kinds) -> Column:
    """``kind:start:end`` of all spans, by kind and start, comma-joined."""
    every = F.concat(*[F.transform(F.col(f"pii_{k.name}"), lambda x: F.concat_ws(":", x["kind"], x["lo"], x["hi"])) for k in kinds])
    return F.array_join(every, ",")
