"""Personal data in whole texts, with built-in functions only.

Patterns propose spans, validators confirm them (Luhn for cards, mod 97 for bank accounts, ranges for addresses, digit
counts for phone numbers), and the words just before a span, or before the list it stands in, move its score. The base kinds stay whatever their
score; further kinds (iban, ssn) are reported from `min_score` on, and a national number thus needs a word that announces it.

Places come from the text between matches: splitting by the pattern gives the gaps, extraction the matches, and
their lengths add up to code-point places. An account has the length that its country sets, so it ends where the next word begins. Patterns are written without backtracking: a match may start only
where no earlier start was possible, so runs of millions of characters are read once.

Defined cases: null text is empty and has no spans; failing matches are dropped and not retried; kinds may
overlap each other; null ids and repeated rows are kept; no rows give no rows. Columns other than id and text
are ignored by `find_pii` and kept by `mask_pii`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
_LOCAL = "A-Za-z0-9._%+-"
#: Codes of countries by the length of their accounts, after which nothing is taken; in the first table only digits follow the code.
DIGITS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL", 19: "SI", 20: "AT BA EE LT XK", 21: "HR", 22: "DE ME RS VA", 23: "IL TL",
    24: "CZ ES SE SK TN", 25: "PT ST", 26: "IS", 27: "MR", 28: "HU PL",
}
MIXED = {
    18: "FK NL SD", 19: "MK", 20: "KZ LU MN", 21: "CH LI LV", 22: "BG BH CR GB GE IE", 23: "AE GI IQ OM SO", 24: "AD MD PK RO SA VG",
    25: "AO CV LY MZ", 26: "DZ IR TR", 27: "BI CM DJ FR GR IT MC MG SM", 28: "AL AZ BY CI CY DO GT HN LB NI SN SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CODES = "|".join(codes.replace(" ", "|") for table in (DIGITS, MIXED) for codes in table.values())
_ACCOUNTS = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?{character}){{{length - 4}}}+"
    for character, table in (("[0-9]", DIGITS), ("[A-Z0-9]", MIXED))
    for length, codes in table.items()
)
# An account of another code goes on over whole words of capitals and digits, up to one that starts an account of a known code.
_OTHERS = rf"(?!{_CODES})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_CODES})[0-9]{{2}})(?=[A-Z0-9]{{1,30}}+(?![A-Za-z0-9])))?[A-Z0-9]){{11,30}}+"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ACCOUNTS}|{_OTHERS})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Score of a confirmed match, and words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|tax id",
}
_CONTEXT_LENGTH = 40
_BLOCK = 64
# Between the numbers of a list stands nothing else; the words before its first number announce all.
_LIST = r"^[^\p{L}]*+(?:(?:and|or|und|oder|et|ou|y|o)(?!\p{L})[^\p{L}]*+)?$"


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    digit = f"cast(substr({digits}, i, 1) as int)"
    doubled = f"cast(substr('0246813579', {digit} + 1, 1) as int)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (sum, i) ->"
        f" sum + case when (length({digits}) - i) % 2 = 1 then {doubled} else {digit} end) % 10 = 0"
    )


def _mod97(account: str) -> str:
    turned = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    return f"aggregate(split({turned}, ''), 0, (rest, c) -> (rest * case when {value} > 9 then 100 else 10 end + {value}) % 97) = 1"


VALID = {
    "email": "true",
    "ip": rf"s.text rlike '^{_BYTE}(?:\\.{_BYTE}){{3}}$'",
    "card": f"length({_digits('s.text')}) between 13 and 19 and {_luhn(_digits('s.text'))}",
    "phone": f"length({_digits('s.text')}) between 9 and 15",
    "iban": _mod97("replace(s.text, ' ', '')"),
    "ssn": "s.text not rlike '^(?:000|666|9)|-00-|-0000$'",
}
# A text without these characters cannot match, and is not searched.
_NEEDS = {"email": "@", "phone": "+"}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _pieces(text: str, kind: str) -> str:
    """Array of (gap, match): the text in turn; the last gap has no match."""
    pattern = _literal(PATTERNS[kind])
    searched = f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (gap, match) -> struct(gap, match))"
    if kind in _NEEDS:
        return f"case when contains({text}, '{_NEEDS[kind]}') then {searched} else array() end"
    return searched


def _score(kind: str, context: str) -> str:
    base = SCORES[kind]
    return f"cast(case when {context} rlike {_literal(CONTEXT[kind])} then {min(1.0, round(base + 0.3, 2))} else {base} end as double)"


def _context(gap: str, before: str) -> str:
    """The end of the text before a match; the matches of a list, however long it is, keep `before`, that of its first one."""
    return f"case when {gap} rlike {_literal(_LIST)} then {before} else right({gap}, {_CONTEXT_LENGTH}) end"


def _collected(pieces: str, out: str, row: str) -> str:
    """Rows of type `out` built by `row` from each match `p` and the state `acc` before it (`at`, `context`), in the order of the text.

    An aggregate copies its whole state at every step. So the pieces are taken in blocks: first only the state at the start
    of every block is carried along, then each block collects its own rows.
    """
    context = _context("p.gap", "acc.context")
    state = f"acc.at + length(p.gap) + length(p.match) as at, {context} as context"
    block = lambda start: f"transform(sequence({start}, least({start} + {_BLOCK}, size(all)) - 1), i -> get(all, i))"
    later = f"case when size(all) > {_BLOCK} then sequence({_BLOCK}, size(all) - 1, {_BLOCK}) else cast(array() as array<int>) end"
    carried = (
        f"aggregate({later}, struct(0 as at, '' as context, array(struct(0 as start, 0 as at, '' as context)) as out), (last, start) ->"
        f" aggregate({block(f'start - {_BLOCK}')}, struct(last.at as at, last.context as context), (acc, p) -> struct({state}),"
        " acc -> struct(acc.at as at, acc.context as context, concat(last.out, array(struct(start as start, acc.at as at, acc.context as context)))"
        " as out)), last -> last.out)"
    )
    rows = (
        f"transform({carried}, s -> aggregate({block('s.start')}, struct(s.at as at, s.context as context, cast(array() as {out}) as out),"
        f" (acc, p) -> case when p.match is null then acc else struct({state}, concat(acc.out, array({row.format(context=context)})) as out) end,"
        " acc -> acc.out))"
    )
    # The array of one is a name for the pieces, which are thus found once. One piece is a text without a match.
    return f"transform(array({pieces}), all -> case when size(all) < 2 then cast(array() as {out}) else flatten({rows}) end)[0]"


def spans_of(text: str, kind: str) -> Column:
    """Confirmed spans of one kind in the column `text`, which must not be null, by start."""
    row = (
        "struct(acc.at + length(p.gap) as start, acc.at + length(p.gap) + length(p.match) as end,"
        " p.match as text, {context} as context)"
    )
    found = _collected(_pieces(text, kind), "array<struct<start:int,end:int,text:string,context:string>>", row)
    confirmed = f"filter({found}, s -> {VALID[kind]})"
    scored = (
        f"transform({confirmed}, s -> struct('{kind}' as kind, s.start as start, s.end as end,"
        f" {_score(kind, 'lower(s.context)')} as score, s.text as text))"
    )
    return F.expr(scored)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """id and `spans`, an array of (kind, start, end, score, text) by kind as in `KINDS`, then start; end is exclusive."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = rows.select(id_col, *[spans_of("_text", k).alias(f"_{k}") for k in KINDS])
    more = [F.filter(f"_{k}", lambda s: s["score"] >= min_score) for k in KINDS if k not in BASE]
    return found.select(id_col, F.concat(*[F.col(f"_{k}") for k in BASE], *more).alias("spans"))


def span_digest(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(
        f"array_join(transform(filter({spans}, s -> s.kind in ({listed})), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    )


def mask_pii(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """`docs` with every reported span replaced by its kind in brackets, kind by kind; null text stays null."""
    columns = docs.columns
    for kind in KINDS:
        keep = VALID[kind].replace("s.text", "p.match")
        text = f"`{text_col}`"
        pieces = _pieces(text, kind)
        if kind not in BASE:
            keep = f"({keep}) and {_score(kind, 'lower(p.context)')} >= {min_score}"
            told = "array<struct<gap:string,match:string,context:string>>"
            found = _collected("all", told, "struct(p.gap as gap, p.match as match, {context} as context)")
            # What follows the last match stands alone in the last piece.
            rest = "struct(element_at(all, -1).gap as gap, cast(null as string) as match, '' as context)"
            pieces = f"transform(array({pieces}), all -> concat({found}, array({rest})))[0]"
        masked = (
            f"array_join(transform({pieces}, p -> case when p.match is null then p.gap"
            f" when {keep} then concat(p.gap, '[{kind.upper()}]') else concat(p.gap, p.match) end), '')"
        )
        if kind in _NEEDS:
            masked = f"case when contains({text}, '{_NEEDS[kind]}') then {masked} else {text} end"
        docs = docs.withColumn(text_col, F.expr(masked))
    return docs.select(columns)
