"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

Numbers and dates that pass their format's own check are permuted within that format by a keyed Feistel network, so
equal values get equal pseudonyms in every document, different ones stay different, and the result passes the same
check. Digits keep their places among the separators. No quantified group of the patterns gives back what it matched, or it
repeats a bounded number of times, so a long run of text needs no deep stack.

    card      13 to 19 digits with a right Luhn digit: the digits before it are permuted and a right one follows
    date      yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy from 1900-01-01 to 2100-01-02, as a number of days
    address   IPv4 with octets to 255, as two 16-bit halves; zeros before an octet are not kept
    social    ddd-dd-dddd: the nine digits
    phone     + and up to 15 digits, or (ddd) ddd-dddd: the last ten digits, or all of fewer
    mail      not a number: the whole address becomes a keyed name of 128 bits at example.invalid
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_DATE_DAYS = (150, 487)  # their product is the number of days from 1900-01-01 to 2100-01-02

#: What is looked for, in this order at each place of the text.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4})(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, left_size: str, right_size: str, key: str, tweak: str) -> str:
    """SQL for a struct (a, b): the pair (left, right) permuted within left_size x right_size values.

    Each round adds a keyed hash of the one half to the other, modulo its size, and exchanges them; the number of
    rounds is even, so the halves end where they began.
    """
    mixed = f"cast(conv(substr(sha2(concat_ws(':', {key}, {tweak}, i, s.b), 256), 1, 14), 16, 10) AS bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({left} AS bigint), 'b', cast({right} AS bigint)), "
        f"(s, i) -> named_struct('a', s.b, 'b', pmod(s.a + {mixed}, CASE WHEN i % 2 = 0 THEN cast({left_size} AS bigint) ELSE cast({right_size} AS bigint) END)))"
    )


def permuted_digits(digits: str, key: str, tweak: str) -> str:
    """SQL for a string of digits (2 to 18) permuted within those of its length."""
    n = f"length({digits})"
    u, v = f"cast(floor({n} / 2) AS int)", f"({n} - cast(floor({n} / 2) AS int))"
    pair = feistel(f"substr({digits}, 1, {u})", f"substr({digits}, {u} + 1)", f"round(pow(10, {u}))", f"round(pow(10, {v}))", key, f"concat({tweak}, {n})")
    return f"transform(array({pair}), p -> concat(lpad(cast(p.a AS string), {u}, '0'), lpad(cast(p.b AS string), {v}, '0')))[0]"


def luhn_digit(payload: str) -> str:
    """SQL for the digit that makes payload and it pass Luhn's check."""
    places = f"transform(split(reverse({payload}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c AS int) * 2 - CASE WHEN c >= '5' THEN 9 ELSE 0 END ELSE cast(c AS int) END)"
    return f"cast(pmod(-aggregate({places}, 0, (a, x) -> a + x), 10) AS string)"


def _refilled(text: str, digits: str) -> str:
    """SQL for text with its digits replaced, in order, by those of ``digits``."""
    place = f"length(regexp_replace(substr({text}, 1, i + 1), '[^0-9]', ''))"
    return f"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c BETWEEN '0' AND '9' THEN substr({digits}, {place}, 1) ELSE c END), '')"


def _only(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _with(value: str, name: str, body: str) -> str:
    """SQL for body with ``name`` standing for value, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym(match: str, key: str) -> str:
    """SQL for the pseudonym of one match of the patterns; a match that fails its format's check comes back as it is. ``key`` is
    SQL, too."""
    mail = f"concat('user', substr(sha2(concat_ws(':', {key}, 'mail', lower({match})), 256), 1, 32), '@example.invalid')"
    halves = [f"cast(o[{k}] AS int) * 256 + cast(o[{k + 1}] AS int)" for k in (0, 2)]
    octets = "concat_ws('.', p.a DIV 256, p.a % 256, p.b DIV 256, p.b % 256)"
    address = _with(
        f"split({match}, '\\\\.')", "o",
        f"CASE WHEN forall(o, x -> cast(x AS int) <= 255) THEN {_with(feistel(*halves, '65536', '65536', key, _literal('address')), 'p', octets)} ELSE {match} END",
    )
    dates = []
    for like, form in (("____-__-__", "yyyy-MM-dd"), ("__/__/____", "dd/MM/yyyy"), ("__.__.____", "dd.MM.yyyy")):
        day = f"datediff(to_date(try_to_timestamp({match}, '{form}')), date'1900-01-01')"
        pair = feistel(f"n DIV {_DATE_DAYS[1]}", f"n % {_DATE_DAYS[1]}", str(_DATE_DAYS[0]), str(_DATE_DAYS[1]), key, _literal("date"))
        moved = _with(pair, "p", f"date_format(date_add(date'1900-01-01', cast(p.a * {_DATE_DAYS[1]} + p.b AS int)), '{form}')")
        dates.append(f"WHEN {match} LIKE '{like}' THEN {_with(day, 'n', f'CASE WHEN n BETWEEN 0 AND {_DATE_DAYS[0] * _DATE_DAYS[1] - 1} THEN {moved} ELSE {match} END')}")
    social = _refilled(match, permuted_digits(_only(match), key, _literal("social")))
    tail = f"concat(substr(d, 1, greatest(0, length(d) - 10)), {permuted_digits('right(d, 10)', key, _literal('phone'))})"
    phone = _with(_only(match), "d", _with(tail, "e", _refilled(match, "e")))
    payload = permuted_digits("left(d, length(d) - 1)", key, _literal("card"))
    valid = f"right(d, 1) = {luhn_digit('left(d, length(d) - 1)')}"
    card = _with(_only(match), "d", f"CASE WHEN {valid} THEN {_with(_with(payload, 'y', f'concat(y, {luhn_digit("y")})'), 'e', _refilled(match, 'e'))} ELSE {match} END")
    return (
        f"CASE WHEN {match} LIKE '%@%' THEN {mail} WHEN {match} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {address} {' '.join(dates)} "
        f"WHEN {match} LIKE '___-__-____' THEN {social} WHEN {match} LIKE '+%' OR {match} LIKE '(%' THEN {phone} ELSE {card} END"
    )


#: The setting of the session that holds the key where the caller gives none.
KEY_SETTING = "spark.gridloom.pii.key"


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with text_col rewritten and a column ``n_private``: how many values were replaced.

    Whoever has ``key`` can undo the pseudonyms. It is the caller's or the session's (KEY_SETTING); without either it is
    drawn at random for this call and kept nowhere else, so pseudonyms link documents of one result only. It reaches the tasks as
    a broadcast row, and is in no plan, nor in what the user interface and the event log show of one. An empty key is an error.

    All other columns stay, whatever their names (one named n_private is replaced). A null text stays null with
    n_private 0; an empty one stays empty. Texts are searched whole, however long they or single values in them are; of
    patterns that fit at one place the first of PATTERNS counts. Repeated rows are rewritten alike. Texts without a
    digit or @ are not searched. An empty table gives an empty one.
    """
    if key is None:
        key = docs.sparkSession.conf.get(KEY_SETTING, None)
    if key is None:
        key = secrets.token_hex(16)
    if not key:
        raise ValueError("the key of the pseudonyms is empty")
    text, hidden, keyed = f"cast(`{text_col}` AS string)", "_found", "_key"
    while hidden in docs.columns or keyed in docs.columns:
        hidden, keyed = hidden + "_", keyed + "_"
    pattern = _literal("|".join(f"(?:{p})" for p in PATTERNS.values()))
    found = F.expr(f"CASE WHEN {text} RLIKE '[0-9@]' THEN transform(regexp_extract_all({text}, {pattern}, 0), m -> named_struct('was', m, 'now', {pseudonym('m', f'`{keyed}`')})) END")
    parts = F.expr(
        f"CASE WHEN size(`{hidden}`) > 0 THEN array_join(transform(split({text}, {pattern}, -1), (x, i) -> concat(x, coalesce(get(`{hidden}`, i).now, ''))), '') ELSE {text} END"
    )
    n = F.expr(f"cast(coalesce(size(filter(`{hidden}`, x -> x.was <> x.now)), 0) AS int)")
    row = docs.sparkSession.createDataFrame([(key,)], f"`{keyed}` string")
    out = docs.crossJoin(F.broadcast(row)).withColumn(hidden, found).drop(keyed)
    return out.withColumns({text_col: parts, "n_private": n}).drop(hidden)
