"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and then validated: payment cards by their check digit, IBANs by theirs, internet addresses
by their range, social-security numbers by their ranges, dates by the calendar, telephone numbers by their number of digits. A valid value is replaced
by a keyed permutation of itself inside its own format, a Feistel network over its digits (or letters, octets, days), and check
digits are set anew. So a pseudonym is again a valid value of the same look, equal values get equal pseudonyms in all documents whatever their
spacing, and with the key the original can be had back (``reverse``).

Only SQL functions are used, row by row: no shuffle, and texts without a digit or an at sign are not looked into. The key stands in no plan.

Kinds: email (the part before the at sign), secret (a value with a digit after a word such as password, up to the next blank, quote, angle
bracket or character that is not ASCII, without punctuation at its end), key (access key ids), iban, phone, ssn, ip, date (1900-01-01 to 2100-05-02), card. Slashed dates are read month first, or day first where that
is no date. A run of digit groups is cut from its left into cards in the usual
groups (4-4-4-4, 4-6-5, 4-6-4, or 13 to 19 digits in one) and the valid ones are replaced, whatever numbers stand before or behind them; a run without one is
tried as a whole, and then at the other groups. A pseudonym in such a run may by chance make another cut valid, so only cards found at the first cut are
sure to come back by ``reverse``;
of an IBAN-like run the longest valid part from the left is replaced, so a word behind
it does no harm. Values that fail validation stay as they are.

Defined cases: a null text stays null, an empty one empty, without spans. Texts are searched whole. Repeated rows get equal results; an empty table an
empty one. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind, hidden, let
from sluiceway.llm.common import without

ROUNDS = 10
EACH = r"(?!^)(?!\z)"  # between any two characters
DAYS = 270 * 271  # from 1900-01-01; a product of two near factors, so that days are two digits of a mixed base
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?+[\x20\t]*+[=:][\x20\t]*+[\"']?+(?=[!#-&(-/:;=?-_a-~]*+[0-9])[!#-&(-;=?-_a-~]{5,}[A-Za-z0-9_-]",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])|(?<![0-9.-])(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9./]?[0-9])",
    "card": r"(?<![0-9-])[0-9](?:(?:[\x20-](?![0-9]{1,2}[/.][0-9]{1,2}|[0-9]{3,4}-[0-9]{2}-[0-9]{2,4}(?![0-9-])))?[0-9]){12,}+",
}
# Cards as they are written inside longer runs of digits.
GROUPED = r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5}(?![0-9])|[0-9]{13,19}(?![0-9]))"


def _hash(key: Column, *parts: Column) -> Column:
    """A number below 2**48 from the key and the parts."""
    digest = F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permute(values: Column, bases: Column, key: Column, kind: str, reverse: bool = False) -> Column:
    """Keyed permutation of an array of digits, ``values[i]`` below ``bases[i]``. The halves of the array change in turn,
    each digit by a hash of the other half, modulo its base."""
    half = F.floor(F.size(values) / 2).cast("int")
    bases_l, bases_r = F.slice(bases, 1, half), F.slice(bases, half + 1, F.size(bases))
    sign = -1 if reverse else 1

    def turned(mine: Column, own: Column, other: Column, at: Column) -> Column:
        told = F.array_join(other.cast("array<string>"), ",")
        return let(told, lambda t: F.transform(mine, lambda v, i: F.pmod(v + sign * _hash(key, F.lit(kind), at, i, t), F.get(own, i)).cast("int")))

    def step(state: Column, at: Column) -> Column:
        even = at % 2 == 0
        return F.struct(F.when(even, turned(state.l, bases_l, state.r, at)).otherwise(state.l).alias("l"),
                        F.when(even, state.r).otherwise(turned(state.r, bases_r, state.l, at)).alias("r"))

    order = list(range(ROUNDS))[::-1] if reverse else list(range(ROUNDS))
    start = F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, F.size(values)).alias("r"))
    return F.aggregate(F.array(*map(F.lit, order)), start, step, lambda s: F.concat(s.l, s.r))


def _numbers(digits: Column) -> Column:
    return F.split(digits, EACH).cast("array<int>")


def _permuted_digits(digits: Column, key: Column, kind: str, reverse: bool) -> Column:
    return let(_numbers(digits), lambda v: F.array_join(permute(v, F.transform(v, lambda _: F.lit(10)), key, kind, reverse).cast("array<string>"), ""))


def _refill(shape: Column, chars: str, filling: Column) -> Column:
    """``shape`` with its characters of the class ``chars`` taken from ``filling`` in order."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{chars}]", ""))
    return F.array_join(F.transform(F.split(shape, EACH), lambda c, i: F.when(c.rlike(f"[{chars}]"), F.substring(filling, seen(i), F.lit(1))).otherwise(c)), "")


def _permuted_chars(text: Column, key: Column, kind: str, reverse: bool) -> Column:
    """Digits stay digits, small letters small letters, capitals capitals, other characters themselves; a secret of 16 and
    more hexadecimal digits stays one."""
    hexa = text.rlike("^[0-9a-f]{16,}$") if kind == "secret" else F.lit(False)
    digit, lower, upper = (lambda c: c.rlike("[0-9]")), (lambda c: c.rlike("[a-z]")), (lambda c: c.rlike("[A-Z]"))
    base = lambda c: F.when(hexa, 16).when(digit(c), 10).when(lower(c) | upper(c), 26).otherwise(1)
    value = lambda c: F.when(digit(c), F.ascii(c) - 48).when(hexa, F.ascii(c) - 87).when(lower(c), F.ascii(c) - 97).when(upper(c), F.ascii(c) - 65).otherwise(0)
    char = lambda c, v: (F.when(hexa, F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1))).when(digit(c), v.cast("string"))
                         .when(lower(c), F.chr(v + 97)).when(upper(c), F.chr(v + 65)).otherwise(c))
    return let(F.split(text, EACH), lambda cs: F.array_join(F.zip_with(
        cs, permute(F.transform(cs, value).cast("array<int>"), F.transform(cs, base), key, kind, reverse), char), ""))


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs behind a string of digits."""
    doubled = F.transform(F.reverse(_numbers(digits)), lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string")


def iban_check(bban: Column, country: Column) -> Column:
    """The two check digits of an IBAN."""
    chars = F.split(F.concat(bban, country, F.lit("00")), EACH)
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def _email(v, key, reverse):
    return F.concat(_permuted_chars(F.substring_index(v, "@", 1), key, "email", reverse), F.lit("@"), F.substring_index(v, "@", -1))


def _secret(v, key, reverse):
    name = F.regexp_extract(v, r"^(.*?[=:][\x20\t]*[\"']?)", 1)
    return F.concat(name, _permuted_chars(F.substring(v, F.length(name) + 1, F.length(v)), key, "secret", reverse))


def _key(v, key, reverse):
    return F.concat(F.substring(v, 1, 4), _permuted_chars(F.substring(v, 5, 16), key, "key", reverse))


def _iban(v, key, reverse):
    """The longest valid part that begins at the leftmost place where one begins; what stands around it stays."""
    sound = lambda part: let(F.replace(part, F.lit(" "), F.lit("")), lambda b: F.substring(b, 3, 2) == iban_check(F.substring(b, F.lit(5), F.length(b)), F.substring(b, 1, 2)))

    def fresh(part: Column) -> Column:
        def build(b: Column) -> Column:
            country = F.substring(b, 1, 2)
            return let(_permuted_chars(F.substring(b, F.lit(5), F.length(b)), key, "iban", reverse), lambda p: _refill(part, "A-Z0-9", F.concat(country, iban_check(p, country), p)))
        return let(F.replace(part, F.lit(" "), F.lit("")), build)

    def parts(groups: Column) -> Column:
        ends = lambda s: F.transform(F.sequence(F.size(groups), s, F.lit(-1)), lambda e: F.array_join(F.slice(groups, s, e - s + 1), " "))
        starts = F.transform(groups, lambda g, i: F.when(g.rlike("^[A-Z]{2}[0-9]{2}"), ends(i + 1)).otherwise(F.array().cast("array<string>")))
        return F.filter(F.flatten(starts), lambda part: (F.length(part) >= 12) & sound(part))

    first = let(let(F.split(v, " "), parts), lambda found: F.get(found, F.lit(0)))
    return let(first, lambda part: F.when(part.isNotNull(), _swapped(v, part, fresh(part))))


def _swapped(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` in it replaced."""
    return let(F.instr(text, old), lambda n: F.concat(F.substring(text, F.lit(1), n - 1), new, F.substring(text, n + F.length(old), F.length(text))))


def _phone(v, key, reverse):
    code = F.regexp_extract(v, r"^(\+[0-9]{1,3}?(?=[\x20.-]|\()|1[\x20.-])", 1)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.when(F.length(digits).between(7, 15), F.concat(code, _refill(rest, "0-9", _permuted_digits(digits, key, "phone", reverse))))


def _ssn(v, key, reverse):
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    sound = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    show = lambda p: F.format_string("%03d-%02d-%04d", F.get(p, 0) + 1 + (F.get(p, 0) >= 665).cast("int"), F.get(p, 1) + 1, F.get(p, 2) + 1)
    return F.when(sound, let(permute(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", reverse), show))


def _ip(v, key, reverse):
    parts = F.split(v, r"\.").cast("array<int>")
    fresh = permute(parts, F.array(*[F.lit(256)] * 4), key, "ip", reverse)
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(fresh.cast("array<string>"), "."))


def _date(v, key, reverse):
    first = F.lit("1900-01-01").cast("date")

    def shown(form: str) -> Column:
        day = F.try_to_timestamp(v, F.lit(form)).cast("date")
        at = F.datediff(day, first)
        fresh = let(permute(F.array(F.floor(at / 271).cast("int"), at % 271), F.array(F.lit(270), F.lit(271)), key, "date", reverse),
                    lambda p: F.date_format(F.date_add(first, F.get(p, 0) * 271 + F.get(p, 1)), form))
        return F.when((at >= 0) & (at < DAYS), fresh)

    padded = v.rlike(r"^[0-9]{2}[./][0-9]{2}[./]")
    dotted = v.contains(".")
    return (F.when(v.contains("-"), shown("yyyy-MM-dd")).when(dotted & padded, shown("dd.MM.yyyy")).when(dotted, shown("d.M.yyyy"))
            .when(padded, F.coalesce(shown("MM/dd/yyyy"), shown("dd/MM/yyyy"))).otherwise(F.coalesce(shown("M/d/yyyy"), shown("d/M/yyyy"))))


def _card(v, key, reverse):
    def digits(part: Column) -> Column:
        return F.regexp_replace(part, "[^0-9]", "")

    def sound(part: Column) -> Column:
        return let(digits(part), lambda d: F.length(d).between(13, 19) & (F.substring(d, -1, 1) == luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1))))

    def fresh(part: Column) -> Column:
        body = let(digits(part), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))
        return let(_permuted_digits(body, key, "card", reverse), lambda p: _refill(part, "0-9", F.concat(p, luhn_digit(p))))

    between, cards = _parts(v, GROUPED)
    fills = F.concat(F.transform(cards, lambda part: F.when(sound(part), fresh(part)).otherwise(part)), F.array(F.lit("")))
    each = F.array_join(F.zip_with(between, fills, lambda a, b: F.concat(a, b)), "")
    # Groups of four that are more than a card may begin with another number.
    shifted = F.filter(F.regexp_extract_all(v, F.lit(f"(?=({GROUPED}))"), F.lit(1)), lambda part: (part != "") & sound(part))
    other = lambda: let(F.get(shifted, F.lit(0)), lambda part: F.when(part.isNotNull(), _swapped(v, part, fresh(part))))
    return F.when(F.exists(cards, sound), each).when(sound(v), fresh(v)).otherwise(other())


MAKERS = {"email": _email, "secret": _secret, "key": _key, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "card": _card}


def _parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches, and the matches."""
    return F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), reverse: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced and ``spans``: array of (kind, pseudonym) for every value replaced, in order."""
    # Back references are by number, so the one in the date pattern is named anew for the joint pattern.
    joint = "|".join(f"(?:{PATTERNS[k]})".replace(r"([./])", r"(?<mark>[./])").replace(r"\1", r"\k<mark>") for k in kinds)
    between, matches = _parts(F.col(text), joint)

    def judged(value: Column) -> Column:
        """(kind, replacement or null) of a match."""
        kind = fresh = None
        for k in kinds:
            # Look-arounds were checked in the text; here the match stands alone.
            fits = value.rlike(f"^(?:{PATTERNS[k]})$")
            kind = (F if kind is None else kind).when(fits, F.lit(k))
            fresh = (F if fresh is None else fresh).when(fits, MAKERS[k](value, F.col("_key"), reverse))
        return F.struct(kind.alias("kind"), fresh.alias("fresh"), value.alias("value"))

    def rebuilt(found: Column) -> Column:
        fills = F.concat(F.transform(found, lambda m: F.coalesce(m.fresh, m.value)), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(between, fills, lambda a, b: F.concat(a, b)), "")
        spans = F.transform(F.filter(found, lambda m: m.fresh.isNotNull()), lambda m: F.struct(m.kind.alias("kind"), m.fresh.alias("pseudonym")))
        return F.struct(whole.alias("text"), spans.alias("spans"))

    none = F.struct(F.col(text).alias("text"), F.array().cast("array<struct<kind:string,pseudonym:string>>").alias("spans"))
    value = F.when(F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False)), let(F.transform(matches, judged), rebuilt)).otherwise(none)
    rows = without(docs, ("spans",))
    done = bind(rows.withColumn("_key", hidden(key)), "_done", value)
    return done.select(*[F.col("_done.text").alias(n) if n == text else F.col(f"`{n}`") for n in rows.columns], F.col("_done.spans").alias("spans"))
