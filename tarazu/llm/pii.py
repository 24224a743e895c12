"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import unused

ROUNDS = 8
#: What may hold personal data, by kind, in the order in which they are tried at each place. Fixed values.
#: Groups repeat possessively or a bounded number of times: the engine recurses for each turn of any other loop over a group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "isodate": r"(?<!\d)(?:1[6-9]|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)",
    "daydate": r"(?<![\d/])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|[12]\d|3[01])/(?:1[6-9]|20)\d\d(?![\d/])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){1,2}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]\(?\d\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![0-9A-Za-z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,}(?![0-9A-Za-z])|(?<![A-Za-z0-9])password=[0-9A-Za-z_-]{6,}|(?<![A-Za-z0-9])(?:gh[pousr]_|sk-)[0-9A-Za-z]{16,}",
}
#: Dates are permuted among the days that the patterns let through, 1600-01-01 to 2099-12-31: the 144 days a year up to
#: the 12th of a month among themselves, so that a date with day and month in either order never becomes one whose
#: order is open, and the others among themselves. Each number is given as two factors.
FIRST_DAY, YEARS, EARLY_DAYS, LATE_DAYS = "1600-01-01", 500, (288, 250), (618, 179)
#: Social security numbers are permuted among those that the pattern lets through: 898 areas times 99 groups, and 9,999 serials.
SSNS = (898 * 99, 9999)
#: Country calling codes: of one or two digits; all others have three. Fixed values.
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Cipher:
    """SQL expressions for keyed permutations; F, the round function, is SHA-256 of key, kind, round and the other half."""

    def __init__(self, key: str):
        self.key = _quote(key)

    def number(self, value: str, left: int, right: int, tweak: str) -> str:
        """A permutation of 0 .. left * right - 1: Feistel rounds that shift the two mixed-radix halves in turn, so none falls outside."""
        prf = f"cast(conv(substr(sha2(concat({self.key}, '|{tweak}|', i, '|', if(i % 2 = 1, acc.b, acc.a)), 256), 1, 12), 16, 10) as bigint)"
        return (
            f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {value} div {right}, 'b', {value} % {right}), "
            f"(acc, i) -> if(i % 2 = 1, named_struct('a', (acc.a + {prf}) % {left}, 'b', acc.b), named_struct('a', acc.a, 'b', (acc.b + {prf}) % {right})), acc -> acc.a * {right} + acc.b)"
        )

    def text(self, value: str, tweak: str, hexadecimal: bool = False) -> str:
        """A permutation of the texts with the same kinds of characters (digits, a-z, A-Z; all else stays) in the same places.

        Each round shifts every character of one half, within its kind, by a stream made of the other half.
        """
        k = "cast(conv(substr(h, 1 + (j * 4) % 60, 4), 16, 10) as int)"
        if hexadecimal:
            shifted = f"substr('0123456789abcdef', 1 + (cast(conv(c, 16, 10) as int) + {k}) % 16, 1)"
        else:
            kinds = [("0", "9", 48, 10), ("a", "z", 97, 26), ("A", "Z", 65, 26)]
            shifted = "case " + " ".join(f"when c between '{lo}' and '{hi}' then chr({at} + (ascii(c) - {at} + {k}) % {n})" for lo, hi, at, n in kinds) + " else c end"
        stream = f"sha2(concat({self.key}, '|{tweak}|', i, '|', length(acc.a), '|', acc.b), 256)"
        # the half is split into its characters once, so the work is in proportion to its length
        moved = f"if(acc.a = '', '', array_join(element_at(transform(array({stream}), h -> transform(split(acc.a, ''), (c, j) -> {shifted})), 1), ''))"
        half = f"cast(length({value}) div 2 as int)"
        return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left({value}, {half}), 'b', substr({value}, {half} + 1)), (acc, i) -> named_struct('a', acc.b, 'b', {moved}), acc -> concat(acc.a, acc.b))"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(x: str, new: str, kind: str = "0-9") -> str:
    """x with its characters of the kind replaced by those of new, in order; punctuation stays."""
    n = f"length(regexp_replace(left({x}, p), '[^{kind}]', ''))"
    return f"array_join(transform(sequence(1, length({x})), p -> case when substr({x}, p, 1) rlike '[{kind}]' then substr({new}, {n}, 1) else substr({x}, p, 1) end), '')"


def luhn_sum(digits: str, doubled: int) -> str:
    """The Luhn sum; `doubled` is the parity, counted from the right at 1, of the digits that count twice."""
    d = f"cast(substr({digits}, length({digits}) + 1 - q, 1) as int)"
    twice = f"(2 * {d} - case when {d} > 4 then 9 else 0 end)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, q) -> s + case when q % 2 = {doubled} then {twice} else {d} end)"


def mod97(x: str) -> str:
    """An IBAN's remainder, its first four characters moved to the end, letters as 10 to 35."""
    c = f"substr(concat(substr({x}, 5), left({x}, 4)), q, 1)"
    v = f"case when {c} between '0' and '9' then ascii({c}) - 48 else ascii({c}) - 55 end"
    return f"aggregate(sequence(1, length({x})), 0, (s, q) -> (s * case when {c} between '0' and '9' then 10 else 100 end + {v}) % 97)"


def replacement(key: str) -> str:
    """SQL for what a match m becomes; null where it is not valid for any kind."""
    cipher = Cipher(key)

    def whole(kind: str) -> str:
        return f"m rlike {_quote('^(?:' + PATTERNS[kind] + ')$')}"

    email = _let("regexp_extract(m, '@.*$', 0)", "host", f"concat({_let(f'left(m, cast(length(m) - length(host) as int))', 'v', cipher.text('v', 'email'))}, host)")
    ip = _let("split(m, '[.]')", "o", _let(cipher.number(_let("transform(o, z -> cast(z as bigint))", "y", "((y[0] * 256 + y[1]) * 256 + y[2]) * 256 + y[3]"), 65536, 65536, "ip"), "n", "concat_ws('.', cast(n div 16777216 as string), cast((n div 65536) % 256 as string), cast((n div 256) % 256 as string), cast(n % 256 as string))"))

    def date(form: str) -> str:
        day = f"to_date(try_to_timestamp(m, '{form}'))"
        early = _let(cipher.number(f"cast((year(x) - 1600) * 144 + (month(x) - 1) * 12 + day(x) - 1 as bigint)", *EARLY_DAYS, "day"), "n", "make_date(cast(1600 + n div 144 as int), cast(n div 12 % 12 + 1 as int), cast(n % 12 + 1 as int))")
        # later days are numbered through: those before month k are all days before it less 12 a month
        start = f"add_months(date'{FIRST_DAY}', cast(k as int))"
        month = f"array_max(filter(sequence(greatest(n * {12 * YEARS} div {LATE_DAYS[0] * LATE_DAYS[1]} - 1, 0), n * {12 * YEARS} div {LATE_DAYS[0] * LATE_DAYS[1]} + 1), k -> datediff({start}, date'{FIRST_DAY}') - 12 * k <= n))"
        place = f"cast(datediff(x, date'{FIRST_DAY}') - 12 * ((year(x) - 1600) * 12 + month(x)) as bigint)"
        late = _let(cipher.number(place, *LATE_DAYS, "day"), "n", _let(month, "k", f"date_add(date'{FIRST_DAY}', cast(n + 12 * (k + 1) as int))"))
        return _let(day, "x", f"date_format(if(day(x) <= 12, {early}, {late}), '{form}')")

    valid = lambda form: f"try_to_timestamp(m, '{form}') is not null"
    body = _let(f"left({_digits('m')}, cast(length({_digits('m')}) - 1 as int))", "v", cipher.text("v", "card"))
    card = _let(body, "w", _refill("m", f"concat(w, cast((10 - {luhn_sum('w', 1)} % 10) % 10 as string))"))
    unspaced = "regexp_replace(m, ' ', '')"
    iban = _let(unspaced, "u", _let(_let("substr(u, 5)", "v", cipher.text("v", "iban")), "w", _let(mod97("concat(left(u, 2), '00', w)"), "r", _refill("m", "concat(left(u, 2), lpad(cast(98 - r as string), 2, '0'), w)", "A-Z0-9"))))
    code = f"regexp_extract({_digits('m')}, '^(?:{CALLING}|[0-9]{{3}})', 0)"
    number = _let("substr(d, length(c) + 1)", "v", f"concat(c, {cipher.text('v', 'phone')})")
    phone = _let(_digits("m"), "d", _let(f"if(m like '+%', {code}, '')", "c", _let(number, "w", _refill("m", "w"))))
    secret = _let("case when m rlike '^AKIA' then 'AKIA' else regexp_extract(m, '^(password=|gh[pousr]_|sk-)', 0) end", "c", _let("substr(m, length(c) + 1)", "v", f"concat(c, case when v rlike '^[0-9a-f]+$' then {cipher.text('v', 'secret', True)} else {cipher.text('v', 'secret')} end)"))
    part = lambda at, n: f"cast(substr(m, {at}, {n}) as bigint)"
    place = f"((({part(1, 3)} - 1 - if({part(1, 3)} > 666, 1, 0)) * 99 + {part(5, 2)} - 1) * 9999 + {part(8, 4)} - 1)"  # areas 000, 666 and 900 up, group 00 and serial 0000 have none
    padded = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
    area = _let("n div (99 * 9999)", "z", padded("z + 1 + if(z >= 665, 1, 0)", 3))
    ssn = _let(place, "u", _let(cipher.number("u", *SSNS, "ssn"), "n", f"concat_ws('-', {area}, {padded('(n div 9999) % 99 + 1', 2)}, {padded('n % 9999 + 1', 4)})"))
    return (
        f"case when {whole('email')} then named_struct('kind', 'email', 'to', {email}) "
        f"when {whole('iban')} and {_let(unspaced, 'u', mod97('u'))} = 1 then named_struct('kind', 'iban', 'to', {iban}) "
        f"when {whole('ip')} then named_struct('kind', 'ip', 'to', {ip}) "
        f"when {whole('isodate')} and {valid('yyyy-MM-dd')} then named_struct('kind', 'date', 'to', {date('yyyy-MM-dd')}) "
        f"when {whole('daydate')} and {valid('dd/MM/yyyy')} then named_struct('kind', 'date', 'to', {date('dd/MM/yyyy')}) "
        f"when {whole('daydate')} and {valid('MM/dd/yyyy')} then named_struct('kind', 'date', 'to', {date('MM/dd/yyyy')}) "
        f"when {whole('ssn')} then named_struct('kind', 'ssn', 'to', {ssn}) "
        f"when {whole('card')} and {_let(_digits('m'), 'v', luhn_sum('v', 0))} % 10 = 0 then named_struct('kind', 'card', 'to', {card}) "
        f"when {whole('phone')} then named_struct('kind', 'phone', 'to', {phone}) "
        f"when {whole('secret')} then named_struct('kind', 'secret', 'to', {secret}) end"
    )


def replacements(key: str) -> str:
    """SQL for (kinds, to) of a match m: itself as one value, else with the values between its separators replaced; no kinds where there are none.

    A card's or an IBAN's pattern can take in what stands beside the value (an expiry date, a security code, a
    capital word). From each place after a separator, left to right, the longest part that ends at a separator and
    is valid counts. Kinds without a check digit must stand between spaces. A match has at most 43 characters here.
    """
    one = replacement(key)
    places = lambda at, beside: f"filter(sequence(1, length(m)), z -> substr(m, cast(z as int), 1) not in (' ', '-') and ({at} or substr(m, cast(z as int) {beside}, 1) in (' ', '-')))"
    sure = "(r.kind in ('card', 'iban') or not ((p > 1 and substr(m, p - 1, 1) = '-') or substr(m, e + 1, 1) = '-'))"
    end = f"element_at(transform(array({_let('substr(m, p, e - p + 1)', 'm', one)}), r -> if({sure}, named_struct('kind', r.kind, 'to', r.to, 'next', e + 1), null)), 1)"
    none = "cast(null as struct<kind: string, to: string, next: int>)"
    longest = f"aggregate(reverse(ends), {none}, (f, e) -> if(f.kind is not null or e < p, f, {end}))"
    step = _let(longest, "f", "if(f.kind is null, acc, named_struct('next', f.next, 'kinds', concat(acc.kinds, array(f.kind)), 'to', concat(acc.to, substr(m, acc.next, p - acc.next), f.to)))")
    start = "named_struct('next', 1, 'kinds', cast(array() as array<string>), 'to', '')"
    inner = f"aggregate({places('z = 1', '- 1')}, {start}, (acc, p) -> if(p < acc.next, acc, {step}), acc -> named_struct('kinds', acc.kinds, 'to', concat(acc.to, substr(m, acc.next))))"
    inner = _let(places("z = length(m)", "+ 1"), "ends", inner)
    whole = _let(one, "r", "if(r.kind is null, null, named_struct('kinds', array(r.kind), 'to', r.to))")
    return f"coalesce({whole}, if(length(m) between 14 and 43 and m rlike '[ -]', {inner}, null), named_struct('kinds', cast(array() as array<string>), 'to', m))"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and pii_found (values replaced) and pii_kinds (their kinds in order) added.

    Cards (Luhn), IBANs (modulo 97), calendar dates, IPv4 addresses and US social security numbers are checked
    and permuted within their format: check digits, countries and punctuation stay right, dates stay
    dates that a pattern finds and social security numbers ones that could be issued. Phone numbers are known by
    their shape alone; their calling code stays and their other digits are permuted. An equal value gets
    an equal pseudonym in every document and notation (2001-09-30 and 30/09/2001, +1 555-123-4567 and +15551234567),
    and two values never share one. The local part of e-mail addresses and the body of access keys, tokens and
    passwords are permuted by kind of character. Digits that are not valid for any kind stay. The key alone gives
    the permutations: it must not be empty; keep it secret.

    Null text stays null with nothing found; an empty text stays empty; repeated rows get equal results; an
    empty table stays empty; an input's own pii_found and pii_kinds are replaced; other columns stay. A very long
    text, or a very long match in it, takes work in proportion to its length. All labels after an address's @ are its host and stay.
    The key is a literal of the plan: where plans and event logs are read by others, set spark.sql.redaction.string.regex to match it.
    Narrow: no shuffle, no Python.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    found = "(" + ")|(".join(PATTERNS.values()) + ")"
    text = F.col(text_col)
    may = text.rlike("[0-9@]|AKIA|password=|gh[pousr]_|sk-")  # each kind has a digit, an @ or a secret's mark: most texts are let through by this alone
    own_m, own_to = unused(docs, "m", "to")
    m = docs.withColumn(own_m, F.when(may, F.regexp_extract_all(text, F.lit(found), F.lit(0))))
    m = m.withColumn(own_to, F.when(F.size(own_m) > 0, F.expr(f"transform({own_m}, m -> {replacements(key)})")))
    pieces = F.split(text, found, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(F.zip_with(own_m, own_to, lambda x, t: F.coalesce(t["to"], x)), F.array(F.lit(""))), lambda p, t: F.concat(p, t)), "")
    kinds = F.coalesce(F.flatten(F.transform(own_to, lambda t: t["kinds"])), F.array().cast("array<string>"))
    out = m.withColumn(text_col, F.when(F.col(own_to).isNotNull(), joined).otherwise(text)).withColumn("pii_kinds", kinds)
    return out.withColumn("pii_found", F.size("pii_kinds").cast("long")).drop(own_m, own_to)
