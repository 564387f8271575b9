"""Format-preserving Feistel pseudonyms for numbers and dates, in DataFrame functions only.

Found and validated: payment cards (13 to 19 digits, Luhn), IBANs with digits only (mod 97), US social security
numbers (assigned ranges), North American phone numbers (area and exchange from 200), IPv4 addresses (octets to 255)
and calendar dates from 1900 to 2099 (year-month-day, day.month.year or day-month-year, month/day/year).

A valid value becomes two numbers (l, r) below (a, b) with a * b the size of its format, and a keyed Feistel network
with modular addition (l += F(r) mod a, then r += F(l) mod b, eight rounds, F from SHA-256 of key, kind, round and
half) permutes the pairs, so every value of the format has one pseudonym in the format and the reverse. A card keeps
its first digit and an IBAN its country; check digits are computed anew. Separators stay where they were, and the
value is its digits alone, so equal values get equal pseudonyms in any document and any writing.

All of it is a narrow projection of each row: no shuffle, no broadcast.

Cases: null text stays null with no values; invalid look-alikes stay as they are; a null or empty key is refused;
repeated rows are rows; an empty table gives an empty result; extra columns pass through unless an output column has
their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import replace_columns

KEY = "pseudonyms-1"
ROUNDS = 8
KINDS = ("iban", "date", "ssn", "phone", "ip", "card")
_L, _R = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
# In order of preference at the same place.
FORMS = {
    "iban": _L + "[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,6}(?: ?[0-9]{1,3})?" + _R,
    "date": _L + "(?<![0-9][-/.])(?:(?:19|20)[0-9]{2}(?:-[01][0-9]-|/[01][0-9]/|\\.[01][0-9]\\.)[0-3][0-9]"
            "|[0-3][0-9](?:-[01][0-9]-|\\.[01][0-9]\\.)(?:19|20)[0-9]{2}|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})"
            + _R + "(?![-/.][0-9])",
    "ssn": _L + "(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R + "(?!-[0-9])",
    "phone": "(?:(?<![0-9A-Za-z])\\([0-9]{3}\\) ?|" + _L + "(?<![0-9][-. ])[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}" + _R
             + "(?![-.][0-9])",
    "ip": _L + "(?<![0-9]\\.)(?:[0-9]{1,3}\\.){3}[0-9]{1,3}" + _R + "(?!\\.[0-9])",
    "card": _L + "[2-6][0-9]{3}(?:[0-9]{9,15}|(?: [0-9]{2,7}){2,4}|(?:-[0-9]{2,7}){2,4})" + _R,
}
PATTERN = "|".join(f"(?:{p})" for p in FORMS.values())
DAYS = 73049  # 1900-01-01 to 2099-12-31: 17 * 4297


def _long(c: Column) -> Column:
    return c.cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string; valid if divisible by 10."""
    n = F.length(d)

    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(bban: Column, country: Column, check: Column) -> Column:
    """The IBAN remainder of digits, country letters and check digits, in two steps of at most 19 digits."""
    head = F.substring(bban, F.lit(1), F.lit(9)).cast("long") % 97
    letters = F.concat(*[(F.ascii(F.substring(country, k, 1)) - 55).cast("string") for k in (1, 2)])
    rest = F.concat(F.substring(bban, F.lit(10), F.lit(40)), letters, check)
    one = F.concat(F.lpad(head.cast("string"), 2, "0"), F.substring(rest, F.lit(1), F.lit(12))).cast("long") % 97
    return F.concat(F.lpad(one.cast("string"), 2, "0"), F.substring(rest, F.lit(13), F.lit(16))).cast("long") % 97


def _date(m: Column) -> Column:
    """The day a date text names, null if there is none."""
    sep = F.regexp_extract(m, "[-/.]", 0)
    part = F.split(m, "[-/.]")
    iso = F.length(part[0]) == 4
    us = ~iso & (sep == "/")
    year = F.when(iso, part[0]).otherwise(part[2])
    month = F.when(iso, part[1]).when(us, part[0]).otherwise(part[1])
    day = F.when(iso, part[2]).when(us, part[1]).otherwise(part[0])
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def _domain(m: Column) -> Column:
    """struct(kind, l, r, a, b) of a match; kind is null if it is not valid."""
    d = _digits(m)
    n = F.length(d)

    def cut(at, size):
        return F.substring(d, F.lit(at) if isinstance(at, int) else at, F.lit(size) if isinstance(size, int) else size)

    def whole(kind, ok, left, right, a, b):
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), _long(left).alias("l"), _long(right).alias("r"),
                                   _long(a).alias("a"), _long(b).alias("b")))

    is_iban = m.rlike("^[A-Z]{2}")
    bban = F.substring(d, F.lit(3), F.lit(40))
    country = F.substring(m, 1, 2)
    half = F.floor((n - 2) / 2).cast("int")
    octets = F.split(m, "\\.")
    octet = [_long(octets[k]) for k in range(4)]
    is_ip = m.rlike("^(?:[0-9]{1,3}\\.){3}[0-9]{1,3}$")
    # A card's permuted digits: all but the first and the check digit.
    mid = n - 2
    mid_left = F.floor(mid / 2).cast("int")
    day = _date(m)
    is_date = m.rlike("^(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$")
    days = F.datediff(day, F.lit("1900-01-01").cast("date"))
    is_ssn = m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    area, group, serial = _long(cut(1, 3)), _long(cut(4, 2)), _long(cut(6, 4))
    is_phone = m.rlike("^\\(?[0-9]{3}\\)?[-. ]?[0-9]{3}[-. ][0-9]{4}$")
    nxx = _long(cut(4, 3))
    ten = lambda k: F.pow(F.lit(10.0), k)
    cases = [
        (is_iban, whole("iban", (_mod97(bban, country, F.substring(d, 1, 2)) == 1) & (n <= 28),
                        F.substring(bban, F.lit(1), half), F.substring(bban, half + 1, n - 2 - half),
                        ten(half), ten(n - 2 - half))),
        (is_date, whole("date", day.isNotNull() & (days >= 0) & (days < DAYS), F.floor(days / 4297), days % 4297,
                        F.lit(17), F.lit(4297))),
        (is_ssn, whole("ssn", (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0),
                       area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
                       F.lit(898), F.lit(99 * 9999))),
        (is_phone & (n == 10), whole("phone", (area >= 200) & (nxx >= 200),
                                     (area - 200) * 100 + F.floor((nxx - 200) / 8),
                                     ((nxx - 200) % 8) * 10000 + _long(cut(7, 4)), F.lit(80000), F.lit(80000))),
        (is_ip, whole("ip", (octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256),
                      octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536))),
    ]
    card = whole("card", (n >= 13) & (n <= 19) & (_luhn(d) % 10 == 0), F.substring(d, F.lit(2), mid_left),
                 F.substring(d, mid_left + 2, mid - mid_left), ten(mid_left), ten(mid - mid_left))
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(card)


def _round(key: str, kind: Column, step: Column, x: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), kind, step.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _permuted(s: Column, key: str, rounds: int) -> Column:
    """struct(l, r) after the Feistel rounds over the pair of ``s``."""
    steps = F.sequence(F.lit(0), F.lit(rounds - 1))
    start = F.struct(s["l"].alias("l"), s["r"].alias("r"))

    def turn(p, i):
        left = F.when(i % 2 == 0, (p["l"] + _round(key, s["kind"], i, p["r"])) % s["a"]).otherwise(p["l"])
        right = F.when(i % 2 == 1, (p["r"] + _round(key, s["kind"], i, p["l"])) % s["b"]).otherwise(p["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(steps, start, turn)


def _pad(x: Column, width) -> Column:
    return F.lpad(x.cast("string"), width, F.lit("0") if isinstance(width, Column) else "0")


def _in_format(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one by one."""
    gaps = F.split(m, "[0-9]", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")


def _written(m: Column, s: Column, p: Column) -> Column:
    """The pseudonym in the writing of the match."""
    left, right, kind = p["l"], p["r"], s["kind"]
    d = _digits(m)
    n = F.length(d)
    # Digits of a and b: one less than the length of a power of ten.
    wide = F.concat(F.lpad(left.cast("string"), F.length(s["a"].cast("string")) - 1, F.lit("0")),
                    F.lpad(right.cast("string"), F.length(s["b"].cast("string")) - 1, F.lit("0")))
    country = F.substring(m, 1, 2)
    check = 98 - _mod97(wide, country, F.lit("00"))
    body = F.concat(F.substring(d, 1, 1), wide)
    luhn = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    day = F.date_add(F.lit("1900-01-01").cast("date"), (left * 4297 + right).cast("int"))
    order = F.when(m.rlike("^[0-9]{4}"), F.date_format(day, "yyyyMMdd")) \
        .when(m.contains("/"), F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy"))
    area = left + 1 + F.when(left >= 665, 1).otherwise(0)
    ssn = F.concat(_pad(area, 3), _pad(F.floor(right / 9999) + 1, 2), _pad(right % 9999 + 1, 4))
    phone = F.concat(_pad(F.floor(left / 100) + 200, 3),
                     _pad((left % 100) * 8 + F.floor(right / 10000) + 200, 3), _pad(right % 10000, 4))
    ip = F.concat_ws(".", F.floor(left / 256).cast("string"), (left % 256).cast("string"),
                     F.floor(right / 256).cast("string"), (right % 256).cast("string"))
    return (F.when(kind == "ip", ip)
            .when(kind == "iban", _in_format(m, F.concat(_pad(check, 2), wide)))
            .when(kind == "card", _in_format(m, F.concat(body, luhn.cast("string"))))
            .when(kind == "date", _in_format(m, order)).when(kind == "ssn", _in_format(m, ssn))
            .when(kind == "phone", _in_format(m, phone)).otherwise(m))


def pseudonymise(documents: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with text pseudonymised, plus values: array of (kind, pseudonym) in text order."""
    if not key:
        raise ValueError("a key is needed")
    base = replace_columns(documents, ["values", "__m", "__p"])
    cols = base.columns
    found = F.when(F.col("text").rlike("[0-9]{2}|[0-9]\\."), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))
    staged = base.withColumn("__m", F.transform(F.coalesce(found, F.array().cast("array<string>")),
                                                lambda m: F.struct(m.alias("m"), _domain(m).alias("s"))))
    staged = staged.withColumn("__m", F.transform("__m", lambda x: F.struct(
        x["m"].alias("m"), x["s"].alias("s"), F.when(x["s"].isNotNull(), _permuted(x["s"], key, rounds)).alias("p"))))
    staged = staged.withColumn("__p", F.transform("__m", lambda x: F.struct(
        x["s"]["kind"].alias("kind"),
        F.when(x["s"].isNull(), x["m"]).otherwise(_written(x["m"], x["s"], x["p"])).alias("text"))))
    pieces = F.split(F.col("text"), PATTERN, -1)
    woven = F.array_join(F.transform(pieces, lambda t, i: F.concat(t, F.coalesce(F.get(F.col("__p"), i)["text"],
                                                                                F.lit("")))), "")
    text = F.when(F.size(F.filter("__p", lambda x: x["kind"].isNotNull())) > 0, woven).otherwise(F.col("text"))
    values = F.transform(F.filter("__p", lambda x: x["kind"].isNotNull()),
                         lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("pseudonym")))
    return staged.select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in cols], values.alias("values"))
