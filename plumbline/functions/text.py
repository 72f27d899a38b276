"""What a text value is: a placeholder, a number, a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

#: The type of ``reading``.
READING = "struct<placeholder: boolean, blank: boolean, raw: boolean, clean: boolean, at: timestamp>"

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
#: No date is written with more characters.
LONGEST_DATE = 64
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
#: What may follow a date: a time of day, before noon or after, and its distance from UTC.
_TIME = r"[t\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})([.,]\d{1,9})?)?\s*([ap]m)?\s*(z|utc|gmt|[+-]\d{2}(?::?\d{2})?)?$"
#: Shapes of dates and where they hold year, month and day; in "any" a month of over 12 is the day.
_DATES = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1 $3 $4 -"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1 $2 $3 -"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1 $2 1 -"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$", "$4 $1 $3 any"),
    (rf"^{_DAY}(?: of)?[-\s]+{_MONTH},?[-\s]+(\d{{4}}|\d{{2}})$", "$3 $2 $1 -"),
    (rf"^{_MONTH}[-\s]+{_DAY},?[-\s]+(\d{{4}})$", "$3 $1 $2 -"),
    (rf"^{_MONTH},?[-\s]+(\d{{4}})$", "$2 $1 1 -"),
    (rf"^(\d{{4}})[-\s]+{_MONTH}[-\s]+{_DAY}$", "$1 $2 $3 -"),
)


def stripped(v: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def is_placeholder(v: Column) -> Column:
    return F.lower(stripped(v)).isin(*fixed.PLACEHOLDERS)


def to_number(v: Column) -> Column:
    """The number a text spells, else null; d, f and overflow aren't numbers."""
    def parsed(t):
        number = let(F.when(t.rlike(f"^(?:{fixed.NUMBER})$"), t.try_cast("double")), lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))
        endless = F.when(F.lower(t).rlike(r"^[+-]?inf(inity)?$"), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        return F.coalesce(number, endless)

    return let(stripped(v), parsed)


def undecorated(v: Column) -> Column:
    """Accounting negatives, thousands separators, currency and percent signs and decimal commas resolved."""
    t = F.regexp_replace(stripped(v), r"^\((.+)\)$", "-$1")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, "(?U)" + fixed.DECORATION, "")
    return let(t, lambda x: F.when(x.rlike(f"^(?:{fixed.DECIMAL_COMMA})$"), F.regexp_replace(F.replace(x, F.lit("."), F.lit("")), ",", ".")).otherwise(x))


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it; else expressions would double with every step."""
    return F.transform(F.array(x), f)[0]


def to_timestamp(v: Column) -> Column:
    """The time a text names, else null: it needs a four-digit year or the shape of a date, and to be a date.

    Year, month and day are put in order by the shape of the text, the month first
    where both could be it; two-digit years are 1969 to 2068. A time of day and a
    distance from UTC may follow. Nothing is parsed by trial, so nothing is thrown.
    """
    plain = F.regexp_replace(F.lower(stripped(v)), _WEEKDAY, "")
    return let(plain, lambda t: F.when((F.length(t) <= LONGEST_DATE) & t.rlike(fixed.DATE_SHAPE), _parts(t)))


def _parts(t: Column) -> Column:
    date = lambda timed: F.when(timed, stripped(F.regexp_replace(t, ",?" + _TIME, ""))).otherwise(t)
    ordered = lambda d: F.split(F.coalesce(*[F.when(d.rlike(shape), F.regexp_replace(d, shape, order)) for shape, order in _DATES]), " ")
    return let(t.rlike(_TIME), lambda timed: let(date(timed), lambda d: let(ordered(d), lambda o: let(_numbers(t, timed, o), _instant))))


def _numbers(t: Column, timed: Column, o: Column) -> Column:
    """Year, month or day, day or month, whether these may be turned; hour, half of the day, minute, second, and minutes from UTC."""
    part = lambda i: F.when(timed, F.regexp_extract(t, _TIME, i))
    word = F.substring(F.get(o, F.lit(1)), 1, 3)
    named = F.when(word.rlike("^[a-z]"), ((F.position(word, F.lit(_MONTHS)) + 3) / 4).cast("int"))
    year = F.get(o, F.lit(0))
    full = let(year.cast("int"), lambda y: F.when(F.length(year) > 2, y).when(y < 69, y + 2000).otherwise(y + 1900))
    second = F.concat(F.when(part(3) == "", "0").otherwise(part(3)), F.replace(part(4), F.lit(","), F.lit("."))).try_cast("decimal(16,6)")
    away = F.regexp_replace(part(6), "[^0-9+-]", "")
    minutes = let(away, lambda a: F.when(a.rlike(r"^[+-]\d"), F.when(a.startswith("-"), -1).otherwise(1) * (F.substring(a, 2, 2).cast("int") * 60 + F.coalesce(F.substring(a, 4, 2).try_cast("int"), F.lit(0)))))
    zero = F.lit(0)
    return F.struct(
        full.alias("year"), F.coalesce(named, F.get(o, F.lit(1)).try_cast("int")).alias("a"), F.get(o, F.lit(2)).try_cast("int").alias("b"), (F.get(o, F.lit(3)) == "any").alias("loose"),
        F.coalesce(part(1).try_cast("int"), zero).alias("hour"), F.coalesce(part(5), F.lit("")).alias("half"), F.coalesce(part(2).try_cast("int"), zero).alias("minute"), F.coalesce(second, zero.cast("decimal(16,6)")).alias("second"), F.coalesce(minutes, zero).alias("away"),
    )


def _instant(n: Column) -> Column:
    turned = n["loose"] & (n["a"] > 12)
    hour = F.when(n["half"] == "", n["hour"]).when((n["hour"] >= 1) & (n["hour"] <= 12), n["hour"] % 12 + F.when(n["half"] == "pm", 12).otherwise(0))
    at = F.try_make_timestamp(n["year"], F.when(turned, n["b"]).otherwise(n["a"]), F.when(turned, n["a"]).otherwise(n["b"]), hour, n["minute"], n["second"])
    good = (n["second"] < 60) & (n["minute"] < 60) & (n["year"] >= 1)
    return F.when(good, F.timestamp_micros(F.unix_micros(at) - n["away"].cast("long") * F.lit(60_000_000)))


def reading(v: Column) -> Column:
    """READING of a text."""
    return let(
        stripped(v),
        lambda t: F.struct(is_placeholder(t).alias("placeholder"), (t == "").alias("blank"), to_number(t).isNotNull().alias("raw"), let(undecorated(t), lambda u: to_number(u).isNotNull()).alias("clean"), to_timestamp(t).alias("at")),
    )
