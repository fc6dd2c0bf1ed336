"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(predicates) -> Column:
    """Conjunction of a list of predicates; true for an empty list."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def epoch_seconds(ts) -> Column:
    """Wall-clock seconds since 1970, independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(F.to_date(c)).cast("long") * 86400
        + F.hour(c) * 3600
        + F.minute(c) * 60
        + F.second(c)
    )


def count_if(pred: Column) -> Column:
    return F.count(F.when(pred, 1))


def share(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def prior(distances) -> Column:
    """Distances to earlier submissions: the array without its trailing entry
    for the attempt itself."""
    a = F.col(distances) if isinstance(distances, str) else distances
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def repeats_earlier(distances) -> Column:
    """True when some earlier submission had distance 0."""
    return F.coalesce(F.array_contains(prior(distances), 0), F.lit(False))


def is_new_password(distances) -> Column:
    """1 for the first submission of a password within the day, else 0."""
    return F.when(repeats_earlier(distances), 0).otherwise(1)


_OCTET = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IPV4 = rf"^({_OCTET}\.){{3}}{_OCTET}$"


def ipv4_number(ip) -> Column:
    """IPv4 text as a long, NULL when it is not dotted-quad text."""
    c = F.col(ip) if isinstance(ip, str) else ip
    octets = F.split(c, r"\.")
    value = F.aggregate(
        octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.try_cast("long")
    )
    return F.when(c.rlike(_IPV4), value)


_GROUP = "^[0-9a-f]{1,4}$"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value written once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ipv6_groups(ip: Column) -> Column:
    """The eight groups of an IPv6 address as text, NULL when it is none."""

    def spelled(last):
        # an IPv4 address may stand for the last two groups
        front = F.substring(ip, F.lit(1), F.length(ip) - F.length(last))
        two = _let(
            ipv4_number(last),
            lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n % 65536)),
        )
        return F.lower(F.when(F.instr(last, ".") > 0, F.concat(front, two)).otherwise(ip))

    def groups(half):
        return F.when(F.length(half) > 0, F.split(half, ":")).otherwise(F.array().cast("array<string>"))

    def filled(sides, halves):
        zeros = 8 - F.size(sides["l"]) - F.size(sides["r"])
        whole = F.concat(sides["l"], F.array_repeat(F.lit("0"), zeros), sides["r"])
        return F.when(F.size(halves) == 1, sides["l"]).when((F.size(halves) == 2) & (zeros > 0), whole)

    def joined(halves):
        sides = F.struct(
            groups(F.get(halves, F.lit(0))).alias("l"), groups(F.get(halves, F.lit(1))).alias("r")
        )
        return _let(sides, lambda s: filled(s, halves))

    out = _let(F.split(_let(F.substring_index(ip, ":", -1), spelled), "::"), joined)
    valid = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(_GROUP))
    return F.when(F.instr(ip, ":") > 0, _let(out, lambda g: F.when(valid(g), g)))


def address(ip) -> Column:
    """An IPv4 or IPv6 address as ⟨family, hi, lo⟩: its bits from the left in two longs, so a
    prefix length means the same for both. NULL when the text is no address."""
    c = F.col(ip) if isinstance(ip, str) else ip

    def fields(family, hi, lo):
        return F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))

    def four(number):
        return F.when(number.isNotNull(), fields(4, F.shiftleft(number, 32), F.lit(0).cast("long")))

    def six(digits):
        half = lambda start: F.conv(F.substring(digits, start, 16), 16, -10).cast("long")
        return F.when(digits.isNotNull(), fields(6, half(1), half(17)))

    def either(text):
        digits = F.array_join(F.transform(_ipv6_groups(text), lambda g: F.lpad(g, 4, "0")), "")
        return F.coalesce(_let(ipv4_number(text), four), _let(digits, six))

    return _let(c, either)


def network_of(bits: Column, length) -> Column:
    """An address with only the bits of a prefix of the given length."""
    n = F.lit(length) if isinstance(length, int) else length
    hi = F.when(n >= 64, bits["hi"]).when(n <= 0, F.lit(0)).otherwise(_top_bits(bits["hi"], n))
    lo = F.when(n >= 128, bits["lo"]).when(n <= 64, F.lit(0)).otherwise(_top_bits(bits["lo"], n - 64))
    return F.struct(bits["family"].alias("family"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def _top_bits(value: Column, n: Column) -> Column:
    drop = (F.lit(64) - n).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)
