"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framequarry.functions.bound import bound


def general(value: Column) -> Column:
    """Six significant digits in the plain or the exponent form, without trailing zeros, as C's ``%g`` has them."""
    v = value.cast("double")
    size = F.abs(v)
    power = F.regexp_extract(F.format_string("%.15e", size), r"e([+-]\d+)$", 1).try_cast("int")

    def rounded(power: Column) -> Column:
        scaled = F.when(power <= 5, size * F.pow(F.lit(10.0), 5 - power)).otherwise(size / F.pow(F.lit(10.0), power - 5))
        return bound(F.rint(scaled).cast("long"), lambda near: shaped(near, power))  # halves go to the even digit

    def shaped(near: Column, power: Column) -> Column:
        over = near >= 1_000_000
        number = F.struct(F.format_string("%06d", F.when(over, F.lit(100_000).cast("long")).otherwise(near)).alias("digits"), (power + over.cast("int")).alias("exponent"))
        return bound(number, lambda x: written(x["digits"], x["exponent"]))

    def written(digits: Column, exponent: Column) -> Column:
        bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        whole = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(6)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        mantissa = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))
        large = F.concat(bare(mantissa), F.lit("e"), F.format_string("%+03d", exponent))
        return F.when((exponent < -4) | (exponent >= 6), large).when(exponent < 0, bare(small)).otherwise(bare(whole))

    plain = F.concat(F.when(v < 0, "-").otherwise(""), bound(power, rounded))
    return F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(plain)
