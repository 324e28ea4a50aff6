"""Generated logs for tests and benchmarks: each line depends on its number and the seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: shares, in thousandths, of methods and statuses, and of odd lines
METHODS = (("GET", 800), ("POST", 140), ("HEAD", 30), ("PUT", 20), ("DELETE", 10))
STATUSES = ((200, 820), (304, 60), (301, 40), (404, 50), (500, 20), (403, 10))
ERRORS, BLANKS, LATE, IPV6 = 5, 1, 50, 50
START = 1_704_067_200
#: the lines at the top of a W3C file, and the columns from its middle on
W3C_HEAD = ("#Software: tallylog", "#Version: 1.0", "#Date: 2024-01-01 00:00:00", "#Fields: date time c-ip cs-method cs-uri-stem sc-status sc-bytes")
W3C_SECOND = "#Fields: date time sc-status s-port cs-method cs-uri-stem c-ip"
FORMATS = ("combined", "common", "w3c", "pipe")


def _draw(name: str, seed: int, below: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(below))


def _weighted(draw: Column, shares: tuple) -> Column:
    out, upto = F.lit(shares[-1][0]), 1000
    for value, share in reversed(shares):
        upto -= share
        out = F.when(draw < upto + share, F.lit(value)).otherwise(out)
    return out


def generate(spark: SparkSession, lines: int, form: str = "combined", seed: int = 1, ips: int = 200_000, paths: int = 50_000, errors: int = ERRORS, blanks: int = BLANKS) -> DataFrame:
    """(line_number, value) of ``lines`` lines; some are broken, blank, or up to a minute late."""
    if form not in FORMATS:
        raise ValueError("an unknown format")
    late = F.when(_draw("late", seed, 1000) < LATE, _draw("by", seed, 61)).otherwise(0)
    time = F.timestamp_seconds(F.lit(START) + F.col("id") - late)
    who = _draw("ip", seed, ips)
    ip4 = F.concat_ws(".", F.lit("10"), *[F.pmod(F.shiftright(who, k), F.lit(256)).cast("string") for k in (16, 8, 0)])
    ip = F.when(F.pmod(who, F.lit(1000)) < IPV6, F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.pmod(who, F.lit(65536)))))).otherwise(ip4)
    method, status = _weighted(_draw("method", seed, 1000), METHODS), _weighted(_draw("status", seed, 1000), STATUSES).cast("string")
    target = F.concat(F.lit("/page/"), _draw("path", seed, paths).cast("string"))
    size = _draw("size", seed, 20_000).cast("string")
    clf = F.concat(ip, F.lit(" - - ["), F.date_format(time, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), method, F.lit(" "), target, F.lit(' HTTP/1.1" '), status, F.lit(" "), size)
    line = {
        "common": clf,
        "combined": F.concat(clf, F.lit(' "-" "Mozilla/5.0 (X11; Linux x86_64)"')),
        "w3c": F.when(F.col("id") < lines // 2, F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd HH:mm:ss"), ip, method, target, status, size)).otherwise(F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd HH:mm:ss"), status, F.lit("443"), method, target, ip)),
        "pipe": F.concat_ws("|", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), ip, method, target, status, size, F.lit("ua")),
    }[form]
    draw = _draw("odd", seed, 1000)
    value = F.when(draw < errors, F.concat(F.lit("broken line "), F.col("id").cast("string"))).when(draw < errors + blanks, "").otherwise(line)
    if form != "w3c":
        return spark.range(lines).select((F.col("id") + 1).alias("line_number"), value.alias("value"))
    # other columns from the middle on, which a reader has to notice
    half = lines // 2
    heads = [(k + 1, x) for k, x in enumerate(W3C_HEAD)] + [(half + len(W3C_HEAD) + 1, W3C_SECOND)]
    number = F.col("id") + 1 + len(W3C_HEAD) + F.when(F.col("id") >= half, 1).otherwise(0)
    return spark.createDataFrame(heads, "line_number long, value string").union(spark.range(lines).select(number, value))
