"""Expressions of one row: trade features, token transforms, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: Fixed values of the token transforms.
DP_CLIP, PNL_SCALE, USER_BUCKETS = 0.2, 50.0, 2_000_000


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where whole is not over 0."""
    return F.when(column(whole) > 0, column(part) / column(whole)).otherwise(F.lit(0.0))


def edge(pnl: Column | str, size: Column | str) -> Column:
    return F.when(column(pnl).isNotNull(), column(pnl) / column(size)).otherwise(F.lit(0.0))


def log_usdc(usdc: Column | str) -> Column:
    return F.log1p(F.coalesce(F.abs(column(usdc)), F.lit(0.0)))


def since_open(ts: Column | str, start: Column | str) -> Column:
    return F.coalesce(F.greatest(F.lit(0), column(ts) - column(start)), F.lit(0)) * F.when(column(start).isNull(), 0).otherwise(1)


def time_of_day(ts: Column | str) -> Column:
    return 2 * F.pi() * F.pmod(column(ts), F.lit(DAY)) / DAY


def p_yes(price: Column | str, outcome: Column | str) -> Column:
    return F.when(column(outcome) == 1, column(price)).otherwise(1 - column(price))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(column(x), F.lit(high)), F.lit(low))


def log_above(x: Column | str) -> Column:
    """ln(1 + max(x, 0))"""
    return F.log1p(F.greatest(column(x), F.lit(0)).cast("double"))


def asinh_pnl(x: Column | str) -> Column:
    return F.asinh(column(x) / PNL_SCALE)


def bucket(key: Column | str, n: int | Column) -> Column:
    """A bucket that any engine can compute: the first 32 bits of the md5, modulo n."""
    return (F.conv(F.substring(F.md5(column(key)), 1, 8), 16, 10).cast("long") % n).cast("long")


def project_path(path: Column | str, marker: str) -> Column:
    """Slashes one way, and all up to the first "marker/" (in any case, also as the
    end of a longer name) cut off; paths without it keep all but their slashes."""
    slashes = F.regexp_replace(column(path), r"\\", "/")
    return F.regexp_replace(slashes, rf"(?is)^.*?\Q{marker}\E/", "")


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-column(x)))


def log_loss(logit: Column | str, y: Column | str) -> Column:
    """Binary cross entropy of one row from its logit, without overflow."""
    z = column(logit)
    return F.greatest(z, F.lit(0.0)) - z * column(y) + F.log1p(F.exp(-F.abs(z)))


def won(y: Column | str, outcome: Column | str) -> Column:
    return column(y) * column(outcome) + (1 - column(y)) * (1 - column(outcome))


def true_edge(edge: Column | str, y: Column | str, price: Column | str, outcome: Column | str | None = None) -> Column:
    """The edge if given, else what the trade won above its price."""
    gain = won(y, outcome) if outcome is not None else column(y)
    return F.coalesce(column(edge), gain - column(price))


def usdc_from_log(x: Column | str) -> Column:
    return F.greatest(F.expm1(column(x)), F.lit(0.0))


def binary_label(y: Column | str) -> Column:
    """1 over one half, else 0; null and NaN give 0."""
    return F.coalesce((F.nanvl(column(y).cast("double"), F.lit(0.0)) > 0.5).cast("int"), F.lit(0))


def signal(p: Column | str, tau: float) -> Column:
    """YES, NO or NONE by the distance of p from one half."""
    return F.when(column(p) > 0.5 + tau, "YES").when(column(p) < 0.5 - tau, "NO").otherwise("NONE")
