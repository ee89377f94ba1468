"""Z-order keys: bits of several ordinals interleaved, most significant first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Resolution of a column in a key: two columns fill one long.
BITS = 31


def float_ordinal(x: Column) -> Column:
    """An integer that never decreases as the double grows, NaN last.

    Logarithmic, so that all magnitudes keep their order; doubles that differ
    in their last digits may share one, which a layout doesn't mind.
    """
    x = x.cast("double")
    top = F.lit((1 << 62) - 1)
    finite = (F.signum(x) * F.floor(F.log1p(F.abs(F.when(F.abs(x) < float("inf"), x))) * float(1 << 40))).cast("long")
    return F.when(F.isnan(x) | (x == float("inf")), top).when(x == float("-inf"), -top).otherwise(finite)


def ordinal(name: str, kind: T.DataType) -> Column:
    """A 64-bit signed integer in the order of the values."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return float_ordinal(c)
    raise TypeError(f"{name}: no Z-order for {kind.simpleString()}")


def bits(value: Column) -> Column:
    """64 characters that sort as the signed integer does; nulls first."""
    flipped = value.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(value.isNull(), F.lit("0" * 64)).otherwise(F.lpad(F.bin(flipped), 64, "0"))


def scaled(name: str, kind: T.DataType, low: int, high: int) -> Column:
    """The ordinal's place between the column's least and greatest, as a long of ``BITS`` bits; 0 for nulls only."""
    part = (ordinal(name, kind).cast("double") - float(low)) / max(1.0, float(high) - float(low))
    step = (F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * float((1 << BITS) - 2)).cast("long") + 1
    return F.when(F.col(f"`{name}`").isNull(), F.lit(0).cast("long")).otherwise(step)


def spread(x: Column, bits: int, gap: int) -> Column:
    """The low ``bits`` bits of a long, each ``gap`` places from the next."""
    step = 1 << (bits - 1).bit_length() if bits > 1 else 1
    while gap > 1 and step > 1:
        step //= 2
        # Groups of 2 * step bits are parted into groups of step bits, and the gaps are cleared.
        mask = sum(1 << (i // step * step * gap + i % step) for i in range(bits))
        x = x.bitwiseOR(F.shiftleft(x, step * (gap - 1))).bitwiseAND(F.lit(mask))
    return x


def interleaved(parts: list[Column]) -> Column:
    """Longs of ``BITS`` bits as one key, most significant bits first: a long, or a struct of longs where one doesn't hold all bits."""
    a_word = min(BITS, 63 // len(parts))
    words, left = [], BITS
    while left > 0:
        take = min(a_word, left)
        left -= take
        word = None
        for k, p in enumerate(parts):
            bits_of = F.shiftright(p, left).bitwiseAND(F.lit((1 << take) - 1))
            one = F.shiftleft(spread(bits_of, take, len(parts)), len(parts) - 1 - k)
            word = one if word is None else word.bitwiseOR(one)
        words.append(word)
    return words[0] if len(words) == 1 else F.struct(*[w.alias(f"w{k}") for k, w in enumerate(words)])


def zorder_key(rows: DataFrame, columns, ends=None) -> Column:
    """Interleaved bits of the columns, each scaled to its own range so that none outweighs the others.

    ``ends`` has the least and greatest ordinal of each column in turn; without it the rows are read for them.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    if ends is None:
        ends = rows.agg(*[f(ordinal(c, kinds[c])) for c in columns for f in (F.min, F.max)]).first()
    return interleaved([scaled(c, kinds[c], ends[2 * k] or 0, ends[2 * k + 1] or 0) for k, c in enumerate(columns)])
