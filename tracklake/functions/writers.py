"""Binary writers, numeric guards and identities as native column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesql as B


def be(value: Column | int, size: int) -> Column:
    """An integer as ``size`` big-endian bytes, modulo 256**size; negative values as their complement."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def joined(parts: Column) -> Column:
    """The binaries of an array side by side, in time linear in their bytes; nulls are empty."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def joined_in_order(data: str, *order: str) -> Column:
    """Aggregate: the binaries of a group side by side, in order."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(data).alias("_data"))))
    return joined(F.transform(parts, lambda p: p["_data"]))


def _packed(texts: pa.Array) -> pa.Array:
    """Texts of 0 and 1 as bytes, all of a batch at once."""
    texts = texts.cast(pa.large_string())
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    bits = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start[0] : start[-1]] == 49
    sizes = np.diff(start)
    room = -(-sizes // 8)
    ends = np.cumsum(room)
    wide = np.zeros(8 * int(room.sum()), bool)
    wide[np.arange(len(bits)) + np.repeat(8 * (ends - room) - (start[:-1] - start[0]), sizes)] = bits
    data = np.packbits(wide)
    out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.binary()), out) if texts.null_count else out


def bits_to_bytes(bits: Column) -> Column:
    """A text of 0 and 1 as bytes, filled up with 0."""
    return F.arrow_udf(_packed, "binary", F.ArrowUDFType.SCALAR)(bits)


def ue_bits(value: Column) -> Column:
    """The unsigned Exp-Golomb code of a number, as a text of 0 and 1."""
    code = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def se_bits(value: Column) -> Column:
    """The signed Exp-Golomb code: 1, -1, 2, -2 have the numbers 1, 2, 3, 4."""
    return ue_bits(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def double_be(x: Column) -> Column:
    """The 8 bytes of a finite number, big end first, by its hexadecimal form, as 0x1.8p3; null for others."""
    form = F.format_string("%a", F.abs(x.cast("double")))
    starts = lambda text: F.startswith(form, F.lit(text))
    exponent = F.when(starts("0x1"), F.substring_index(form, "p", -1).try_cast("int") + 1023).when(starts("0x0"), 0)  # 0 and numbers below 2**-1022
    digits = F.rpad(F.substring_index(F.substring(form, 5, 13), "p", 1), 13, "0")
    return F.unhex(F.concat(F.lpad(F.hex((exponent + F.when(x < 0, 2048).otherwise(0)).cast("long")), 3, "0"), digits))


def stamp33(ticks: Column, mark: int = 2) -> Column:
    """A time stamp of 33 bits in the five bytes that packet headers have for it."""
    high = F.lit(mark * 16 + 1) + F.shiftleft(F.shiftright(ticks, 30).bitwiseAND(7), 1)
    return F.concat(be(high, 1), be(F.shiftleft(F.shiftright(ticks, 15).bitwiseAND(32767), 1) + 1, 2), be(F.shiftleft(ticks.bitwiseAND(32767), 1) + 1, 2))


def float_be(data: Column, at: int | Column, size: int) -> Column:
    """An IEEE number of 4 or 8 big-endian bytes; null past the end."""
    wide, fraction = (11, 52) if size == 8 else (8, 23)
    x = B.part(data, at, size)
    high = F.conv(F.hex(F.substring(x, 1, 2)), 16, 10).cast("long")
    exponent = F.shiftright(high, 15 - wide).bitwiseAND((1 << wide) - 1)
    low = F.conv(F.hex(F.substring(x, 2, size - 1)), 16, 10).cast("long").bitwiseAND((1 << fraction) - 1)
    sign = F.when(high >= 32768, -1.0).otherwise(1.0)
    bias = (1 << (wide - 1)) - 1
    normal = (1 + low / F.lit(float(1 << fraction))) * F.pow(F.lit(2.0), exponent - bias)
    tiny = low / F.lit(float(1 << fraction)) * F.lit(2.0 ** (1 - bias))
    special = F.when(low == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(F.length(x) == size, sign * F.when(exponent == (1 << wide) - 1, special).when(exponent == 0, tiny).otherwise(normal))


def text_at(data: Column, at: int | Column, size: int | Column) -> Column:
    return F.decode(B.part(data, at, size), "ISO-8859-1")


def cstring(data: Column, at: int | Column = 0) -> Column:
    """The characters from a place up to the first zero byte, or the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.get(F.split(F.decode(F.substring(data, at.cast("int") + 1, F.length(data)), "ISO-8859-1"), "\\x00", 2), F.lit(0))


# --- guards

def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False))


def finite(x: Column) -> Column:
    """The number, or 0 for what is none."""
    return F.when(is_finite(x), x).otherwise(0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def positive_int(x: Column) -> Column:
    """Rounded half up, or 1 for what is no number above 0."""
    return F.when(is_finite(x) & (x > 0), F.floor(x + 0.5)).otherwise(1).cast("long")


def non_negative(x: Column) -> Column:
    return F.when(is_finite(x), F.greatest(F.lit(0), F.floor(x + 0.5))).otherwise(0).cast("long")


def positive(x: Column) -> Column:
    return F.when(is_finite(x) & (x > 0), x)


def micros(milliseconds: Column) -> Column:
    return non_negative(milliseconds * 1000)


def ticks(microseconds: Column, scale: Column | int) -> Column:
    return microseconds * (F.lit(scale) if isinstance(scale, int) else scale) / 1_000_000


# --- identities

def base36(x: Column) -> Column:
    """A whole number of any sign in base 36, lower case."""
    x = x.cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, 36)))


def bytes_hash(data: Column) -> Column:
    """32-bit FNV-1a of bytes in base 36."""
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF)
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    return base36(F.aggregate(places, F.lit(2166136261).cast("long"), step))


def text_hash(text: Column) -> Column:
    """Signed 32-bit hash (times 33, plus the character) in base 36; characters of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return base36(F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: wrapped(h * 33 + c)))


#: Structs that stand for an identity: the fields they must have, and how it is written.
_IDENTITIES = [(("selection_id",), "selection:%s"), (("selected_track_id",), "track:%s"), (("source_id", "version"), "source:%s@%s")]


def fingerprint(value: Column, kind: T.DataType) -> Column:
    """A text that tells values of a column apart: by identity where a struct has one, by content otherwise."""
    if isinstance(kind, T.StringType):
        out = F.concat(F.lit("s:"), value)
    elif isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("b:"), value.cast("string"))
    elif isinstance(kind, T.IntegralType):
        out = F.concat(F.lit("n:"), value.cast("string"))
    elif isinstance(kind, T.NumericType):
        whole = (F.abs(value) < 1e15) & (value == F.floor(value))
        out = F.concat(F.lit("n:"), F.when(F.isnan(value.cast("double")), "NaN").when(whole, F.floor(value).cast("long").cast("string")).otherwise(value.cast("string")))
    elif isinstance(kind, T.BinaryType):
        out = F.concat_ws(":", F.lit("bytes"), F.length(value).cast("string"), bytes_hash(value))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: fingerprint(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        for names, form in _IDENTITIES:
            if set(names) <= set(kind.names):
                return F.when(value.isNull(), "null").otherwise(F.format_string(form, *[value[n].cast("string") for n in names]))
        parts = [F.concat(F.lit(f"{n}:"), fingerprint(value[n], kind[n].dataType)) for n in sorted(kind.names)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        out = F.concat(F.lit(f"{kind.simpleString()}:"), value.cast("string"))
    return F.coalesce(out, F.lit("null"))
