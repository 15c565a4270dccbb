"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import formulas as f

#: Names of stored numbers.
MODE_NAMES = {1: "gray", 2: "gray-alpha", 3: "rgb", 4: "rgba", 5: "palette", 7: "separable", 9: "native", 10: "filtered", 11: "palette-stream", 12: "palette-predict", 13: "compressed-palette", 14: "tiles", 15: "tile-model", 16: "gray-model", 17: "animation", 18: "blocks"}
TRANSFORM_NAMES = {0: "identity", 1: "green-delta", 2: "identity-raw", 3: "green-delta-raw", 4: "identity-rle", 5: "green-delta-rle", 6: "index-rle", 7: "separable-delta", 8: "red-delta", 9: "blue-delta", 10: "palette-delta"}
CODEC_NAMES = {0: "store", 3: "lzms"}


def named(number: Column, names: dict[int, str]) -> Column:
    return F.coalesce(*(F.when(number == k, F.lit(v)) for k, v in names.items()), F.lit("unknown"))


def clamp(v: Column, high: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(high), v))


def floor_shift(v: Column, n: int) -> Column:
    """Division by 2 ** n, rounded down."""
    return F.shiftright(v, n)


def bit_length(v: Column) -> Column:
    """Bits of a number from 0 up; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def next_power_of_two(v: Column) -> Column:
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit_length(v - 1)))


def modulo(v: Column, m: int) -> Column:
    """Remainder from 0 up."""
    return F.pmod(v, F.lit(m))


def circular_distance(a: Column, b: Column) -> Column:
    d = (a - b).bitwiseAND(255)
    return F.least(d, 256 - d)


def signed_byte(v: Column) -> Column:
    return F.when(v < 128, v).otherwise(v - 256)


def folded(v: Column) -> Column:
    """Signed to unsigned, alternating: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unfolded(v: Column) -> Column:
    return F.when(v % 2 == 0, F.shiftright(v, 1)).otherwise(-F.shiftright(v + 1, 1))


def lerp15(a: Column, b: Column, q: Column) -> Column:
    """Between a and b by fifteenths."""
    return F.floor((a * (15 - q) + b * q + 7) / 15).cast("int")


def varint_bytes(v: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("int")


def residual_cost(e: Column) -> Column:
    n = F.abs(e)
    return F.when(n == 0, 1).otherwise(2 * bit_length(n) + 1)


def index_bits(n: Column) -> Column:
    """Bits of a palette number among n colours."""
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).when(n <= 256, 8).otherwise(bit_length(n - 1))


def sample_depth_mask(v: str) -> Column:
    """A bit for each depth from 1 to 7 on whose scaling grid a sample lies."""
    from tessera.operators.colour import on_grid

    return sum((F.when(F.expr(f.spark(on_grid(v, d))), 1 << d).otherwise(0) for d in range(1, 8)), F.lit(0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def has_ending(path: Column, ending: str) -> Column:
    return F.lower(path).endswith(ending.lower())


def output_path(path: Column, folder: str, ending: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(base_name(path), r"\.[^.]*$", ""), F.lit("." + ending))


def category(path: Column, source: Column, split_first: Column) -> Column:
    """A source's name, with the first folder below it where the source is divided that way."""
    parts = F.split(path, r"[/\\]")
    return F.when(split_first & (F.size(parts) > 1), F.concat(source, F.lit("-"), parts[0])).otherwise(source)


def value_of(text: Column, name: str) -> Column:
    """What follows name= in a line of such pairs, or null."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\s){name}=(\S+)", 1), F.lit(""))


def human_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_number(n / 1024**i, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def run_order(place: Column, n: int) -> Column:
    """Which of n codecs goes first for the image at this place, from 0."""
    return F.pmod(place, F.lit(n))


def threads(text: Column, most: int) -> Column:
    """How many threads a word asks for: `all` is `most`, a whole number is held between 1 and `most`, anything else is null."""
    number = F.when(text.rlike(r"^[0-9]{1,9}$"), text.cast("int"))
    return F.when(F.lower(text) == "all", F.lit(most)).otherwise(F.greatest(F.lit(1), F.least(number, F.lit(most))) * F.when(number.isNotNull(), 1))
