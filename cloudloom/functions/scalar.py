"""Scalar column functions: vectors, packed keys, planes, logarithms, clamps, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plane index -> unit normal; planes 0..5 are +x, +y, +z, -x, -y, -z.
PLANE_NORMALS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1))
#: Plane index -> (normal axis, tangent axis, bitangent axis, projection mode).
PLANE_AXES = ((0, 2, 1, 0), (1, 2, 0, 0), (2, 0, 1, 0), (0, 2, 1, 1), (1, 2, 0, 1), (2, 0, 1, 1))


def add(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b))


def subtract(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b))


def negate(a: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(-x for x in a)


def scaled(a: tuple[Column, ...], by: Column) -> tuple[Column, ...]:
    """Integer components divided by an integer, truncating."""
    return tuple(((x - x % by) / by).cast("int") for x in a)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0))


def round_up(n: Column, multiple: int) -> Column:
    """The next multiple of a power of two."""
    if multiple & (multiple - 1):
        raise ValueError("multiple must be a power of two")
    return (n + (multiple - 1)).bitwiseAND(~(multiple - 1))


def zero_pad(n: Column, width: int) -> Column:
    """Decimal digits with leading zeros; longer numbers keep all digits."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def pack(x: Column, y: Column, z: Column, bits: int) -> Column:
    """x + (y << bits) + (z << 2 bits) as a long."""
    return x.cast("long") + F.shiftleft(y.cast("long"), bits) + F.shiftleft(z.cast("long"), 2 * bits)


def unpack(key: Column, bits: int) -> tuple[Column, Column, Column]:
    mask = (1 << bits) - 1
    return tuple(F.shiftright(key, s).bitwiseAND(F.lit(mask).cast("long")).cast("int") for s in (0, bits, 2 * bits))


def pack2(x: Column, y: Column, bits: int) -> Column:
    return x.cast("long") + F.shiftleft(y.cast("long"), bits)


def plane_axis(ppi: Column, role: int) -> Column:
    """Normal (0), tangent (1) or bitangent (2) axis of a plane, or its projection mode (3)."""
    return F.element_at(F.array(*(F.lit(p[role]) for p in PLANE_AXES)), ppi.cast("int") + 1)


def plane_normal(ppi: Column) -> Column:
    return F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in PLANE_NORMALS)), ppi.cast("int") + 1)


def on_axis(axis: Column, x: Column, y: Column, z: Column) -> Column:
    return F.when(axis == 0, x).when(axis == 1, y).otherwise(z)


def relative_depth(mode: Column, depth: Column, plane: Column) -> Column:
    """Depth from the projection plane, forwards (mode 0) or backwards (mode 1)."""
    return F.when(mode == 1, plane - depth).otherwise(depth - plane)


def floor_log2(n: Column) -> Column:
    """-1 for 0."""
    return F.when(n == 0, F.lit(-1)).otherwise(F.length(F.bin(n.cast("long"))) - 1)


def ceil_log2(n: Column) -> Column:
    """-1 for 0, 0 for 1."""
    return F.when(n == 0, F.lit(-1)).otherwise(floor_log2(n.cast("long") - 1) + 1)


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(v, low), high)


def argmax_first(values: Column) -> Column:
    """Index of the first largest element of an array without nulls."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def direction_plane(vx: Column, vy: Column, axis: int) -> Column:
    """Plane that a step (vx, vy) within a slice across `axis` faces: the first largest of vy, -vx, -vy, vx."""
    planes = SLICE_PLANES[axis]
    return F.element_at(F.array(*map(F.lit, planes)), argmax_first(F.array(vy, -vx, -vy, vx)) + 1)


#: Axis of a slice -> planes faced by steps whose largest component is vy, -vx, -vy, vx; axes are (x: y, z), (y: x, z), (z: x, y).
SLICE_PLANES = {0: (4, 5, 1, 2), 1: (3, 5, 0, 2), 2: (4, 3, 1, 0)}


def mean_of_four(parts: list[tuple[Column, int]]) -> Column:
    """Weighted integer mean of pixels, truncated."""
    total = sum(w for _, w in parts)
    value = sum((p.cast("int") * w for p, w in parts), F.lit(0))
    return F.floor(value / total).cast("int")


def quantise_position(offset: Column) -> Column:
    return F.shiftright(offset, 6)


def quantise_size(size: Column) -> Column:
    return F.shiftright(size + 1, 6)


def rate(text: Column) -> Column:
    """`16-22-2` as a struct of geometry QP, attribute QP and occupancy block; nulls where it has another form."""
    part = lambda i: F.when(text.rlike(r"^\d+-\d+-\d+$"), F.regexp_extract(text, r"^(\d+)-(\d+)-(\d+)$", i).cast("int"))
    return F.struct(part(1).alias("geometry_qp"), part(2).alias("attribute_qp"), part(3).alias("block"))


def strict_int(text: Column) -> Column:
    """The integer that the whole text is, else null."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def strict_double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def strict_bool(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "1"), F.lit(True)).when(F.lower(text).isin("false", "0"), F.lit(False))


def is_one_of(text: Column, allowed: list[str]) -> Column:
    return text.rlike("^(" + "|".join(allowed) + ")$")


def key_values(text: Column) -> Column:
    """`k=v,k=v` as a map; the first of equal keys stays."""
    pairs = F.filter(F.split(text, ","), lambda p: p.rlike(r"^\w+=[^,]*$"))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("key"), F.regexp_extract(p, r"^\w+=(.*)$", 1).alias("value")))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(first)


def rectangle_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two rectangles, in 32-bit floats."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = (w * h).cast("float")
    union = (aw * ah + bw * bh - w * h).cast("float")
    return F.when(union > 0, (both / union).cast("float")).otherwise(F.lit(0.0).cast("float"))


def nearest_name(text: Column, names: list[str]) -> Column:
    """The name with the smallest Levenshtein distance; ties to the first in alphabetical order."""
    ranked = F.array(*(F.struct(F.levenshtein(text, F.lit(n)).alias("d"), F.lit(n).alias("name")) for n in sorted(names)))
    return F.array_min(ranked)["name"]
