"""Bounding boxes: ``struct<x,y,w,h: double>`` on a page of size 1 by 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertally.config import let
from papertally.functions.numbers import flt, is_finite

BOX_TYPE = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def clamp_box(x: Column, y: Column, w: Column, h: Column, keep_empty: bool = False) -> Column:
    """Cut a box at the page edge and round to four digits; an empty one is null."""
    cx, cy = _unit(x), _unit(y)
    cw = F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0) - cx)
    ch = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0) - cy)
    rounded = box(F.round(cx, 4), F.round(cy, 4), F.round(cw, 4), F.round(ch, 4))
    return rounded if keep_empty else F.when((cw > 0) & (ch > 0), rounded)


def canonical_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box given by its sides. All four are divided by 1000 if one exceeds 1.5."""
    sides = [F.coalesce(c, F.lit(0.0)) for c in (x, y, w, h)]
    scale = F.when(F.greatest(*sides) > 1.5, F.lit(1000.0)).otherwise(F.lit(1.0))
    ok = is_finite(sides[0]) & is_finite(sides[1]) & is_finite(sides[2]) & is_finite(sides[3])
    ok = ok & (sides[2] > 0) & (sides[3] > 0)
    return F.when(ok, clamp_box(*[s / scale for s in sides]))


def canonical_corners(ymin: Column, xmin: Column, ymax: Column, xmax: Column) -> Column:
    """Box given by two corners, on a scale of 1 or of 1000."""
    corners = [F.coalesce(c, F.lit(0.0)) for c in (ymin, xmin, ymax, xmax)]
    scale = F.when(F.greatest(*corners) > 1.5, F.lit(1000.0)).otherwise(F.lit(1.0))
    top, left, bottom, right = (c / scale for c in corners)
    ok = is_finite(corners[0]) & is_finite(corners[1]) & is_finite(corners[2]) & is_finite(corners[3])
    ok = ok & (right > left) & (bottom > top)
    return F.when(ok, clamp_box(left, top, right - left, bottom - top))


def lenient_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The form used for field rows: sides are never rescaled, and a box
    without area stays."""
    return clamp_box(*[F.coalesce(c, F.lit(0.0)) for c in (x, y, w, h)], keep_empty=True)


def lenient_corners(ymin: Column, xmin: Column, ymax: Column, xmax: Column) -> Column:
    corners = [F.coalesce(c, F.lit(0.0)) for c in (ymin, xmin, ymax, xmax)]
    scale = F.when(F.greatest(*[F.abs(c) for c in corners]) > 1.5, F.lit(1000.0)).otherwise(F.lit(1.0))
    top, left, bottom, right = (c / scale for c in corners)
    return clamp_box(left, top, right - left, bottom - top, keep_empty=True)


def box_from_json(text: Column, strict: bool = True) -> Column:
    """Box from ``{"x":..,"y":..,"w":..,"h":..}`` or ``[ymin,xmin,ymax,xmax]``."""
    names = ["x", "y", "w", "h"]

    def numbers(parts: list[Column]) -> Column:
        return F.struct(*[flt(p).alias(n) for p, n in zip(parts, names)])

    def by_side(sides: Column) -> Column:
        parts = [sides[n] for n in names]
        given = [p.isNotNull() for p in parts]
        shape = canonical_box if strict else lenient_box
        made = let(numbers(parts), lambda s: shape(*[s[n] for n in names]))
        return made if strict else F.when(given[0] & given[1] & given[2] & given[3], made)

    def by_corner(listed: Column) -> Column:
        shape = canonical_corners if strict else lenient_corners
        parts = [F.get(listed, F.lit(i)) for i in range(4)]
        return F.when(F.size(listed) == 4, let(numbers(parts), lambda s: shape(*[s[n] for n in names])))

    return F.when(text.startswith("{"), let(F.from_json(text, "x string, y string, w string, h string"), by_side)).when(
        text.startswith("["), let(F.from_json(text, "array<string>"), by_corner)
    )


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def _overlap(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    ix = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    iy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(zero, ix) * F.greatest(zero, iy)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if a box is null or the union is empty."""
    inter = _overlap(a, b)
    union = area(a) + area(b) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def same_spot(a: Column, b: Column) -> Column:
    """The intersection covers at least 0.8 of the smaller box."""
    small = F.least(area(a), area(b))
    return F.coalesce((small > 0) & (_overlap(a, b) / small >= 0.8), F.lit(False))


def union_of(boxes: Column) -> Column:
    """Smallest box around an array of boxes; null ones are ignored."""
    known = F.filter(boxes, lambda b: b.isNotNull())
    edges = let(
        known,
        lambda bs: F.struct(
            F.array_min(F.transform(bs, lambda b: b["x"])).alias("x0"),
            F.array_min(F.transform(bs, lambda b: b["y"])).alias("y0"),
            F.array_max(F.transform(bs, lambda b: b["x"] + b["w"])).alias("x1"),
            F.array_max(F.transform(bs, lambda b: b["y"] + b["h"])).alias("y1"),
        ),
    )
    return let(
        edges, lambda e: F.when(e["x0"].isNotNull(), clamp_box(e["x0"], e["y0"], e["x1"] - e["x0"], e["y1"] - e["y0"]))
    )
