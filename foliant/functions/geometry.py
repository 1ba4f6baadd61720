"""Box arithmetic on columns; boxes are x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.binding import bound

EPS = 1e-7
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def to_centre(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def to_corners(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def clip(b: Box, width, height) -> Box:
    held = lambda x, most: F.least(F.greatest(x, F.lit(0)), F.lit(most))
    return held(b[0], width), held(b[1], height), held(b[2], width), held(b[3], height)


def unscale(b: Box, gain, pad_x, pad_y) -> Box:
    """A letterboxed box in the original's frame."""
    return (b[0] - pad_x) / gain, (b[1] - pad_y) / gain, (b[2] - pad_x) / gain, (b[3] - pad_y) / gain


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    side = lambda k: F.greatest(F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]), F.lit(0))
    return side(0) * side(1)


def overlaps(a: Box, b: Box) -> Column:
    """Strictly: a shared edge is no overlap."""
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


def iou(a: Box, b: Box, kind: str = "iou") -> Column:
    """Intersection over union; kind giou, diou or ciou subtracts its penalty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter + EPS
    plain = inter / union
    if kind == "iou":
        return plain
    width, height = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    if kind == "giou":
        hull = width * height + EPS
        return plain - (hull - union) / hull
    diagonal = width * width + height * height + EPS
    apart = (F.pow(b[0] + b[2] - a[0] - a[2], 2) + F.pow(b[1] + b[3] - a[1] - a[3], 2)) / 4
    if kind == "diou":
        return plain - apart / diagonal
    v = 4 / F.pow(F.pi(), 2) * F.pow(F.atan((b[2] - b[0]) / (b[3] - b[1] + EPS)) - F.atan((a[2] - a[0]) / (a[3] - a[1] + EPS)), 2)
    return plain - (apart / diagonal + v * (v / (v - plain + (1 + EPS))))


def inside_share(a: Box, b: Box) -> Column:
    """Intersection over the area of b."""
    return intersection(a, b) / (area(b) + EPS)


def quarter_turn(b: Box, angle: int, width, height) -> Box:
    """A box after its page is turned clockwise by 0, 90, 180 or 270 degrees."""
    w, h = F.lit(width), F.lit(height)
    return {0: b, 90: (h - b[3], b[0], h - b[1], b[2]), 180: (w - b[2], h - b[3], w - b[0], h - b[1]), 270: (b[1], w - b[2], b[3], w - b[0])}[angle]


def normalised(b: Box, width, height, places: int = 6) -> Box:
    """Centre and size as shares of the image."""
    c = to_centre(b)
    return F.round(c[0] / width, places), F.round(c[1] / height, places), F.round(c[2] / width, places), F.round(c[3] / height, places)


def denormalised(b: Box, width, height, pad_x=0, pad_y=0) -> Box:
    """Corners in pixels of a normalised centre and size."""
    c = to_corners(b)
    return c[0] * width + pad_x, c[1] * height + pad_y, c[2] * width + pad_x, c[3] * height + pad_y


def grown(b: Box, x, y, width, height) -> Box:
    """With a margin on each side, held within the image."""
    return clip((b[0] - x, b[1] - y, b[2] + x, b[3] + y), width, height)


def line_box(b: Box, width, height, margin: int = 5, share: float = 0.3) -> Box:
    """A table line's box: grown, as wide as the image if it is narrower than a share of it, never empty."""
    g = grown(b, margin, margin, width, height)
    narrow = g[2] - g[0] < F.lit(width) * share
    left, right = F.when(narrow, 0).otherwise(g[0]), F.when(narrow, F.lit(width)).otherwise(g[2])
    inner = lambda x, most: F.greatest(F.least(x, F.lit(most) - 1), F.lit(0))
    x1, y1 = inner(left, width), inner(g[1], height)
    return x1, y1, F.greatest(x1 + 1, F.least(right, F.lit(width))), F.greatest(y1 + 1, F.least(g[3], F.lit(height)))


def crop_square(b: Box, gain: float = 1.02, pad: int = 10, square: bool = False) -> Box:
    """The box to cut out: grown by a factor and then by pixels, square if asked for."""
    cx, cy, w, h = to_centre(b)
    w, h = (F.greatest(w, h), F.greatest(w, h)) if square else (w, h)
    return to_corners((cx, cy, w * gain + pad, h * gain + pad))


def size_ratio(w: Column, h: Column, w2, h2) -> Column:
    """The worse of both sides' ratios of the lesser to the greater."""
    one = lambda a, b: F.least(a / b, b / a)
    return F.least(one(w, F.lit(w2)), one(h, F.lit(h2)))


def size_iou(w: Column, h: Column, w2: Column, h2: Column) -> Column:
    """Overlap ratio of two sizes laid on one corner."""
    inter = F.least(w, w2) * F.least(h, h2)
    return inter / (w * h + w2 * h2 - inter + EPS)


def keeps_shape(a: Box, b: Box, side=2, aspect=100, share=0.1) -> Column:
    """Whether box a, changed to b, is still large and stout enough."""
    w, h = b[2] - b[0], b[3] - b[1]
    stout = F.greatest(w / (h + 1e-16), h / (w + 1e-16)) < aspect
    return (w > side) & (h > side) & (area(b) / (area(a) + 1e-16) > share) & stout


def fitted_size(w: Column, h: Column, short: int = 416, long: int | None = 608) -> tuple[Column, Column]:
    """Width and height with the shorter side at `short`, the longer one at most `long`, both down to multiples of 32."""
    f = F.lit(float(short)) / F.least(w, h)
    if long is not None:
        f = F.when(f * F.greatest(w, h) > long, F.lit(float(long)) / F.greatest(w, h)).otherwise(f)
    return tuple(F.floor(F.floor(x * f) / 32) * 32 for x in (w, h))


def turned_canvas(w: Column, h: Column, degrees) -> tuple[Column, Column]:
    """Size of the canvas that holds the whole image after a turn."""
    c, s = F.abs(F.cos(F.radians(F.lit(degrees)))), F.abs(F.sin(F.radians(F.lit(degrees))))
    return F.floor(h * s + w * c), F.floor(h * c + w * s)


def direction(x: Column, y: Column) -> Column:
    """The direction of a vector in degrees, over -180 up to 180; of the null vector -90."""
    return F.when((x == 0) & (y == 0), -90.0).otherwise(F.degrees(F.atan2(y, x)))


def leaning_corners(x1: Column, x2: Column, slope: Column, middle: Column, height: Column) -> Column:
    """Corners of joined proposals from the upper left one onwards, in whole numbers: the band of `height` around the line
    slope * x + middle from x1 to x2, two opposite corners moved so that its ends stand square on it."""
    dx, dy = height * F.abs(slope) / (1 + slope * slope), height * slope * slope / (1 + slope * slope)

    def corner(x: Column, side: int, out: int, moved: Column) -> Column:
        y = slope * x + middle + side * height / 2
        return F.array((x + F.when(moved, out * dx).otherwise(0.0)).cast("int"), (y - F.when(moved, side * dy).otherwise(0.0)).cast("int"))

    return F.array(corner(x1, -1, -1, slope < 0), corner(x2, -1, 1, slope >= 0), corner(x2, 1, 1, slope < 0), corner(x1, 1, -1, slope >= 0))


def triangle(points: Column) -> Column:
    """Three points, the one with an angle of 70 to 110 degrees first (else the last one), then the other two by their direction from it, upwards positive; in whole pixels."""
    def ordered(p: Column) -> Column:
        def angle(i: int, j: int, k: int) -> Column:
            ax, ay, bx, by = _x(p[j]) - _x(p[i]), _y(p[j]) - _y(p[i]), _x(p[k]) - _x(p[i]), _y(p[k]) - _y(p[i])
            return F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))

        way = lambda i, j: direction(_x(p[j]) - _x(p[i]), _y(p[i]) - _y(p[j]))
        from_ = lambda i, j, k: F.when(way(i, k) >= way(i, j), F.array(p[i], p[j], p[k])).otherwise(F.array(p[i], p[k], p[j]))
        # Angles of whole-pixel corners at exactly 70 or 110 degrees don't occur.
        return F.when(angle(0, 1, 2).between(70, 110), from_(0, 1, 2)).when(angle(1, 0, 2).between(70, 110), from_(1, 0, 2)).otherwise(from_(2, 0, 1))

    return F.when(F.size(points) == 3, bound(F.transform(points, lambda q: F.transform(q, lambda c: c.cast("int"))), ordered))


def even_parity(bits: Column) -> Column:
    """Whether the remainder of a bit array, divided by the polynomial x + 1, is 0."""
    return F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseXOR(x)) == 0


# Points: an array of (x, y) arrays.
def _x(p: Column) -> Column:
    return F.element_at(p, 1)


def _y(p: Column) -> Column:
    return F.element_at(p, 2)


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def turned_point(p: Column, angle: Column, cx: Column, cy: Column) -> Column:
    x, y, c, s = _x(p) - cx, _y(p) - cy, F.cos(angle), F.sin(angle)
    return point(x * c - y * s + cx, x * s + y * c + cy)


def rotated_points(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Four corners of a box turned about its centre, from the upper left one onwards."""
    return F.array(*(turned_point(point(cx + sx * w / 2, cy + sy * h / 2), angle, cx, cy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def rotated_box(points: Column) -> Column:
    """angle, w, h, cx, cy of four corners; the sides are means of opposite ones, and the angle is null where it has no sine."""
    p = [F.element_at(points, k) for k in (1, 2, 3, 4)]
    mean = lambda f: (f(p[0]) + f(p[1]) + f(p[2]) + f(p[3])) / 4
    far = lambda a, b: F.hypot(_x(a) - _x(b), _y(a) - _y(b))
    sizes = F.struct(((far(p[0], p[1]) + far(p[2], p[3])) / 2).alias("w"), ((far(p[1], p[2]) + far(p[0], p[3])) / 2).alias("h"), mean(_x).alias("cx"), mean(_y).alias("cy"))

    def turned(z: Column) -> Column:
        sine = F.try_divide(2 * (z["h"] * (_x(p[0]) - z["cx"]) - z["w"] * (_y(p[0]) - z["cy"])), z["h"] * z["h"] + z["w"] * z["w"])
        return F.struct(bound(sine, lambda v: F.when(F.abs(v) <= 1, F.asin(v))).alias("angle"), *(z[c].alias(c) for c in ("w", "h", "cx", "cy")))

    return bound(sizes, turned)


def clockwise(points: Column) -> Column:
    """Four points as upper left (least x + y), upper right (of the other two that of least y - x), lower right (greatest x + y), lower left; the first of equals."""
    by_sum = F.array_sort(F.transform(points, lambda p, i: F.struct((_x(p) + _y(p)).alias("s"), i.alias("i"), p.alias("p"))))
    # The first of equals at the far end too: the first member with the greatest sum.
    top = lambda k: F.filter(k, lambda x: x["s"] == F.element_at(k, -1)["s"])[0]
    by_rise = lambda k: F.array_sort(F.transform(F.filter(k, lambda x: (x["i"] != k[0]["i"]) & (x["i"] != top(k)["i"])), lambda x: F.struct((_y(x["p"]) - _x(x["p"])).alias("d"), x["i"].alias("i"), x["p"].alias("p"))))
    return bound(by_sum, lambda k: bound(by_rise(k), lambda r: F.array(k[0]["p"], r[0]["p"], top(k)["p"], F.element_at(r, -1)["p"])))


def quad_size(points: Column) -> tuple[Column, Column]:
    """Width and height of the upright cut of a quad: the longer of opposite sides."""
    p = [F.element_at(points, k) for k in (1, 2, 3, 4)]
    far = lambda a, b: F.hypot(_x(a) - _x(b), _y(a) - _y(b))
    return F.floor(F.greatest(far(p[0], p[1]), far(p[2], p[3]))), F.floor(F.greatest(far(p[0], p[3]), far(p[1], p[2])))


def large_enough(points: Column, least: int = 3) -> Column:
    """Whether the upper and the left side, in whole pixels, are over `least`."""
    p = [F.element_at(points, k) for k in (1, 2, 4)]
    far = lambda a, b: F.floor(F.hypot(_x(a) - _x(b), _y(a) - _y(b)))
    return (far(p[0], p[1]) > least) & (far(p[0], p[2]) > least)


def bounds(points: Column, width=None, height=None) -> Box:
    """Least and greatest coordinates; given the image's size, of the points within it. No points: zeros."""
    if width is not None:
        points = F.filter(points, lambda p: (_x(p) >= 0) & (_y(p) >= 0) & (_x(p) <= width) & (_y(p) <= height))
    xs, ys = F.transform(points, _x), F.transform(points, _y)
    return tuple(F.coalesce(c, F.lit(0)) for c in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def resampled(points: Column, n: int = 1000) -> Column:
    """n points at even steps of the point number around the closed outline."""
    def at(ring: Column, k: Column) -> Column:
        place = k * (F.size(ring) - 1) / F.lit(n - 1)
        low = F.least(F.floor(place), F.size(ring) - 2).cast("int")
        mid = lambda c: c(F.get(ring, low)) + (c(F.get(ring, low + 1)) - c(F.get(ring, low))) * (place - low)
        return point(mid(_x), mid(_y))

    ring = F.concat(points, F.slice(points, 1, 1))
    return F.when(F.size(points) > 0, bound(ring, lambda r: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: at(r, k))))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise."""
    ordered, out = sorted(set(points)), []
    for chain in (ordered, ordered[::-1]):
        start = len(out)
        for p in chain:
            while len(out) - start >= 2 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        out.pop()
    return out


def _turn(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def polygon_area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def common_part(a: list, b: list) -> list:
    """The part of convex polygon a within convex polygon b, both counter-clockwise."""
    for start, end in zip(b, b[1:] + b[:1], strict=True):
        sides, out = [_turn(start, end, p) for p in a], []
        for k, p in enumerate(a):
            before, here = sides[k - 1], sides[k]
            if (before < 0) != (here < 0):
                share = before / (before - here)
                out.append((a[k - 1][0] + (p[0] - a[k - 1][0]) * share, a[k - 1][1] + (p[1] - a[k - 1][1]) * share))
            if here >= 0:
                out.append(p)
        a = out
    return a


def polygon_iou(a: list, b: list) -> float:
    """Overlap ratio of two point lists' convex hulls; 0 if either has no area."""
    a, b = hull([tuple(p) for p in a]), hull([tuple(p) for p in b])
    if len(a) < 3 or len(b) < 3:
        return 0.0
    inter = polygon_area(common_part(a, b))
    return inter / (polygon_area(a) + polygon_area(b) - inter)


def height_of(corners: Column) -> Column:
    """What boxes are sorted by from top to bottom: the sum of their corners' y."""
    return F.aggregate(corners, F.lit(0.0), lambda n, p: n + _y(p))
