"""Geographic points as 52-bit scores, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGITUDE, LATITUDE = (-180.0, 180.0), (-85.05112878, 85.05112878)
STEPS = 26
EARTH = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_LONGITUDE_BITS = 0xAAAAAAAAAAAAA


def valid(longitude: Column, latitude: Column) -> Column:
    return longitude.between(*LONGITUDE) & latitude.between(*LATITUDE)


def _either(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [a[0].bitwiseOR(a[1]) if len(a) == 2 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]


def _spread(x: Column) -> Column:
    """Bit i of a cell at place 2i."""
    return _either([F.shiftleft(x.bitwiseAND(F.lit(1 << i).cast("bigint")), i) for i in range(STEPS)])


def _squash(x: Column) -> Column:
    """Bit 2i at place i."""
    return _either([F.shiftright(x.bitwiseAND(F.lit(1 << 2 * i).cast("bigint")), i) for i in range(STEPS)])


def _bound(x: Column, use) -> Column:
    """``use(x)`` with x evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _cell(value: Column, limits: tuple[float, float]) -> Column:
    low, high = limits
    return F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << STEPS))), F.lit((1 << STEPS) - 1)).cast("bigint")


def encode(longitude: Column, latitude: Column, latitudes: tuple[float, float] = LATITUDE) -> Column:
    """Latitude on the even bits, longitude on the odd ones; null outside the accepted range."""
    bits = _spread(_cell(latitude, latitudes)).bitwiseOR(F.shiftleft(_spread(_cell(longitude, LONGITUDE)), 1))
    return F.when(valid(longitude, latitude), bits)


def decode(bits: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of the cell's centre."""

    def centre(cell: Column, limits: tuple[float, float]) -> Column:
        low, high = limits
        return F.lit(low) + (cell + F.lit(0.5)) / F.lit(float(1 << STEPS)) * F.lit(high - low)

    return centre(_squash(F.shiftright(bits, 1)), LONGITUDE), centre(_squash(bits), LATITUDE)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """The great-circle distance by the haversine formula."""
    if unit not in UNITS:
        raise ValueError(f"unsupported unit {unit!r}")
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    whole = F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)))
    metres = F.when(v == 0, F.lit(EARTH) * F.abs(F.radians(lat2) - F.radians(lat1))).otherwise(whole)
    return metres / F.lit(UNITS[unit])


def geohash(bits: Column) -> Column:
    """The usual base-32 text, 11 characters of which the last is always '0'.

    The text covers latitudes of +-90 degrees, so the latitude is encoded anew; the bits of the longitude stay.
    """
    latitude = _cell(decode(bits)[1], (-90.0, 90.0))
    standard = _bound(latitude, _spread).bitwiseOR(bits.bitwiseAND(F.lit(_LONGITUDE_BITS)))

    def text(s: Column) -> Column:
        letter = lambda i: F.substring(F.lit(_ALPHABET), F.shiftright(s, 47 - 5 * i).bitwiseAND(F.lit(31).cast("bigint")).cast("int") + 1, F.lit(1))
        return F.concat(*(letter(i) for i in range(10)), F.lit("0"))

    return _bound(standard, text)


def geohash_bits(text: Column) -> Column:
    """The 50 bits that the first ten characters of a geohash stand for, at the places they have in 52; null for other text."""
    letter = lambda i: F.instr(F.lit(_ALPHABET), F.substring(text, i + 1, 1)).cast("bigint") - 1
    bits = _either([F.shiftleft(letter(i), 47 - 5 * i) for i in range(10)])
    return F.when(text.rlike(f"^[{_ALPHABET}]{{10}}"), bits)


# ---- cells of fewer steps: the upper 2 * step bits of a score

MERCATOR = 20037726.37  # metres from the meridian of Greenwich to the date line, on the map


def cell(score: Column, step: int) -> Column:
    """The cell of a score at ``step`` halvings of each axis."""
    return F.shiftright(score, 2 * (STEPS - step))


def align(cell_: Column, step: int) -> Column:
    """The lowest score in a cell."""
    return F.shiftleft(cell_.cast("bigint"), 2 * (STEPS - step))


def score_limits(cell_: Column, step: int) -> tuple[Column, Column]:
    """The scores of a cell: from the first, to below the second."""
    return align(cell_, step), align(cell_ + F.lit(1).cast("bigint"), step)


def moved(cell_: Column, step: int, east: int = 0, north: int = 0) -> Column:
    """The cell one to the east or west (1, -1), and to the north or south; the map is a ring in both directions."""
    mask = (1 << 2 * step) - 1
    own = {0: _LONGITUDE_BITS >> 1 & mask, 1: _LONGITUDE_BITS & mask}  # the bits of either axis, by the place of its lowest

    def along(x: Column, place: int, by: int) -> Column:
        bits, rest, unit = own[place], own[1 - place], F.lit(1 << place).cast("bigint")
        value = x.bitwiseAND(F.lit(bits).cast("bigint"))
        # a carry must run through the bits of the other axis
        value = value.bitwiseOR(F.lit(rest).cast("bigint")) + unit if by > 0 else value - unit
        return value.bitwiseAND(F.lit(bits).cast("bigint")).bitwiseOR(x.bitwiseAND(F.lit(rest).cast("bigint")))

    x = cell_.cast("bigint")
    x = along(x, 1, east) if east else x
    return along(x, 0, north) if north else x


def neighbours(cell_: Column, step: int) -> Column:
    """The eight cells around one, from the north clockwise."""
    return F.array(*(moved(cell_, step, east, north) for east, north in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))))


def steps_for_radius(metres: float) -> int:
    """How many steps make cells about as large as a circle, so that it lies in a cell and its neighbours; 1 to 26."""
    if metres <= 0:
        raise ValueError("radius must be positive")
    step = 1
    while metres < MERCATOR and step < STEPS + 2:
        metres *= 2
        step += 1
    return min(max(step - 2, 1), STEPS)
