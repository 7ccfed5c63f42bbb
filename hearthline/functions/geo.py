"""Distances, grid cells and box rules over plain latitude / longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere, fixed to the micrometre so that ties stay ties."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return F.round(F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * K.EARTH_RADIUS_M), 6)


# --- dyadic grid ---------------------------------------------------------------
# 2^bits rows from pole to pole and twice as many columns around the globe, so that cells wrap at 180 degrees.

def bits_for(metres: float) -> int:
    """Bits of the finest level whose rows are at least that high."""
    return max(2, min(20, int(math.floor(math.log2(180.0 / (metres / K.METRES_PER_DEGREE))))))


def wrapped_cell(row: Column, col: Column, bits: int) -> Column:
    """One number for a cell; columns count around, rows beyond a pole count as the last one."""
    inside = F.least(F.greatest(row, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    return inside * F.lit(1 << 24) + F.pmod(col.cast("long"), F.lit(1 << (bits + 1)))


def dyadic_cell(lat: Column, lon: Column, bits: int) -> Column:
    step = 180.0 / (1 << bits)
    return wrapped_cell(F.floor((lat + 90.0) / step), F.floor((lon + 180.0) / step), bits)


def touched_cells(lat: Column, lon: Column, reach_m: float, bits: int) -> Column:
    """All cells of a level that a circle can touch."""
    step = 180.0 / (1 << bits)
    reach = F.lit(reach_m / K.METRES_PER_DEGREE * 1.002)
    wide = F.abs(lat) + reach
    turn = F.when(wide < 89.0, reach / F.cos(F.radians(wide))).otherwise(F.lit(180.0))  # a circle at a pole touches every column
    rows = F.sequence(F.floor((F.greatest(lat - reach, F.lit(-90.0)) + 90.0) / step), F.floor((F.least(lat + reach, F.lit(90.0)) + 90.0) / step))
    cols = F.sequence(F.floor((lon - turn + 180.0) / step), F.floor((lon + turn + 180.0) / step))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: wrapped_cell(r, c, bits)))))


# --- boxes -------------------------------------------------------------------

def box_problem(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Null for a valid box, else the broken rule."""
    missing = west.isNull() | south.isNull() | east.isNull() | north.isNull()
    return (F.when(missing, "not four numbers")
            .when((F.abs(west) > 180) | (F.abs(east) > 180), "longitude out of range")
            .when((F.abs(south) > 90) | (F.abs(north) > 90), "latitude out of range")
            .when(south > north, "south above north")
            .when(west == east, "no width"))


def box_centre_lon(west: Column, east: Column) -> Column:
    wrapped = west + (F.lit(360.0) - west + east) / 2
    return (F.when(west <= east, (west + east) / 2)
            .when(wrapped > 180, wrapped - 360).otherwise(wrapped))


def box_parts(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One or two plain envelopes: a box across the antimeridian is split there."""
    def part(w, e):
        return F.struct(w.alias("w"), south.alias("s"), e.alias("e"), north.alias("n"))
    return (F.when(west <= east, F.array(part(west, east)))
            .otherwise(F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east))))


def clamp_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-K.MERCATOR_LAT), F.least(F.lit(K.MERCATOR_LAT), lat))


def marker_cell_deg(zoom: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees covered by one map marker at a zoom: (lon, lat)."""
    per_px = F.lit(360.0) / (F.lit(256.0) * F.pow(F.lit(2.0), zoom))
    squeeze = F.greatest(F.cos(F.radians(lat)), F.lit(0.15))
    return per_px * K.MARKER_PX[0] / squeeze, per_px * K.MARKER_PX[1]


def ring_position(lat: Column, lon: Column, slot: Column, count: Column) -> tuple[Column, Column, Column]:
    """Offset of co-located markers: (ring degrees, lat, lon)."""
    ring = F.when(count > 1, F.least(F.lit(K.RING_CAP), K.RING_STEP * F.sqrt(count))).otherwise(0.0)
    angle = 2 * math.pi * slot / count
    squeeze = F.greatest(F.cos(F.radians(lat)), F.lit(0.2))
    new_lat = F.when(ring > 0, lat + ring * F.sin(angle)).otherwise(lat)
    new_lon = F.when(ring > 0, lon + ring * F.cos(angle) / squeeze).otherwise(lon)
    return ring, new_lat, new_lon


# --- rings -------------------------------------------------------------------

def ring_area2(ring: Column) -> Column:
    """Twice the signed shoelace area of an open ring of (x, y) structs."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: (
        p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"]))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
