"""Slice geometry in patient coordinates (left, posterior, superior positive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_of(iop: Column) -> list[Column]:
    """Components of the cross product of row and column direction."""
    r, c = [iop[i] for i in range(3)], [iop[i] for i in range(3, 6)]
    return [r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def plane_of(iop: Column) -> Column:
    """AX, COR or SAG by the largest component of the normal, the first of equal ones; ? without an orientation."""
    x, y, z = (F.abs(v) for v in normal_of(iop))
    return F.when(iop.isNull(), "?").when((x >= y) & (x >= z), "SAG").when(y >= z, "COR").otherwise("AX")


def z_of(ipp: list[Column], iop: Column, location: Column, instance: Column) -> Column:
    """Position along the normal, else the third coordinate, else the slice location, else the instance number."""
    n = normal_of(iop)
    along = n[0] * ipp[0] + n[1] * ipp[1] + n[2] * ipp[2]
    return F.coalesce(along, ipp[2], location, instance.cast("double"), F.lit(0.0)) + 0.0


def patient_point(ipp: list[Column], iop: Column, row_sp: Column, col_sp: Column, r: Column, c: Column) -> list[Column]:
    """Patient coordinates of a pixel centre."""
    return [ipp[i] + c * col_sp * iop[i] + r * row_sp * iop[i + 3] + 0.0 for i in range(3)]


def direction_label(x: Column, y: Column, z: Column) -> Column:
    """Letters of the components above 0.1, by falling magnitude, axes in order where equal."""
    parts = F.array(*[F.struct((-F.abs(v)).alias("m"), F.lit(i).alias("axis"), F.when(v > 0, b).otherwise(a).alias("letter")) for i, (v, a, b) in enumerate([(x, "R", "L"), (y, "A", "P"), (z, "I", "S")])])
    return F.array_join(F.transform(F.filter(F.array_sort(parts), lambda p: p["m"] < -0.1), lambda p: p["letter"]), "")


def direction_letter(x: Column, y: Column, z: Column, least: float = 0.75) -> Column:
    """One letter for the largest component, empty if it is below ``least``."""
    a = [F.abs(v) for v in (x, y, z)]
    letter = F.when((a[0] >= a[1]) & (a[0] >= a[2]), F.when(x >= 0, "L").otherwise("R")).when(a[1] >= a[2], F.when(y >= 0, "P").otherwise("A")).otherwise(F.when(z >= 0, "H").otherwise("F"))
    return F.when(F.greatest(*a) < least, "").otherwise(letter)


def distance_mm(r1: Column, c1: Column, r2: Column, c2: Column, row_sp: Column, col_sp: Column) -> Column:
    return F.hypot((r1 - r2) * row_sp, (c1 - c2) * col_sp)


def equivalent_diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / F.lit(3.141592653589793))


def project_voxel(k: Column, r: Column, c: Column, plane: Column, depth: Column) -> tuple[Column, Column, Column]:
    """(index, row, col) of a voxel in a plane; coronal and sagittal images have the last slice on top."""
    top = depth - 1 - k
    return (F.when(plane == "axial", k).when(plane == "coronal", r).otherwise(c), F.when(plane == "axial", r).otherwise(top), F.when(plane == "sagittal", r).otherwise(c))
