"""Risk-offset classes and relative changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes by the signs of the changes.
CLASSES = {1: "cooler and wetter", 2: "risk offset", 3: "fire-weather paradox", 4: "exacerbation", 5: "higher demand, wetter"}


def classify_offset(dvpd: Column, dpr: Column, dfwi: Column | None = None) -> Column:
    """Class 1 to 5 from the signs of the changes of VPD, rain and fire weather; null where VPD or rain is. Without fire weather class 3 is part of 2."""
    down, wet = dvpd < 0, dpr >= 0
    dry = F.when(dfwi <= 0, 2).when(dfwi > 0, 3) if dfwi is not None else F.lit(2)
    return F.when(dvpd.isNotNull() & dpr.isNotNull(), F.when(down & wet, 1).when(down & ~wet, dry).when(~down & ~wet, 4).otherwise(5))


def pct_change(delta: Column, base: Column, least: float = 0.05) -> Column:
    """Change in percent where the base is above a floor, else null."""
    return F.when(base > least, 100 * delta / base)
