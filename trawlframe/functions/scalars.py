"""Row expressions of the survey: effort, classes, labels, transforms."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlframe.functions.strict import column

__all__ = [
    "NM_PER_KM", "STATION_AREA_NM2", "SIZE_SEX_BOUNDS", "safe_div", "area_swept",
    "cpue", "size_sex_class", "width_bin_1mm", "class_label", "split_class_label",
    "recode", "station_key", "region_from_district", "region_from_cruise",
    "sex_from_group", "degrees_east", "fourth_root", "log_positive", "log_plus_one",
    "log10_plus", "squared", "presence", "zero_to_null", "null_to_zero",
    "floor_at_zero", "normal_ci", "project_nm", "unproject_nm", "inside_polygon",
]

# Nautical miles in a kilometre, and the area one survey
# station stands for (square nautical miles).
NM_PER_KM = 0.539957
STATION_AREA_NM2 = 401

# The size/sex classes (sex 1 male, 2 female). Male widths are
# "over, up to and including"; the gaps between the classes are meant.
SIZE_SEX_BOUNDS = [
    {"label": "male31to60", "sex": 1, "width": (31, 60)},
    {"label": "male61to90", "sex": 1, "width": (61, 90)},
    {"label": "male91to120", "sex": 1, "width": (91, 120)},
    {"label": "mature_female", "sex": 2, "clutch": "some"},
    {"label": "immature_female", "sex": 2, "clutch": "none"},
]


def safe_div(a, b) -> Column:
    """a / b, NULL where b is zero or missing."""
    return F.try_divide(column(a), column(b))


def area_swept(distance_km="distance_fished", net_width_m="net_width") -> Column:
    """Square nautical miles covered by a tow."""
    return column(distance_km) * (column(net_width_m) / 1000.0) * (NM_PER_KM**2)


def cpue(num="num_crab", area="area_swept") -> Column:
    return safe_div(num, area)


def size_sex_class(sex="sex", width="cw", clutch="clutch", bounds=SIZE_SEX_BOUNDS) -> Column:
    """Label of the first class whose conditions hold; NULL if none does."""
    sex, width, clutch = column(sex), column(width), column(clutch)
    label = F.lit(None).cast("string")
    for spec in reversed(bounds):
        test = sex == spec["sex"]
        if "width" in spec:
            over, upto = spec["width"]
            test = test & (width > over) & (width <= upto)
        if "clutch" in spec:
            test = test & ((clutch > 0) if spec["clutch"] == "some" else (clutch == 0))
        label = F.when(test, F.lit(spec["label"])).otherwise(label)
    return label


def width_bin_1mm(width="cw") -> Column:
    """Width to the nearest millimetre, halves to the even number."""
    return F.bround(column(width), 0)


def class_label(sex="sex", width_bin="cw_bin") -> Column:
    """'sex_width' with 'NA' for a missing half; NULL when both are missing."""
    sex, width = column(sex), column(width_bin)
    text = F.concat(
        F.coalesce(sex.cast("int").cast("string"), F.lit("NA")),
        F.lit("_"),
        F.coalesce(width.cast("int").cast("string"), F.lit("NA")),
    )
    return F.when(sex.isNotNull() | width.isNotNull(), text)


def split_class_label(label="size_sex") -> tuple[Column, Column]:
    """(sex name, width) from a 1 mm class label; 'NA' widths give NULL."""
    parts = F.split(column(label), "_")
    sex = F.when(parts.getItem(0) == "1", F.lit("Male")).otherwise(F.lit("Female"))
    return sex, parts.getItem(1).try_cast("double")


def recode(value, source, target) -> Column:
    value = column(value)
    return F.when(value == source, F.lit(target)).otherwise(value)


def station_key(station="station") -> Column:
    """Station name without hyphens."""
    return F.translate(column(station).cast("string"), "-", "")


def region_from_district(district="district", northern="NBS All") -> Column:
    district = column(district)
    return F.when(district == northern, F.lit("NBS")).when(
        district.isNotNull(), F.lit("EBS")
    )


def region_from_cruise(cruise="cruise", station="station") -> Column:
    """NBS for even cruise numbers and for stations named so, else EBS."""
    cruise, station = column(cruise), column(station).cast("string")
    return (
        F.when(station.contains("NBS"), F.lit("NBS"))
        .when(cruise % 2 == 0, F.lit("NBS"))
        .when(cruise.isNotNull(), F.lit("EBS"))
    )


def sex_from_group(group) -> Column:
    return F.when(column(group).contains("FEM"), F.lit("Female")).otherwise(F.lit("Male"))


def degrees_east(lon="lon") -> Column:
    return column(lon) + 360.0


def fourth_root(value) -> Column:
    return F.pow(column(value), F.lit(0.25))


def log_positive(value) -> Column:
    """Natural logarithm, NULL for zero and below."""
    value = column(value)
    return F.when(value > 0, F.ln(value))


def log_plus_one(value) -> Column:
    return F.log1p(column(value))


def log10_plus(value, shift: float = 10.0) -> Column:
    return F.log10(column(value) + F.lit(float(shift)))


def squared(value) -> Column:
    return column(value) * column(value)


def presence(value, scale: float = 1.0e10) -> Column:
    """1 for a positive catch, 0 for none."""
    return F.ceil(column(value) / F.lit(float(scale))).cast("int")


def zero_to_null(value) -> Column:
    value = column(value)
    return F.when(value != 0, value)


def null_to_zero(value) -> Column:
    return F.coalesce(column(value), F.lit(0.0))


def floor_at_zero(value) -> Column:
    value = column(value)
    return F.when(value > 0, value).when(value.isNotNull(), F.lit(0.0))


def normal_ci(estimate, se, level: float = 0.95, z: float | None = None) -> tuple[Column, Column]:
    """Lower and upper normal limit; ``z`` overrides the exact quantile."""
    if z is None:
        z = NormalDist().inv_cdf(0.5 + level / 2)
    estimate, se = column(estimate), column(se)
    return estimate - z * se, estimate + z * se


def project_nm(lon, lat, mode, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Nautical miles east and north of an origin.

    ``mode`` is None (identity), 'mean' (cosine of the origin latitude),
    'cosine' (cosine of each latitude) or a number used as the cosine.
    """
    lon, lat = column(lon), column(lat)
    if mode is None:
        return lon, lat
    return (lon - lon0) * 60.0 * _cosine(mode, lat, lat0), (lat - lat0) * 60.0


def projection_origin(df, lon, lat) -> tuple[float, float]:
    """The default origin of a projection: the least longitude and latitude of the data.

    NULLs are passed over; without any position the origin is (0, 0).
    """
    least = df.agg(F.min(column(lon)), F.min(column(lat))).first()
    return tuple(0.0 if v is None else float(v) for v in least)


def unproject_nm(x, y, mode, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Degrees from nautical miles; the inverse of :func:`project_nm`."""
    x, y = column(x), column(y)
    if mode is None:
        return x, y
    lat = y / 60.0 + lat0
    return safe_div(x, 60.0 * _cosine(mode, lat, lat0)) + lon0, lat


def _cosine(mode, lat: Column, lat0: float) -> Column:
    if mode == "mean":
        return F.lit(math.cos(math.radians(lat0)))
    if mode == "cosine":
        return F.cos(F.radians(lat))
    return F.lit(float(mode))


def inside_polygon(x, y, polygon) -> Column:
    """Whether (x, y) lies in a polygon given as [(x, y), ...].

    Counts the edges a ray to the right crosses; the edges are one literal
    array folded inside the expression, so there is no join.
    """
    x, y = column(x), column(y)
    corners = [(float(a), float(b)) for a, b in polygon]
    edges = F.array(*[
        F.struct(
            F.lit(x1).alias("x1"), F.lit(y1).alias("y1"),
            F.lit(x2).alias("x2"), F.lit(y2).alias("y2"),
        )
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1])
        if y1 != y2
    ])

    def crosses(edge):
        spans = (edge["y1"] > y) != (edge["y2"] > y)
        at = edge["x1"] + (y - edge["y1"]) / (edge["y2"] - edge["y1"]) * (edge["x2"] - edge["x1"])
        return F.when(spans & (x < at), 1).otherwise(0)

    crossings = F.aggregate(edges, F.lit(0), lambda total, edge: total + crosses(edge))
    return crossings % 2 == 1
