"""Rules on single values: bands, verdicts, scores, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import fixed

#: Fixed values of the site discovery.
EXCLUDED_REGIONS = ["Jersey", "Guernsey", "Isle of Man"]
STRONG_FORMATS = ["Superstore", "Supercentre", "Extra", "Food Warehouse", "Retail Park"]
RETAILER_SCORES = {"Asda": 3, "Tesco": 3, "Sainsburys": 3, "Morrisons": 3, "Aldi": 2, "Lidl": 2, "Iceland": 2, "Waitrose": 2, "Marks and Spencer": 1}
SIZE_SCORES = {"30,138 ft2 > (2,800 m2)": 3, "15,069 < 30,138 ft2 (1,400 < 2,800 m2)": 2, "3,013 < 15,069 ft2 (280 < 1,400 m2)": 1}
EXCLUDED_FORMATS = ["Express", "Local", "PFS", "Petrol", "BP", "Esso", "Shell", "Hospital", "Travel", "MSA", "Motorway", "Food To Go", "Outlet"]
FOCUS_REGIONS = [
    "Greater London", "Essex", "Kent", "Surrey", "West Sussex", "East Sussex", "Gloucestershire", "Bristol", "West Midlands", "Cardiff",
    "Hampshire", "Berkshire", "Buckinghamshire", "Oxfordshire", "Wiltshire", "Dorset", "Somerset", "Cambridgeshire", "Hertfordshire", "Bedfordshire",
]
INSPECTED_POSTCODES = [
    "BS10 7EN", "RH10 9BN", "RH12 1AJ", "RM7 0AN", "TN24 0SE", "CV6 3EX", "CO12 3HJ", "CT11 9TT", "B33 9AN", "TW4 7DN", "BN12 4AL",
    "GL52 8NF", "CF23 9AN", "RH13 5PX", "E6 1NN", "TW9 4AD", "ME20 6PW", "SE28 8RD", "DA16 1QL", "HA1 4HX", "CO3 8AA", "KT1 1BU",
    "E4 8HP", "IG10 4PE", "CR3 5QX", "IG8 8GE", "IG11 7BS", "CO4 3BQ", "BN27 1BE", "KT3 4HE", "BS6 7XW",
]
SHORTLIST_COLUMNS = ["id", "retailer", "fascia", "store_name", "add_one", "town", "county", "postcode", "long_wgs", "lat_wgs", "pqi", "size_band", "candidate_score"]
SHORTLIST_BLANKS = ["accepted", "surface_car_park_visible", "capacity_estimable", "exclude_reason", "proposed_split"]
#: Fixed thresholds used where no selected one is at hand.
FALLBACK_THRESHOLDS = {"baseline": 0.004, "transfer": 0.012, "uk_adapt": 0.477}
#: Fixed bounds of valid coordinates.
LON, LAT = (-8.5, 2.5), (49.0, 61.0)


def size_band(capacity: Column) -> Column:
    """Below 75 Small, to 200 Medium, else (unknown too) Large."""
    return F.when(capacity < 75, "Small").when(capacity <= 200, "Medium").otherwise("Large")


def verdict(ratio: Column, rho: Column) -> Column:
    near = (ratio < 0.95) & (rho.isNull() | F.isnan(rho) | (rho < 0))
    return F.when(near, "clusters near entrance").when(ratio > 1.05, "away from entrance").otherwise("no clear gradient")


def progress(first: Column, second: Column) -> Column:
    """Which of two counts are positive: done, partial or todo."""
    a, b = first > 0, second > 0
    return F.when(a & b, "done").when(a | b, "partial").otherwise("todo")


def split_of(name: Column, val: list, test: list) -> Column:
    """test wins over val; anything else is train."""
    return F.when(name.isin(test), "test").when(name.isin(val), "val").otherwise("train")


def split_folder(registry_split: Column) -> Column:
    """Null for a split that has no folder."""
    return F.when(registry_split == "uk_train_calibration", "calibration").when(registry_split == "uk_test", "test")


def matches_any(column: Column, terms: list[str]) -> Column:
    """Case-insensitive search for any term; null doesn't match."""
    return F.coalesce(column.rlike("(?i)" + "|".join(terms)), F.lit(False))


def lookup(column: Column, scores: dict[str, int]) -> Column:
    """A value by name, 0 where there is none."""
    pairs = [x for k, v in scores.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(0))


def valid_coordinates(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(*LON) & lat.between(*LAT), F.lit(False))


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole; null where whole is 0."""
    return F.try_divide(F.lit(scale) * part, whole.cast("double"))


def metric_text(value: Column) -> Column:
    """Four decimals, or n/a for an absent or negative value."""
    return F.when(value.isNull() | (value < 0), "n/a").otherwise(fixed(value, 4))
