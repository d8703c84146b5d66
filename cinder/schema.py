"""Column names, types and fixed values shared by every operator.

Fixed values below must equal the reference's for results to agree; they are
stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: canonical predictor list (order fixed) ------------------
FEATURES = [
    "DEM", "slope", "aspect", "b1", "relative_humidity", "total_precipitation_sum",
    "temperature_2m", "temperature_2m_min", "temperature_2m_max", "build_up_index",
    "drought_code", "duff_moisture_code", "fine_fuel_moisture_code",
    "fire_weather_index", "initial_fire_spread_index",
]
CATEGORICAL = ["b1"]
# Columns that are never model inputs.
NON_FEATURES = ["fraction", "burned", "bin", "year", "month", "latitude", "longitude"]

# --- fixed values: coarse-grid aggregation rule per predictor --------------
COARSE_MIN = ["relative_humidity", "total_precipitation_sum"]
COARSE_MAX = [
    "temperature_2m", "temperature_2m_min", "temperature_2m_max", "build_up_index",
    "drought_code", "duff_moisture_code", "fine_fuel_moisture_code",
    "fire_weather_index", "initial_fire_spread_index",
]
COARSE_MODE = ["b1"]  # every other predictor: mean

# --- fixed values: land-cover code -> label (default "Unknown") -------------
LAND_COVER = {
    0: "Unclassified", 6: "Poplar forest", 7: "Oak forest", 10: "Pine forest",
    11: "Fir forest", 12: "Aspen forest", 13: "Hemlock forest", 14: "Spruce forest",
    15: "White Spruce", 16: "Black Spruce", 17: "Mixed forest", 18: "Larch forest",
    19: "Birch forest", 20: "Scotts Pine forest", 21: "Jack Pine forest",
    22: "Cedar forest", 23: "Maple", 24: "Siberian Pine", 25: "Linden",
    26: "Cedar Elfin Wood", 30: "Alpine shrubland", 31: "Riparian shrubland",
    32: "Other shrubland", 33: "Herbaceous", 35: "Sparsely Vegetated",
    50: "Bog", 51: "Fen", 52: "Marsh", 60: "Erect-shrub tundra",
    61: "Prostrate-shrub tundra", 62: "Shrub tundra", 63: "Graminoid tundra",
    64: "Wet-sedge tundra", 65: "Barren tundra", 70: "Developed",
    98: "Snow/Ice", 99: "Other",
}
LAND_COVER_DEFAULT = "Unknown"

# --- fixed values: burn-count categories ------------------------------------
BURN_CATEGORIES = ["0: Never Burned", "1-5 Times", "6-10 Times", "11+ Times (Hyper-Active)"]

# --- fixed values: confusion labels -----------------------------------------
CONFUSION_LABELS = ["TP", "FN", "TN", "FP", "NA"]

# --- fixed values: thresholds and constants ---------------------------------
PIXEL_BURN_THRESHOLD = 0.5          # burned if fraction > 0.5
CELL_BURN_THRESHOLD = 0.05          # coarse cell burnable if burned share >= 0.05
SWEEP_EPS = 1e-7                    # grid sweep metric epsilon
MAX_F1_EPS = 1e-12                  # PR-curve F1 epsilon
NO_BURN_THRESHOLD = 0.99            # area-match threshold when no pixel burned
RESCALE_K = 99.0                    # odds rescale moving 0.99 to 0.5
PIXEL_AREA_HA_4KM = 1600.0          # 4 km pixel
METRES_PER_DEGREE = 111320.0
NEG_POS_RATIO_FULL = 4169.10        # recorded negative:positive ratio, full data
BIN_EPS = 1e-8                      # fraction-bin edge tolerance
# fraction bins: 0 -> (<= 0), 1 -> [0.01, 0.33], 2 -> [0.34, 0.66], 3 -> [0.67, 1.00]
FRACTION_BINS = [(1, 0.01, 0.33), (2, 0.34, 0.66), (3, 0.67, 1.00)]
# physical rules: drop if RH > 80, T < 270, FFMC < 50, ISI < 2
PHYS_RULES = {"relative_humidity": (">", 80.0), "temperature_2m": ("<", 270.0),
              "fine_fuel_moisture_code": ("<", 50.0), "initial_fire_spread_index": ("<", 2.0)}
FWI_NONNEG = ["build_up_index", "drought_code", "duff_moisture_code", "fine_fuel_moisture_code"]
# alias table bridging old and new band names
NAME_ALIASES = {"initial_spread_index": "initial_fire_spread_index"}

PIXEL_KEY = ["grid_row", "grid_col"]
PIXEL_MONTH_KEY = ["grid_row", "grid_col", "year", "month"]

PIXEL_MONTH_SCHEMA = T.StructType(
    [T.StructField("grid_row", T.IntegerType()), T.StructField("grid_col", T.IntegerType()),
     T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
     T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType()),
     T.StructField("fraction", T.DoubleType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)
