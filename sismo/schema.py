"""Schemas and the constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
BIN_SIZE = 0.5                    # cell size in degrees
FIRST_YEAR = 2008                 # first history year
LAST_YEAR = 2025                  # last history year
TARGET_YEAR = 2026                # forecast year
MIN_YEARS = 3                     # min distinct years for a cell series
SEQUENCE_LENGTH = 5               # forecaster window
TOP_K = 15                        # hotspots shown by default
W_COUNT = 0.8                     # heat weight of the count term
W_MAG = 0.2                       # heat weight of the magnitude term
N_SIGMA = 3.0                     # anomaly threshold = mean + 3 * std
FALLBACK_THRESHOLD = 0.0001606588873608411
N_CLUSTERS = 2
SEED = 42
HIST_BINS = 50
HIST_STEP = 0.2
MAP_SAMPLE = 5000
CORR_SAMPLE = 10000
MARKER_CAP = 5000
KDE_GRID = 200
KDE_CUT = 3.0
AE_LAYERS = (4, 64, 32, 10, 32, 64, 4)        # autoencoder widths
AE_LATENT_LAYER = 3                            # index of the 10-wide layer
AE_EPOCHS = 30
AE_BATCH = 256
AE_VALIDATION = 0.1
FORECAST_EPOCHS = 30
FORECAST_BATCH = 32
TRAIN_FRACTION = 0.8
SPLIT_MIN_ROWS = 10
RANGE_CHECKS = (("magnitude", 0.0, 10.0), ("depth", 0.0, 700.0),
                ("latitude", -90.0, 90.0), ("longitude", -180.0, 180.0))
DEFAULT_BOUNDS_MAIN = (-11.0, 6.0, 95.0, 141.0)   # lat min, lat max, lon min, lon max
PAD_CELLS_MAIN = 5
PAD_CELLS_OTHER = 3
OTHER_CENTER_SPAN = 5.0
METHOD_LSTM = "LSTM (Deep Learning)"
METHOD_FREQUENCY = "Frequency-Based (Statistik)"
METHOD_UNKNOWN = "Unknown"
METHOD_LINEAR = "Linear Regression"
METHOD_GBT = "Gradient Boosted Trees"
METHOD_RF = "Random Forest"
METHOD_WEIGHTED = "Weighted Average"
NOT_AVAILABLE_LONG = "Tidak tersedia"
NOT_AVAILABLE = "N/A"
TYPE_HISTORICAL = "Historical"
TYPE_PREDICTED = "Predicted"
DATETIME_LABEL_FORMAT = "dd MMMM yyyy, HH:mm:ss 'WIB'"
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "HH:mm:ss"
# Date spellings brought to year-month-day: (pattern, replacement), in order.
# With slashes and the year last, the month comes first.
DATE_REWRITES = ((r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"),
                 (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"))
# ---------------------------------------------------------------------------

FEATURES = ("magnitude", "depth", "latitude", "longitude")

CATALOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("magnitude", T.DoubleType()),
    T.StructField("depth", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("location", T.StringType()),
])


HOTSPOT_SCHEMA = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("count", T.LongType()),
    T.StructField("historical_count", T.LongType()),
    T.StructField("mag", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])

PREDICTION_DOC_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("hotspot_points", T.ArrayType(HOTSPOT_SCHEMA)),
    T.StructField("timestamp", T.StringType()),
])

REQUIRED_COLUMNS = ("datetime", "magnitude", "depth", "latitude", "longitude")
