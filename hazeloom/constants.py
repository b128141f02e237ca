"""Fixed values of the domain: they decide results, so they are stated as plain text."""

# --- Fixed values: calendar -------------------------------------------------------------
SEASONS = {
    "winter": [12, 1, 2],
    "pre_monsoon": [3, 4, 5],
    "monsoon": [6, 7, 8, 9],
    "post_monsoon": [10, 11],
}
HEATING_MONTHS = [11, 12, 1, 2]
BURNING_MONTHS = [10, 11]
DAYS_IN_CYCLE = 366.0

# --- Fixed values: thresholds ---------------------------------------------------------------
EXTREME_UGM3 = 150.0
TARGET_FLOOR_UGM3 = 5.0
MIN_VALID_HOURS = 18
SEGMENT_GAP_DAYS = 2.0
CALM_WIND_MS = 2.0
STAGNANT_BLH_M = 300.0
QA_THRESHOLD = 0.75
MIN_VALID_PIXELS = 5
AOD_VALID_RANGE = (-0.05, 5.0)
RASTER_SANITY_LIMIT = 1e12

# --- Fixed values: prediction grid (north-up, degrees) --------------------------------------
GRID_LAT_MAX = 37.3
GRID_LAT_MIN = 23.3
GRID_LON_MIN = 60.5
GRID_LON_MAX = 77.9
GRID_RES = 0.1
GRID_ROWS = 141
GRID_COLS = 175
GRID_CELLS = 24675
NODATA = -9999.0

# --- Fixed values: geometry ------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG_LON = 111.32
KM_PER_DEG_LAT_BLOCK = 110.57
KM_PER_DEG_LAT_PIXEL = 110.54
KM_PER_DEG_SPLAT = 111.0
SINUSOIDAL_RADIUS_M = 6371007.181
SINUSOIDAL_X_MIN = -20015109.353729
SINUSOIDAL_Y_MAX = 10007554.676865
SINUSOIDAL_TILE_M = 1111950.5197665554
SINUSOIDAL_TILE_PIXELS = 1200
SINUSOIDAL_H_MAX = 35
SINUSOIDAL_V_MAX = 17

# --- Fixed values: AQI (concentration low, high, index low, high) ----------------------------
AQI_BANDS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
AQI_CATEGORY_UPPER = [9.0, 35.4, 55.4, 125.4, 225.4]
AQI_CATEGORY_LABELS = [
    "Good",
    "Moderate",
    "Unhealthy (SG)",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
]

# --- Fixed values: satellite gas products ----------------------------------------------------
GAS_PRODUCTS = ["no2", "so2", "co", "hcho", "aai", "alh", "ch4", "cloud", "o3", "nh3"]

# --- Fixed values: feature-name patterns per stage (matched on the lower-cased name) ----------
META_NAMES = ["date", "date_utc", "latitude", "longitude", "grid_id", "row", "col", "snapped_flag", "dt_days"]
META_PREFIXES = ["grid_", "__", "snap_", "agg_"]
STATIC_PATTERNS = [r"\bslope\b", r"\baspect\b", r"\blandcover\b", r"\burban\b"]
MET_PATTERNS = [
    r"^(t2m|d2m|u10|v10|u100|v100|sp|tp|blh|rh|vpd|ws10|ws100|vc|msl|tcc|clr|q|theta)\b",
    r"^(wd10|wd100|dws|dwd|vci|stagnant|highrh|calm\d+)\b",
    r"^(heating_season_flag|burning_season_flag)$",
    r"^(blh|mslp|sp|dt)_tend\b",
    r"_daily_(mean|max|min|sum)$",
    r"_roll(mean|std|min|max)_(\d+)d$",
    r"_lag(\d+)d$",
    r"_anom_(\d+)d$",
    r"^wd10_(sin|cos|var)(_rm_\d+d)?$",
    r"^doy_(sin|cos)(_\d+)?$",
]
AOD_PATTERNS = [
    r"\baod\b",
    r"\bmaiac\b",
    r"\boptical[_-]?depth\b",
    r"\bod(047|055|066)\b",
    r"\boptical[_-]?depth[_-]?(047|055|066)\b",
    r"\bdeep[_-]?blue\b",
    r"\baod[_-]?uncertainty\b",
    r"\bqa[_-]?(cloudmask|adjacency|aod|n_pixels)\b",
    r"\baod[_-]?(total|files|window)",
    r"^optical_depth_\d+$",
]
GAS_PATTERNS = [
    r"\btropomi\b",
    r"^(no2|so2|co|hcho|o3|ch4|nh3|aai|alh|cloud)_",
    r"\baer(_|-)?ai\b",
    r"\bqa(_|-)?value\b",
]
GAS_STAGE = "tropomi"
STAGES = ["meta", "static", "met", "aod", "tropomi", "unknown"]
