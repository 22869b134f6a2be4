"""Fixed values of the analysis domain; the operators take all of them as parameters."""

# thresholds of the surface classes (fixed values)
NDSI_LIGHT, NDSI_SOLID, NDWI_WATER = 0.40, 0.70, 0.20
VIS_BRIGHT_MIN, NIR_BRIGHT_MIN = 0.10, 0.17
INDEX_EPSILON, DENOMINATOR_FLOOR, VOID_TOLERANCE = 1e-6, 0.02, 1e-4
QUANTIFICATION, OFFSET, OFFSET_BASELINE, OFFSET_FROM = 10000.0, -0.1, 4, "2022-01-25"
NODATA_SHARE, USABLE_SHARE = 0.20, 0.30
# catalogue guards (fixed values)
MAX_LON_SPAN, MAX_LAT_SPAN, MIN_COVERAGE = 20.0, 10.0, 0.10
BLANK_BAND, NOT_BLANK_SCENE, PARTIAL_SPREAD = 0.95, 0.50, 0.25
# season windows, in days of the year, and the first late season (fixed values)
SEASON, LIGHT_SEASON, FROZEN = (53, 180), (45, 180), (45, 105)
LATE_FROM = 2021
# other instruments (fixed values)
FREEZING_K = 271.35
LEVEL2_SCALE, LEVEL2_OFFSET = 0.0000275, -0.2
QA_BITS = (0, 1, 3, 4)
RADAR_FLOOR, RADAR_VALID, RADAR_CONTRAST = 1e-8, 0.98, 0.0
ICE_VERDICT, WATER_VERDICT = 0.75, 0.25
BREAKUP_THRESHOLD = 0.15

#: Classes of the raster, in the order in which a later one replaces an earlier one (fixed values).
CLASSES = {0: "unclassified", 1: "nodata", 2: "land", 3: "cloud", 4: "ice_solid", 5: "ice_light", 6: "water"}
#: Columns of a scene summary, in their fixed order.
COUNTS = ("solid_px", "light_px", "water_px", "cloud_px", "land_px", "nodata_px")
SHARES = ("solid_pct", "light_pct", "water_pct", "cloud_pct", "land_pct", "nodata_pct")
