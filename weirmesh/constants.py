"""Fixed values of the data contract (distances in metres, plane coordinates)."""

MATCH_TOLERANCE = 30
FUSION_RADIUS = 50
DEDUP_RADIUS = 50
RIVER_TOLERANCE = 30
CONFIRMED_CONFIDENCE = 0.85
NDWI_THRESHOLD = 0.2
MIN_WATER_AREA = 200
WATER_FRACTION_CONFIRM = 0.01
EXCESS_AREA = 400
EXCESS_FRACTION = 0.3
DEFAULT_HALF_WIDTH = 10
HALF_WIDTH_BY_STRAHLER = {1: 3, 2: 4, 3: 6, 4: 10, 5: 15, 6: 25, 7: 40, 8: 60, 9: 80}
TILE_SIZE, SNAPPED_TILE = 5000, 500
AOI_BUFFER = 200
CHUNK_CORE, CHUNK_BUFFER = 40000, 5000
STEP_WINDOW, STEP_UP, STEP_DOWN, STEP_RATIO, STEP_ACCUM = 6, 0.015, 0.05, 3.0, 500
SOURCE_PRIORITY = {"SNCZI": 0, "DAM_OR_WEIR": 1, "ANDALUCIA_DERA": 2, "AMBER": 3, "OSM": 4}
SOURCE_PRIORITY_MICRO = {"SNCZI": 0, "ANDALUCIA_DERA": 1, "AMBER": 2, "OSM": 3}
STAGES = ("imagery", "layer1", "layer2", "layer3", "layer4", "fusion")
STATUSES = ("pending", "done", "failed")
TERMINAL_STATUSES = ("OK", "NO_COVERAGE", "mask_error")
WATER_HSV = ((35, 25, 20), (140, 255, 220))
BOX_LEAST_AREA, BOX_REACH, BOX_MOST_OF_FRAME = 400, 0.35, 0.85
RATE_LIMIT_DELAYS = (30, 120, 300)
SAMPLE_SIZE, SAMPLE_GRID, HOLDOUT_FRACTION = 100, 10, 0.2
OUTPUT_COLUMNS = (
    "lat", "lon", "layers", "n_layers", "confidence", "per_layer_confidence", "match_status",
    "matched_source", "matched_source_id", "matched_distance_m", "source_refs",
)
