"""Published codes, thresholds and word lists the results depend on."""

# --- fixed values: sale register code letters -------------------------------
SALE_TYPE_CODES = {"D": "detached", "S": "semi_detached", "T": "terraced", "F": "flat", "O": "other"}
TENURE_CODES = {"F": "freehold", "L": "leasehold", "U": "unknown"}
BASIS_CODES = {"A": "STANDARD", "B": "ADDITIONAL"}
REGISTER_COLUMNS = [
    "record_id", "price", "date", "postcode", "type", "new_build", "duration", "paon", "saon",
    "street", "locality", "town", "district", "county", "category", "status",
]
MIN_REGISTER_PRICE = 100.0

# --- fixed values: street-type and compass abbreviations --------------------
STREET_WORDS = {
    "ST": "STREET", "STR": "STREET", "RD": "ROAD", "AVE": "AVENUE", "AV": "AVENUE", "LN": "LANE",
    "DR": "DRIVE", "CT": "COURT", "CRT": "COURT", "PL": "PLACE", "SQ": "SQUARE", "CL": "CLOSE",
    "CLS": "CLOSE", "CRES": "CRESCENT", "GDNS": "GARDENS", "GDN": "GARDEN", "TER": "TERRACE",
    "TERR": "TERRACE", "PK": "PARK", "BLVD": "BOULEVARD", "HTS": "HEIGHTS", "MT": "MOUNT",
    "GRN": "GREEN", "GR": "GROVE", "WLK": "WALK", "YD": "YARD", "WY": "WAY", "MEWS": "MEWS",
    "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NTH": "NORTH", "STH": "SOUTH",
}
SUBUNIT_WORDS = ["FLAT", "APARTMENT", "APT", "APPT", "UNIT", "ROOM", "SUITE", "MAISONETTE", "STUDIO"]

# --- fixed values: transfer file codes and plausibility bounds --------------
TRANSFER_TYPES = {"Maison": "house", "Appartement": "flat"}
TRANSFER_COMMERCIAL = ["Local industriel. commercial ou assimilé"]
TRANSFER_SALE_NATURE = "Vente"
TRANSFER_MIN_PRICE, TRANSFER_MIN_AREA = 5000.0, 8.0
TRANSFER_PPSM = (150.0, 60000.0)

# --- fixed values: area statistics ------------------------------------------
LEVEL_MIN_SALES = {"country": 50, "county": 25, "district": 15, "outcode": 8, "sector": 5}
AREA_SEGMENTS = ["all", "detached", "semi_detached", "terraced", "flat", "house"]
LIVE_MIN_SALES = 2
LIVE_WINDOW_YEARS = 3
QUARTER_MIN_SALES = 30
YEAR_MIN_SALES = 30

# --- fixed values: wide index file layout -----------------------------------
# segment -> (price, index, 1-month change, 12-month change, volume) columns
WIDE_INDEX_COLUMNS = {
    "all": ("AveragePrice", "Index", "1m%Change", "12m%Change", "SalesVolume"),
    "detached": ("DetachedPrice", "DetachedIndex", "Detached1m%Change", "Detached12m%Change", None),
    "semi_detached": ("SemiDetachedPrice", "SemiDetachedIndex", "SemiDetached1m%Change",
                      "SemiDetached12m%Change", None),
    "terraced": ("TerracedPrice", "TerracedIndex", "Terraced1m%Change", "Terraced12m%Change", None),
    "flat": ("FlatPrice", "FlatIndex", "Flat1m%Change", "Flat12m%Change", None),
}
COUNTRY_CODE_PREFIXES = ["E92", "W92", "S92", "N92"]
REGION_CODE_PREFIX = "E12"
AUTHORITY_CODE_PREFIXES = ["E06", "E07", "E08", "E09", "W06", "S12", "N09"]
NUMERIC_NULLS = ["NA", "N/A", ":", "-"]

# --- fixed values: abolished district -> successor authority ----------------
DISTRICT_SUCCESSORS = {
    "Harrogate": "North Yorkshire", "Scarborough": "North Yorkshire", "Selby": "North Yorkshire",
    "Hambleton": "North Yorkshire", "Craven": "North Yorkshire", "Ryedale": "North Yorkshire",
    "Richmondshire": "North Yorkshire",
    "Somerset West And Taunton": "Somerset", "Sedgemoor": "Somerset", "Mendip": "Somerset",
    "South Somerset": "Somerset", "Taunton Deane": "Somerset", "West Somerset": "Somerset",
    "Carlisle": "Cumberland", "Allerdale": "Cumberland", "Copeland": "Cumberland",
    "South Lakeland": "Westmorland and Furness", "Barrow In Furness": "Westmorland and Furness",
    "Eden": "Westmorland and Furness",
    "Kettering": "North Northamptonshire", "Wellingborough": "North Northamptonshire",
    "Corby": "North Northamptonshire", "East Northamptonshire": "North Northamptonshire",
    "Daventry": "West Northamptonshire", "South Northamptonshire": "West Northamptonshire",
    "Northampton": "West Northamptonshire",
    "Wrekin": "Telford and Wrekin", "Isles Of Scilly": "Isles of Scilly",
}
FUZZY_FLOOR = 0.55

# --- fixed values: statistical cubes ----------------------------------------
CUBE_AGGREGATES = ["EU", "EU27_2020", "EU28", "EU15", "EU25", "EA", "EA11", "EA12", "EA13", "EA15",
                   "EA16", "EA17", "EA18", "EA19", "EA20", "EA21"]
CUBE_ISO_FIXES = {"EL": "GR", "UK": "GB"}
INDEX_FLAVOURS = ["purchase-only", "all-transactions"]
PROVINCE_ALIASES = {"Fryslân": "Friesland"}
SWEDISH_PRICE_CODE, SWEDISH_COUNT_CODE = "BO0501O4", "BO0501O3"
AUSTRALIAN_STATES = {
    "AUS": "Australia", "1": "New South Wales", "2": "Victoria", "3": "Queensland",
    "4": "South Australia", "5": "Western Australia", "6": "Tasmania", "7": "Northern Territory",
    "8": "Australian Capital Territory",
}
CENSUS_VALUE, CENSUS_MARGIN = "B25077_001E", "B25077_001M"
CENSUS_NULLS = ["-666666666", "-999999999", "", "null"]
CENSUS_MAX_MARGIN = 1 / 3
SHAPE_NULLS = ["-99", "-1", "None"]

# --- fixed values: constituent country by postcode area ---------------------
SCOTTISH_AREAS = ["AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH",
                  "TD", "ZE"]
WELSH_AREAS = ["CF", "LL", "NP", "SA"]
NORTHERN_IRISH_AREAS = ["BT"]
UK_REGION_CODES = {"Scotland": "GB-SCT", "Northern Ireland": "GB-NIR"}
UK_COVERED = ["England", "Wales"]
NI_ENVELOPE = (-8.20, 53.95, -5.43, 55.28)
COASTAL_TOLERANCE_M = 15000.0
REGION_MATCH_M = 25000.0

# --- fixed values: country -> currency --------------------------------------
COUNTRY_CURRENCY = {
    "AT": "EUR", "BE": "EUR", "CY": "EUR", "DE": "EUR", "EE": "EUR", "ES": "EUR", "FI": "EUR",
    "FR": "EUR", "GR": "EUR", "HR": "EUR", "IE": "EUR", "IT": "EUR", "LT": "EUR", "LU": "EUR",
    "LV": "EUR", "MT": "EUR", "NL": "EUR", "PT": "EUR", "SI": "EUR", "SK": "EUR", "BG": "EUR",
    "GB": "GBP", "CH": "CHF", "CZ": "CZK", "DK": "DKK", "HU": "HUF", "IS": "ISK", "NO": "NOK",
    "PL": "PLN", "RO": "RON", "SE": "SEK", "TR": "TRY", "RS": "RSD", "UA": "UAH",
    "US": "USD", "CA": "CAD", "AU": "AUD", "NZ": "NZD", "IN": "INR", "JP": "JPY", "ZA": "ZAR",
    "BR": "BRL", "SG": "SGD", "HK": "HKD", "KR": "KRW", "CN": "CNY", "MX": "MXN", "AE": "AED",
    "IL": "ILS",
}

# --- fixed values: zoom ladder ----------------------------------------------
# (lowest zoom, tier, area level, row limit), finest first
ZOOM_LADDER = [
    (14.5, "PROPERTY", None, 400),
    (13.2, "STREET", "street", 350),
    (12.0, "POSTCODE", "postcode", 300),
    (10.5, "NEIGHBOURHOOD", "sector", 250),
    (9.0, "CITY", "outcode", 200),
    (7.0, "REGION", "district", 200),
    (4.5, "COUNTRY", "county", 150),
    (0.0, "WORLD", "country", 120),
]
TIERS = ["WORLD", "COUNTRY", "REGION", "CITY", "NEIGHBOURHOOD", "POSTCODE", "STREET", "PROPERTY"]
LEVEL_OVERRIDES = {"FR": {"REGION": "county", "CITY": "district", "NEIGHBOURHOOD": "sector"}}
LEVELS_FINE_TO_COARSE = ["street", "postcode", "sector", "outcode", "district", "county", "state",
                         "country"]
LIVE_LEVELS = ["postcode", "street"]
PRECISIONS = ["EXACT_TRANSACTION", "PROPERTY_ESTIMATE", "STREET_POSTCODE", "NEIGHBOURHOOD",
              "CITY_REGIONAL", "NONE"]
TIER_PRECISION = {
    "PROPERTY": "PROPERTY_ESTIMATE", "STREET": "STREET_POSTCODE", "POSTCODE": "STREET_POSTCODE",
    "NEIGHBOURHOOD": "NEIGHBOURHOOD", "CITY": "CITY_REGIONAL", "REGION": "CITY_REGIONAL",
    "COUNTRY": "CITY_REGIONAL", "WORLD": "CITY_REGIONAL",
}
LEVEL_PRECISION = {
    "street": "STREET_POSTCODE", "postcode": "STREET_POSTCODE", "sector": "STREET_POSTCODE",
    "outcode": "NEIGHBOURHOOD", "district": "NEIGHBOURHOOD", "county": "CITY_REGIONAL",
    "state": "CITY_REGIONAL", "country": "CITY_REGIONAL",
}
LEVEL_TIER = {
    "street": "STREET", "postcode": "POSTCODE", "sector": "POSTCODE", "outcode": "NEIGHBOURHOOD",
    "district": "CITY", "county": "REGION", "state": "REGION", "country": "COUNTRY",
}
MERCATOR_LAT = 85.05
MARKER_PX = (70.0, 46.0)
RING_STEP, RING_CAP = 0.00010, 0.00036

# --- fixed values: similarity of a sale to a dwelling -----------------------
WEIGHT_DISTANCE, WEIGHT_RECENCY, WEIGHT_SIZE = 0.58, 0.25, 0.17
DECAY_METRES, DECAY_MONTHS = 900.0, 30.0
TYPE_UNKNOWN, TYPE_UNLISTED = 0.45, 0.18
TYPE_AFFINITY = [
    ("semi_detached", "terraced", 0.62), ("semi_detached", "detached", 0.55),
    ("terraced", "flat", 0.30), ("detached", "terraced", 0.30), ("semi_detached", "flat", 0.22),
    ("detached", "flat", 0.12), ("house", "detached", 0.80), ("house", "semi_detached", 0.80),
    ("house", "terraced", 0.78), ("house", "flat", 0.20),
]

# --- fixed values: valuation ------------------------------------------------
MIN_COMPARABLES, MIN_EVIDENCE_WEIGHT, MIN_SIMILARITY = 3, 1.6, 0.35
MAX_HALF_WIDTH, DISPERSION_SHARE = 0.32, 0.73
OWN_MAX_SHARE, OWN_DECAY_YEARS = 0.55, 7.0
OWN_EVIDENCE_SHARE, OWN_EVIDENCE_OFFSET = 0.65, 4.0
NEAREST_LIMIT = 160
MIN_SERIES_POINTS, MAX_MONTH_GAP = 24, 6
GRADE_FLOORS = (4.2, 2.2, 0.6)
GRADE_HALF_WIDTH = {"HIGH": 0.075, "MEDIUM": 0.125, "LOW": 0.200, "VERY_LOW": 0.300}
BACKCAST_PER_YEAR, BACKCAST_CAP, BACKCAST_NONLOCAL, BACKCAST_BASE = 0.012, 0.22, 0.04, 0.12

# --- fixed values: forecast -------------------------------------------------
LONG_MONTHS, SHORT_MONTHS, MIN_FIT_MONTHS = 240, 48, 96
DAMPING, DRIFT_SHARE, MOMENTUM_SHARE = 0.945, 0.35, 0.0
SHRINK_MONTHS, PROVISIONAL_SIGMA, INTERVAL_Z = 120.0, 0.075, 1.2816
MAX_HORIZON_MONTHS = 120
HORIZONS = [12, 24, 36, 48, 60, 84, 120]
DRIFT_GRID = [0.0, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0]
MOMENTUM_GRID = [0.0, 0.25, 0.55, 0.8, 1.0]
MIN_BACKTEST_OBS = 20

# --- fixed values: coverage and export --------------------------------------
NO_DATA_TEXT = "Property price data is not currently available for this location."
EXPORT_TABLES = {
    "map": ["data_sources", "countries", "regions", "market_indices", "area_index_links",
            "area_stats", "provider_coverage", "forecasts", "ingestion_runs", "model_evaluations"],
    "full": ["data_sources", "countries", "regions", "postcodes", "properties", "transactions",
             "market_indices", "area_index_links", "area_stats", "provider_coverage", "forecasts",
             "ingestion_runs", "model_evaluations"],
}
EXPORT_FILTERS = {"lean": {"area_stats": "area_level <> 'sector'",
                           "market_indices": "period >= DATE '1995-01-01'"}}
EXPORT_NOTE = "Exported without single sales: area figures only, nothing for one dwelling."
EARTH_RADIUS_M = 6371008.771415
METRES_PER_DEGREE = 111320.0
