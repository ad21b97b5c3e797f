"""Values that results depend on and that therefore have to be exactly these.

Fixed values: vocabularies, lookup tables, thresholds and codes.  Nothing in
this module computes anything beyond naming them.
"""

# --- fixed values: strike record header aliases, per canonical field ---------
STRIKE_ALIASES = {
    "record_id": ["INDEX_NR", "RECORD_ID", "INDEX NR", "ID"],
    "incident_date": ["INCIDENT_DATE", "INCIDENT DATE", "DATE"],
    "incident_time_local": ["TIME", "INCIDENT_TIME", "LOCAL_TIME"],
    "airport_id": ["AIRPORT_ID", "AIRPORTID", "AIRPORT CODE"],
    "airport_name": ["AIRPORT", "AIRPORT_NAME", "AIRPORT NAME"],
    "state": ["STATE"],
    "latitude": ["LATITUDE", "LAT"],
    "longitude": ["LONGITUDE", "LON", "LONG"],
    "phase_of_flight": ["PHASE_OF_FLIGHT", "PHASE OF FLIGHT", "FLT_PHASE", "PHASE"],
    "height_agl_ft": ["HEIGHT", "HEIGHT_AGL", "HEIGHT (FT)"],
    "speed_ias_knots": ["SPEED", "IAS", "SPEED_IAS", "SPEED (KTS)"],
    "aircraft_make": ["AC_MAKE", "AIRCRAFT_MAKE", "MAKE"],
    "aircraft_model": ["AC_MODEL", "AIRCRAFT_MODEL", "MODEL"],
    "aircraft_type": ["AC_CLASS", "AIRCRAFT_TYPE", "AC_TYPE"],
    "aircraft_mass_class": ["AC_MASS", "AIRCRAFT_MASS", "MASS_CLASS"],
    "engine_type": ["ENG_TYPE", "ENGINE_TYPE", "TYPE_ENG"],
    "engine_count": ["NUM_ENGS", "ENGINE_COUNT", "NR_ENGINES"],
    "sky_condition": ["SKY", "SKY_CONDITION"],
    "precipitation": ["PRECIPITATION", "PRECIP"],
    "species_common_name": ["SPECIES", "SPECIES_NAME", "SPECIES_COMMON_NAME"],
    "species_scientific_name": ["SPECIES_ID", "SCIENTIFIC_NAME", "SPECIES_SCIENTIFIC_NAME"],
    "wildlife_size": ["SIZE", "WILDLIFE_SIZE"],
    "number_seen": ["NUM_SEEN", "NUMBER_SEEN"],
    "number_struck": ["NUM_STRUCK", "NUMBER_STRUCK"],
    "damage_flag": ["DAMAGE_IND", "DAMAGE_FLAG", "INDICATED_DAMAGE"],
    "damage_level": ["DAM_LEVEL", "DAMAGE_LEVEL"],
    "effect_on_flight": ["EFFECT", "EFFECT_ON_FLIGHT", "EFFECT_FLT"],
    "parts_struck": ["STR_PARTS", "PARTS_STRUCK"],
    "parts_damaged": ["DAM_PARTS", "PARTS_DAMAGED"],
    "repair_cost": ["COST_REPAIRS", "REPAIR_COST"],
    "other_cost": ["COST_OTHER", "OTHER_COST"],
    "injuries": ["NR_INJURIES", "INJURIES"],
    "fatalities": ["NR_FATALITIES", "FATALITIES"],
    "narrative": ["REMARKS", "NARRATIVE", "REMARKS_TEXT"],
}

# --- fixed values: outcome fields that may never be model inputs -------------
OUTCOME_FIELDS = [
    "damage_flag", "damage_level", "effect_on_flight", "parts_damaged", "repair_cost",
    "other_cost", "injuries", "fatalities", "narrative",
]
IDENTIFIER_FIELDS = ["record_id", "airport_name"]

# --- fixed values: raw strike-export columns barred from both feature modes --
RAW_FORBIDDEN = [
    "INDICATED_DAMAGE", "DAMAGE_LEVEL", "damage_binary", "damage_target_status", "damage_level_inconsistent",
    "STR_RAD", "DAM_RAD", "STR_WINDSHLD", "DAM_WINDSHLD", "STR_NOSE", "DAM_NOSE",
    "STR_ENG1", "DAM_ENG1", "ING_ENG1", "STR_ENG2", "DAM_ENG2", "ING_ENG2",
    "STR_ENG3", "DAM_ENG3", "ING_ENG3", "STR_ENG4", "DAM_ENG4", "ING_ENG4",
    "INGESTED_OTHER", "STR_PROP", "DAM_PROP", "STR_WING_ROT", "DAM_WING_ROT",
    "STR_FUSE", "DAM_FUSE", "STR_LG", "DAM_LG", "STR_TAIL", "DAM_TAIL",
    "STR_LGHTS", "DAM_LGHTS", "STR_OTHER", "DAM_OTHER", "OTHER_SPECIFY", "EFFECT", "EFFECT_OTHER",
    "COST_REPAIRS", "COST_OTHER", "COST_REPAIRS_INFL_ADJ", "COST_OTHER_INFL_ADJ", "AOS",
    "NR_INJURIES", "NR_FATALITIES",
    "SPECIES_ID", "SPECIES", "OUT_OF_RANGE_SPECIES", "SIZE", "BIRD_BAND_NUMBER",
    "NUM_SEEN", "NUM_STRUCK", "REMAINS_COLLECTED", "REMAINS_SENT",
    "REMARKS", "COMMENTS", "REPORTED_NAME", "REPORTED_TITLE", "REPORTED_DATE",
    "SOURCE", "PERSON", "LUPDATE", "TRANSFER", "IMAGE", "INDEX_NR", "REG", "FLT",
    "OPID", "ENROUTE_STATE", "LOCATION", "RUNWAY", "DISTANCE",
]
RAW_CONTROL = ["OPERATOR", "AC_CLASS", "INCIDENT_DATE", "INCIDENT_YEAR", "LATITUDE", "LONGITUDE"]
RAW_PREFLIGHT = [
    "AC_MASS", "TYPE_ENG", "NUM_ENGS", "ENG_1_POS", "ENG_2_POS", "ENG_3_POS", "ENG_4_POS",
    "AIRCRAFT", "AIRPORT_ID", "STATE", "FAAREGION", "SKY", "PRECIPITATION", "INCIDENT_MONTH",
]
RAW_ENCOUNTER = ["PHASE_OF_FLIGHT", "HEIGHT", "SPEED", "TIME_OF_DAY", "WARNED"]

# --- fixed values: raw columns normalised before population filters ----------
RAW_TEXT = [
    "OPERATOR", "AC_CLASS", "TYPE_ENG", "AC_MASS", "PHASE_OF_FLIGHT", "SKY", "PRECIPITATION",
    "TIME_OF_DAY", "WARNED", "STATE", "FAAREGION", "AIRPORT_ID", "ENG_1_POS", "ENG_2_POS",
    "ENG_3_POS", "ENG_4_POS", "INDICATED_DAMAGE", "DAMAGE_LEVEL", "AIRCRAFT",
]
RAW_NUMERIC = ["HEIGHT", "SPEED", "NUM_ENGS", "LATITUDE", "LONGITUDE", "INCIDENT_YEAR", "INCIDENT_MONTH"]

# --- fixed values: target vocabularies ---------------------------------------
DAMAGE_POSITIVE = ["Y", "YES", "TRUE", "1", "DAMAGE"]
DAMAGE_NEGATIVE = ["N", "NO", "FALSE", "0", "NONE", "N/A - NO DAMAGE"]
STATUS_POSITIVE, STATUS_NEGATIVE, STATUS_UNKNOWN = "explicit_positive", "explicit_negative", "missing_or_ambiguous"
INDICATED_YES, INDICATED_NO = ["1", "Y"], ["0", "N"]
LEVEL_DAMAGED, LEVEL_UNDAMAGED = ["M", "M?", "S", "D"], ["N", ""]
LEVEL_SEVERITY = {"M": 1.0, "M?": 1.0, "S": 2.0, "D": 3.0}
OPERATORS_BUSINESS_PRIVATE = ["BUSINESS", "PRIVATELY OWNED"]

# --- fixed values: species groups (scientific, common, group) ----------------
TAXONOMY = [
    ("Branta canadensis", "Canada Goose", "waterfowl"),
    ("Anser anser", "Greylag Goose", "waterfowl"),
    ("Anas platyrhynchos", "Mallard", "waterfowl"),
    ("Cygnus olor", "Mute Swan", "waterfowl"),
    ("Larus argentatus", "Herring Gull", "gull"),
    ("Larus marinus", "Great Black-backed Gull", "gull"),
    ("Chroicocephalus ridibundus", "Black-headed Gull", "gull"),
    ("Buteo buteo", "Common Buzzard", "raptor"),
    ("Falco tinnunculus", "Common Kestrel", "raptor"),
    ("Accipiter nisus", "Eurasian Sparrowhawk", "raptor"),
    ("Haliaeetus leucocephalus", "Bald Eagle", "raptor"),
    ("Ardea herodias", "Great Blue Heron", "large_bird"),
    ("Ardea cinerea", "Grey Heron", "large_bird"),
    ("Phalacrocorax carbo", "Great Cormorant", "large_bird"),
    ("Corvus brachyrhynchos", "American Crow", "songbird"),
    ("Corvus corax", "Common Raven", "songbird"),
    ("Sturnus vulgaris", "Common Starling", "songbird"),
    ("Turdus migratorius", "American Robin", "songbird"),
    ("Hirundo rustica", "Barn Swallow", "songbird"),
    ("Columba livia", "Rock Pigeon", "other"),
    ("Charadrius hiaticula", "Common Ringed Plover", "other"),
]
UNKNOWN_GROUP = "unknown"
LARGE_BODIED_GROUPS = ["large_bird", "waterfowl", "raptor"]

# --- fixed values: monitoring ------------------------------------------------
COUNT_TYPES = ["visible_migration", "capture", "nocturnal_flight_call", "other"]
PROVENANCE_FIELDS = [
    "source_name", "source_url", "download_date", "access_method", "permission_or_license",
    "contact_or_citation", "geographic_scope", "temporal_scope", "notes",
]
WIDE_METADATA = [
    "count_id", "site_id", "count_date", "start_time_local", "end_time_local", "observation_hours",
    "flight_direction", "count_type", "weather_notes", "observer_effort_available",
]
SEASON_NON_MONTH = [
    "row_type", "rank", "species", "total", "newly_ringed", "retraps", "maximum_count", "maximum_date",
    "maximum_url", "presence_percent", "presence_days", "first_date", "first_url", "last_date", "last_url",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CROSSTAB_METRICS = {
    "Combined (newly ringed + retraps)": "combined",
    "Newly ringed": "newly_ringed",
    "Retraps": "retraps",
}
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]  # 45 degrees apart, clockwise from north

# --- fixed values: regions, radii, windows -----------------------------------
REGIONS = {  # lon min, lat min, lon max, lat max (inclusive; tested in this order)
    "conus": ("EPSG:5070", -125.0, 24.0, -66.0, 50.0),
    "europe": ("EPSG:3035", -25.0, 34.0, 45.0, 72.0),
}
RADII_KM = [50, 100, 250]
COVERAGE_RADIUS_KM = 250.0
HALF_LIFE_KM = 50.0
LOW_COVERAGE_SITES = 2
WINDOWS_HOURS = {"24h": 24, "3d": 72, "7d": 168, "14d": 336}
WEATHER_MAX_KM, WEATHER_MAX_AGE_HOURS = 100.0, 3.0
MIGRATION_MONTHS = [3, 4, 5, 8, 9, 10]
DISTANCE_LADDER_KM = [50, 100, 250, 500, 1000, 2500]
YEAR_LADDER = [0, 1, 5, 10, 20]

# --- fixed values: modelling -------------------------------------------------
RISK_BANDS = [
    (0.10, "Low relative conditional severity"),
    (0.25, "Moderate relative conditional severity"),
    (0.50, "Elevated relative conditional severity"),
    (1.01, "High relative conditional severity"),
]
RARE_THRESHOLD, RARE_TOKEN, MISSING_TOKEN = 20, "rare_other", "missing_value"
TRAIN_END_YEAR, VALIDATION_END_YEAR = 2019, 2022
TRAIN_FRACTION, VALIDATION_FRACTION = 0.70, 0.15
HELD_OUT_REGIONS = ["AAL", "FGN"]
THRESHOLD_LOW, THRESHOLD_HIGH, THRESHOLD_COUNT = 0.01, 0.99, 199
ISOTONIC_MIN_ROWS = 2000
PREDICTION_NOTE = (
    "This is conditional damage probability assuming a strike occurs. "
    "It is not the probability that a strike will occur."
)
GBT_GRID = {"depth": [4, 6, 8], "learning_rate": [0.03, 0.05, 0.1], "l2": [3, 6]}

# --- fixed values: scenario fields -> raw strike columns ---------------------
SCENARIO_RAW = {
    "aircraft_type": "AIRCRAFT", "aircraft_mass_class": "AC_MASS", "engine_type": "TYPE_ENG",
    "engine_count": "NUM_ENGS", "engine_position_primary": "ENG_1_POS",
    "engine_position_secondary": "ENG_2_POS", "state": "STATE", "faa_region": "FAAREGION",
    "sky_condition": "SKY", "precipitation": "PRECIPITATION", "month": "INCIDENT_MONTH",
    "phase_of_flight": "PHASE_OF_FLIGHT", "height_agl_ft": "HEIGHT", "speed_ias_knots": "SPEED",
    "light_condition": "TIME_OF_DAY", "bird_warned": "WARNED",
}
SCENARIO_NUMERIC = ["engine_count", "month", "height_agl_ft", "speed_ias_knots"]

# --- fixed values: the six named scenarios (order of SCENARIO_RAW) -----------
PRESETS = {
    "c172_day_clear_takeoff": ("C-172", "1", "A", 1.0, "7", "NONE", "TX", "ASW", "NO CLOUD", None, 6,
                               "TAKE-OFF RUN", 0.0, 65.0, "DAY", "NO"),
    "c172_night_clear_approach": ("C-172", "1", "A", 1.0, "7", "NONE", "TX", "ASW", "NO CLOUD", None, 10,
                                  "APPROACH", 500.0, 75.0, "NIGHT", "NO"),
    "pa28_day_clear_approach": ("PA-28", "1", "A", 1.0, "7", "NONE", "CA", "AWP", "NO CLOUD", None, 6,
                                "APPROACH", 500.0, 80.0, "DAY", "NO"),
    "cirrus_day_clear_cruise": ("CIRRUS SR 20/22", "1", "A", 1.0, "7", "NONE", "FL", "ASO", "NO CLOUD", None, 6,
                                "EN ROUTE", 6500.0, 170.0, "DAY", "UNKNOWN"),
    "king_air_day_clear_approach": ("BE-200 KING", "2", "C", 2.0, "4", "4", "CO", "ANM", "NO CLOUD", None, 6,
                                    "APPROACH", 1000.0, 140.0, "DAY", "NO"),
    "business_jet_day_clear_approach": ("CL-300", "3", "D", 2.0, "5", "5", "NJ", "AEA", "NO CLOUD", None, 6,
                                        "APPROACH", 1500.0, 160.0, "DAY", "NO"),
}

# --- fixed values: activity index wording ------------------------------------
BASIS_NO_COVERAGE = "no_trektellen_coverage"
BASIS_NO_RECENT = "no_recent_observations"
BASIS_RATE = "effort_normalized_7d_rate_with_coverage_adjustment"
CAVEAT_NO_COVERAGE = "No Trektellen monitoring sites are configured for this query."
CAVEAT_NO_RECENT = (
    "No Trektellen observation session occurred in the previous 7 days within the configured radius - "
    "absence of data, not zero activity."
)
CAVEAT_DISTANCE = "Nearest monitoring site is farther than the configured coverage radius."
CAVEAT_LOW = "Fewer than the recommended number of monitoring sites are within range."
BUFFER_UNAVAILABLE = "outside supported CRS regions (conus, europe)"
