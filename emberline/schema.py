"""Names, units, periods and key columns of the data model."""

from __future__ import annotations

KEYS = ["model", "scenario", "member"]
CELL = ["cell_id"]

# Periods, scenarios, canonical variables with the names that archives give them, and target units.
TARGET_PERIOD, ASSESS_PERIOD, SPINUP_YEARS = (2020, 2039), (2064, 2083), 1
SCENARIOS = ["ssp245", "G6-1.5K-SAI", "G6-1.5K-HiLLA"]
RUNS = [("target", "ssp245", *TARGET_PERIOD), ("ssp245", "ssp245", *ASSESS_PERIOD), ("G6-1.5K-SAI", "G6-1.5K-SAI", *ASSESS_PERIOD), ("G6-1.5K-HiLLA", "G6-1.5K-HiLLA", *ASSESS_PERIOD)]
PAIRS = [
    ("ssp245-target", "ssp245", "target"),
    ("SAI-target", "G6-1.5K-SAI", "target"),
    ("HiLLA-target", "G6-1.5K-HiLLA", "target"),
    ("SAI-ssp245", "G6-1.5K-SAI", "ssp245"),
    ("HiLLA-ssp245", "G6-1.5K-HiLLA", "ssp245"),
    ("HiLLA-SAI", "G6-1.5K-HiLLA", "G6-1.5K-SAI"),
]
ALIASES = {
    "tasmax": ["tasmax", "TREFHTMX", "TREFMXAV", "TMAX", "tmax", "t2max"],
    "tas": ["tas", "TREFHT", "T2", "t2m", "SurfT"],
    "hursmin": ["hursmin", "RHREFHTMN", "RHREFHTMIN", "hurs_min"],
    "hurs": ["hurs", "RHREFHT", "rh", "RH2M", "relhum"],
    "sfcWind": ["sfcWind", "U10", "WSPDSRFAV", "wind10", "si10"],
    "pr": ["pr", "PRECT", "precip", "PRECTOT"],
    "huss": ["huss", "QREFHT", "q2m"],
    "ps": ["ps", "PS", "sp"],
    "uas": ["uas", "UAS"],
    "vas": ["vas", "VAS"],
}
CANON = {a: c for c, names in ALIASES.items() for a in names}
TARGET_UNITS = {"tasmax": "K", "tas": "K", "hurs": "%", "hursmin": "%", "sfcWind": "m s-1", "pr": "kg m-2 s-1", "huss": "1", "ps": "Pa", "uas": "m s-1", "vas": "m s-1"}
FOCUS_REGIONS = ["NWN", "NEN", "WSB", "ESB", "WNA", "MED", "NSA", "SAM", "NES", "WAF", "ESAF", "SEA", "NAU", "EAU"]
MONTH_DAYS = [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
BANDS = {"Global": (-90, 90), "Tropics": (-20, 20), "NH_Boreal": (50, 70), "SH_Extratropics": (-90, -35)}

#: Schemas as DDL.
LISTING = "path string, length long"
CATALOG = "model string, scenario string, member string, var string, kind string, paths array<string>, var_name string"
CATALOG_JSON = "map<string, map<string, map<string, map<string, struct<kind: string, paths: array<string>, store: string, group: string, repo: string, branch: string, var: string>>>>>"
DAILY = (
    "model string, scenario string, member string, cell_id long, lat double, lon double, tile int, year int, month int, day int, doy int, day_idx int, "
    "tasmax float, tas float, hurs float, hursmin float, sfcWind float, pr float, huss float, ps float, uas float, vas float"
)
