"""Fixed values.

Everything in this file must equal the published label sets, thresholds and
lookup tables, because results carry them verbatim.
"""

# --- fixed values: slot states -------------------------------------------------
NO_READINGS = "sense_mesures"
OTHER = "altres"
BOTH_EXTREMES = "extremes"
EMPTY = "buida"
FULL = "plena"
NORMAL = "normal"
MODEL_CLASSES = (EMPTY, NORMAL, FULL)
PROBLEM_STATES = (EMPTY, FULL, BOTH_EXTREMES)
UNMODELLED_STATES = (NO_READINGS, OTHER, BOTH_EXTREMES)
STATE_NUMBER = {EMPTY: 0, NORMAL: 1, FULL: 2}
DAY_TYPE_WEEKEND = "fest"
DAY_TYPE_WORKDAY = "lab"

# --- fixed values: state and problem colours -------------------------------------
STATE_COLOUR = {
    EMPTY: "#dc2626",
    FULL: "#2563eb",
    BOTH_EXTREMES: "#eab308",
    NORMAL: "#333333",
    NO_READINGS: "#333333",
}
DEFAULT_STATE_COLOUR = "#333333"
LOW_PROBLEM_COLOUR = "#222222"
LOW_PROBLEM_PCT = 2
FULL_INTENSITY_PCT = 20
DOMINANCE_FACTOR = 2
# (base, change at full intensity) per colour channel
PROBLEM_RAMPS = {
    "empty": ((230, 25), (160, -160), (160, -160)),
    "full": ((160, -140), (160, -140), (200, 55)),
    "mixed": ((230, 25), (220, -20), (80, -60)),
}
DISTRICT_PALETTE = (
    "#E63946", "#457B9D", "#F4A261", "#2A9D8F", "#9B5DE5",
    "#00B4D8", "#E76F51", "#06D6A0", "#FFD166", "#EF476F",
)

# --- fixed values: calendar names -------------------------------------------------
SEASONS = {1: "Hivern", 2: "Primavera", 3: "Estiu", 4: "Tardor"}
MONTH_SHORT = {
    1: "Gen", 2: "Feb", 3: "Març", 4: "Abr", 5: "Maig", 6: "Juny",
    7: "Jul", 8: "Ago", 9: "Set", 10: "Oct", 11: "Nov", 12: "Des",
}
MONTH_LONG = {
    1: "Gener", 2: "Febrer", 3: "Març", 4: "Abril", 5: "Maig", 6: "Juny",
    7: "Juliol", 8: "Agost", 9: "Setembre", 10: "Octubre", 11: "Novembre", 12: "Desembre",
}
WEEKDAYS = {
    1: "Dilluns", 2: "Dimarts", 3: "Dimecres", 4: "Dijous",
    5: "Divendres", 6: "Dissabte", 7: "Diumenge",
}

# --- fixed values: reading validity -------------------------------------------------
IN_SERVICE = "IN_SERVICE"
RENTING = "1"
EPOCH_MIN, EPOCH_MAX = 946684800, 2145916800
LOCAL_ZONE = "Europe/Madrid"

# --- fixed values: text, bands, codes -------------------------------------------------
WORD_LETTERS = "a-záéíóúüñ"
WEIGHT_RANGE = (20, 300)
HEIGHT_RANGE = (0.5, 2.5)
BMI_BANDS = ((18.5, "Bajo peso"), (24.9, "Peso normal"), (29.9, "Sobrepeso"), (None, "Obesidad"))
GENDER_CODES = {"H": "Hombre", "D": "Mujer", "A": "Otros", "NC": None}
MARGIN_LABEL = "Mitjana"
INCREMENTS = {"Grup A": "5%", "Grup B": "3,5%", "Grup C": "2%", "Grup D": "8%"}
VOLUME_THRESHOLD = 400
VOLUME_LABELS = ("Menos de 400 tr", "Tiene 400 tr", "Mas de 400 tr")
ACTIVE, INACTIVE = "active", "inactive"

# --- fixed values: feature bands (first hour, hour after the last) ------------------
WORKDAY_BANDS = ((6, 8), (8, 10), (10, 12), (12, 14), (14, 16), (16, 18), (18, 20), (20, 22), (22, 24))
WEEKEND_BANDS = ((6, 10), (10, 14), (14, 18), (18, 22), (22, 24))
MORNING_PEAK, EVENING_PEAK = (7, 9), (17, 19)
DEFAULT_CAPACITY = 20.0
MAX_NULL_FEATURES = 10

# --- fixed values: names of the five published station groups, by their published number
CLUSTER_NAMES = {
    0: "Perifèric Baix Ús",
    1: "Central Alta Ocupació",
    2: "Origen Commuter Matí",
    3: "Ús Mixt Equilibrat",
    4: "Residencial Entrada Tarda",
}
