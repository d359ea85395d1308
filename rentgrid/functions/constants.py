"""Fixed values of the market the library is configured for."""

# --- fixed values: domains, in their contract order -------------------------
ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room", "Hotel room"]
DISTRICTS = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
LICENCE_STATUS = ["registrada", "isenta", "ausente", "outra"]
PROPERTY_GROUPS = ["apartamento_inteiro", "casa_inteira", "quarto_em_apartamento",
                   "quarto_em_casa", "hotel_pousada", "quarto_compartilhado", "atipico"]

# --- fixed values: item patterns, matched without case on each item ---------
AMENITY_PATTERNS = {
    "amen_wifi": r"\bwi-?fi\b",
    "amen_cozinha": r"^(kitchen|kitchenette)$",
    "amen_ar_condicionado": r"air conditioning|\bac\b",
    "amen_aquecimento": r"heating|\bheater\b",
    "amen_lavadora": r"\bwasher\b",
    "amen_secadora": r"(?<!hair )\bdryer\b",
    "amen_lava_loucas": r"dishwasher",
    "amen_elevador": r"\belevator\b",
    "amen_academia": r"^(?!.*nearby).*(\bgym\b|exercise equipment)",
    "amen_estacionamento": r"parking.*on premises|garage on premises|carport",
    "amen_piscina": r"\bpool\b(?! table| view)",
    "amen_porteiro": r"building staff|doorman|concierge",
    "amen_self_checkin": r"self check-?in",
    "amen_espaco_trabalho": r"workspace",
    "amen_tv": r"\b(hd)?tv\b",
    "amen_varanda_patio": r"patio|balcon|backyard|terrace",
    "amen_permite_pets": r"pets allowed",
}

# --- fixed values: property wording -----------------------------------------
HOTEL_WORDS = r"hotel|hostel|resort|bed and breakfast|\bdorm\b|kezhan|^room in"
UNUSUAL_WORDS = (r"\b(boat|houseboat|camper|rv|tent|tower|floor|barn|dome|cave|castle|train|"
                 r"earthen|religious|ranch|treehouse|yurt|lighthouse|windmill|bus|island)\b")
APARTMENT_WORDS = r"rental unit|condo|loft|serviced apartment|\bplace\b"
GROUP_BY_ROOM_TYPE = {"Entire home/apt": "apartamento_inteiro", "Private room": "quarto_em_casa",
                      "Shared room": "quarto_compartilhado", "Hotel room": "hotel_pousada"}

# --- fixed values: review-based occupancy -----------------------------------
REVIEW_RATE = 0.50
MEAN_STAY = 6.4
MEAN_STAY_DEFAULT = 3.0
OCCUPANCY_CAP = 0.70
ACTIVE_DAYS = 365
NIGHTS_CAP = 255
DAYS_PER_MONTH = 365.25 / 12

# --- fixed values: price limits and stay limits -----------------------------
PRICE_FLOOR = 10.0
PRICE_CEILING = 10_000.0
QUOTE_MAX_NIGHTS = 31
LONG_STAY_NIGHTS = 30

# --- fixed values: bounding box (lon min, lat min, lon max, lat max) --------
BBOX = (-74.2591, 40.4774, -73.7004, 40.9176)
REGIME_DATE = "2023-09-05"
EARTH_RADIUS_M = 6_371_008.8

# --- fixed values: bands as (right-closed edges, labels) --------------------
HOST_BANDS = ([0, 1, 2, 5, 10, 50, None], ["1", "2", "3–5", "6–10", "11–50", "51+"])
HOST_BANDS_SHORT = ([0, 1, 2, 5, 10, None], ["1", "2", "3–5", "6–10", "11+"])
RECENCY_BANDS = ([-1, 90, 365, 1_000_000], ["≤ 90 dias", "91–365 dias", "> 1 ano"])
OVERPRICE_BANDS = ([None, -20, -5, 5, 20, None],
                   ["≥ 20% abaixo", "5–20% abaixo", "±5%", "5–20% acima", "≥ 20% acima"])
QUOTE_NIGHT_BANDS = ([0, 27, 31, 60, 120, 366], ["1-27", "28-31", "32-60", "61-120", "121-365"])
