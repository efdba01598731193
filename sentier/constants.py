"""Fixed values that must equal the app's own for identical results.

Everything here is configuration data of the app being re-built (labels,
rates, bands, texts), kept plainly and in its natural order.
"""

# --- fixed values: sentiment labels (accented literals, order Négatif/Neutre/Positif)
SENTIMENT_NEGATIVE = "Négatif"
SENTIMENT_NEUTRAL = "Neutre"
SENTIMENT_POSITIVE = "Positif"
SENTIMENTS = (SENTIMENT_NEGATIVE, SENTIMENT_NEUTRAL, SENTIMENT_POSITIVE)

# --- fixed values: the twelve feedback themes, in configuration order
THEMES = (
    "Patrimoine historique et culturel",
    "Paysages et nature",
    "Activités et loisirs",
    "Événements et festivals",
    "Gastronomie et produits locaux",
    "Hébergement et services",
    "Transport et accessibilité",
    "Accueil et information",
    "Conservation et entretien",
    "Expérience utilisateur et impressions générales",
    "Accessibilité numérique",
    "Autres",
)
FALLBACK_THEME = "Autres"
FALLBACK_SENTIMENT = "Neutre"
UNKNOWN_TSID = "XXXXXX"

# --- fixed values: recommendation and retrieval parameters
ALPHA = 0.5                 # score = cosine - alpha * km
GREAT_CIRCLE_RADIUS_KM = 6371.009
RECOMMEND_TOP_K = 10
RECOMMEND_SHOWN = 8
RAG_TOP_K = 10
RAG_OVERFETCH = 10          # index searched for top_k * 10 candidates
POSTAL_WEIGHT = 0.5
NO_PHOTO = "static/imgs/no_photo.jpg"

# --- fixed values: WGS-84 ellipsoid
WGS84_A_M = 6378137.0
WGS84_F = 1 / 298.257223563

# --- fixed values: transit
NEAREST_STOP_MAX_M = 2000.0
CO2_G_PER_KM = {"bike": 0.0, "bus": 55.9, "tram": 1.2, "metro": 1.42}
BIKE_COINS_PER_KM = 150
BUS_COINS_PER_KM = 100
OTHER_COINS_PER_KM = 50

# --- fixed values: loyalty
LEVEL_XP = 1000
BADGES = {
    "Incontournable de la Normandie": "A visité la Cathédrale de Rouen",
    "Connaisseur de la région": "A visité 50% de la Normandie",
    "Ami des deux roues": "S'est déplacé en vélo sur plus de 10 km",
}
BADGE_UNKNOWN = "Description non disponible"
TIERS = (
    (1, 1000, 2000, (("Carte postale offerte", 1000),
                     ("Réduction 10% sur toutes les stations vélos 24H", 1000),
                     ("Goodies mystère", 1000))),
    (2, 2000, 3000, (("Bon d'achat - 5€", 2000),
                     ("Ticket de bus offert dans Rouen", 2000),
                     ("Boisson gratuite dans un restaurant participant", 2000))),
    (3, 3000, 5000, (("Bon d'achat - 15€", 3000),
                     ("Piste VIP", 3000),
                     ("Dîner spécial", 3000))),
    (4, 5000, None, (("Expérience deluxe", 5000),
                     ("Voyage offert SNCF", 5000),
                     ("Cadeau premium", 5000))),
)
INFINITY_LABEL = "∞"

# --- fixed values: accessibility defaults
ACCESS_NOT_AVAILABLE = "Non disponible"
ACCESS_YES = "Oui"
ACCESS_BOOL_FIELDS = (
    "transport_station_presence", "stationnement_presence", "stationnement_pmr",
    "entree_ascenseur", "entree_pmr", "accueil_audiodescription_presence",
    "accueil_equipements_malentendants_presence", "sanitaires_presence", "sanitaires_adaptes",
)
ACCESS_STR_FIELDS = ("accueil_personnels",)
ACCESS_LIST_FIELDS = ("accueil_audiodescription", "labels", "labels_familles_handicap")

# --- fixed values: drinking-water query box (south, west, north, east)
WATER_BBOX = (49.0, -1.7, 50.0, 1.5)

# --- fixed values: paging
PLACES_PER_PAGE = 10
FEEDBACK_PER_PAGE = 8
TREND_CUTOFF_DAYS = 120
TOP_NEGATIVE_N = 3
RECENT_NEGATIVE_N = 5
TEASER_CHARS = 100
TEASER_WORDS = 30
