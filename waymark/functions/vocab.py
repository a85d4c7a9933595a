"""Word lists, points and thresholds that the results depend on, in their natural order."""

# Scoring presets: baseline and weights.
PRESETS = {
    "strict": {"baseline": 50, "specialtyKeywords": 25, "roaster": 15, "website": 5, "openingHours": 3, "wifiAccess": 1, "chainPenalty": -50, "genericPenalty": -20, "restaurantPenalty": -15},
    "balanced": {"baseline": 50, "specialtyKeywords": 20, "roaster": 10, "website": 5, "openingHours": 3, "wifiAccess": 2, "chainPenalty": -40, "genericPenalty": -15, "restaurantPenalty": -10},
    "precision": {"baseline": 50, "specialtyKeywords": 31, "roaster": 10, "website": 6, "openingHours": 3, "wifiAccess": 2, "chainPenalty": -52, "genericPenalty": -15, "restaurantPenalty": -10},
    "discovery": {"baseline": 60, "specialtyKeywords": 15, "roaster": 10, "website": 5, "openingHours": 5, "wifiAccess": 3, "chainPenalty": -30, "genericPenalty": -5, "restaurantPenalty": -8},
}

# Words that classify a place.
TYPE_COFFEE = ["cafe", "café", "coffee", "espresso", "barista", "roaster", "roastery", "v60", "chemex", "aeropress", "filter coffee", "brew bar", "drip bar", "specialty", "speciality", "cupping", "קפה", "קלייה"]
TYPE_RESTAURANT = ["restaurant", "bistro", "grill", "sushi", "pizza", "burger", "food", "brunch", "breakfast", "מסעדה", "ביסטרו", "גריל", "סושי", "פיצה", "המבורגר", "בראנץ", "ארוחת בוקר"]
TYPE_BAR = ["bar", "pub", "wine_bar", "wine", "cocktail", "tavern", "nightclub", "בר", "פאב", "יין", "קוקטייל"]
TYPE_OTHER = ["bubble_tea", "bubble tea", "boba", "tea_house", "tea house", "dessert", "dessert_bar", "ice_cream", "ice cream", "gelato", "frozen_yogurt", "frozen yogurt", "yogurt", "mochi", "waffle", "crepe", "donut", "doughnut", "bakery", "patisserie", "pastry", "boulangerie", "bäckerei"]

# Words in names that change the score.
CHAINS = [
    "starbucks", "costa coffee", "costa", "pret a manger", "pret", "nero", "caffè nero", "dunkin", "tim hortons", "mccafé", "mccafe", "mcdonald",
    "greggs", "subway", "krispy kreme", "coffee republic", "wild bean cafe", "segafredo", "lavazza", "illy", "tchibo", "balzac coffee", "einstein kaffee",
    "starbucks reserve", "coffee#1", "café amazon", "wayne's coffee", "espresso house", "baresso", "joe & the juice", "le pain quotidien",
    "aroma", "aroma espresso bar", "ארומה", "benedict", "בנדיקט",
]
WEAK_CHAINS = ["aroma", "aroma espresso bar", "ארומה"]
GENERIC_NAMES = ["cafe", "café", "coffee shop", "coffee house", "kaffee", "kaffeehaus", "bistro", "bakery", "bäckerei", "boulangerie", "cafeteria"]
SPECIALTY_WORDS = [
    "specialty", "speciality", "artisan", "craft", "micro-roast", "third wave", "single origin", "pour over", "filter bar", "coffee lab", "kaffeelabor", "torrefazione",
    "v60", "chemex", "aeropress", "kalita", "batch brew", "cold brew", "filter coffee", "manual brew", "drip bar", "brew bar",
    "cupping", "tasting notes", "latte art", "barista", "coffee workshop", "קלייה", "מקור יחיד", "ספיישלטי", "פילטר קפה",
]
ROASTER_WORDS = ["roaster", "roastery", "coffee roasters", "kaffeerösterei", "micro roaster", "in-house roast", "fresh roast", "rösterei", "torrefazione", "brûlerie", "קלייה", "בית קלייה", "קלאי"]
SCORE_RESTAURANT = ["restaurant", "bistro", "grill", "sushi", "pizza", "bar", "pub", "eatery", "kitchen", "diner", "burger", "food", "brunch", "breakfast", "בראנץ", "ארוחת בוקר"]

# Tags that change the score: label, tags, points (each or once) and the most they give.
CORE_TAGS = ["specialty_coffee", "third_wave", "single_origin", "filter_coffee", "espresso_bar", "manual_brew"]
ROASTING_TAGS = ["roastery", "in_house_roasting", "micro_roaster", "guest_roasters", "direct_trade", "traceability"]
BREWING_TAGS = ["v60", "chemex", "aeropress", "kalita", "batch_brew", "cold_brew", "espresso_tonics"]
EQUIPMENT_TAGS = ["quality_grinder", "espresso_machine_pro", "precision_brewing", "weighing_scale"]
EXPERIENCE_TAGS = ["latte_art", "barista_focus", "tasting_notes", "cupping", "coffee_workshop"]
VERIFIED_TAGS = CORE_TAGS + ROASTING_TAGS + BREWING_TAGS + EQUIPMENT_TAGS + EXPERIENCE_TAGS

# Words that decide whether a place is listed.
COFFEE_WORDS = ["coffee", "cafe", "café", "cafè", "caffè", "espresso", "roaster", "roastery", "specialty", "barista", "קפה", "בית קפה", "אספרסו", "קלייה", "רוסטר"]
STRICT_COFFEE_WORDS = ["coffee", "cafe", "café", "cafè", "caffè", "espresso", "coffee shop", "kaffee", "kafe", "קפה", "בית קפה", "אספרסו"]
FOOD_WORDS = [
    "restaurant", "bistro", "grill", "sushi", "pizza", "bar", "pub", "eatery", "kitchen", "diner", "burger", "burgers", "bubble", "bubble tea", "bubble_tea", "boba", "tea house", "dessert", "ice cream",
    "gelato", "frozen yogurt", "yogurt", "mochi", "waffle", "crepe", "donut", "מסעדה", "בר", "פיצה", "סושי", "גריל", "המבורגר",
]
BAKERY_WORDS = ["bakery", "patisserie", "pastry", "boulangerie", "viennoiserie", "croissant", "מאפיה", "מאפייה", "קונדיטוריה", "פטיסרי", "מאפים"]
MORE_SWEET_WORDS = ["bubble_tea", "bubble tea", "boba", "dessert", "ice_cream", "ice cream", "gelato", "frozen_yogurt", "frozen yogurt", "tea house", "teahouse", "mochi"]
BRUNCH_WORDS = ["brunch", "breakfast", "sandwich", "kitchen", "בוקר", "בראנץ"]
LEADING_TYPES = ["cafe", "café", "coffee", "coffee_shop", "coffee shop", "espresso", "espresso_bar", "espresso bar", "roastery", "roaster"]
LEADING_WORDS = ["coffee", "cafe", "café", "espresso", "roastery", "roaster", "specialty coffee", "בית קפה", "קפה"]
CUISINE_COFFEE = ["coffee", "coffee_shop", "espresso", "קפה", "אספרסו"]
CLOSED_WORDS = ["temporarily closed", "temporary closure", "closed temporarily", "סגור זמנית", "סגורה זמנית"]
EXCLUDED_WORDS = [
    "roladin", "רולדין", "maafe neeman", "מאפה נאמן", "greg patisserie", "גרג קונדיטוריה", "hadasa patisserie", "קונדיטוריה", "bubble tea", "bubble_tea", "bubble", "boba", "dessert",
    "ice cream", "ice_cream", "gelato", "frozen yogurt", "frozen_yogurt", "tea house", "teahouse", "mochi", "yogurt bar", "bubbleteacup", "square bubbles",
]
ALLOWED_WORDS = ["cafelix", "קפליקס", "nahat", "נחת", "waycup", "ווייקאפ", "coffee lab", "קופי לאב"]
CITY_LOCKS = [(["cafelix shlomo hamelech", "קפליקס שלמה המלך"], "tel aviv")]

# Deduplication: metres for very close, same name and same address; names that say nothing.
DEDUPE_DEFAULT = (18.0, 90.0, 90.0)
DEDUPE_BY_CITY = {"Tel Aviv": (12.0, 60.0, 70.0), "Haifa": (12.0, 60.0, 70.0), "Jerusalem": (12.0, 60.0, 70.0), "Berlin": (12.0, 60.0, 70.0), "Ramat Gan": (10.0, 45.0, 55.0), "Givatayim": (10.0, 45.0, 55.0)}
GENERIC_TOKENS = ["cafe", "coffee", "espresso", "kafe", "קפה", "בית"]
SOURCE_PRIORITY = {"manual": 4, "seeded": 3, "osm": 2, "google": 1}

# Tagging rules, and the points of tags and sources in the second score.
TAG_RULES = [
    ("specialty_coffee", ["specialty", "single origin", "micro-lot", "third wave"]), ("espresso_bar", ["espresso bar", "espresso"]), ("pour_over", ["pour over", "pour-over", "filter coffee"]),
    ("v60", ["v60"]), ("chemex", ["chemex"]), ("aeropress", ["aeropress", "aero press"]), ("roastery", ["roaster", "roastery", "roast"]), ("bakery", ["bakery", "pastry", "croissant", "patisserie"]),
    ("brunch", ["brunch", "breakfast", "sandwich", "kitchen"]), ("work_friendly", ["laptop", "wifi", "work", "workspace", "quiet"]), ("takeaway_friendly", ["take away", "takeaway", "to-go", "to go"]),
]
TAG_POINTS = {"specialty_coffee": 18, "espresso_bar": 8, "pour_over": 10, "v60": 7, "chemex": 7, "aeropress": 7, "roastery": 12, "bakery": 2, "brunch": -4, "work_friendly": 4, "takeaway_friendly": 2}
SOURCE_POINTS = {"seeded": 8, "manual": 7, "google": 4, "osm": 3}

# Review: tags that lead, that speak of bakeries, and that count as coffee at all.
LEADING_TAGS = ["specialty_coffee", "roastery", "espresso_bar", "pour_over", "v60", "chemex", "aeropress"]
BAKERY_BRUNCH_TAGS = ["bakery", "brunch"]
RELEVANT_TAGS = [*LEADING_TAGS, "coffee", "cafe", "coffee_shop"]

# cities' radius in metres, and the least and most of the filter in kilometres.
CITY_RADIUS_METRES = {"Tel Aviv": 5000, "Jerusalem": 3500, "Haifa": 3000, "Ramat Gan": 2500, "Ra'anana": 2500}
DEFAULT_RADIUS_METRES, LEAST_RADIUS_KM, MOST_RADIUS_KM = 2200, 3.5, 40.0
CITY_DISPLAY = {"Ramat Gan": "Ramat Gan-Givataim"}

# Chains that European cities leave out, and the countries that count as such.
EUROPE_CHAINS = ["starbucks", "costa", "costa coffee", "joe & juice", "joe & the juice", "joe and the juice", "caffe nero", "caffè nero", "cafe nero"]
EUROPEAN_COUNTRIES = [
    "Austria", "Belarus", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia", "Finland", "France", "Georgia", "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia", "Lithuania",
    "Luxembourg", "Moldova", "Netherlands", "North Macedonia", "Norway", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "Turkey", "Ukraine", "United Kingdom",
]

# Words of the specialty flag.
SPECIALTY_FLAG_WORDS = [
    "specialty", "speciality", "third wave", "artisan", "roaster", "roastery", "micro", "single origin", "pour over", "filter", "craft", "independent", "espresso bar", "coffee lab", "coffee collective", "the barn",
    "five elephant", "bonanza", "father carpenter", "lot sixty one", "coffee district", "satan's coffee",
]
SEEDED_FLOOR = 72

# The score of discovered candidates (words; points each, most, and what they start from).
DISCOVERY_TEXT = [
    "specialty", "speciality", "third wave", "single origin", "filter coffee", "manual brew", "pour over", "v60", "chemex", "aeropress", "kalita", "batch brew", "cold brew", "roastery", "roaster", "coffee lab",
    "direct trade", "traceability", "tasting notes", "cupping", "espresso bar", "ספיישלטי", "מקור יחיד", "פילטר", "קלייה", "רוסטר", "קאפינג",
]
DISCOVERY_NAME = ["coffee", "cafe", "café", "espresso", "roaster", "roastery", "קפה", "אספרסו", "קלייה"]
DISCOVERY_NEGATIVE = ["cocktail", "wine bar", "pub", "nightclub", "restaurant", "bistro", "burger", "pizza", "grill", "sushi", "בר קוקטיילים", "בר יין", "פאב", "מסעדה", "ביסטרו"]
DISCOVERY_FROM, DISCOVERY_LEAST = 60, 18

# Words of the import gate.
IMPORT_NON_COFFEE = ["pizza", "sushi", "ice cream", "gelato", "frozen yogurt", "yogurt", "bubble tea", "bubble_tea", "boba", "tea house", "teahouse", "dessert", "waffle", "crepe", "donut", "mochi"]
IMPORT_COFFEE_TEXT = [
    "coffee", "cafe", "café", "espresso", "coffee shop", "specialty coffee", "roaster", "roastery", "pour over", "pour-over", "filter coffee", "v60", "chemex", "aeropress", "קפה", "בית קפה", "אספרסו", "רוסטר", "קלייה",
]
IMPORT_COFFEE_NAME = ["coffee", "cafe", "café", "espresso", "roaster", "roastery", "specialty"]
IMPORT_FOOD_FIRST = [
    "brunch", "breakfast", "all day breakfast", "sandwich", "kitchen", "restaurant", "steakhouse", "ramen", "noodle", "burger", "hotdog", "taco", "bbq", "barbecue", "grill", "bistro", "diner", "wine", "cocktail",
    "ארוחת בוקר", "בראנץ", "מסעדה", "gelato", "ice cream",
]
IMPORT_BAKERY_BRUNCH = ["bakery", "patisserie", "boulangerie", "brunch", "breakfast", "sandwich", "kitchen"]
IMPORT_EXCLUDED = ["roladin", "רולדין", "maafe neeman", "מאפה נאמן", "greg patisserie", "גרג קונדיטוריה", "hadasa patisserie", "קונדיטוריה"]
IMPORT_NEUTRAL_SCORE = 48

# Words that make a listed place look wrong in the audit of a city.
SUSPICIOUS_WORDS = ["burger", "sushi", "pizza", "bar", "pub", "dessert", "gelato", "ice cream", "yogurt", "mochi", "waffle", "donut", "bubble"]

# Part of the address of photos that browsers may not read.
BROKEN_PHOTO = "/place-photos/AL8"
