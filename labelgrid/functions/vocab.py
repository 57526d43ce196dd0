"""Word lists, patterns and thresholds.

Fixed values: results depend on each of them, and on their order.
"""

INGREDIENT_ANCHORS = ["ingredients", "ingredient", "ingredients:", "ingredient:", "composition", "contents", "made from", "made with", "contains"]
ALL_INGREDIENT_ANCHORS = ["ingredients", "ingredient", "ingredients:", "ingredient:", "composition", "contents", "made from", "made with", "contains", "सामग्री", "सामग्रियां", "घटक", "key ingredients", "active ingredients", "other ingredients"]
NUTRITION_ANCHORS = ["nutrition information", "nutritional information", "nutrition facts", "nutritional facts", "nutrition", "nutrient information", "nutrition facts panel"]
NUTRIENT_KEYWORDS = [
    "energy", "calories", "protein", "total protein", "carbohydrate", "total carbohydrate", "total carbohydrates", "sugar", "total sugar", "total sugars",
    "added sugar", "added sugars", "fat", "total fat", "saturated fat", "trans fat", "dietary fibre", "fiber", "fibre", "sodium", "salt", "potassium",
    "calcium", "iron", "vitamin", "vitamin a", "vitamin c", "vitamin d",
]
NUTRIENT_UNITS = ["kcal", "kj", "g", "mg", "mcg", "iu", "%"]
SECTION_STOP_WORDS = [
    "nutrition", "nutrition facts", "nutrition information", "nutritional information", "allergen", "allergen information", "allergen advice",
    "allergy advice", "contains", "storage", "storage instructions", "directions", "cooking instructions", "preparation", "net weight", "net wt",
    "net quantity", "mrp", "batch", "batch no", "manufactured by", "marketed by", "customer care", "fssai", "barcode", "expiry", "best before", "use by",
]
FOOD_SIGNALS = ["nutrition", "ingredients", "energy", "protein", "carbohydrate", "fat", "sugar", "serving", "calories"]
PERSONAL_CARE_SIGNALS = ["shampoo", "conditioner", "moisturizer", "cream", "serum", "soap", "face wash", "body wash", "toothpaste", "cosmetic"]
ALLERGEN_CONTEXT_WORDS = [
    "wheat", "milk", "soy", "soya", "nut", "nuts", "peanut", "egg", "eggs", "gluten", "sesame", "shellfish", "fish", "mustard", "celery", "lupin",
    "sulphite", "sulfite", "tree nut", "dairy",
]

# line classes: words that are matched as headings and looked for, in the order in which the classes break ties
CLASS_WORDS = {
    "allergen": ["allergen", "allergy", "contains:", "may contain", "contains wheat", "contains milk", "contains soy", "contains peanut", "free from"],
    "manufacturer": ["manufactured by", "mfg by", "marketed by", "imported by", "distributor", "packed by", "packager", "manufactured for", "address", "registered office", "regd office"],
    "storage": ["storage", "store in", "keep in", "cool and dry", "cool, dry", "refrigerate", "do not freeze", "keep container tightly"],
    "directions": ["directions", "instructions", "how to prepare", "cooking time", "prep method", "dosage", "directions for use", "suggested use"],
    "regulatory": ["fssai", "lic. no.", "lic no", "grade", "standard", "regulatory", "hallmark", "registered", "isi mark"],
    "product_information": [
        "mrp", "rs.", "batch", "expiry", "best before", "use by", "net weight", "net wt", "net quantity", "pack size", "manufacturing date", "mfg. date",
        "mfg date", "expiry date", "exp date", "customer care", "contact us", "feedback", "queries",
    ],
}
CLASSES = ["ingredients", "nutrition", *CLASS_WORDS, "other"]
CLUSTERED = CLASSES[:-1]
SERVING_WORDS = ["serving", "servings", "serves", "pack size", "per 100g", "per 100 g", "per serving", "approx."]
MARKETING_WORDS = ["all rights reserved", "trademark", "patent", "visit us", "www.", "http", ".com", "address", "registered office"]
OTHER_HEADINGS = [
    "storage", "directions", "cooking", "manufactured", "marketed", "customer care", "contact us", "feedback", "mrp", "batch", "best before", "expiry",
    "use by", "fssai", "barcode", "net weight", "net wt", "net quantity",
]

# block types: words that decide, in the order in which they are asked
BLOCK_ALLERGEN = ["allergen", "allergy", "contains:", "contains wheat", "contains milk", "contains soy", "may contain"]
BLOCK_STORAGE = ["storage", "store in", "keep in", "cool and dry", "best before", "expiry", "exp date", "use by", "batch"]
BLOCK_MANUFACTURER = ["manufactured by", "mfg by", "marketed by", "pepsico", "hindustan unilever", "nestle", "britannia", "itc limited", "address:"]
BLOCK_INSTRUCTION = ["directions", "instructions", "how to prepare", "cooking time", "prep method"]
BLOCK_CONTACT = ["customer care", "contact us", "write to", "feedback", "queries", "toll free", "toll-free", "email id", "email:"]
BLOCK_MRP = ["mrp", "max retail price", "retail price", "rs."]

# nutrients: key, then what names it; the first match counts
NUTRIENT_KEYS = [
    ("energy", ["energy", "calories"]),
    ("protein", ["protein"]),
    ("total_carbohydrate", [r"total\s*carbohydrate", "carbohydrate"]),
    ("total_sugars", [r"total\s*sugars", r"added\s*sugars", "sugars?"]),
    ("total_fat", [r"total\s*fat", "fat"]),
    ("saturated_fat", [r"saturated\s*fat"]),
    ("trans_fat", [r"trans\s*fat"]),
    ("dietary_fibre", [r"dietary\s*fib(?:re|er)", "fib(?:re|er)"]),
    ("sodium", ["sodium"]),
    ("salt", ["salt"]),
    ("cholesterol", ["cholesterol"]),
    ("calcium", ["calcium"]),
    ("iron", ["iron"]),
    ("vitamin", [r"vitamin\s*[a-z0-9]*"]),
]
TABLE_HEADERS = ["per 100", "per serving", "per serve", "approx", "% rda", "rda", "% gd"]

NUMBER_UNIT = r"\d+(\.\d+)?\s*(kcal|kj|mcg|µg|mg|ml|g|%)\b"
VALUE_UNIT = r"(\d+(?:\.\d+)?)\s*(kcal|kj|mcg|mg|iu|g|%)"
INS_NUMBER = r"\b(?:ins|e)\s*\d+[a-z]?(\([i|v|x]+\))?\b"
INS_CODE = r"\b(?:ins|e)\s?-?\s?\d{3,4}[a-z]?\b"
PERCENTAGE = r"\b\d+(?:\.\d+)?\s*(?:%|percent)\b"
PERCENT_TOKEN = r"\(?\s?\d{1,3}(\.\d+)?\s?%\s?\)?"
PARENTHESIS = r"\(.*?\)"
NUMERIC = r"\b\d+(?:\.\d+)?\b"
GARBAGE = r"[^a-zA-Z0-9%.,:;()\-\s]"
LEADING_HEADINGS = ["ingredients", "ingredient", "composition", "contents", "made from", "contains"]
TOKEN_HEADING = r"^\s*(ingredients?|composition|contents)\s*:?\s*-?\s*"

KB_NAME_HINTS = ["ingredient", "name", "ingredient_name", "primary_name", "item", "nutrient", "nutrient_name", "product", "product_name"]
KB_ALTERNATE_HINTS = ["alternate", "alt_name", "alt_names", "synonym", "synonyms", "aka", "also_known_as", "other_names"]

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png"]
ANCHOR_SCORE = 78
KB_SCORE, KB_FLOOR = 85, 80
STOP_AUTO_SCORE, STOP_CONTEXT_SCORE, STOP_HEADING_LENGTH = 92, 78, 40
TOKEN_STOP_SCORE = 88
LINE_V, LINE_H, LINE_HEIGHT, LINE_OVERLAP = 0.45, 4.0, 0.3, 0.35
GROUP_H, GROUP_WIDTH = 6.0, 0.05
BLOCK_GAP, BLOCK_OVERLAP, BAND = 2.5, 0.2, 3.0
EXPAND_GAP, EXPAND_LINES, EXPAND_HEIGHT, BAND_OVERLAP = 2.6, 40, 26, 0.25
COLUMN_GAP = 0.12
HEADER_GAP = 2.0
TABLE_TERMS, TABLE_DISTANCE = 3, 3.0
ANCHORS_TRIED = 3
RECONCILE_IOU = 0.15
PADDING = 0.015
SHORT_CIRCUIT = 0.88
PRIMARY = 0.70
