"""Fixed values that results depend on: vocabularies, formats, weights, capabilities."""

# Names. Fixed values.
HONORIFICS = ["MR", "MRS", "MS", "MISS", "SHRI", "SRI", "SMT", "SMTH", "KUM", "KUMARI", "DR", "PROF", "ER", "ADV", "LATE", "M/S", "SH"]
ABBREVIATIONS = {"MD": ["MUHAMMED", "MOHAMMED", "MOHAMMAD", "MUHAMMAD"], "MOHD": ["MUHAMMED", "MOHAMMED", "MOHAMMAD", "MUHAMMAD"], "MUHD": ["MUHAMMED", "MUHAMMAD"], "ABD": ["ABDUL"], "SK": ["SHAIKH", "SHEIKH"], "KR": ["KUMAR"], "SGH": ["SINGH"], "RAJ": ["RAJU"]}

# Genders. Fixed values.
MALE = ["M", "MALE", "MAN", "पुरुष", "पुुरुष", "पु", "ಪುರುಷ", "ஆண்", "పురుషుడు", "പുരുഷൻ"]
FEMALE = ["F", "FEMALE", "WOMAN", "महिला", "स्त्री", "ಮಹಿಳೆ", "பெண்", "స్త్రీ", "സ്ത്രീ"]
OTHER = ["O", "OTHER", "T", "TG", "TRANSGENDER", "THIRD GENDER", "अन्य", "ट्रांसजेंडर"]

# Addresses. Fixed values.
EXPANSIONS = [(r"\bR/?O\b", "RESIDENT OF"), (r"\bS/?O\b", "SON OF"), (r"\bD/?O\b", "DAUGHTER OF"), (r"\bW/?O\b", "WIFE OF"), (r"\bC/?O\b", "CARE OF"), (r"\bH\.?\s?NO\.?\b", "HOUSE NO"), (r"\bFLR\b", "FLOOR"), (r"\bAPT\b", "APARTMENT"), (r"\bRD\b", "ROAD"), (r"\bST\b", "STREET"), (r"\bLN\b", "LANE"), (r"\bDIST\b", "DISTRICT"), (r"\bTQ\b", "TALUK"), (r"\bPO\b", "POST OFFICE"), (r"\bPS\b", "POLICE STATION"), (r"\bNR\b", "NEAR"), (r"\bOPP\b", "OPPOSITE")]
STATES = ["ANDHRA PRADESH", "ARUNACHAL PRADESH", "ASSAM", "BIHAR", "CHHATTISGARH", "GOA", "GUJARAT", "HARYANA", "HIMACHAL PRADESH", "JHARKHAND", "KARNATAKA", "KERALA", "MADHYA PRADESH", "MAHARASHTRA", "MANIPUR", "MEGHALAYA", "MIZORAM", "NAGALAND", "ODISHA", "ORISSA", "PUNJAB", "RAJASTHAN", "SIKKIM", "TAMIL NADU", "TELANGANA", "TRIPURA", "UTTAR PRADESH", "UTTARAKHAND", "WEST BENGAL", "DELHI", "NEW DELHI", "JAMMU AND KASHMIR", "LADAKH", "PUDUCHERRY", "CHANDIGARH", "ANDAMAN AND NICOBAR ISLANDS", "DADRA AND NAGAR HAVELI", "DAMAN AND DIU", "LAKSHADWEEP"]
COUNTRIES = ["INDIA", "BHARAT"]
ADDRESS_NOISE = ["THE", "AND", "NEAR", "POST", "OFFICE", "HOUSE", "ROAD", "STREET", "DISTRICT"]

# Months by their first letters. Fixed values.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_NAMES = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]

# Forms of dates, of the start and end of an address, of a postal code. Fixed values.
DATE_SEPARATORS = r"\s*([/.\-])\s*"
DATE_ISO = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$"
DATE_NAMED = r"^(\d{1,2})[\s.\-/]*([A-Z]{3,9})[\s.\-/]*(\d{2,4})$"
DATE_NAMED_FIRST = r"^([A-Z]{3,9})[\s.\-/]*(\d{1,2})[,\s.\-/]*(\d{2,4})$"
DATE_NUMERIC = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$"
DATE_YEAR = r"^(\d{4})$"
ADDRESS_COMMAS = r"(?:\s*,\s*)+"
ADDRESS_EDGES = r"^[\s,.\-]+|[\s,.\-]+$"
# The last number of six digits: a house number may have six as well.
POSTAL_CODE = r"(?s).*\b([0-9]{6})\b"

# What stands on the text of a page: labels by field in order, dates, genders, numbers, words that declare a type, lines that are no name. Fixed values.
PAGE_LABELS = {
    "holder_name": [r"name of (?:the )?(?:card ?)?holder", r"holder'?s name", r"\bname\b(?! of father)"],
    "father_name": [r"father'?s? name", r"father", r"पिता"],
    "mother_name": [r"mother'?s? name", r"mother", r"माता"],
    "spouse_name": [r"husband'?s? name", r"wife'?s? name", r"spouse'?s? name"],
    "address": [r"address", r"पता"],
}
PAGE_DATE = r"(?:\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})"
PAGE_BIRTH = r"dob|date of birth|birth|जन्म"
PAGE_GENDERS = [r"(?<![A-Za-z0-9_])(?:sex|gender)\s*[:=-]\s*(male|female|other|m|f|o)\b", r"\b(male|female)\b"]
PAGE_NUMBERS = [r"\b([A-Z]{5}\s?\d{4}\s?[A-Z])\b", r"\b(\d{4}\s?\d{4}\s?\d{4})\b", r"\b([A-Z]{3}\s?\d{7})\b", r"\b([A-Z]\d{7})\b"]
PAGE_TYPES = [("income tax", "pan"), ("permanent account", "pan"), ("aadhaar", "aadhaar"), ("passport", "passport"), ("election commission", "voter"), ("elector", "voter"), ("birth certificate", "birth_certificate"), ("certificate of birth", "birth_certificate"), ("registration of birth", "birth_certificate")]
PAGE_BIRTH_LINE = r"dob|date of birth|जन्म"
PAGE_NAME_LINE = r"^[A-Za-z][A-Za-z .]{2,50}$"
PAGE_HEADERS = r"government|india|भारत|सरकार|unique|identification|authority|aadhaar|आधार|male|female|year of birth|address|आम आदमी"

# Document numbers: pattern, length, checksum. Fixed values.
FORMATS = {"pan": ("^[A-Z]{5}[0-9]{4}[A-Z]$", 10, False), "aadhaar": ("^[2-9][0-9]{11}$", 12, True), "passport": ("^[A-Z][0-9]{7}$", 8, False), "voter": ("^[A-Z]{3}[0-9]{7}$", 10, False), "birth_certificate": (None, None, False)}
SLOTS = {"pan": "AAAAA0000A", "passport": "A0000000", "voter": "AAA0000000", "aadhaar": "000000000000"}
TO_ALPHA = {"0": "O", "1": "I", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B", "9": "G"}
TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "J": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "A": "4", "T": "7"}
CONFUSIONS = {"0": "8", "8": "06", "1": "7", "7": "1", "5": "6", "6": "58", "3": "9", "9": "3", "2": "7", "4": "9"}

# Sources of a reading and what their agreement weighs. Fixed values.
SOURCE_WEIGHTS = {"barcode": 1.0, "mrz": 1.0, "deterministic": 0.95, "vision+crosscheck": 0.85, "embedded-text": 0.8, "ocr": 0.7, "vision": 0.6, "user_correction": 0.5, "tesseract-fallback": 0.5}
DEFAULT_WEIGHT, STRONG = 0.6, 0.9
HOLDER_SOURCES = ["user", "user_correction", "manual"]
SEVERITY = {"holder_name": "reject", "dob": "reject", "gender": "reject", "guardian_name": "warn", "father_name": "warn", "mother_name": "warn", "spouse_name": "warn", "face": "warn", "address": "info"}
SEVERITIES = ["none", "info", "warn", "needs_confirmation", "reject"]
REQUIRED_FIELDS, IDENTITY_FIELDS, MINIMUM_DOCUMENTS = ["holder_name", "dob"], ["holder_name", "dob", "gender"], 2
ISSUABLE = ["verified_match", "verified_with_partial_overlap", "verified_no_conflict"]

# Fields and what each page of a document prints. Fixed values.
FIELDS = ["holder_name", "surname", "given_names", "father_name", "mother_name", "spouse_name", "dob", "year_of_birth", "age", "gender", "address", "place_of_birth", "document_number", "issue_date", "expiry_date", "nationality", "issuing_authority", "mrz"]
GROUPS = {"guardian_name": ["father_name", "spouse_name"]}
COMPARED = ["holder_name", "dob", "gender", "father_name", "mother_name", "spouse_name", "address"]
NEVER_COMPARED = ["document_number", "issue_date", "expiry_date", "mrz", "issuing_authority", "nationality", "surname", "given_names", "place_of_birth"]
#: (type, page): allowed, required, impossible, conditional
CAPABILITIES = {
    ("pan", "front"): ("holder_name father_name mother_name dob document_number", "holder_name document_number", "gender address mrz expiry_date spouse_name place_of_birth", {}),
    ("aadhaar", "front"): ("holder_name dob year_of_birth gender document_number address", "holder_name document_number", "mother_name mrz expiry_date place_of_birth", {"father_name": r"(?i)\b(S\s*/\s*O|D\s*/\s*O|W\s*/\s*O|father)\b", "spouse_name": r"(?i)\b(W\s*/\s*O|husband|spouse)\b"}),
    ("aadhaar", "back"): ("address document_number", "", "mrz gender", {}),
    ("passport", "front"): ("holder_name surname given_names document_number nationality dob gender place_of_birth issue_date expiry_date issuing_authority mrz", "holder_name document_number dob", "father_name mother_name spouse_name address", {}),
    ("passport", "back"): ("father_name mother_name spouse_name address", "", "document_number mrz place_of_birth", {}),
    ("voter", "front"): ("holder_name father_name spouse_name dob year_of_birth age gender document_number", "holder_name document_number", "mrz expiry_date", {}),
    ("voter", "back"): ("address issue_date", "", "mrz", {}),
    ("driving_licence", "front"): ("holder_name father_name dob gender address document_number issue_date expiry_date issuing_authority", "holder_name document_number", "mrz mother_name", {}),
    ("birth_certificate", "front"): ("holder_name father_name mother_name dob gender place_of_birth document_number issue_date issuing_authority address", "dob", "mrz expiry_date spouse_name", {}),
    ("national_id", "front"): ("holder_name dob year_of_birth gender document_number address", "holder_name document_number", "mrz expiry_date", {}),
    ("national_id", "back"): ("address document_number father_name", "", "mrz", {}),
    ("tax_id", "front"): ("holder_name father_name mother_name dob document_number", "holder_name document_number", "gender address mrz expiry_date", {}),
    ("unknown", "front"): (" ".join(FIELDS), "", "", {}),
}
#: Fields that some layouts print and others don't.
PARTIAL = {"dob": ["voter"], "mother_name": ["pan"], "address": ["passport", "aadhaar"], "father_name": ["voter", "aadhaar"], "spouse_name": ["voter", "passport"], "gender": ["birth_certificate"]}

# Words that stand for no value, names of fields and of types. Fixed values.
NULLISH = ["", "NULL", "NONE", "N/A", "NA", "NIL", "NOT AVAILABLE", "NOT FOUND", "NOT PRESENT", "NOT VISIBLE", "UNKNOWN", "UNDEFINED", "-", "--", "NOT APPLICABLE", "NOT SPECIFIED", "NOT MENTIONED", "ABSENT", "BLANK", "EMPTY"]
ALIASES = {"name": "holder_name", "full_name": "holder_name", "holder": "holder_name", "sex": "gender", "dateofbirth": "dob", "date_of_birth": "dob", "residential_address": "address", "pob": "place_of_birth"}
#: The fields of a card's compressed code, in order, and those that make its address.
CODE_FIELDS = ["email_mobile_flag", "reference_id", "name", "dob", "gender", "careof", "district", "landmark", "house", "location", "pincode", "postoffice", "state", "street", "subdistrict", "vtc"]
CODE_ADDRESS = ["house", "street", "landmark", "location", "vtc", "postoffice", "subdistrict", "district", "state", "pincode"]
TYPES = ["pan", "aadhaar", "passport", "voter", "birth_certificate", "driving_licence"]
TYPE_HINTS = [("birth", "birth_certificate"), ("aadhaar", "aadhaar"), ("aadhar", "aadhaar"), ("pan", "pan"), ("permanent_account", "pan"), ("passport", "passport"), ("voter", "voter"), ("epic", "voter"), ("election", "voter"), ("driv", "driving_licence"), ("licence", "driving_licence"), ("license", "driving_licence")]

# Labels printed beside fields; self-identifying fields need none. Fixed values.
LABELS = {"dob": r"d\.?o\.?b|date\s*of\s*birth|birth\s*date|born|year\s*of\s*birth|y\.?o\.?b|age", "gender": "gender|sex|male|female|transgender", "father_name": r"father|father'?s?\s*name|s\s*/\s*o|son\s*of", "mother_name": r"mother|mother'?s?\s*name|d\s*/\s*o", "spouse_name": r"husband|wife|spouse|w\s*/\s*o", "address": r"address|residence|resident|r\s*/\s*o", "issue_date": r"issue|issued|date\s*of\s*issue", "expiry_date": r"expiry|expires|valid\s*until|date\s*of\s*expiry", "place_of_birth": r"place\s*of\s*birth|birth\s*place"}
SELF_IDENTIFYING = ["document_number", "mrz", "holder_name", "surname", "given_names", "gender"]
SELF_EVIDENT = ["mrz", "barcode", "deterministic"]

# Image quality: sharpness, contrast, glare, darkness below or above which a page is unusable or marginal. Fixed values.
QUALITY = {"sharpness": (22, 55), "contrast": (10, 18), "glare": (0.22, 0.10), "dark": (0.70, 0.55), "width": 480, "height": 300}

# Pages: fields that mark a front or a back. Fixed values.
FRONT_MARKERS, BACK_MARKERS = ["holder_name", "dob", "gender", "mrz"], ["address", "father_name", "mother_name", "spouse_name"]

# Statuses of a document in which nothing works on it any more; fields of a record; what a share may hold. Fixed values.
FINAL_STATUSES = ["ready", "unreadable", "retake_required", "rejected_file", "removed_by_user"]
RECORD_FIELDS = ["holder_name", "dob", "gender", "guardian_name", "mother_name", "address"]
SHARE_FIELDS = ["holder_name", "dob", "gender", "guardian_name", "mother_name", "address", "documents", "photo"]

# Uploads: files of an application, seconds after which work counts as stale, uploads and sessions live, one-time codes. Fixed values.
MAX_FILES, STALE_SECONDS, UPLOAD_SECONDS, SESSION_SECONDS, CODE_SECONDS, CODE_ATTEMPTS = 50, 600, 1_800, 3_600, 300, 5

# Faces: least side in pixels, share of the page, detection score. Fixed values.
FACE = {"side": 48, "share": 0.006, "score": 0.4}
