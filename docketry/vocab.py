"""Word lists, patterns, lookup tables and formats.

Everything in this file is data that results depend on. Every operator that
uses one of these tables takes it as an argument with the table as default.
"""

# --- enumerations (stored as strings) -----------------------------------------
CLASSIFICATIONS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]
INSURANCE_TYPES = ["COMPULSORY", "THIRD_PARTY", "COMPREHENSIVE", "OTHER"]
SEVERITIES = ["INFO", "WARNING", "HIGH", "CRITICAL"]
ACTIONS = [
    "VIEW", "CREATE", "EDIT", "DELETE", "UPLOAD", "DOWNLOAD", "AI_QUERY",
    "EXPORT", "ADMIN", "APPROVE", "GLOBAL_AI_ESCALATION",
]
UNKNOWN_DOCUMENT = "UNKNOWN_VEHICLE_DOCUMENT"

# --- limits -------------------------------------------------------------------
CHUNK_WORDS = 220
OVERLAP_WORDS = 40
RETRIEVAL_K = 8
CONTEXT_CHUNKS = 4
SNIPPET_CHARS = 280
EXTERNAL_CONTEXT_CHARS = 12000
UPLOAD_LIMIT_MB = 200
RENEWAL_GAP_DAYS = 31
DEFAULT_TITLE = "New conversation"

# --- role matrix (role -> actions, all on resource "*") -----------------------
ROLE_MATRIX = {
    "System Administrator": ACTIONS,
    "CIO / IT Administrator": [
        "VIEW", "CREATE", "EDIT", "UPLOAD", "DOWNLOAD", "AI_QUERY", "EXPORT",
        "APPROVE", "ADMIN", "GLOBAL_AI_ESCALATION",
    ],
    "Municipal Secretary": [
        "VIEW", "CREATE", "EDIT", "UPLOAD", "DOWNLOAD", "AI_QUERY", "EXPORT",
        "APPROVE", "GLOBAL_AI_ESCALATION",
    ],
    "Finance": ["VIEW", "UPLOAD", "DOWNLOAD", "AI_QUERY", "EXPORT"],
    "Vehicle Manager": [
        "VIEW", "CREATE", "EDIT", "UPLOAD", "DOWNLOAD", "AI_QUERY", "APPROVE",
    ],
    "Read Only": ["VIEW", "AI_QUERY"],
    "Guest": ["VIEW"],
}

# --- personal-data patterns, applied in this order ----------------------------
# (type, placeholder, pattern, ignore case)
PII_PATTERNS = [
    ("email", "[EMAIL]", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", False),
    ("url", "[URL]", r"\bhttps?://[^\s]+", True),
    ("iban", "[ACCOUNT]", r"\bIL\d{2}[\d ]{15,23}\b", True),
    ("credit_card", "[ACCOUNT]", r"\b(?:\d[ -]?){13,19}\b", False),
    ("phone", "[PHONE]", r"\b(?:\+972[-\s]?|0)(?:\d[-\s]?){8,9}\d\b", False),
    ("vehicle", "[VEHICLE]", r"\b\d{2,3}-\d{2,3}-\d{2,3}\b", False),
    ("id", "[ID]", r"\b\d{9}\b", False),
    ("ip", "[IP]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
]
# Same list, but an international phone number may start anywhere.
PII_PATTERNS_STRICT = [
    (t, h, r"(?:(?<!\w)\+972[-\s]?|\b0)(?:\d[-\s]?){8,9}\d\b" if t == "phone" else p, i)
    for t, h, p, i in PII_PATTERNS
]
# What a text must hold to match: these characters, or a digit of any script.
PII_SIGNS = {p: "@" if t == "email" else "://" for t, _, p, _ in PII_PATTERNS if t in ("email", "url")}
PII_OF_DIGITS = {p for t, _, p, _ in PII_PATTERNS + PII_PATTERNS_STRICT if t not in ("email", "url")}
EIGHT_DIGIT_ID = r"(?<!\d)\d{8}(?!\d)"
HIGH_SENSITIVITY_TYPES = ["id", "credit_card", "iban"]

# --- categories that never leave, tested in this order ------------------------
BLOCKED_CATEGORIES = ["password", "token", "api_key", "credential", "secret"]
BLOCKED_PATTERNS = {
    "password": r"\b(password|סיסמ[הא]|كلمة\s*المرور)\b",
    "token": r"\b(token|bearer\s+[\w.\-]+|טוקן)\b",
    "api_key": r"\b(api[_-]?key|sk-[A-Za-z0-9]{10,})\b",
    "credential": r"\b(credential|credentials|אישורי\s*גישה)\b",
    "secret": r"\b(secret|private\s*key|-----BEGIN)\b",
}
ESCALATION_KEYS = ["*", "GLOBAL_AI_ESCALATION:*", "GLOBAL_AI_ESCALATION"]

# --- text hygiene patterns ----------------------------------------------------
PAGE_NUMBER_LINE = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"
CITATION_MARK = r"\s*\[\s*\d{1,3}\s*\]"
SENTENCE_BREAK = r"(?<=[.!?׃؟])\s+|\n+"
SCAFFOLD = r"\b(context|sources)\b\s*:?|\S*\.pdf[>\]]?|<[^>]*>|[<>]+"
CONTENT_LETTER = r"[A-Za-z֐-׿؀-ۿ]"
ARABIC = r"[؀-ۿ]"
HEBREW = r"[֐-׿]"

# --- prompts and fallback sentences -------------------------------------------
PROMPT_FORMAT = (
    "GLOBAL AI ASSISTANCE REQUEST\n\nProblem:\n%s\n\n"
    "Relevant non-sensitive context:\n%s\n\nQuestion:\n%s\n\nRequirements:\n"
    "- Use only the information provided above.\n"
    "- Do not ask for identifying personal data.\n"
    "- Provide clear reasoning and, where relevant, cite which part of the context you used.\n"
)
DEFAULT_PROBLEM = "A municipal question the local model was not confident answering."
DEFAULT_CONTEXT = "(none provided)"
WEAK_ANSWER_TEXT = {
    "he": "לא הצלחתי למצוא תשובה ברורה במסמכים הזמינים. נסו לנסח מחדש או לבחור את המסמך הרלוונטי.",
    "ar": "لم أتمكن من العثور على إجابة واضحة في المستندات المتاحة. حاول إعادة الصياغة أو اختيار المستند المناسب.",
    "en": "I could not find a clear answer in the available documents. Try rephrasing or selecting the relevant document.",
}
HEDGE_PREFIX = {
    "he": "מצאתי במסמך: ",
    "ar": "وجدت في المستند: ",
    "en": "Found in the document: ",
}

# --- question intents: full patterns, in order --------------------------------
INTENT_PATTERNS = [
    ("document_type", [
        r"סוג\s*(?:ה)?מסמך", r"איזה\s*(?:סוג\s*)?מסמך", r"מה\s*(?:זה\s*)?(?:ה)?מסמך\b",
        r"document\s*type", r"type\s*of\s*(?:the\s*)?document", r"what\s*(?:kind|type).*document",
        r"نوع\s*(?:ال)?مستند", r"ما\s*نوع\s*المستند",
    ]),
    ("vehicle_number", [
        r"מספר\s*(?:ה)?רכב", r"מס[׳'\"]?\s*רישוי", r"מספר\s*רישוי", r"מס[׳'\"]?\s*רכב",
        r"vehicle\s*(?:number|no\.?|registration)", r"plate\s*(?:number|no\.?|#)?",
        r"registration\s*(?:number|no\.?)", r"license\s*plate",
        r"رقم\s*(?:السيارة|المركبة|الترخيص)",
    ]),
    ("policy_number", [
        r"מספר\s*(?:ה)?פוליסה", r"מס[׳'\"]?\s*פוליסה",
        r"policy\s*(?:number|no\.?)", r"رقم\s*(?:البوليصة|الوثيقة|وثيقة)",
    ]),
    ("insurance_start", [
        r"תחילת\s*(?:ה)?ביטוח", r"מועד\s*תחילת\s*(?:ה)?ביטוח", r"תאריך\s*תחילה",
        r"מתי\s*(?:ה)?ביטוח\s*מתחיל", r"מתי\s*מתחיל",
        r"insurance\s*start", r"start\s*date", r"when\s*does\s*(?:the\s*)?insurance\s*start",
        r"بداية\s*التأمين", r"تاريخ\s*البداية", r"متى\s*يبدأ\s*التأمين",
    ]),
    ("insurance_end", [
        r"(?:סיום|תום|פקיעת)\s*(?:ה)?ביטוח", r"מועד\s*פקיעת\s*(?:ה)?ביטוח", r"תאריך\s*סיום",
        r"תוקף\s*(?:ה)?ביטוח", r"עד\s*מתי", r"מתי\s*(?:ה)?ביטוח\s*נגמר", r"מתי\s*נגמר",
        r"insurance\s*(?:end|expiry|expiration)", r"end\s*date", r"expiry\s*date",
        r"when\s*does\s*(?:the\s*)?insurance\s*(?:end|expire)",
        r"نهاية\s*التأمين", r"انتهاء\s*التأمين", r"تاريخ\s*الانتهاء", r"صلاحية\s*التأمين",
        r"متى\s*ينتهي\s*التأمين",
    ]),
    ("policy_holder", [
        r"בעל\s*(?:ה)?פוליסה", r"שם\s*(?:ה)?מבוטח", r"מי\s*(?:ה)?מבוטח",
        r"policy\s*holder", r"insured\s*(?:name|party)", r"صاحب\s*(?:البوليصة|الوثيقة)",
    ]),
    ("id_number", [
        r"מספר\s*זהות", r"תעודת\s*זהות", r"ת[.\"׳']?\s*ז", r"ח[.\"׳']?\s*פ",
        r"id\s*(?:number|no\.?)", r"رقم\s*الهوية",
    ]),
    ("insurer", [
        r"חברת\s*(?:ה)?ביטוח", r"מי\s*(?:ה)?מבטח", r"מי\s*(?:ה)?חברה",
        r"insurer", r"insurance\s*company", r"شركة\s*التأمين",
    ]),
    ("premium", [
        r"דמי\s*ביטוח", r"פרמיה", r"עלות\s*(?:ה)?ביטוח", r"כמה\s*(?:עלה|שילמו|עולה)",
        r"premium", r"how\s*much", r"قسط\s*التأمين",
    ]),
    ("manufacturer", [
        r"(?:יצרן|תוצר)\s*(?:ה)?רכב", r"manufacturer", r"make", r"صانع\s*(?:السيارة|المركبة)",
    ]),
    ("production_year", [
        r"שנת\s*ייצור", r"production\s*year", r"model\s*year", r"سنة\s*الصنع",
    ]),
    ("engine_capacity", [
        r"נפח\s*מנוע", r"engine\s*(?:capacity|size)", r"سعة\s*المحرك",
    ]),
    ("chassis", [
        r"מספר\s*שלדה", r"מס[׳'\"]?\s*שלדה", r"(?:vin|chassis)\s*(?:number|no\.?)?",
        r"رقم\s*(?:الشاسيه|الهيكل)",
    ]),
]
INTENT_ALIASES = {
    "תחילה": "insurance_start", "התחלה": "insurance_start", "מתאריך": "insurance_start",
    "بداية": "insurance_start", "start": "insurance_start",
    "תום": "insurance_end", "סיום": "insurance_end", "פקיעה": "insurance_end",
    "תוקף": "insurance_end", "نهاية": "insurance_end", "انتهاء": "insurance_end",
    "expiry": "insurance_end", "expiration": "insurance_end",
    "רכב": "vehicle_number", "רישוי": "vehicle_number", "مركبة": "vehicle_number",
    "سيارة": "vehicle_number", "plate": "vehicle_number",
    "פוליסה": "policy_number", "بوليصة": "policy_number", "policy": "policy_number",
    "מבוטח": "policy_holder", "مؤمن": "policy_holder",
    "זהות": "id_number", "תז": "id_number", "هوية": "id_number",
    "מחיר": "premium", "עלות": "premium", "פרמיה": "premium", "سعر": "premium",
    "قسط": "premium", "price": "premium", "cost": "premium",
    "מבטח": "insurer", "insurer": "insurer",
}
QUESTION_PUNCTUATION = r"[?.!,:;،؟\"'’“”׳״\-]+"
HEBREW_PREFIX = r"^(ה|ל|ב|מ|ש|כ|ו)"

# --- answer labels by language ------------------------------------------------
FIELD_LABELS = {
    "he": {
        "vehicle_number": "מספר הרכב הוא", "policy_number": "מספר הפוליסה הוא",
        "insurance_start": "תחילת הביטוח היא", "insurance_end": "תום הביטוח הוא",
        "policy_holder": "בעל הפוליסה הוא", "id_number": "מספר הזהות הוא",
        "insurer": "חברת הביטוח היא", "premium": "דמי הביטוח הם",
        "manufacturer": "יצרן הרכב הוא", "production_year": "שנת הייצור היא",
        "engine_capacity": "נפח המנוע הוא", "chassis": "מספר השלדה הוא",
    },
    "ar": {
        "vehicle_number": "رقم المركبة هو", "policy_number": "رقم الوثيقة هو",
        "insurance_start": "بداية التأمين هي", "insurance_end": "نهاية التأمين هي",
        "policy_holder": "صاحب الوثيقة هو", "id_number": "رقم الهوية هو",
        "insurer": "شركة التأمين هي", "premium": "قسط التأمين هو",
        "manufacturer": "صانع المركبة هو", "production_year": "سنة الصنع هي",
        "engine_capacity": "سعة المحرك هي", "chassis": "رقم الشاسيه هو",
    },
    "en": {
        "vehicle_number": "Vehicle number:", "policy_number": "Policy number:",
        "insurance_start": "Insurance start:", "insurance_end": "Insurance end:",
        "policy_holder": "Policy holder:", "id_number": "ID number:",
        "insurer": "Insurer:", "premium": "Premium:",
        "manufacturer": "Manufacturer:", "production_year": "Production year:",
        "engine_capacity": "Engine capacity:", "chassis": "Chassis number:",
    },
}
TYPE_LABELS = {
    "he": {
        "VEHICLE_REGISTRATION": "רישיון רכב", "COMPULSORY_INSURANCE": "ביטוח חובה",
        "COMPREHENSIVE_INSURANCE": "ביטוח מקיף", "THIRD_PARTY_INSURANCE": "ביטוח צד ג'",
        "PROTECTION_APPROVAL": "אישור מיגון", "VEHICLE_TEST": "מבחן רכב (טסט)",
        "MAINTENANCE_INVOICE": "חשבונית/מסמך טיפול", "WARRANTY": "כתב אחריות",
    },
    "ar": {
        "VEHICLE_REGISTRATION": "رخصة المركبة", "COMPULSORY_INSURANCE": "تأمين إلزامي",
        "COMPREHENSIVE_INSURANCE": "تأمين شامل", "THIRD_PARTY_INSURANCE": "تأمين طرف ثالث",
        "PROTECTION_APPROVAL": "شهادة تحصين", "VEHICLE_TEST": "فحص المركبة",
        "MAINTENANCE_INVOICE": "فاتورة/مستند صيانة", "WARRANTY": "شهادة ضمان",
    },
    "en": {
        "VEHICLE_REGISTRATION": "Vehicle registration", "COMPULSORY_INSURANCE": "Compulsory insurance",
        "COMPREHENSIVE_INSURANCE": "Comprehensive insurance", "THIRD_PARTY_INSURANCE": "Third-party insurance",
        "PROTECTION_APPROVAL": "Protection certificate", "VEHICLE_TEST": "Vehicle test",
        "MAINTENANCE_INVOICE": "Repair/maintenance invoice", "WARRANTY": "Warranty",
    },
}
TYPE_LEAD = {"he": "סוג המסמך הוא", "ar": "نوع المستند هو", "en": "Document type:"}

# --- document classes: (class, type, terms), in priority order ----------------
DOCUMENT_TERMS = [
    ("mandatory_insurance", "COMPULSORY_INSURANCE",
     ["תעודת ביטוח חובה", "ביטוח חובה", "פקודת ביטוח רכב מנועי", "פקודת ביטוח"]),
    ("comprehensive_insurance", "COMPREHENSIVE_INSURANCE", ["ביטוח מקיף", "מקיף"]),
    ("third_party_insurance", "THIRD_PARTY_INSURANCE", ["צד ג'", "צד ג", "צד שלישי"]),
    ("vehicle_registration", "VEHICLE_REGISTRATION",
     ["רישיון רכב", "רשיון רכב", "משרד התחבורה", "אגף הרכב"]),
    ("protection_approval", "PROTECTION_APPROVAL", ["אישור מיגון", "מיגון"]),
    ("vehicle_test", "VEHICLE_TEST", ["טסט", "מבחן רכב", "בדיקת רכב", "תקינות"]),
    ("repair_invoice", "MAINTENANCE_INVOICE", ["חשבונית", "מוסך", "תיקון", "חשבונית מס"]),
    ("warranty", "WARRANTY", ["אחריות", "כתב אחריות"]),
]

# --- label anchors: field -> phrases, in order --------------------------------
ANCHORS = {
    "vehicle_number": [
        "מס' רישוי", "מספר רישוי", "מס רישוי", "מס׳ רישוי",
        "מספר הרכב", "מס' רכב", "מספר רכב", "מס הרכב",
    ],
    "id_number": [
        "מס' זהות / ח\"פ", "מס' זהות", "מספר זהות", "ת.ז", "ת\"ז",
        "תעודת זהות", "ח.פ", "ח\"פ", "ח.פ.", "מספר עוסק",
    ],
    "policy_number": [
        "מס' פוליסה", "מספר פוליסה", "פוליסה מספר", "פוליסה מס'", "מס פוליסה",
    ],
    "policy_holder": ["שם בעל הפוליסה", "בעל הפוליסה", "שם המבוטח"],
    "address": ["כתובת בעל הפוליסה", "כתובת המבוטח"],
    "agent_number": ["מס' סוכן", "מספר סוכן", "מס' סוכן משני", "מספר סוכן משני"],
    "chassis": ["מספר שלדה", "מס' שלדה"],
    "manufacturer": ["שם היצרן והדגם", "שם היצרן", "יצרן", "תוצר"],
    "model": ["דגם הרכב", "דגם"],
    "engine_capacity": ["נפח מנוע", "נפח מנוע / הספק"],
    "production_year": ["שנת ייצור", "שנת יצור", "שנת ייצור / מועד עליה לכביש"],
    "insurance_start": [
        "מועד תחילת הביטוח", "תחילת הביטוח", "תחילת ביטוח", "מתאריך",
        "בתוקף מ", "החל מ", "תקופת הביטוח מ",
    ],
    "insurance_end": [
        "מועד פקיעת הביטוח", "פקיעת הביטוח", "תום הביטוח", "סיום הביטוח",
        "עד תאריך", "בתוקף עד", "תקופת הביטוח עד",
    ],
    "premium": ["דמי ביטוח", "פרמיה", "סה\"כ לתשלום", "סך לתשלום", "סכום"],
    "insurer": ["חברת הביטוח", "שם המבטח"],
}
LABEL_THRESHOLD = 0.86
LABEL_QUOTES = "\"'`״׳‘’“”"

# --- insurer signatures, in order ---------------------------------------------
INSURER_SIGNATURES = [
    ("הפול", ["המאגר הישראלי לביטוחי רכב", "המאגר הישראלי לבטוחי רכב", "pool.org.il"]),
    ("הראל", ["הראל חברה לביטוח", "הראל ביטוח"]),
    ("כלל", ["כלל חברה לביטוח", "כלל ביטוח"]),
    ("מגדל", ["מגדל חברה לביטוח", "מגדל ביטוח"]),
    ("הפניקס", ["הפניקס חברה לביטוח", "הפניקס ביטוח"]),
    ("מנורה מבטחים", ["מנורה מבטחים ביטוח", "מנורה מבטחים"]),
    ("איילון", ["איילון חברה לביטוח", "איילון ביטוח"]),
    ("שלמה ביטוח", ["שלמה חברה לביטוח", "שלמה ביטוח"]),
    ("ביטוח ישיר", ["ביטוח ישיר", "איי.די.איי חברה לביטוח"]),
    ("הכשרה", ["הכשרה חברה לביטוח", "הכשרה ביטוח"]),
    ("AIG", ["AIG", "איי.איי.ג'י"]),
    ("שומרה", ["שומרה חברה לביטוח", "שומרה ביטוח"]),
    ("ליברה", ["ליברה חברה לביטוח", "ליברה ביטוח"]),
    ("weSure", ["weSure", "ווישור"]),
]

# --- patterns on document text ------------------------------------------------
POLICY_NUMBER = r"\b\d{3}-\d{6,}-\d{2}\b"
DAY_FIRST_TOKEN = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
START_LABELS = ["מועד תחילת הביטוח", "תחילת הביטוח"]
END_LABELS = ["מועד פקיעת הביטוח", "פקיעת הביטוח", "תום הביטוח"]
PREMIUM_PATTERNS = [
    r"₪\s*([0-9][0-9,]*\.\d{2})\s*:?\s*דמי\s*ביטוח",
    r"(?:ש\s*[\"׳״']?\s*ח|₪)?\s*([0-9][0-9,]*\.\d{2})\s*:?\s*סכום",
    r"דמי\s*ביטוח\s*:?\s*(?:₪|ש\s*[\"׳״']?\s*ח)?\s*([0-9][0-9,]*\.\d{2})",
]

# --- flat-text extraction (old form) ------------------------------------------
FLAT_INSURERS = [
    "הראל", "כלל", "מגדל", "הפניקס", "מנורה", "איילון", "שלמה", "ביטוח ישיר",
    "הכשרה", "AIG", "Harel", "Clal", "Migdal", "Phoenix", "Menora",
]
FLAT_PLATE = r"\b\d{2,3}-?\d{2,3}-?\d{2,3}\b"
FLAT_DATE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
FLAT_POLICY = (
    r"(?:פוליסה|מספר פוליסה|policy(?:\s*(?:no|number|#))?)\D{0,10}([A-Za-z0-9\-/]{5,20})"
)
FLAT_VIN = r"\b[A-HJ-NPR-Z0-9]{17}\b"
# (type, confidence, exact words, lower-case words), in order
FLAT_CLASSES = [
    ("VEHICLE_REGISTRATION", 0.8, ["רישיון רכב", "רשיון רכב"], ["vehicle registration"]),
    ("COMPULSORY_INSURANCE", 0.75, ["חובה"], ["compulsory"]),
    ("COMPREHENSIVE_INSURANCE", 0.75, ["מקיף"], ["comprehensive"]),
    ("THIRD_PARTY_INSURANCE", 0.75, ["צד ג", "צד שלישי"], ["third party"]),
    ("VEHICLE_TEST", 0.6, ["טסט"], ["inspection", "roadworthiness"]),
]
FLAT_INSURANCE_TYPES = [
    ("COMPREHENSIVE", ["מקיף"], ["comprehensive"]),
    ("COMPULSORY", ["חובה"], ["compulsory"]),
    ("THIRD_PARTY", ["צד ג", "צד שלישי"], ["third party"]),
]

# --- which fields a document class resolves, and how --------------------------
GENERAL_FIELDS = {
    "numeric": ["id_number", "agent_number", "engine_capacity", "production_year"],
    "raw": ["policy_number", "premium"],
    "text": ["policy_holder", "manufacturer", "model"],
    "date": ["insurance_start", "insurance_end"],
}
REGISTRATION_FIELDS = {
    "numeric": ["engine_capacity", "production_year", "id_number"],
    "raw": ["chassis"],
    "text": ["manufacturer", "model"],
    "date": [],
}
# penalties of a vehicle-number candidate claimed by another label
CLAIM_PENALTIES = {
    "id_number": -100.0, "policy_number": -100.0, "agent_number": -80.0, "chassis": -60.0,
}
OCR_DIGITS = ("OoQDIl|SBZg", "00001115829")

# --- column sets of the public entities ---------------------------------------
ENTITY_COLUMNS = {
    "department": ["id", "name", "slug"],
    "user": ["id", "email", "full_name", "is_superuser", "locale", "department", "permissions"],
    "agent": ["id", "name", "slug", "description", "icon", "enabled"],
    "document": ["id", "title", "original_filename", "file_type", "classification", "language",
                 "page_count", "processing_status", "indexing_status", "created_at"],
    "conversation": ["id", "title", "agent_id", "pinned", "archived", "created_at", "updated_at"],
    "message_source": ["document_id", "document_title", "page", "snippet", "rank"],
    "message": ["id", "role", "content", "origin", "model", "provider", "confidence",
                "created_at", "sources"],
    "vehicle": ["id", "registration_number", "normalized_number", "manufacturer", "model",
                "is_active"],
    "policy": ["id", "vehicle_id", "policy_number", "insurance_type", "insurer", "start_date",
               "end_date", "status", "verified"],
    "conflict": ["id", "vehicle_id", "policy_a_id", "policy_b_id", "conflict_type",
                 "overlap_days", "severity", "status", "notes"],
    "extraction": ["id", "field_name", "ocr_original_value", "corrected_value", "confidence",
                   "verified"],
    "vehicle_document": ["id", "vehicle_id", "document_type", "original_filename",
                         "review_status", "classification_confidence", "created_at"],
    "audit": ["id", "action", "resource_type", "resource_id", "result", "detail", "created_at"],
    "integration": ["id", "name", "kind", "enabled", "status"],
}
