"""Fixed values of free-text scanning: labels, spoken digits, guard phrases, edge characters."""

# fixed values
LABELS = [
    ("IMEI", ["imei", "جهاز"]),
    ("IMSI", ["imsi"]),
    ("ICCID", ["iccid", "sim", "شريحة"]),
    ("EG_NATIONAL_ID", ["قومي", "هوية", "national id", "nid", "الرقم القومي"]),
    ("CREDIT_CARD", ["card", "visa", "mastercard", "بطاقة", "ائتمان", "فيزا", "كارت"]),
    ("PHONE_NUMBER", ["موبايل", "الموبايل", "هاتف", "تليفون", "phone", "mobile", "msisdn", "line", "connected"]),
]
CVV_LABELS = ["cvv", "cvc", "سي في", "سي في في", "الضهر", "ظهر"]

# fixed values: spoken number words and the digits they stand for
SPOKEN = {
    "0": "زيرو صفر zero", "1": "واحد وحد حد one", "2": "اتنين اثنين اثنان two", "3": "تلاتة ثلاثة تلاته ثلاثه تلات ثلاث three",
    "4": "أربعة اربعة أربعه اربعه four", "5": "خمسة خمسه five", "6": "ستة سته six", "7": "سبعة سبعه seven",
    "8": "تمانية ثمانية تمانيه ثمانيه تمنيه تمينة تمنية eight", "9": "تسعة تسعه nine",
    "10": "عشرة عشره ten", "11": "حداشر احداشر eleven", "12": "اتناشر اثناشر twelve", "13": "تلاتاشر ثلاثاشر thirteen",
    "14": "اربعتاشر أربعتاشر fourteen", "15": "خمسطاشر خمستاشر fifteen", "16": "ستاشر sixteen", "17": "سبعتاشر seventeen",
    "18": "تمنتاشر ثمنتاشر eighteen", "19": "تسعتاشر nineteen",
    "20": "عشرين", "30": "تلاتين ثلاثين", "40": "اربعين أربعين", "50": "خمسين", "60": "ستين", "70": "سبعين",
    "80": "تمانين ثمانين تمنين ثمنين", "90": "تسعين",
    "100": "مية ميه مائة مئه hundred", "200": "ميتين مئتين مائتين", "300": "تلاتمية ثلاثمية ثلاثمائة تلتومية تلتوميه",
    "400": "اربعمية أربعميه اربعمائة ربعمية ربعميه", "500": "خمسمية خمسمائة", "600": "ستمية ستمائة", "700": "سبعمية سبعمائة",
    "800": "تمنمية ثمنمية ثمانمائة", "900": "تسعمية تسعمائة",
}
# fixed values: plural digit nouns, "four fives" = 5555
SPOKEN_PLURALS = {
    "1": "وحدات واحدات", "2": "اتنينات اثنينات", "3": "تلاتات ثلاثات", "4": "أربعات اربعات", "5": "خمسات", "6": "ستات",
    "7": "سبعات", "8": "تمانيات ثمانيات", "9": "تسعات", "0": "زيروات اصفار أصفار",
}

# fixed values: prompt-injection phrases and toxic terms
INJECTION = [
    r"ignore (all|any|the)?\s*(previous|prior|above)\s*instructions",
    r"disregard (the )?(system|previous) prompt",
    r"you are (now|no longer) (dan|jailbroken|unrestricted)",
    r"reveal (your|the) (system prompt|instructions)",
    r"pretend (you have|to have) no (restrictions|guidelines|filters)",
    r"do anything now",
    r"bypass (your|the) (safety|content) (filter|guidelines|policy)",
    r"\bsystem prompt\b[\s\S]{0,20}\b(leak|dump|print|show|reveal)\b",
    r"act as if you (have|had) no (rules|restrictions|guidelines)",
    r"jailbreak",
]
TOXIC = ["idiot", "stupid", "moron", "shut up", "i hate you", "kill yourself", "worthless", "die in a fire", "go to hell"]

# fixed values: entity families for comparing values
DIGIT_FAMILY = ["PHONE_NUMBER", "PHONE", "MSISDN", "EG_NATIONAL_ID", "NATIONAL_ID", "CREDIT_CARD", "PARTIAL_CARD", "IMEI", "IMSI",
                "ICCID", "OTP", "SIM_PUK", "VOUCHER"]
ARABIC_FAMILY = ["PERSON", "NAME", "LOCATION", "ADDRESS", "ORGANIZATION", "NRP"]
EMAIL_FAMILY = ["EMAIL_ADDRESS", "EMAIL"]
ADDRESS_FAMILY = ["MAC_ADDRESS", "IP_ADDRESS", "IPV4", "IPV6"]
NO_TRIM = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS", "MAC_ADDRESS"]
EDGE_LEAD, EDGE_TAIL = r"^[\s:：=\-–—]+", r"[\s.،,;:!?؟…»«\"']+$"
KEEP_BOTH = ["CVV", "CREDIT_CARD", "CREDIT_CARD_EXPIRATION", "OTP", "IP_ADDRESS", "PASSPORT", "EG_TAX_ID"]

# fixed values: which source of a span wins
ENGINE_PRIORITY = {"phone": 40, "preprocess": 35, "regex": 30, "ner": 20, "review": 10}

# fixed values: what an address clause must hold, from where on it counts, and words of assent at its end
ADDRESS_HEAD = (r"(?i)(?:\d+|شارع|(?<!عن )طريق|عمارة|شقة|حي|مدينة|قدام|واحة|الكيلو|"
                r"villa|street|st\.?|building|apt\.?|apartment|flat)")
TRAIL_FILLER = r"(?i)(?:\s+(?:صح|right|yes))+$"
SENTENCE_STOPS = ".؟!\n"
SPEAKERS = "Agent|Caller|الوكيل|المتصل"
