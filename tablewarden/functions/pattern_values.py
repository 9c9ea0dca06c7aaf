"""Fixed values of the detection catalogue: patterns, tokens, collision groups and entity levels.

Each pattern: name, entity, group (structured = whole cell, free_text = inside text), script, validator,
collision group, base score, score after a passed validator, column-name hints, regular expression.
"""

# fixed values
PATTERNS = [
    # Egyptian phone numbers
    ("msisdn_egypt_national", "PHONE_NUMBER", "structured", "numeric", None, None, 0.90, None, "phone mobile msisdn tel هاتف رقم جوال", r"^01[0125]\d{8}$"),
    ("msisdn_egypt_international", "PHONE_NUMBER", "structured", "numeric", None, None, 0.92, None, "phone mobile msisdn tel هاتف رقم", r"^\+201[0125]\d{8}$"),
    ("msisdn_egypt_double_zero", "PHONE_NUMBER", "structured", "numeric", None, None, 0.88, None, "phone mobile msisdn هاتف", r"^0020?1[0125]\d{8}$"),
    ("msisdn_egypt_any_format", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile contact هاتف رقم", r"^(?:\+20|0020|0)?1[0125]\d{8}$"),
    ("msisdn_egypt_vodafone", "PHONE_NUMBER", "structured", "numeric", None, "vodafone_cash_vs_msisdn", 0.60, None, "phone mobile vodafone هاتف", r"^(?:\+20|0)?10\d{8}$"),
    ("msisdn_egypt_etisalat", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile etisalat eand هاتف", r"^(?:\+20|0)?11\d{8}$"),
    ("msisdn_egypt_orange", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile orange هاتف", r"^(?:\+20|0)?12\d{8}$"),
    ("msisdn_egypt_we", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile we telecom هاتف", r"^(?:\+20|0)?15\d{8}$"),
    ("msisdn_egypt_spaced", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile هاتف", r"^(?:\+20|0)?\s?1[0125]\s?\d{4}\s?\d{4}$"),
    ("msisdn_egypt_scan", "PHONE_NUMBER", "free_text", "numeric", None, None, 0.60, None, "notes comment description remarks ملاحظات", r"\b(?:\+20|0020|0)?1[0125]\d{8}\b"),
    ("landline_egypt_cairo", "PHONE_NUMBER", "structured", "numeric", None, None, 0.55, None, "phone landline tel هاتف تليفون", r"^(?:\+20|0)?2\d{8}$"),
    ("landline_egypt_alexandria", "PHONE_NUMBER", "structured", "numeric", None, None, 0.55, None, "phone landline tel هاتف", r"^(?:\+20|0)?3\d{8}$"),
    ("landline_egypt_other_gov", "PHONE_NUMBER", "structured", "numeric", None, None, 0.55, None, "phone landline tel هاتف", r"^(?:\+20|0)?(?:13|40|45|46|47|48|50|55|57|62|64|65|66|68|69|82|84|86|88|92|93|95|96|97)\d{7}$"),
    ("landline_egypt_scan", "PHONE_NUMBER", "free_text", "numeric", None, None, 0.75, None, "notes comment remarks ملاحظات", r"\b(?:\+?20|0020|0)?(?:[23]\d{8}|(?:13|40|45|46|47|48|50|55|57|62|64|65|66|68|69|82|84|86|88|92|93|95|96|97)\d{7}|554\d{6})\b"),
    # Egyptian national id
    ("national_id_egypt", "EG_NATIONAL_ID", "structured", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.50, None, "national id nid رقم_قومي هوية الرقم_القومي", r"^[23]\d{13}$"),
    ("national_id_egypt_strict", "EG_NATIONAL_ID", "structured", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.92, 0.97, "national id nid رقم_قومي هوية الرقم_القومي", r"^[23]\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:0[1-4]|1[1-9]|2[1-9]|3[1-5]|88)\d{5}$"),
    ("national_id_egypt_male", "EG_NATIONAL_ID", "structured", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.93, 0.97, "national id gender male رقم_قومي ذكر", r"^[23]\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:0[1-4]|1[1-9]|2[1-9]|3[1-5]|88)\d{3}[13579]\d$"),
    ("national_id_egypt_female", "EG_NATIONAL_ID", "structured", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.93, 0.97, "national id gender female رقم_قومي أنثى", r"^[23]\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:0[1-4]|1[1-9]|2[1-9]|3[1-5]|88)\d{3}[02468]\d$"),
    ("national_id_egypt_scan", "EG_NATIONAL_ID", "free_text", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.70, None, "notes comment رقم_قومي هوية", r"\b[23]\d{13}\b"),
    # passports
    ("passport_egypt", "PASSPORT", "structured", "latin", None, "passport_alpha_eight_digits", 0.70, None, "passport travel جواز سفر", r"^[A-Z]\d{8}$"),
    ("passport_egypt_scan", "PASSPORT", "free_text", "latin", None, "passport_alpha_eight_digits", 0.65, None, "notes passport travel جواز", r"\b[A-Z]\d{8}\b"),
    # banking, tax, utilities, vehicles
    ("iban_egypt", "IBAN_CODE", "structured", "latin", "iban", None, 0.60, 0.97, "iban bank account حساب بنك", r"^EG\d{2}[A-Z0-9]{25}$"),
    ("swift_bic_egypt", "SWIFT_BIC", "structured", "latin", "swift", None, 0.55, 0.95, "swift bic bank transfer بنك", r"^[A-Z]{4}EG[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"),
    ("meeza_card", "CREDIT_CARD", "structured", "numeric", "luhn", "sixteen_digit_numeric", 0.70, 0.95, "card meeza payment بطاقة", r"^627033\d{10}$"),
    ("instapay_handle", "EMAIL_ADDRESS", "structured", "latin", None, None, 0.90, None, "instapay payment wallet محفظة", r"^[A-Za-z0-9._-]{3,30}@instapay$"),
    ("vodafone_cash_account", "PHONE_NUMBER", "structured", "numeric", None, "vodafone_cash_vs_msisdn", 0.60, None, "wallet cash vodafone محفظة فودافون_كاش", r"^(?:\+20|0)?10\d{8}$"),
    ("tax_id_egypt", "EG_TAX_ID", "structured", "numeric", None, "nine_digit_numeric", 0.60, None, "tax tin commercial ضريبي ضريبة", r"^\d{3}-\d{3}-\d{3}$"),
    ("tax_id_egypt_plain", "EG_TAX_ID", "structured", "numeric", None, "nine_digit_numeric", 0.60, None, "tax tin ضريبي", r"^\d{9}$"),
    ("electricity_account_with_label", "UTILITY_ACCOUNT", "free_text", "both", None, None, 0.85, None, "notes comment electricity كهرباء", r"(?i)\b(?:elec(?:tricity)?|كهرباء)\s*(?:acc(?:ount)?|no|number|#)?\s*[:#\-]*\s*\d{8,16}\b"),
    ("water_account_with_label", "UTILITY_ACCOUNT", "free_text", "both", None, None, 0.85, None, "notes comment water مياه", r"(?i)\b(?:water|wtr|مياه)\s*(?:acc(?:ount)?|no|number|#)?\s*[:#\-]*\s*\d{8,16}\b"),
    ("gas_account_with_label", "UTILITY_ACCOUNT", "free_text", "both", None, None, 0.85, None, "notes comment gas غاز", r"(?i)\b(?:gas|غاز)\s*(?:acc(?:ount)?|no|number|#)?\s*[:#\-]*\s*\d{8,16}\b"),
    ("vehicle_plate_egypt_arabic", "EG_VEHICLE_PLATE", "structured", "arabic", None, None, 0.45, None, "plate vehicle car لوحة سيارة", "^[ء-ي]{1,3}\\s?\\d{1,4}$"),
    ("vehicle_plate_egypt_latin", "EG_VEHICLE_PLATE", "structured", "latin", None, None, 0.45, None, "plate vehicle car لوحة", r"^[A-Z]{1,3}\s?\d{1,4}$"),
    # subscriber, device and network
    ("imsi_egypt", "IMSI", "structured", "numeric", None, None, 0.95, None, "imsi subscriber sim مشترك", r"^602(?:01|02|03|04)\d{10}$"),
    ("imsi_strict", "IMSI", "structured", "numeric", "imsi", "fifteen_digit_numeric", 0.55, 0.92, "imsi subscriber sim", r"^602\d{12}$"),
    ("imsi_generic", "IMSI", "structured", "numeric", "imsi", "fifteen_digit_numeric", 0.40, 0.90, "imsi subscriber sim msin mcc mnc مشترك", r"^\d{14,15}$"),
    ("iccid_egypt", "ICCID", "structured", "numeric", "iccid", None, 0.95, None, "iccid sim card شريحة", r"^8920(?:01|02|03|04)\d{14,16}$"),
    ("iccid", "ICCID", "structured", "numeric", "iccid", None, 0.88, None, "iccid sim card شريحة", r"^89\d{16,20}$"),
    ("imei", "IMEI", "structured", "numeric", "imei", "fifteen_digit_numeric", 0.60, 0.95, "imei device handset equipment جهاز", r"^\d{15}$"),
    ("imei_with_dashes", "IMEI", "structured", "numeric", "imei", None, 0.90, 0.95, "imei device handset جهاز", r"^\d{2}-\d{6}-\d{6}-\d$"),
    ("imeisv", "IMEI", "structured", "numeric", "imeisv", "sixteen_digit_numeric", 0.55, 0.88, "imeisv device software جهاز", r"^\d{16}$"),
    ("ipv4_address", "IP_ADDRESS", "structured", "numeric", None, None, 0.90, None, "ip address source destination src dst", r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$"),
    ("ipv4_private", "IP_ADDRESS", "structured", "numeric", None, None, 0.70, None, "ip internal private src dst", r"^(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2})$"),
    ("ipv6_address", "IP_ADDRESS", "structured", "hex", None, None, 0.90, None, "ip ipv6 address src dst", r"^(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}$"),
    ("mac_address_colon", "MAC_ADDRESS", "structured", "hex", "mac", None, 0.60, 0.92, "mac address device hardware جهاز", r"^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"),
    ("scan_ipv4", "IP_ADDRESS", "free_text", "numeric", None, None, 0.82, None, "log notes comment event", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("scan_mac_address", "MAC_ADDRESS", "free_text", "hex", None, None, 0.82, None, "log notes event device", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b"),
    # places
    ("gps_pair", "LOCATION", "structured", "numeric", None, None, 0.88, None, "gps location coordinate lat lon موقع", r"^[-+]?\d{1,3}\.\d+,\s?[-+]?\d{1,3}\.\d+$"),
    ("gps_latitude", "LOCATION", "structured", "numeric", None, None, 0.45, None, "lat latitude خط_عرض", r"^[-+]?(?:[1-8]?\d|90)\.\d{4,}$"),
    ("gps_longitude", "LOCATION", "structured", "numeric", None, None, 0.45, None, "lon longitude lng خط_طول", r"^[-+]?(?:180|1[0-7]\d|[1-9]?\d)\.\d{4,}$"),
    ("gps_scaled_int", "LOCATION", "structured", "numeric", "scaled_coordinate", None, 0.35, 0.70, "lat lon gps coord خط_عرض خط_طول", r"^[-+]?\d{7,9}$"),
    ("wkt_point", "LOCATION", "structured", "latin", None, None, 0.90, None, "gps location wkt geom geometry موقع", r"^POINT\s*\(\s*[-+]?\d+(?:\.\d+)?\s+[-+]?\d+(?:\.\d+)?\s*\)$"),
    ("gps_dms", "LOCATION", "structured", "latin", None, None, 0.92, None, "gps location dms coordinate موقع", r"""^\d{1,3}°\s*\d{1,2}'\s*\d{1,2}(?:\.\d+)?"\s*[NSEW]$"""),
    # people and contact
    ("url", "URL", "structured", "latin", None, None, 0.85, None, "url link website social profile oauth linkedin facebook twitter instagram", r"^(?:https?|ftp)://[^\s/$.?#].[^\s]*$"),
    ("email_address", "EMAIL_ADDRESS", "structured", "latin", None, None, 0.92, None, "email mail بريد إيميل", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"),
    ("scan_email", "EMAIL_ADDRESS", "free_text", "latin", None, None, 0.85, None, "notes comment بريد ملاحظات", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("person_name_arabic", "PERSON", "structured", "arabic", None, None, 0.40, None, "اسم_العميل الاسم_الكامل اسم_كامل customer_name client_name full_name", "^[ء-ي]+(?:\\s[ء-ي]+){1,4}$"),
    ("person_name_latin", "PERSON", "structured", "latin", None, None, 0.40, None, "first_name last_name full_name fname lname firstname lastname fullname customer_name client_name holder_name contact_name", r"^[A-Z][a-z]+(?:[\s\-'][A-Z][a-z]+){1,4}$"),
    ("date_of_birth_ymd", "DATE_TIME", "structured", "numeric", None, None, 0.50, None, "dob birth born birthdate birthday dateofbirth تاريخ_ميلاد ميلاد", r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$"),
    ("date_of_birth_dmy", "DATE_TIME", "structured", "numeric", None, None, 0.50, None, "dob birth born birthdate birthday dateofbirth تاريخ_ميلاد ميلاد", r"^(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/\d{4}$"),
    ("gender_indicator", "GENDER", "structured", "latin", None, None, 0.75, None, "gender sex نوع جنس", r"(?i)^(?:M|F|X|Male|Female|Other|O|Unknown|U)$"),
    ("postcode_egypt", "LOCATION", "structured", "numeric", None, None, 0.35, None, "postcode zip postal postal_code رمز_بريدي بريدي", r"^\d{5}$"),
    # other national ids and phones of the region
    ("national_id_uae", "NATIONAL_ID", "structured", "numeric", "uae_id", None, 0.50, 0.95, "national id uae emirates هوية", r"^\d{3}-\d{4}-\d{7}-\d$"),
    ("national_id_ksa", "NATIONAL_ID", "structured", "numeric", "ksa_id", "ten_digit_numeric", 0.45, 0.92, "national id iqama saudi هوية اقامة", r"^[12]\d{9}$"),
    ("national_id_jordan", "NATIONAL_ID", "structured", "numeric", None, "ten_digit_numeric", 0.30, None, "national id jordan الرقم_الوطني", r"^\d{10}$"),
    ("national_id_morocco", "NATIONAL_ID", "structured", "latin", None, None, 0.55, None, "national id cin morocco هوية", r"^[A-Z]{1,2}\d{6}$"),
    ("msisdn_ksa", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile ksa saudi هاتف", r"^(?:\+966|00966|0)?5\d{8}$"),
    ("msisdn_uae", "PHONE_NUMBER", "structured", "numeric", None, None, 0.60, None, "phone mobile uae emirates هاتف", r"^(?:\+971|00971|0)?5[024568]\d{7}$"),
    ("msisdn_e164", "PHONE_NUMBER", "structured", "numeric", None, None, 0.85, None, "phone mobile international هاتف", r"^\+[1-9]\d{6,14}$"),
    # cards, accounts, wallets
    ("credit_card_visa", "CREDIT_CARD", "structured", "numeric", "luhn", "sixteen_digit_numeric", 0.70, 0.95, "card visa credit payment بطاقة", r"^4\d{12}(?:\d{3})?(?:\d{3})?$"),
    ("credit_card_mastercard", "CREDIT_CARD", "structured", "numeric", "luhn", "sixteen_digit_numeric", 0.70, 0.95, "card mastercard credit payment بطاقة", r"^(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)\d{12}$"),
    ("credit_card_with_spaces", "CREDIT_CARD", "structured", "numeric", "luhn", "sixteen_digit_numeric", 0.70, 0.95, "card credit payment بطاقة", r"^\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}$"),
    ("scan_credit_card", "CREDIT_CARD", "free_text", "numeric", "luhn", None, 0.75, None, "notes comment payment بطاقة", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"),
    ("iban_generic", "IBAN_CODE", "structured", "latin", "iban", None, 0.45, 0.93, "iban bank account حساب بنك تحويل", r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"),
    ("scan_iban", "IBAN_CODE", "free_text", "latin", None, None, 0.78, None, "notes comment transfer بنك", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("crypto_wallet_btc_legacy", "CRYPTO_WALLET", "structured", "latin", "btc", None, 0.55, 0.95, "wallet btc bitcoin crypto محفظة", r"^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$"),
    ("crypto_wallet_eth", "CRYPTO_WALLET", "structured", "hex", None, None, 0.90, None, "wallet eth ethereum crypto محفظة", r"^0x[a-fA-F0-9]{40}$"),
    # keys, tokens, hashes, codes
    ("api_key_aws_access", "API_KEY", "structured", "latin", None, None, 0.97, None, "key api aws access token مفتاح", r"^AKIA[0-9A-Z]{16}$"),
    ("api_key_google", "API_KEY", "structured", "latin", None, None, 0.97, None, "key api google token مفتاح", r"^AIza[0-9A-Za-z\-_]{35}$"),
    ("api_key_github_pat", "API_KEY", "structured", "latin", None, None, 0.97, None, "key token github pat مفتاح", r"^ghp_[A-Za-z0-9]{36}$"),
    ("api_key_anthropic", "API_KEY", "structured", "latin", None, None, 0.98, None, "key token api anthropic مفتاح", r"^sk-ant-[A-Za-z0-9\-_]{32,}$"),
    ("jwt_token", "JWT_TOKEN", "structured", "latin", "jwt", None, 0.70, 0.95, "jwt token bearer auth access_token id_token", r"^eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*$"),
    ("scan_jwt", "JWT_TOKEN", "free_text", "latin", None, None, 0.88, None, "log notes token auth", r"\beyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*\b"),
    ("hash_bcrypt", "PASSWORD_HASH", "structured", "latin", None, None, 0.95, None, "password hash pwd كلمة_سر مشفر", r"^\$2[abxy]?\$\d{2}\$[./A-Za-z0-9]{53}$"),
    ("hash_argon2", "PASSWORD_HASH", "structured", "latin", None, None, 0.96, None, "password hash pwd كلمة_سر", r"^\$argon2(?:i|d|id)\$v=\d+\$m=\d+,t=\d+,p=\d+\$[A-Za-z0-9+/]+\$[A-Za-z0-9+/]+$"),
    ("hash_md5_like", "PASSWORD_HASH", "structured", "hex", None, None, 0.50, None, "password pwd كلمة_سر", r"^[a-f0-9]{32}$"),
    ("hash_sha256_like", "PASSWORD_HASH", "structured", "hex", None, None, 0.55, None, "password pwd كلمة_سر", r"^[a-f0-9]{64}$"),
    ("otp_with_label", "OTP", "free_text", "both", None, None, 0.90, None, "notes sms message otp verification رمز كود", r"(?i)\b(?:otp|one[\-\s]?time\s*password|verification\s*code|auth\s*code|كود|رمز)\s*(?:is|:|=|\s)+\s*\d{4,8}\b"),
    ("scan_otp_in_sms", "OTP", "free_text", "both", None, None, 0.85, None, "sms message body نص", r"(?i)(?:OTP|code|verification|كود|رمز)[^\d]{0,20}\b(\d{4,8})\b"),
    ("puk_with_label", "SIM_PUK", "free_text", "latin", None, None, 0.92, None, "puk sim unlock notes", r"(?i)\b(?:puk|personal\s*unlock(?:ing)?\s*key)(?:\s+\w+){0,4}\s*[:=]?\s*\d{8}\b"),
    ("scan_support_ticket", "SUPPORT_TICKET", "free_text", "latin", None, None, 0.88, None, "ticket تذكرة sr support complaint", r"\bSR-\d{3,12}\b"),
    ("cvv_with_label", "CREDIT_CARD", "free_text", "latin", None, None, 0.92, None, "cvv card payment notes بطاقة", r"(?i)\b(?:cvv|cvc|cvv2|security\s*code)\s*[:=]?\s*\d{3,4}\b"),
    # special categories
    ("gdpr_religion", "GDPR_SPECIAL_CATEGORY", "free_text", "both", None, None, 0.55, None, "religion faith notes ملاحظات ديانة", r"(?i)\b(?:muslim|christian|coptic|catholic|orthodox|jewish|buddhist|hindu|atheist|islam|christianity|الإسلام|مسلم|مسلمة|مسيحي|مسيحية|قبطي|قبطية|يهودي)\b"),
    ("gdpr_health_condition", "GDPR_SPECIAL_CATEGORY", "free_text", "both", None, None, 0.55, None, "health medical notes ملاحظات صحة", r"(?i)\b(?:HIV|AIDS|cancer|diabetes|hepatitis|psychiatric|mental\s+(?:illness|health)|disability|الإيدز|سرطان|سكري|إعاقة|اضطراب\s+نفسي)\b"),
    ("gdpr_biometric_data", "GDPR_SPECIAL_CATEGORY", "free_text", "both", None, None, 0.55, None, "biometric identity notes ملاحظات بصمة", r"(?i)\b(?:fingerprint|iris\s+scan|facial\s+recognition|voice\s+print|biometric|بصمة|قزحية|بصمة\s+الوجه)\b"),
    ("gdpr_minor_data_flag", "GDPR_SPECIAL_CATEGORY", "free_text", "both", None, None, 0.55, None, "notes legal guardian ملاحظات قاصر", r"(?i)\b(?:child|children|minor|underage|under\s*18|guardian\s+of|طفل|أطفال|قاصر|تحت\s+السن)\b"),
    # log and record scanners
    ("scan_national_id_egypt", "EG_NATIONAL_ID", "free_text", "numeric", "egypt_nid", "fourteen_digit_numeric", 0.68, None, "log notes cdr رقم_قومي", r"\b[23]\d{13}\b"),
    ("scan_imei", "IMEI", "free_text", "numeric", "imei", "fifteen_digit_numeric", 0.55, 0.92, "log cdr imei device جهاز", r"\b\d{15}\b"),
    ("scan_imsi", "IMSI", "free_text", "numeric", "imsi", "fifteen_digit_numeric", 0.55, 0.92, "log cdr imsi subscriber sim مشترك", r"\b(?:602(?:01|02|03|04)\d{10}|602\d{12})\b"),
    ("scan_iccid", "ICCID", "free_text", "numeric", "iccid", None, 0.82, None, "log cdr iccid sim شريحة", r"\b89\d{16,20}\b"),
    ("scan_transaction_id", "TRANSACTION_ID", "free_text", "latin", None, None, 0.75, None, "txn transaction عملية كود_العملية reference ref", r"\bTXN[-_]?\d{4,12}\b"),
    ("scan_passport", "PASSPORT", "free_text", "latin", None, "passport_alpha_eight_digits", 0.60, None, "passport travel notes جواز", r"\b[A-Z]\d{8}\b"),
    ("address_keywords_egypt", "LOCATION", "free_text", "both", None, None, 0.65, None, "address location notes عنوان ملاحظات", r"(?i)\b(?:street|st\.?|road|rd\.?|building|floor|apartment|apt\.?|flat|villa|district|governorate|cairo|giza|alexandria|nasr\s*city|maadi|zamalek|الشارع|شارع|طريق|عمارة|دور|شقة|محافظة|القاهرة|الجيزة|الإسكندرية|مدينة\s+نصر|المعادي|الزمالك)\b"),
]
INACTIVE = {"hash_md5_like", "hash_sha256_like"}

# fixed values: which pattern a column name picks inside a group of look-alikes
COLLISIONS = [
    ("fourteen_digit_numeric", "national_id_egypt_strict", "national id nid رقم_قومي هوية الرقم_القومي قومي"),
    ("fourteen_digit_numeric", "national_id_egypt", "national id nid رقم_قومي هوية"),
    ("fifteen_digit_numeric", "imsi_generic", "imsi subscriber sim identity msin mcc mnc مشترك"),
    ("fifteen_digit_numeric", "imsi_strict", "imsi subscriber sim identity مشترك"),
    ("fifteen_digit_numeric", "imei", "imei device handset equipment terminal جهاز هاتف"),
    ("sixteen_digit_numeric", "credit_card_visa", "card visa credit payment بطاقة"),
    ("sixteen_digit_numeric", "credit_card_mastercard", "card mastercard credit payment بطاقة"),
    ("sixteen_digit_numeric", "credit_card_with_spaces", "card credit payment بطاقة"),
    ("sixteen_digit_numeric", "meeza_card", "card meeza payment بطاقة ميزا"),
    ("sixteen_digit_numeric", "imeisv", "imeisv device software imei جهاز"),
    ("nine_digit_numeric", "tax_id_egypt_plain", "tax tin fiscal ضريبي ضريبة سجل"),
    ("nine_digit_numeric", "tax_id_egypt", "tax tin commercial ضريبي ضريبة"),
    ("vodafone_cash_vs_msisdn", "msisdn_egypt_vodafone", "phone mobile msisdn tel contact هاتف رقم جوال"),
    ("vodafone_cash_vs_msisdn", "vodafone_cash_account", "wallet cash ewallet fintech محفظة فودافون_كاش كاش"),
    ("passport_alpha_eight_digits", "passport_egypt", "passport travel nationality جواز سفر جنسية"),
    ("ten_digit_numeric", "national_id_ksa", "national id iqama saudi هوية اقامة"),
    ("ten_digit_numeric", "national_id_jordan", "national id jordan هوية أردني"),
]

# fixed values: column-name tokens that rule an entity out
NEGATIVE_TOKENS = {
    "LOCATION": "age score rating pct percent ratio rate count qty quantity temp temperature amount price discount weight "
                "height duration latency day week month year version level priority",
    "IMEI": "ts time timestamp epoch seq sequence serial amount balance bytes volume",
    "IMSI": "ts time timestamp epoch seq sequence",
    "EG_NATIONAL_ID": "ts time timestamp epoch datetime dt created updated modified inserted loaded",
}
PHONE_NAME_TOKENS = ["phone", "mobile", "contact", "tel", "fax", "whatsapp", "msisdn", "number"]
ID_NAME_TOKENS = ["id", "account", "order", "transaction", "reference", "ref", "code", "key", "seq"]
NETWORK_NAME = r"(?i)cell_global|(^|_)lac$|tac_lte|\bcgi_identity\b"
LAT_TOKENS = ["lat", "latitude", "خط_عرض"]
LON_TOKENS = ["lon", "lng", "longitude", "خط_طول"]
GEO_TOKENS = ["coord", "gps", "geo", "position", "الموقع", "موقع"]

# fixed values: entity levels and aliases
SENSITIVE = ["EG_NATIONAL_ID", "NATIONAL_ID", "PASSPORT", "CREDIT_CARD", "CRYPTO_WALLET", "GDPR_SPECIAL_CATEGORY",
             "EG_TAX_ID", "IBAN_CODE", "OTP", "SIM_PUK", "VOUCHER"]
INDIRECT = ["SESSION_ID", "PSEUDO_ID", "DEVICE_ID", "COOKIE_ID", "TRACKING_ID", "IP_ADDRESS", "EMPLOYER"]
SECURITY = ["PASSWORD_HASH", "CSRF_TOKEN", "API_KEY", "SECRET", "JWT", "SESSION_TOKEN"]
NON_PII = ["SWIFT_BIC", "ORGANIZATION", "CONTENT_HASH", "URL", "NETWORK_ID", "CELL_ID"]
PERSONAL = ["PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON", "DATE_TIME", "GENDER", "LOCATION", "MAC_ADDRESS", "IMEI", "IMSI",
            "ICCID", "SUPPORT_TICKET", "UTILITY_ACCOUNT", "EG_VEHICLE_PLATE", "SOCIAL_PROFILE_URL"]
ALIASES = {
    "EMAIL": "EMAIL_ADDRESS", "ADDRESS": "LOCATION", "PHONE": "PHONE_NUMBER", "MSISDN": "PHONE_NUMBER", "ORG": "ORGANIZATION",
    "SID": "SESSION_ID", "SESSION": "SESSION_ID", "CSRF": "CSRF_TOKEN", "XSRF": "CSRF_TOKEN", "PASSWORD": "PASSWORD_HASH",
    "PASSWD": "PASSWORD_HASH", "PWD": "PASSWORD_HASH", "PWD_HASH": "PASSWORD_HASH", "JWT_TOKEN": "JWT",
    "SCRATCH_CARD": "VOUCHER", "SCRATCH_CARD_PIN": "VOUCHER", "RECHARGE_VOUCHER": "VOUCHER", "TICKET": "SUPPORT_TICKET",
    "INTERNAL_ID": "SUPPORT_TICKET",
}

# fixed values: what a text must hold for a free-text pattern to match at all, as lower-case pieces or a run of digits
NEEDS_ANY = {
    "electricity_account_with_label": ["elec", "كهرباء"], "water_account_with_label": ["water", "wtr", "مياه"], "gas_account_with_label": ["gas", "غاز"],
    "scan_email": ["@"], "scan_jwt": ["eyj"], "scan_support_ticket": ["sr-"], "scan_transaction_id": ["txn"], "scan_mac_address": [":", "-"],
    "otp_with_label": ["otp", "one", "code", "كود", "رمز"], "scan_otp_in_sms": ["otp", "code", "verification", "كود", "رمز"],
    "puk_with_label": ["puk", "unlock"], "cvv_with_label": ["cvv", "cvc", "security"],
    "gdpr_religion": ["muslim", "christian", "coptic", "catholic", "orthodox", "jewish", "buddhist", "hindu", "atheist", "islam", "الإسلام", "مسلم", "مسيحي", "قبطي", "يهودي"],
    "gdpr_health_condition": ["hiv", "aids", "cancer", "diabetes", "hepatitis", "psychiatric", "mental", "disability", "الإيدز", "سرطان", "سكري", "إعاقة", "اضطراب"],
    "gdpr_biometric_data": ["fingerprint", "iris", "facial", "voice", "biometric", "بصمة", "قزحية"],
    "gdpr_minor_data_flag": ["child", "minor", "underage", "under", "guardian", "طفل", "أطفال", "قاصر", "تحت"],
    "address_keywords_egypt": ["st", "rd", "road", "building", "floor", "apartment", "apt", "flat", "villa", "governorate", "cairo", "giza", "alexandria", "nasr", "maadi",
                               "zamalek", "شارع", "طريق", "عمارة", "دور", "شقة", "محافظة", "القاهرة", "الجيزة", "الإسكندرية", "مدينة", "المعادي", "الزمالك"],
}
NEEDS_DIGITS = {
    "msisdn_egypt_scan": 10, "landline_egypt_scan": 9, "national_id_egypt_scan": 14, "passport_egypt_scan": 8, "scan_ipv4": 1, "scan_credit_card": 4, "scan_iban": 2,
    "scan_national_id_egypt": 14, "scan_imei": 15, "scan_imsi": 15, "scan_iccid": 18, "scan_passport": 8,
}
