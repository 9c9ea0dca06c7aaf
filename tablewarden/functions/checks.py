"""Value validators as Columns: checksums, shapes and staged identity numbers. Everything stays in the JVM
except Base58Check, whose big-integer step runs in an Arrow batch over values that already have the shape."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import let, lit_map
from tablewarden.functions.text import fold_digits

# fixed values
IBAN_LENGTHS = {"EG": 29, "AE": 23, "SA": 24, "JO": 30, "KW": 30, "QA": 29, "BH": 22, "OM": 23, "LB": 28, "MA": 28,
                "TN": 24, "DZ": 26, "LY": 25, "GB": 22, "DE": 22, "FR": 27, "IT": 27, "ES": 24, "NL": 18, "CH": 21,
                "TR": 26, "PK": 24}
COUNTRIES = ["AE", "BH", "DZ", "EG", "FR", "DE", "GB", "IN", "IQ", "JO", "KW", "LB", "LY", "MA", "OM", "PK", "PS", "QA",
             "SA", "SD", "SY", "TN", "TR", "US", "YE"]
REPORTING_BODIES = ["01", "10", "30", "33", "35", "44", "45", "49", "50", "51", "52", "53", "54", "86", "91", "98", "99"]
GOVERNORATES = {
    "01": "Cairo", "02": "Alexandria", "03": "Port Said", "04": "Suez", "11": "Damietta", "12": "Dakahlia",
    "13": "Sharqia", "14": "Qalyubia", "15": "Kafr El-Sheikh", "16": "Gharbia", "17": "Monufia", "18": "Beheira",
    "19": "Ismailia", "21": "Giza", "22": "Beni Suef", "23": "Fayoum", "24": "Minya", "25": "Asyut", "26": "Sohag",
    "27": "Qena", "28": "Aswan", "29": "Luxor", "31": "Red Sea", "32": "New Valley", "33": "Matrouh",
    "34": "North Sinai", "35": "South Sinai", "88": "Born abroad"}
CHECK_WEIGHTS = [2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
OPERATORS = {"10": "Vodafone", "11": "Etisalat (e&)", "12": "Orange", "15": "WE / Telecom Egypt"}
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def day(as_of: str | None = None) -> Column:
    """The day that ages and plausibility refer to: today unless one is given."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn(c: Column) -> Column:
    d = digits_of(c)
    return F.coalesce((d != "") & F.call_function("luhn_check", d), F.lit(False))


def iban(c: Column) -> Column:
    """Country length and mod 97 = 1; the remainder is folded character by character."""
    s = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    want = F.try_element_at(lit_map(IBAN_LENGTHS), F.substring(s, 1, 2))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda ch: ch != "")
    rest = F.aggregate(chars, F.lit(0), lambda acc, ch: F.when(
        ch.rlike("^[0-9]$"), (acc * 10 + ch.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97))
    shape = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.length(s) >= 15) & (F.length(s) <= 34)
    return F.coalesce(shape & (want.isNull() | (F.length(s) == want)) & (rest == 1), F.lit(False))


def swift(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.coalesce(s.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$") & F.substring(s, 5, 2).isin(COUNTRIES), F.lit(False))


def ksa_id(c: Column) -> Column:
    d = digits_of(c)
    return F.coalesce(d.rlike("^[12][0-9]{9}$") & F.call_function("luhn_check", d), F.lit(False))


def uae_id(c: Column) -> Column:
    d = digits_of(c)
    year = F.substring(d, 4, 4).try_cast("int")
    return F.coalesce(d.rlike("^784[0-9]{12}$") & year.between(1900, 2100) & F.call_function("luhn_check", d), F.lit(False))


def mac(c: Column) -> Column:
    h = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    first = F.conv(F.substring(h, 1, 2), 16, 10).try_cast("int")
    return F.coalesce((F.length(h) == 12) & ~h.isin("000000000000", "ffffffffffff") & (first.bitwiseAND(1) == 0), F.lit(False))


def eth(c: Column) -> Column:
    """Shape only: mixed case is accepted without a checksum."""
    return F.coalesce(F.trim(c).rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))


@F.pandas_udf(T.BooleanType())
def _base58_checksum(values: pd.Series) -> pd.Series:
    def ok(s: str) -> bool:
        number = 0
        for ch in s:
            number = number * 58 + BASE58.index(ch)
        zeros = len(s) - len(s.lstrip("1"))
        raw = b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")
        inner = hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()
        return len(raw) > 4 and inner[:4] == raw[-4:]
    return values.map(lambda s: None if s is None else ok(s))


def btc(c: Column) -> Column:
    """Only values of the right shape reach Python; null for the rest keeps the batch empty of them."""
    s = F.trim(c)
    return F.coalesce(_base58_checksum(F.when(s.rlike(f"^[{BASE58}]+$"), s)), F.lit(False))


def jwt(c: Column) -> Column:
    parts = F.split(F.trim(c), r"\.")
    head = F.translate(F.get(parts, 0), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    shape = (F.size(parts) == 3) & (F.get(parts, 0) != "") & (F.get(parts, 1) != "")
    return F.coalesce(shape & F.get_json_object(text, "$.alg").isNotNull(), F.lit(False))


def nir(c: Column) -> Column:
    """French NIR key; Corsican departments 2A / 2B count as 19 / 18."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    dept = F.substring(s, 6, 2)
    mapped = F.when((F.length(s) == 15) & dept.isin("2A", "2B"), F.concat(
        F.substring(s, 1, 5), F.when(dept == "2A", "19").otherwise("18"), F.substring(s, 8, 8))).otherwise(s)
    d = digits_of(mapped)
    body, key = F.substring(d, 1, 13).try_cast("bigint"), F.substring(d, 14, 2).try_cast("int")
    return F.coalesce((F.length(d) == 15) & (97 - body % 97 == key), F.lit(False))


def iccid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^89[0-9]{17,18}$") & luhn(c), F.lit(False))


def scaled_coordinate(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[+-]*[0-9]{7,9}$"), F.lit(False))


# --- staged numbers: struct(valid, reason, …) ------------------------------------------------------------

def number_text(c: Column) -> Column:
    """Digits of a typed number; any other character makes it empty."""
    t = F.regexp_replace(c, r"[ \t\-_/. ]", "")
    return F.when(t.rlike("^[0-9]+$"), t).otherwise("")


def imei(c: Column, verify_body: bool = True, known_tacs: Sequence[str] | None = None) -> Column:
    d = number_text(c)
    body = F.substring(d, 1, 2)
    reason = F.when((d == "") | d.isNull(), "normalize").when(F.length(d) != 15, "format") \
        .when(~F.call_function("luhn_check", d), "luhn")
    if verify_body:
        reason = reason.when(~body.isin(REPORTING_BODIES), "rbi")
    if known_tacs is not None:
        reason = reason.when(~F.substring(d, 1, 8).isin(list(known_tacs)), "tac_known")
    reason = reason.otherwise("")
    return F.struct((reason == "").alias("valid"), reason.alias("reason"), F.substring(d, 1, 8).alias("tac"),
                    body.alias("rbi"), F.substring(d, 9, 6).alias("snr"), F.substring(d, 15, 1).alias("check_digit"))


def imeisv(c: Column) -> Column:
    d = number_text(c)
    reason = F.when((d == "") | d.isNull(), "normalize").when(F.length(d) != 16, "format") \
        .when(~F.substring(d, 1, 2).isin(REPORTING_BODIES), "rbi").otherwise("")
    return F.struct((reason == "").alias("valid"), reason.alias("reason"), F.substring(d, 1, 8).alias("tac"),
                    F.substring(d, 15, 2).alias("svn"))


def imsi(c: Column, home_mcc: str = "602", known_mccs: Sequence[str] | None = None,
         partners: dict[str, Sequence[str]] | None = None) -> Column:
    """Length, country code, network code, home or roaming.

    ``known_mccs`` takes the assigned country codes.  Without it a code is accepted when its zone digit is one of
    the geographic zones 2 to 7, or it is the shared code 901; unassigned codes inside a zone then pass.
    """
    d = number_text(c)
    mcc = F.substring(d, 1, 3)
    known = mcc.isin(list(known_mccs)) if known_mccs is not None else mcc.rlike("^([2-7][0-9]{2}|901)$")
    mnc2, mnc3 = F.substring(d, 4, 2), F.substring(d, 4, 3)
    hit2 = hit3 = wanted = F.lit(False)
    for code, networks in (partners or {}).items():
        two, three = [m for m in networks if len(m) == 2], [m for m in networks if len(m) == 3]
        hit2 = hit2 | ((mcc == code) & mnc2.isin(two)) if two else hit2
        hit3 = hit3 | ((mcc == code) & mnc3.isin(three)) if three else hit3
        wanted = wanted | (mcc == code)
    reason = F.when((d == "") | d.isNull(), "normalize").when(~F.length(d).isin(14, 15), "format") \
        .when(~known, "mcc_known").when(wanted & ~hit2 & ~hit3, "mnc_known").otherwise("")
    mnc = F.when(~hit2 & hit3, mnc3).otherwise(mnc2)
    return F.struct((reason == "").alias("valid"), reason.alias("reason"), mcc.alias("mcc"), mnc.alias("mnc"),
                    F.substring(d, 4 + 2, 12).alias("msin"), (mcc == home_mcc).alias("is_home"), (hit2 | hit3).alias("mnc_validated"))


def egypt_nid(c: Column, as_of: str | None = None, max_age: int = 110, min_year: int = 1900,
              verify_check_digit: bool = False) -> Column:
    """Normalize, format, calendar, governorate, plausibility, check digit; with what the number carries."""
    t = F.regexp_replace(fold_digits(c), "[ \\t\\-_/\u00a0\u200e\u200f\u061c]", "")
    today = day(as_of)

    def parsed(d: Column) -> Column:
        ok = d.rlike("^[23][0-9]{13}$")
        numbers = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.substr(d, i, F.lit(1)).try_cast("int"))
        total = F.aggregate(F.zip_with(numbers, F.array(*[F.lit(w) for w in CHECK_WEIGHTS]), lambda a, w: a * w),
                            F.lit(0), lambda acc, x: acc + x)
        return F.struct(
            d.alias("digits"), ok.alias("ok"), F.substring(d, 8, 2).alias("gov_code"),
            F.try_to_date(F.when(ok, F.concat(F.when(F.substring(d, 1, 1) == "2", "19").otherwise("20"), F.substring(d, 2, 6))),
                          "yyyyMMdd").alias("birth"),
            F.when(ok, (F.substring(d, 13, 1).try_cast("int") % 2) == 1).alias("male"),
            F.when(ok, F.substring(d, 14, 1).try_cast("int") == (11 - total % 11) % 11 % 10).alias("check_ok"))

    def judged(p: Column) -> Column:
        birth, name = p["birth"], F.try_element_at(lit_map(GOVERNORATES), p["gov_code"])
        plausible = (F.year(birth) >= min_year) & (birth <= today) & (F.datediff(today, birth) <= max_age * 366)
        reason = F.when(p["digits"].isNull() | (p["digits"] == ""), "normalize").when(~p["ok"], "format") \
            .when(birth.isNull(), "calendar").when(name.isNull(), "governorate").when(~plausible, "plausibility")
        if verify_check_digit:
            reason = reason.when(~p["check_ok"], "checkdigit")
        return let(reason.otherwise(""), lambda r: F.struct(
            (r == "").alias("valid"), r.alias("reason"), birth.alias("birth_date"), p["gov_code"].alias("gov_code"),
            name.alias("governorate"), F.when(p["male"], "male").when(~p["male"], "female").alias("gender"),
            p["check_ok"].alias("check_digit_ok"), p["digits"].alias("digits")))
    return let(let(F.when(t.rlike("^[0-9]+$"), t).otherwise(""), parsed), judged)


def msisdn_egypt(c: Column) -> Column:
    """Canonical +20… form of a typed mobile number, else null."""
    s = F.regexp_replace(F.trim(c), r"^'|\.0$", "")

    def national(x: Column) -> Column:
        d = x["d"]
        return (F.when(x["plus"] & d.startswith("20"), F.substring(d, 3, 20)).when(d.startswith("0020"), F.substring(d, 5, 20))
                .when(d.startswith("20") & (F.length(d) == 12), F.substring(d, 3, 20))
                .when(d.startswith("0") & (F.length(d) == 11), F.substring(d, 2, 20)).otherwise(d))
    n = let(F.struct(digits_of(s).alias("d"), s.startswith("+").alias("plus")), national)
    return let(n, lambda x: F.when(x.rlike("^1[0125][0-9]{8}$"), F.concat(F.lit("+20"), x)))


def operator(c: Column) -> Column:
    """The operator a mobile number was first allocated to."""
    return F.try_element_at(lit_map(OPERATORS), F.substring(msisdn_egypt(c), 4, 2))


# fixed values: numbering plans as (region, country code, national length range, mobile prefixes)
PHONE_PLANS = [
    ("EG", "20", 8, 10, "10 11 12 15"), ("SA", "966", 8, 9, "5"), ("AE", "971", 8, 9, "50 52 54 55 56 58"), ("JO", "962", 8, 9, "77 78 79"),
    ("KW", "965", 8, 8, "5 6 9"), ("QA", "974", 8, 8, "3 5 6 7"), ("BH", "973", 8, 8, "3"), ("OM", "968", 8, 8, "7 9"),
    ("GB", "44", 9, 10, "7"), ("DE", "49", 7, 11, "15 16 17"), ("FR", "33", 9, 9, "6 7"), ("US", "1", 10, 10, "2 3 4 5 6 7 8 9"),
]


def phone(c: Column, region: str = "EG") -> Column:
    """struct(valid, mobile, region, unknown) by the numbering-plan table; ``unknown``: the country code is in none of its plans, so the number is not judged.

    This is plan arithmetic (country code, length, mobile prefix), not a full numbering library: a number
    inside an unassigned range of a valid length counts as valid.
    """
    plans = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(cc).alias("cc"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                               F.array(*[F.lit(m) for m in mob.split()]).alias("mob")) for r, cc, lo, hi, mob in PHONE_PLANS])
    is_date = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"
    none = F.struct(F.lit(False).alias("valid"), F.lit(False).alias("mobile"), F.lit(None).cast("string").alias("region"), F.lit(False).alias("unknown"))

    def split(s: Column) -> Column:
        d = digits_of(s)
        return F.struct(
            (s.rlike(r"^[+]?[0-9][0-9 ().\-]{5,22}$") & ~s.rlike(is_date)).alias("shaped"),
            F.when(s.startswith("+"), d).when(d.startswith("00"), F.substring(d, 3, 20)).alias("e164"),
            F.regexp_replace(d, "^0", "").alias("local"))

    def planned(x: Column) -> Column:
        abroad = F.get(F.filter(plans, lambda p: F.startswith(x["e164"], p["cc"])), F.lit(0))
        home = F.get(F.filter(plans, lambda p: p["r"] == region), F.lit(0))
        return let(F.when(x["e164"].isNotNull(), abroad).otherwise(home), lambda p: let(
            F.when(x["e164"].isNotNull(), F.substr(x["e164"], F.length(p["cc"]) + 1)).otherwise(x["local"]),
            lambda n: F.when(x["shaped"] & p.isNotNull() & F.length(n).between(p["lo"], p["hi"]) & n.rlike("^[1-9]"), F.struct(
                F.lit(True).alias("valid"), F.exists(p["mob"], lambda m: F.startswith(n, m)).alias("mobile"), p["r"].alias("region"), F.lit(False).alias("unknown")))
            .when(x["shaped"] & p.isNull() & F.length(x["e164"]).between(8, 15), F.struct(
                F.lit(False).alias("valid"), F.lit(False).alias("mobile"), F.lit(None).cast("string").alias("region"), F.lit(True).alias("unknown")))))
    return F.coalesce(let(let(F.trim(c), split), planned), none)


def as_boolean(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(fn(c)["valid"], F.lit(False))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn, "iban": iban, "swift": swift, "ksa_id": ksa_id, "uae_id": uae_id, "mac": mac, "eth": eth, "btc": btc,
    "jwt": jwt, "nir": nir, "iccid": iccid, "scaled_coordinate": scaled_coordinate, "imei": as_boolean(imei),
    "imeisv": as_boolean(imeisv), "imsi": as_boolean(imsi), "egypt_nid": as_boolean(egypt_nid), "phone": as_boolean(phone),
    "msisdn": lambda c: msisdn_egypt(c).isNotNull()}
STAGED: dict[str, Callable[[Column], Column]] = {"imei": imei, "imeisv": imeisv, "imsi": imsi, "egypt_nid": egypt_nid, "phone": phone}
WHOLE_VALUE = {"iban", "swift", "mac", "eth", "btc", "jwt"}


def register_validator(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a validator: a function from a text Column to a boolean Column."""
    VALIDATORS[name] = fn
