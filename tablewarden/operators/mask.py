"""Masking and de-identification: a plan compiles to one projection over the table."""

from __future__ import annotations

import json
import re
import re._constants as rx
import re._parser as re_parser
import string
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import crypto as K
from tablewarden.functions.columns import col, count_if, dealt, let, lit_list, ratio
from tablewarden.functions.spans import spliced
from tablewarden.functions.text import ARABIC_RANGE, safe_shape
from tablewarden.operators.detect import canonical_entity, sensitivity

# names, places and firms for fakes
EN_FIRST_M = ["Aaron", "Albert", "Arthur", "Barney", "Calvin", "Dennis", "Edgar", "Felix", "Gordon", "Harvey", "Ivan", "Julian", "Kenneth", "Lionel", "Marvin", "Nigel", "Oscar", "Philip", "Quentin", "Rupert", "Stanley", "Trevor", "Vernon", "Wallace"]
EN_FIRST_F = ["Agnes", "Beatrice", "Cecilia", "Doris", "Edith", "Florence", "Gloria", "Harriet", "Ingrid", "Josephine", "Kathleen", "Lillian", "Mabel", "Nora", "Ophelia", "Pauline", "Rosalind", "Sylvia", "Theresa", "Ursula", "Violet", "Winifred"]
EN_LAST = ["Abbott", "Barlow", "Carver", "Dalton", "Ellison", "Fletcher", "Garrison", "Hawkins", "Ingram", "Jarvis", "Kendall", "Lockwood", "Merritt", "Norwood", "Osborne", "Pemberton", "Quinlan", "Rowland", "Sheldon", "Thornton", "Underhill", "Vickers", "Whitaker", "Yardley"]
AR_FIRST_M = ["سامي", "طارق", "وليد", "كريم", "بلال", "فارس", "زياد", "رامي", "ماهر", "نبيل", "جمال", "عادل", "هاني", "باسم", "أنس", "مروان"]
AR_FIRST_F = ["زينب", "سلمى", "منى", "دينا", "هناء", "سعاد", "لمياء", "نادية", "وفاء", "إيمان", "جميلة", "خديجة", "رباب", "شيماء", "عبير", "نجلاء"]
AR_LAST = ["الحداد", "الخطيب", "الزهراني", "الطحان", "العطار", "الغامدي", "الفقي", "القحطاني", "الكردي", "المالكي", "النحاس", "الوكيل", "البنا", "الجمال", "الدسوقي", "الصباغ"]
EN_CITY = ["Ashford", "Bellmoor", "Crestwick", "Dunbridge", "Eastmere", "Foxhollow", "Glenbrook", "Harrowgate", "Ivydale", "Kingsbury", "Larkfield", "Millhaven", "Northwick", "Oakhurst", "Pinewood", "Redcliff"]
EN_STREET = ["Alder Way", "Birch Lane", "Chapel Row", "Dover Street", "Elder Close", "Ferry Road", "Garden Walk", "Harbour View", "Juniper Court", "Kiln Road", "Linden Avenue", "Market Square", "Orchard Drive", "Priory Lane", "Quarry Road", "Station Parade"]
AR_CITY = ["الإسماعيلية", "السويس", "بورسعيد", "دمياط", "الفيوم", "المنيا", "سوهاج", "الأقصر", "الدمام", "الطائف", "تبوك", "أبها"]
AR_STREET = ["شارع السلام", "شارع المدرسة", "شارع البحر", "شارع الورود", "شارع النصر", "شارع المحطة", "شارع السوق", "شارع الزهور", "شارع المتحف", "شارع الميناء"]
EN_COMPANY = ["Alder & Finch", "Bluegate Supplies", "Copperline Works", "Driftwood Foods", "Evenfall Travel", "Fernhill Textiles", "Greyhaven Motors", "Hollowell Partners", "Ironbark Tools", "Juniper Analytics", "Kestrel Freight", "Lanternfish Media"]
AR_COMPANY = ["شركة الواحة", "مجموعة السنابل", "مؤسسة البيان", "شركة الجسر", "مجموعة الريحان", "شركة المنارة", "مؤسسة الينابيع", "شركة القوافل", "مجموعة الشراع", "شركة الأفق"]
MAIL_HOSTS = ["mail.example.com", "post.example.net", "inbox.example.org", "letters.test", "people.test", "box.example"]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "x.com", "linkedin.com", "tiktok.com"]
QUASI_HINTS = ["dob", "birth", "zip", "postal", "gender", "sex", "age", "nationality"]
# fixed values: named patterns for regex fakes
PATTERN_LIBRARY = {
    "eg_mobile": r"01[0125]\d{8}", "eg_national_id": r"[23]\d{13}", "us_ssn": r"[1-9]\d{2}-\d{2}-\d{4}", "us_phone": r"\([2-9]\d{2}\) [2-9]\d{2}-\d{4}",
    "email_simple": r"[a-z]{3,8}\.[a-z]{3,8}@(example|test|demo)\.(com|net|org)", "uuid_v4": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    "iso_date": r"20[12]\d-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", "credit_card_visa": r"4\d{3}-\d{4}-\d{4}-\d{4}", "iban_eg": r"EG\d{27}",
    "ipv4": r"(1\d{2}|2[0-4]\d|25[0-5]|[1-9]\d?)\.(1\d{2}|2[0-4]\d|25[0-5]|\d{1,2})\.(1\d{2}|2[0-4]\d|25[0-5]|\d{1,2})\.(1\d{2}|2[0-4]\d|25[0-5]|\d{1,2})",
    "hex_color": r"#[0-9a-fA-F]{6}", "sa_mobile": r"05[0-9]\d{7}",
}
# names of this library
PATTERN_LIBRARY |= {"uuid": PATTERN_LIBRARY["uuid_v4"], "plate": r"[A-Z]{3} \d{3,4}", "order": r"ORD-\d{8}", "hex32": r"[0-9a-f]{32}"}


def load_patterns(path: str) -> dict[str, str]:
    """The library with the patterns of a JSON file (name: pattern, or name: object with ``regex``) added; its names win."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    found = found.get("patterns", found)
    return PATTERN_LIBRARY | {k: v["regex"] if isinstance(v, dict) else v for k, v in found.items()}


@dataclass(frozen=True)
class MaskRule:
    column: str
    strategy: str = "passthrough"
    params: dict[str, Any] = field(default_factory=dict)
    entity: str | None = None


# --- plain transforms --------------------------------------------------------------------------------------

def partial(c: Column, keep_first: int = 0, keep_last: int = 4, char: str = "*", preserve_length: bool = True) -> Column:
    """All but the first ``keep_first`` and last ``keep_last`` characters covered; a text no longer than these stays as it is."""
    ahead = max(keep_first, 0)
    covered = F.greatest(F.length(c) - ahead - max(keep_last, 0), F.lit(0))
    cover = F.repeat(F.lit(char), covered if preserve_length else F.least(covered, F.lit(4)))
    return F.when(covered > 0, F.overlay(c, cover, F.lit(ahead + 1), covered)).otherwise(c)


def hashed(c: Column, algo: str = "sha256", key: bytes | None = None, truncate: int = 0, prefix: str = "") -> Column:
    d = K.hmac_sha256(c, key) if key else K.digest(c, algo)
    d = F.substring(d, 1, truncate) if truncate else d
    return F.concat(F.lit(prefix), d) if prefix else d


def sliced(c: Column, fn, start: int = 0, end: int | None = None) -> Column:
    """Transform ``[start, end)`` only."""
    n = F.length(c)
    stop = F.least(F.lit(end), n) if end is not None else n
    begin = F.lit(max(0, start))
    return F.when(begin >= stop, c).otherwise(F.concat(
        F.substr(c, F.lit(1), begin), fn(F.substr(c, begin + 1, stop - begin)), F.substr(c, stop + 1)))


# --- fakes: a keyed stream of the value picks from pools or replaces characters -------------------------------

def _pick(pool: Sequence[str], stream: Column, i: int) -> Column:
    return F.get(lit_list(pool), K.draw(stream, i, len(pool)))


def _is_arabic(c: Column, locale: str) -> Column:
    return F.lit(locale == "ar") if locale in ("ar", "en") else c.rlike(ARABIC_RANGE)


def fake_name(c: Column, stream: Column, locale: str = "default", gender: str | None = None) -> Column:
    def build(r: Column) -> Column:
        female = F.lit(gender == "f") if gender else K.draw(r, 0, 2) == 1
        en = F.concat_ws(" ", F.when(female, _pick(EN_FIRST_F, r, 1)).otherwise(_pick(EN_FIRST_M, r, 1)), _pick(EN_LAST, r, 2))
        ar = F.concat_ws(" ", F.when(female, _pick(AR_FIRST_F, r, 1)).otherwise(_pick(AR_FIRST_M, r, 1)), _pick(AR_LAST, r, 2))
        return F.when(_is_arabic(c, locale), ar).otherwise(en)
    return let(stream, build)


def fake_address(c: Column, stream: Column, locale: str = "default") -> Column:
    def build(r: Column) -> Column:
        num = (K.draw(r, 0, 299) + 1).cast("string")
        en = F.concat(num, F.lit(" "), _pick(EN_STREET, r, 1), F.lit(", "), _pick(EN_CITY, r, 2))
        ar = F.concat(_pick(AR_STREET, r, 1), F.lit(" "), num, F.lit("، "), _pick(AR_CITY, r, 2))
        return F.when(_is_arabic(c, locale), ar).otherwise(en)
    return let(stream, build)


def fake_company(c: Column, stream: Column, locale: str = "default") -> Column:
    return let(stream, lambda r: F.when(_is_arabic(c, locale), _pick(AR_COMPANY, r, 0)).otherwise(_pick(EN_COMPANY, r, 0)))


def _replace_chars(c: Column, stream: Column, keep_digits: Column | int = 0, letters: bool = False) -> Column:
    """Digits (and letters) replaced one by one from the stream; shape, case and separators stay."""
    keep = F.lit(keep_digits) if isinstance(keep_digits, int) else keep_digits

    def build(r: Column) -> Column:
        def step(acc: Column, ch: Column) -> Column:
            digit = ch.rlike("^[0-9]$")
            new_digit = F.when(acc["seen"] < keep, ch).otherwise(K.draw(r, acc["pos"], 10).cast("string"))
            letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), K.draw(r, acc["pos"], 26) + 1, F.lit(1))
            letter = F.when(F.upper(ch) == ch, F.upper(letter)).otherwise(letter)
            out = F.when(digit, new_digit)
            out = out.when(ch.rlike(r"^\p{L}$"), letter).otherwise(ch) if letters else out.otherwise(ch)
            return F.struct((acc["pos"] + 1).alias("pos"), F.when(digit, acc["seen"] + 1).otherwise(acc["seen"]).alias("seen"),
                            F.concat(acc["out"], out).alias("out"))
        zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("seen"), F.lit("").alias("out"))
        return F.aggregate(K.characters(c), zero, step, lambda a: a["out"])
    return let(stream, build)


def _blocks(c: Column) -> Column:
    return F.greatest(F.ceil(F.length(c) / 8), F.lit(1)).cast("int")


def fake_phone(c: Column, stream: Column, preserve_format: bool = True, country_code: bool = True, region: str = "") -> Column:
    """Keep the grouping and the country code or the three-digit national prefix."""
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    code = F.length(F.regexp_replace(F.regexp_extract(c, r"^\s*\+\d{1,3}", 0), r"\D", ""))
    keep = F.lit(0) if not country_code else F.when(F.ltrim(c).startswith("+"), code) \
        .when(F.ltrim(c).startswith("0") & (digits >= 8), 3).otherwise(0)
    shape = F.concat(F.lit("+20 " if region.upper() == "EG" else "+1 "), F.lit("000 000 0000"))
    fresh = _replace_chars(shape, stream, 2 if region.upper() == "EG" else 1)
    return F.when(digits == 0, fresh).otherwise(_replace_chars(c, stream, keep)) if preserve_format else fresh


def fake_email(c: Column, stream: Column, preserve_domain: bool = True, name: Column | None = None) -> Column:
    host = F.split_part(c, F.lit("@"), F.lit(2))

    def build(r: Column) -> Column:
        made = F.concat(_pick(["user", "rand", "anon", "cust"], r, 0), (K.draw(r, 1, 99990) + 10).cast("string"))
        local = made
        if name is not None:
            from_name = F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), " ", "."), "[^a-z0-9._]+", ""), r"^\.+|\.+$", "")
            local = F.when(name.isNull(), made).when(from_name == "", F.concat(F.lit("user"), (K.draw(r, 2, 9990) + 10).cast("string"))).otherwise(from_name)
        domain = F.when(host != "", host).otherwise(_pick(MAIL_HOSTS, r, 3)) if preserve_domain else _pick(MAIL_HOSTS, r, 3)
        return F.concat(local, F.lit("@"), domain)
    return let(stream, build)


def fake_url(c: Column, stream: Column, preserve_host: bool = True) -> Column:
    """Keep scheme and host, replace the path in its shape, drop query and fragment."""
    t = F.trim(c)
    rx = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#\s]+\.[^/?#\s]+)(/[^?#]*)?"
    path = F.regexp_extract(t, rx, 3)
    path = F.when(F.translate(path, "/", "") == "", F.concat(F.lit("/user"), F.lit("0000"))).otherwise(path)
    host = F.regexp_extract(t, rx, 2) if preserve_host else _pick(SOCIAL_HOSTS, stream, 0)
    return F.when(t.rlike(rx), F.concat(F.regexp_extract(t, rx, 1), host, _replace_chars(path, stream, letters=True))) \
        .otherwise(_replace_chars(t, stream, letters=True))


def fake_digits(c: Column, stream: Column) -> Column:
    return _replace_chars(c, stream)


# fixed values: the date shapes a jitter understands
JITTER_FORMATS = [(r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
                  (r"^\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"), (r"^\d{2}/\d{2}/\d{4}", "dd/MM/yyyy")]


def fake_date(c: Column, stream: Column, days: int = 30) -> Column:
    head = F.substring(c, 1, 10)
    delta = K.draw(stream, 0, 2 * days + 1) - days
    out = F.coalesce(*[F.when(head.rlike(rx), F.date_format(F.date_add(F.try_to_date(head, fmt), delta), fmt)) for rx, fmt in JITTER_FORMATS])
    return F.coalesce(out, c)


def fake_uuid(stream: Column) -> Column:
    return let(stream, lambda r: F.concat_ws("-", F.substring(r, 1, 8), F.substring(r, 9, 4), F.substring(r, 13, 4), F.substring(r, 17, 4), F.substring(r, 21, 12)))


PRINTABLE = "".join(map(chr, range(32, 127)))
CATEGORIES = {rx.CATEGORY_DIGIT: string.digits, rx.CATEGORY_WORD: string.ascii_letters + string.digits + "_", rx.CATEGORY_SPACE: " "}
REPEAT_EXTRA = 4              # an open repeat (*, +, {n,}) makes at most so many more than it must


class RegexFake:
    """Texts of a pattern: its syntax tree becomes one expression over a keyed stream of as many draws as the tree can need."""

    def __init__(self, pattern: str, extra: int = REPEAT_EXTRA):
        self.tree, self.extra = re_parser.parse(pattern), extra
        self.draws = 0
        self._text(self.tree, None)                       # counts the draws
        self.blocks = max(1, -(-self.draws // 8))         # eight draws to a block of the stream

    def text(self, stream: Column) -> Column:
        """``stream``: the blocks of the keyed stream, an array."""
        self.draws = 0
        return self._text(self.tree, stream)

    def _draw(self, stream: Column | None, n: int) -> Column:
        self.draws += 1
        at = self.draws - 1
        return F.lit(0) if stream is None else K.draw(F.get(stream, F.lit(at // 8)), at % 8, n)

    def _one_of(self, pool: str, stream: Column | None) -> Column:
        return F.substr(F.lit(pool), self._draw(stream, len(pool)) + 1, F.lit(1))

    def _text(self, tree, stream: Column | None) -> Column:
        parts = [self._node(op, value, stream) for op, value in tree]
        return F.concat(*parts) if parts else F.lit("")

    def _node(self, op, value, stream: Column | None) -> Column:
        if op is rx.LITERAL:
            return F.lit(chr(value))
        if op is rx.ANY:
            return self._one_of(PRINTABLE, stream)
        if op is rx.NOT_LITERAL:
            return self._one_of(PRINTABLE.replace(chr(value), ""), stream)
        if op is rx.IN:
            return self._one_of(self._members(value), stream)
        if op is rx.SUBPATTERN:
            return self._text(value[-1], stream)
        if op is rx.BRANCH:
            choice = self._draw(stream, len(value[1]))
            return F.get(F.array(*[self._text(b, stream) for b in value[1]]), choice)
        if op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
            least, most, body = value
            most = least + self.extra if most is rx.MAXREPEAT else most
            times = self._draw(stream, most - least + 1) + least if most > least else F.lit(least)
            copies = [self._text(body, stream) for _ in range(most)]
            return F.array_join(F.slice(F.array(*copies), F.lit(1), times), "") if copies else F.lit("")
        if op is rx.AT:
            return F.lit("")
        raise ValueError(f"pattern part not supported in fakes: {op}")

    @staticmethod
    def _members(items) -> str:
        found: set[str] = set()
        for op, value in items:
            if op is rx.RANGE:
                found.update(map(chr, range(value[0], value[1] + 1)))
            elif op is rx.LITERAL:
                found.add(chr(value))
            elif op is rx.CATEGORY:
                if value not in CATEGORIES:
                    raise ValueError(f"pattern part not supported in fakes: {value}")
                found.update(CATEGORIES[value])
        return "".join(sorted(set(PRINTABLE) - found if items[0][0] is rx.NEGATE else found))


def fake_regex(label: Column, key: bytes, pattern: str, extra: int = REPEAT_EXTRA) -> Column:
    fake = RegexFake(pattern, extra)
    return let(K.random_blocks(label, key, fake.blocks), fake.text)


# --- the plan ----------------------------------------------------------------------------------------------

def transform(c: Column, rule: MaskRule, master: bytes, name: Column | None = None) -> Column:
    """The expression of one rule over a text column; nulls stay null (redact excepted)."""
    p = rule.params
    key = K.derive_key(master, p.get("key_ref", "k1"))

    def apply_to(s: Column) -> Column:
        label = F.concat(F.lit(f"{rule.column}|"), s)
        stream = K.random_hex(label, key)
        long_stream = K.random_hex(label, key, _blocks(s))
        preserve = p.get("preserve") or {}
        kind = p.get("kind", "free_text")
        locale = p.get("locale", "default")
        if rule.strategy == "mask":
            return partial(s, p.get("keep_first", 0), p.get("keep_last", 4), p.get("mask_char", "*"), p.get("preserve_length", True))
        if rule.strategy == "hash":
            hkey = K.derive_key(master, p["hmac_key_ref"]) if p.get("hmac_key_ref") else None
            return hashed(s, p.get("algo", "sha256"), hkey, int(p.get("truncate", 0)), p.get("prefix", ""))
        if rule.strategy == "encrypt":
            return K.encrypt(s, key)
        if rule.strategy == "fpe":
            return K.fpe(s, key, p.get("alphabet", "digits"), p.get("tweak", "") or rule.column, p.get("mode") or "ff3", p.get("short_value_policy", "error"))
        if kind == "name":
            return fake_name(s, stream, locale)
        if kind == "address":
            return fake_address(s, stream, locale)
        if kind == "company":
            return fake_company(s, stream, locale)
        if kind == "phone":
            return fake_phone(s, K.random_hex(label, key, F.greatest(_blocks(s), F.lit(2))), preserve.get("format", True), preserve.get("country_code", True), preserve.get("region", ""))
        if kind == "email":
            return fake_email(s, stream, preserve.get("domain", True), name)
        if kind == "social_url":
            return fake_url(s, K.random_hex(label, key, F.greatest(_blocks(s), F.lit(2))), preserve.get("host", True))
        if kind in ("credit_card", "iban", "national_id"):
            return fake_digits(s, long_stream)
        if kind == "date":
            return fake_date(s, stream, int(p.get("jitter_days", 30)))
        if kind == "uuid":
            return fake_uuid(stream)
        if kind == "regex":
            library = load_patterns(p["regex_file"]) if p.get("regex_file") else PATTERN_LIBRARY
            return fake_regex(label, key, p.get("regex_pattern") or library[p["regex_library"]], int(p.get("repeat_extra", REPEAT_EXTRA)))
        return F.lit("[redacted]")
    if rule.strategy == "passthrough":
        return c
    if rule.strategy == "redact":
        return F.lit(p.get("replacement")).cast("string")
    text = c.cast("string")
    if "start_index" in p or "end_index" in p:
        return F.when(c.isNotNull(), sliced(text, apply_to, p.get("start_index", 0), p.get("end_index")))
    return F.when(c.isNotNull(), apply_to(text))


def _is_email(r: MaskRule) -> bool:
    return r.strategy == "fake" and r.params.get("kind") == "email"


def _is_costly(r: MaskRule) -> bool:
    return r.strategy == "fpe" or (r.strategy == "fake" and r.params.get("kind") == "regex")


def apply(df: DataFrame, plan: Sequence[MaskRule], master: bytes) -> DataFrame:
    """Mask the whole table in one projection; e-mails follow in a second so they can use the faked names."""
    rules = {r.column: r for r in plan}
    df = dealt(df) if any(_is_costly(r) for r in plan) else df
    names = [r.column for r in plan if r.strategy == "fake" and r.params.get("kind") == "name" and r.column in df.columns]
    first = df.select(*[transform(col(c), rules[c], master).alias(c) if c in rules and not _is_email(rules[c]) else col(c) for c in df.columns])
    if not any(_is_email(r) for r in plan):
        return first
    name = col(names[0]) if names else None
    return first.select(*[transform(col(c), rules[c], master, name).alias(c) if c in rules and _is_email(rules[c]) else col(c) for c in df.columns])


def suggest(evidence: DataFrame) -> DataFrame:
    """A masking rule per evidence row (column, entity_type, detected): strategy and parameters as JSON."""
    e = F.upper(F.coalesce("entity_type", F.lit("")))
    level = sensitivity(F.col("entity_type"))
    ids = ["NATIONAL_ID", "SSN", "ID", "ID_NUMBER", "PASSPORT", "CREDIT_CARD", "IBAN", "IBAN_CODE", "BANK_ACCOUNT", "CARD", "EG_NATIONAL_ID", "EG_TAX_ID"]
    fakes = {"email": ["EMAIL", "EMAIL_ADDRESS"], "phone": ["PHONE", "PHONE_NUMBER"], "name": ["PERSON", "NAME", "PER"],
             "social_url": ["SOCIAL_PROFILE_URL", "SOCIAL_URL"], "address": ["ADDRESS", "LOCATION", "GPE", "LOC"],
             "date": ["DATE", "DATE_TIME", "DOB", "BIRTHDATE"], "company": ["COMPANY", "ORG", "ORGANIZATION"]}
    kind = F.lit(None).cast("string")
    for k, entities in fakes.items():
        kind = F.when(e.isin(entities), k).otherwise(kind)
    fpe, hmac = '{"mode":"ff3","alphabet":"digits","key_ref":"k1"}', '{"algo":"sha256","hmac_key_ref":"k1","truncate":12}'
    off = ~F.coalesce("detected", F.lit(False)) | (e == "")
    strategy = (F.when(off, "passthrough").when(level == "pii_sensitive", F.when(e.isin(ids), "fpe").otherwise("hash"))
                .when(level == "pii_personal", F.when(kind.isNotNull(), "fake").otherwise("hash")).when(level == "pii_indirect", "fpe")
                .when(level == "security_sensitive", "redact").otherwise("passthrough"))
    params = (F.when(strategy == "fpe", fpe).when(strategy == "hash", hmac)
              .when(strategy == "fake", F.to_json(F.struct(kind.alias("kind")))).otherwise("{}"))
    return evidence.withColumn("strategy", strategy).withColumn("params", params)


def sync(plan: DataFrame, columns: DataFrame, evidence: DataFrame) -> DataFrame:
    """The plan (column, strategy, params, edited) against today's columns: new ones are suggested, gone ones leave, edits stay."""
    fresh = suggest(columns.join(evidence, "column", "left")).select("column", F.col("strategy").alias("new_strategy"), F.col("params").alias("new_params"))
    both = plan.join(fresh, "column", "full")
    keep = F.col("edited") | F.col("new_strategy").isNull()
    state = F.when(F.col("strategy").isNull(), "added").when(F.col("new_strategy").isNull(), "removed") \
        .when(F.col("edited"), "kept").when(F.col("strategy") == F.col("new_strategy"), "unchanged").otherwise("updated")
    return both.select("column", F.when(F.coalesce(keep, F.lit(False)), F.col("strategy")).otherwise(F.col("new_strategy")).alias("strategy"),
                       F.when(F.coalesce(keep, F.lit(False)), F.col("params")).otherwise(F.col("new_params")).alias("params"), state.alias("change"))


def risk(df: DataFrame, plan: Sequence[MaskRule]) -> DataFrame:
    """Weak choices of a plan: findings (column, severity, issue, detail)."""
    from tablewarden.operators.profile import distinct_counts

    rules = [r for r in plan if r.column in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, r in enumerate(rules):
        alpha = K.ALPHABETS.get(r.params.get("alphabet", "digits"), r.params.get("alphabet", "digits"))
        quoted = "".join("\\" + ch if ch in r"\]^-[" else ch for ch in alpha)
        text = col(r.column).cast("string")
        aggs += [count_if((text != "") & ~text.rlike(f"[{quoted}]")).alias(f"u{i}"), count_if(text != "").alias(f"n{i}")]
    rows = df.agg(*aggs).select("rows", F.inline(F.array(*[F.struct(
        F.lit(r.column).alias("column"), F.lit(r.strategy).alias("strategy"), F.lit(r.params.get("mode") or "ff3").alias("mode"),
        F.lit(r.params.get("short_value_policy", "error")).alias("short"), F.lit(r.params.get("kind", "")).alias("kind"),
        F.lit(bool(r.params.get("redact", True))).alias("redact"), F.col(f"u{i}").alias("untouched"), F.col(f"n{i}").alias("filled")) for i, r in enumerate(rules)])))
    full = rows.join(distinct_counts(df, [r.column for r in rules]).select("column", "distinct"), "column", "left")
    s = F.col("strategy")
    quasi = reduce(lambda a, b: a | b, [F.lower("column").contains(h) for h in QUASI_HINTS])

    def finding(cond: Column, severity: str, issue: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), detail.alias("detail")))
    found = F.array(
        finding((s == "hash") & (ratio(F.col("distinct"), F.col("rows")) < 0.1), "high", "Deterministic hash on low-cardinality column",
                F.concat(F.col("distinct").cast("string"), F.lit(" distinct values"))),
        finding((s == "passthrough") & quasi, "medium", "Quasi-identifier passed through", F.lit("")),
        finding((s == "fpe") & (F.col("untouched") > 0), "high", "FPE leaves values unchanged",
                F.concat(F.col("untouched").cast("string"), F.lit(" of "), F.col("filled").cast("string"), F.lit(" values"))),
        finding((s == "fpe") & (F.col("mode") == "keystream"), "high", "Legacy keystream FPE", F.lit("")),
        finding((s == "fpe") & (F.col("mode") != "keystream") & (F.col("short") == "keystream"), "medium", "Mixed-mode FPE column", F.lit("")),
        finding((s == "fpe") & (F.col("mode") != "keystream") & (F.col("short") != "keystream"), "low", "Reversible strategy (fpe)", F.lit("")),
        finding(s == "encrypt", "low", "Reversible strategy (encrypt)", F.lit("")),
        finding((s == "fake") & (F.col("kind") == "free_text") & ~F.col("redact"), "medium", "Free-text not redacted", F.lit("")))
    return full.select("column", F.inline(F.array_compact(found)))


def compare(df: DataFrame, plan: Sequence[MaskRule], master: bytes, n: int = 10) -> DataFrame:
    """A few rows side by side: one struct (original, masked) per column."""
    few = df.limit(n)
    pair = few.select(F.struct("*").alias("o"), *[col(c) for c in few.columns])
    both = apply(pair, plan, master)
    return both.select(*[F.struct(F.col("o")[c].cast("string").alias("original"), col(c).cast("string").alias("masked")).alias(c) for c in few.columns])


def manifest(plan: Sequence[MaskRule], spark) -> DataFrame:
    """What was done to each column: parameters without key bytes."""
    rows = [(r.column, r.strategy, r.entity or "", sorted(f"{k}={v}" for k, v in r.params.items() if not k.endswith("_bytes")),
             r.strategy in ("fpe", "encrypt")) for r in plan]
    return spark.createDataFrame(rows, "column string, strategy string, entity string, params array<string>, reversible boolean")


# --- de-identification ---------------------------------------------------------------------------------------

def rule_for(found: DataFrame, overrides: DataFrame, default: str | None = "redact", unknown: str = "redact") -> DataFrame:
    """The strategy of each finding: its entity's override when the score is high enough, else the default."""
    named = overrides.select(F.upper("entity_type").alias("_e"), F.col("strategy").alias("_s"), "min_score")
    joined = found.join(named, F.upper(found["entity_type"]) == F.col("_e"), "left")
    hit = F.col("_e").isNotNull() & (F.col("score") >= F.col("min_score"))
    return joined.select(*[found[c] for c in found.columns], F.when(hit, F.col("_s")).otherwise(F.lit(default or unknown)).alias("strategy"))


def deid_text(docs: DataFrame, spans: DataFrame, policy: dict[str, MaskRule], master: bytes, default: MaskRule | None = None) -> DataFrame:
    """Replace non-overlapping spans by the rule of their entity; one splice per document."""
    entity = F.col("entity_type")
    fallback = default or MaskRule("*", "redact")

    def one(rule: MaskRule) -> Column:
        if rule.strategy == "redact":
            return F.lit(rule.params["replacement"]) if rule.params.get("replacement") else F.concat(F.lit("["), entity, F.lit("]"))
        return F.coalesce(transform(F.col("surface"), MaskRule("_span", rule.strategy, rule.params), master), F.lit(""))
    new = one(fallback)
    for name, rule in policy.items():
        new = F.when(entity == name, one(rule)).otherwise(new)
    edits = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", new.alias("new")))).alias("edits"))
    joined = docs.join(edits, "doc_id", "left")

    done = spliced(F.col("text"), F.col("edits"))
    return joined.select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(done).alias("text"),
                         F.coalesce(F.size("edits"), F.lit(0)).alias("replaced"))


def deid_columns(df: DataFrame, evidence: DataFrame, policy: dict[str, MaskRule], master: bytes, only_detected: bool = True,
                 default: MaskRule | None = None) -> DataFrame:
    """Mask the columns evidence names (one small row per column, read on the driver to build the projection)."""
    plan = []
    for r in evidence.select("column", canonical_entity(F.col("entity_type")).alias("e"), "detected").collect():
        if only_detected and not r["detected"]:
            continue
        rule = policy.get(r["e"]) or default or MaskRule(r["column"], "redact", {"replacement": f"[{r['e']}]"})
        plan.append(MaskRule(r["column"], rule.strategy, rule.params, r["e"]))
    return apply(df, plan, master)


def safe_samples(df: DataFrame, columns: Sequence[str], consent: dict[str, bool] | None = None) -> DataFrame:
    """Shapes of values per column, five without consent and eight with it; never a value."""
    from pyspark.sql import Window as W

    from tablewarden.functions.columns import unpivot
    shapes = unpivot(df, columns).where(F.trim("value") != "").select("column", safe_shape(F.col("value")).alias("shape")).distinct()
    limit = F.lit(5)
    for c, ok in (consent or {}).items():
        limit = F.when((F.col("column") == c) & F.lit(ok), 8).otherwise(limit)
    w = W.partitionBy("column").orderBy("shape")
    return shapes.withColumn("rank", F.row_number().over(w)).where("rank <= 8").where(F.col("rank") <= limit)
