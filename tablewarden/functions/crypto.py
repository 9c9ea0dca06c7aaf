"""Keyed hashing, encryption and format-preserving encryption as Column expressions.

Derived keys enter expressions as literals and nothing else: they are never written to a table or a log.  They do
show in an explained plan, so plans of masked jobs must not be stored.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.columns import let, lit_list

# fixed values
ALPHABETS = {"digits": "0123456789", "alnum": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ROUNDS, KNOWN_SHIFTS = 8, 64
NUM = "decimal(38,0)"


def derive_key(master: bytes, key_ref: str) -> bytes:
    return _hmac.new(master, f"keyref:{key_ref}".encode(), hashlib.sha256).digest()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text column: two nested sha2 calls over padded keys."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    body = F.concat(F.lit(bytearray(inner)), F.encode(message, "utf-8"))
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(body, 256))), 256)


def digest(c: Column, algo: str = "sha256") -> Column:
    return {"md5": lambda: F.md5(c), "sha1": lambda: F.sha1(c), "sha224": lambda: F.sha2(c, 224), "sha256": lambda: F.sha2(c, 256),
            "sha384": lambda: F.sha2(c, 384), "sha512": lambda: F.sha2(c, 512)}[algo]()


def encrypt(c: Column, key: bytes) -> Column:
    """AES-256-GCM with a random nonce: ``g1:`` + url-safe base64 of nonce, ciphertext and tag."""
    cipher = F.aes_encrypt(F.encode(c, "utf-8"), F.lit(bytearray(key[:32])), F.lit("GCM"))
    return F.concat(F.lit("g1:"), F.translate(F.base64(cipher), "+/", "-_"))


def decrypt(c: Column, key: bytes) -> Column:
    raw = F.unbase64(F.translate(F.substring(c, 4, 1 << 30), "-_", "+/"))
    return F.when(c.startswith("g1:"), F.try_aes_decrypt(raw, F.lit(bytearray(key[:32])), F.lit("GCM")).cast("string"))


def random_hex(label: Column, key: bytes, blocks: Column | int = 1) -> Column:
    """A keyed hex stream that depends on the label only: the same value gets the same fake everywhere."""
    if isinstance(blocks, int) and blocks == 1:
        return hmac_sha256(F.concat(label, F.lit("|0")), key)
    return F.array_join(random_blocks(label, key, blocks), "")


def random_blocks(label: Column, key: bytes, blocks: Column | int) -> Column:
    """The blocks of ``random_hex`` as an array: a draw from one of them need not walk the whole stream."""
    n = F.lit(blocks) if isinstance(blocks, int) else blocks
    return let(label, lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: hmac_sha256(F.concat(x, F.lit("|"), i.cast("string")), key)))


def draw(stream: Column, i: int | Column, n: int) -> Column:
    """The i-th number in [0, n) of a hex stream, eight hex characters each."""
    at = F.lit(i * 8 + 1) if isinstance(i, int) else i * 8 + 1
    return (F.conv(F.substr(stream, at, F.lit(8)), 16, 10).cast("bigint") % n).cast("int")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


# --- keystream ---------------------------------------------------------------------------------------------

def keystream(c: Column, key: bytes, alphabet: str = "digits", tweak: str = "", reverse: bool = False) -> Column:
    """Shift every alphabet character by a keyed amount of its position; other characters stay."""
    alpha = ALPHABETS.get(alphabet, alphabet)
    radix = len(alpha)
    known = [int.from_bytes(_hmac.new(key, f"{tweak}:{p}".encode(), hashlib.sha256).digest()[:8], "big") % radix for p in range(KNOWN_SHIFTS)]

    def shift(pos: Column) -> Column:
        live = F.conv(F.substring(hmac_sha256(F.concat(F.lit(f"{tweak}:"), pos.cast("string")), key), 1, 16), 16, 10).cast("decimal(20,0)") % radix
        return F.when(pos < KNOWN_SHIFTS, F.get(lit_list(known), pos)).otherwise(live.cast("int"))

    def step(acc: Column, ch: Column) -> Column:
        i = F.instr(F.lit(alpha), ch) - 1
        j = F.pmod(i - shift(acc["pos"]) if reverse else i + shift(acc["pos"]), F.lit(radix))
        return F.when(i < 0, F.struct(acc["pos"].alias("pos"), F.concat(acc["out"], ch).alias("out"))).otherwise(
            F.struct((acc["pos"] + 1).alias("pos"), F.concat(acc["out"], F.substr(F.lit(alpha), j + 1, F.lit(1))).alias("out")))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(characters(c), zero, step, lambda a: a["out"])


# --- FF3-1 (NIST SP 800-38G rev. 1) ------------------------------------------------------------------------

def domain_limits(alphabet: str) -> tuple[int, int, int]:
    radix = len(ALPHABETS.get(alphabet, alphabet))
    return radix, math.ceil(math.log(1_000_000, radix)), 2 * math.floor(96 / math.log2(radix))


def _round_words(tweak: bytes) -> list[str]:
    """The reversed round word of each round as hex."""
    left = bytes([*tweak[:3], tweak[3] & 0xF0])
    right = bytes([*tweak[4:7], (tweak[3] & 0x0F) << 4])
    words = []
    for i in range(ROUNDS):
        w = right if i % 2 == 0 else left
        words.append(bytes([w[0], w[1], w[2], w[3] ^ i])[::-1].hex())
    return words


NIBBLES = 0x0F0F0F0F0F0F0F


def _swap_nibbles(x: Column) -> Column:
    """The two hex digits of each byte of a number below 2**56, exchanged: with the hex text reversed, that reverses its bytes."""
    mask = F.lit(NIBBLES).cast("bigint")
    return F.shiftleft(x.bitwiseAND(mask), 4).bitwiseOR(F.shiftright(x, 4).bitwiseAND(mask))


def _little_endian(x: Column, size: int) -> Column:
    """Hex text of the ``size`` bytes (7 at most) of a bigint, least byte first."""
    return F.reverse(F.lpad(F.hex(_swap_nibbles(x)), 2 * size, "0"))


def ff3(core: Column, key: bytes, tweak: bytes, alphabet: str = "digits", reverse: bool = False, narrow: bool = False) -> Column:
    """FF3-1 over a text of alphabet characters only, with the built-in AES as round function.

    Both halves are carried as numbers (first character least significant), so a round is arithmetic.  ``narrow``
    keeps halves below 2**31 and works on bigint; otherwise decimal(38) holds the largest domain (31 digits).
    """
    alpha = ALPHABETS.get(alphabet, alphabet)
    decimal_digits = alpha == "0123456789"
    radix, _, longest = domain_limits(alphabet)
    num_type = "bigint" if narrow else NUM
    half = _narrow_half(radix) if narrow else longest // 2
    fit = math.floor(62 / math.log2(radix))       # characters whose number fits a bigint; a half has twice as many at most
    steps = F.array(*[F.lit(radix ** i).cast("bigint") for i in range(fit)])
    powers = F.array(*[F.lit(str(radix ** i)).cast(num_type) for i in range(half + 2)])
    words = lit_list(_round_words(tweak))
    aes_key = F.lit(bytearray(key[:32][::-1]))

    def number(text: Column) -> Column:
        if decimal_digits:
            return F.reverse(text).cast(num_type)

        def piece(at: int) -> Column:
            return F.aggregate(F.reverse(characters(F.substring(text, at + 1, fit))), F.lit(0).cast("bigint"), lambda acc, ch: acc * radix + F.instr(F.lit(alpha), ch) - 1)
        total = piece(0).cast(num_type)
        for at in range(fit, half, fit):
            total = (total + piece(at).cast(num_type) * F.lit(str(radix ** at)).cast(num_type)).cast(num_type)
        return total

    def little_endian_hex(num: Column) -> Column:
        if narrow:
            return F.concat(_little_endian(num, 4), F.lit("0" * 16))

        def words_of(low: Column) -> Column:
            return F.concat(_little_endian(low.cast("bigint"), 6), _little_endian(((num - low) / F.lit(1 << 48).cast(NUM)).cast("bigint"), 6))
        return let((num % F.lit(1 << 48).cast(NUM)).cast(NUM), words_of)

    def keyed(num: Column, i: Column, modulus: Column) -> Column:
        block = F.unhex(F.concat(little_endian_hex(num), F.get(words, i)))
        cipher = F.reverse(F.hex(F.aes_encrypt(block, aes_key, F.lit("ECB")).substr(1, 16)))

        def piece(h: Column, at: int, size: int) -> Column:
            return _swap_nibbles(F.conv(F.substring(h, at + 1, size), 16, 10).cast("bigint"))

        def remainder(h: Column) -> Column:
            """The 128-bit number mod the modulus, as many bits at a time as the number type leaves room for."""
            if narrow:
                acc = piece(h, 0, 8) % modulus
                for at in (8, 16, 24):
                    acc = (F.shiftleft(acc, 32) + piece(h, at, 8)) % modulus
                return acc
            high = ((piece(h, 0, 14).cast(NUM) * F.lit(1 << 56).cast(NUM) + piece(h, 14, 14)).cast(NUM) % modulus).cast(NUM)
            return ((high * F.lit(1 << 16).cast(NUM) + piece(h, 28, 4)).cast(NUM) % modulus).cast(NUM)
        return let(cipher, remainder)

    def run(p: Column) -> Column:
        def forward(acc: Column, i: Column) -> Column:
            modulus = F.when(i % 2 == 0, p["mu"]).otherwise(p["mv"])
            return F.struct(acc["b"].alias("a"), ((acc["a"] + keyed(acc["b"], i, modulus)) % modulus).cast(num_type).alias("b"))

        def backward(acc: Column, i: Column) -> Column:
            modulus = F.when(i % 2 == 0, p["mu"]).otherwise(p["mv"])
            return F.struct(((acc["b"] - keyed(acc["a"], i, modulus) + modulus) % modulus).cast(num_type).alias("a"), acc["a"].alias("b"))
        zero = F.struct(p["a"].alias("a"), p["b"].alias("b"))
        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        done = F.aggregate(order, zero, backward if reverse else forward)
        return let(done, lambda r: F.concat(spell(r["a"], p["u"]), spell(r["b"], p["v"])))

    def spell(num: Column, size: Column) -> Column:
        if decimal_digits:
            return F.reverse(F.lpad(num.cast("string"), size, F.lit("0")))

        def letters(x: Column, count: Column) -> Column:
            place = lambda i: F.call_function("div", x, F.get(steps, i)) % radix
            return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(F.lit(alpha), place(i).cast("int") + 1, F.lit(1))), "")).otherwise("")
        if half <= fit:
            return letters(num, size)
        whole = F.lit(str(radix ** fit)).cast(NUM)
        return let((num % whole).cast(NUM), lambda low: F.concat(letters(low.cast("bigint"), F.least(size, F.lit(fit))), letters(((num - low) / whole).cast("bigint"), size - fit)))
    n = F.length(core)
    u = F.ceil(n / 2).cast("int")
    v = (n - u).cast("int")
    halves = F.struct(u.alias("u"), v.alias("v"), number(F.substr(core, F.lit(1), u)).alias("a"), number(F.substr(core, u + 1, v)).alias("b"),
                      F.get(powers, u).alias("mu"), F.get(powers, v).alias("mv"))
    return let(halves, run)


def _narrow_half(radix: int) -> int:
    """The longest half whose numbers stay below 2**31, so that 32 more bits still fit a bigint."""
    return math.floor(31 / math.log2(radix))


def fpe(c: Column, key: bytes, alphabet: str = "digits", tweak: str = "", mode: str = "ff3", short: str = "error",
        reverse: bool = False) -> Column:
    """Format-preserving encryption; characters outside the alphabet keep their place.

    A value outside the FF3-1 length range follows ``short``: error, keystream or passthrough (too long is an error).
    """
    if mode == "keystream":
        return keystream(c, key, alphabet, tweak, reverse)
    alpha = ALPHABETS.get(alphabet, alphabet)
    _, least, longest = domain_limits(alphabet)
    seven = hashlib.sha256(f"fpe:{tweak}".encode()).digest()[:7]
    quoted = "".join("\\" + ch if ch in r"\]^-[" else ch for ch in alpha)
    core = F.regexp_replace(c, f"[^{quoted}]", "")

    def put_back(new: Column) -> Column:
        def step(acc: Column, ch: Column) -> Column:
            inside = F.instr(F.lit(alpha), ch) > 0
            return F.struct(F.when(inside, acc["pos"] + 1).otherwise(acc["pos"]).alias("pos"),
                            F.concat(acc["out"], F.when(inside, F.substr(new, acc["pos"], F.lit(1))).otherwise(ch)).alias("out"))
        spread = F.aggregate(characters(c), F.struct(F.lit(1).alias("pos"), F.lit("").alias("out")), step, lambda a: a["out"])
        return F.when(F.length(c) == F.length(new), new).otherwise(spread)
    small = {"keystream": keystream(c, key, alphabet, tweak, reverse), "passthrough": c,
             "error": F.raise_error(F.concat(F.lit(f"value too short for FF3-1 (minimum {least} characters): length "), F.length(core).cast("string")))}[short]
    too_long = F.raise_error(F.lit(f"value too long for FF3-1 (maximum {longest} characters)")).cast("string")
    size = F.length(core)
    return F.when(size == 0, c).when(size < least, small.cast("string")).when(size > longest, too_long) \
        .when(size <= 2 * _narrow_half(len(alpha)), let(ff3(core, key, seven, alphabet, reverse, narrow=True), put_back)) \
        .otherwise(let(ff3(core, key, seven, alphabet, reverse), put_back))
