"""Keys, encryption and signatures with what the platform has: scrypt, AES-GCM, Ed25519 of the JVM."""

from __future__ import annotations

import hashlib
import os
import secrets
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SIGNED_PREFIX = b"stratarc-v1 signature\0"
CATALOG_COUNTER = (1 << 64) - 1


def new_salt() -> bytes:
    return secrets.token_bytes(16)


def read_key(given: str, size: int) -> bytes:
    """A key of so many bytes from hex digits, or from a file that holds them; white space around them doesn't matter."""
    text = given.strip()
    if os.path.isfile(given):
        with open(given) as f:
            text = f.read(4 * size + 64).strip()
    try:
        key = bytes.fromhex(text)
    except ValueError:
        key = b""
    if len(key) != size:
        raise ValueError(f"not a key of {size} bytes in hex")
    return key


def derive_key(password: str, salt: bytes, n: int = 1 << 14, r: int = 8, p: int = 1) -> bytes:
    """A 32-byte key; the password is normalised, so the same characters always give the same key. A fresh salt gives a fresh key."""
    if not (1 <= p <= 16 and 1 <= r <= 64 and 2 <= n <= 1 << 22 and n & (n - 1) == 0):
        raise ValueError("key derivation parameters out of bounds")
    return hashlib.scrypt(unicodedata.normalize("NFC", password).encode(), salt=salt, n=n, r=r, p=p, dklen=32, maxmem=256 * n * r + (1 << 20))


def _iv(counter: Column) -> Column:
    """12 bytes: four zeros and the block's counter; unique per key, since every archive has its own key."""
    return F.unhex(F.concat(F.lit("00000000"), F.lpad(F.hex(counter), 16, "0")))


def sealed(payload: Column, key: bytes, counter: Column, aad: Column) -> Column:
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _iv(counter), aad)


def opened(payload: Column, key: bytes, aad: Column) -> Column:
    """The plain payload, null if key, header or payload are not those it was sealed with."""
    return F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)


class Signer:
    """Ed25519 through the driver's JVM. Keys are raw 32-byte values."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway

    def _key(self, prefix: str, raw: bytes, private: bool):
        factory = self.jvm.java.security.KeyFactory.getInstance("Ed25519")
        data = bytearray(bytes.fromhex(prefix) + raw)
        if private:
            return factory.generatePrivate(self.jvm.java.security.spec.PKCS8EncodedKeySpec(data))
        return factory.generatePublic(self.jvm.java.security.spec.X509EncodedKeySpec(data))

    def new_keys(self) -> tuple[bytes, bytes]:
        """(private, public)"""
        pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
        factory = self.jvm.java.security.KeyFactory.getInstance("Ed25519")
        spec = lambda key, name: bytes(factory.getKeySpec(key, self.jvm.java.lang.Class.forName(f"java.security.spec.{name}EncodedKeySpec")).getEncoded())
        return spec(pair.getPrivate(), "PKCS8")[-32:], spec(pair.getPublic(), "X509")[-32:]

    def sign(self, private: bytes, root_hash: str) -> bytes:
        one = self.jvm.java.security.Signature.getInstance("Ed25519")
        one.initSign(self._key("302e020100300506032b657004220420", private, True))
        one.update(bytearray(SIGNED_PREFIX + bytes.fromhex(root_hash)))
        return bytes(one.sign())

    def verify(self, public: bytes, root_hash: str, signature: bytes) -> bool:
        """Strict: a key of small order or a scalar not below the group order is refused."""
        order = 2**252 + 27742317777372353535851937790883648493
        if len(public) != 32 or len(signature) != 64 or int.from_bytes(signature[32:], "little") >= order or _small_order(public) or _small_order(signature[:32]):
            return False
        try:
            one = self.jvm.java.security.Signature.getInstance("Ed25519")
            one.initVerify(self._key("302a300506032b6570032100", public, False))
            one.update(bytearray(SIGNED_PREFIX + bytes.fromhex(root_hash)))
            return bool(one.verify(bytearray(signature)))
        except Exception:  # a malformed key or point is no valid signature
            return False


def _small_order(point: bytes) -> bool:
    """Whether the encoded point, added to itself three times over, is the neutral element."""
    p = 2**255 - 19
    d = -121665 * pow(121666, -1, p) % p
    y = int.from_bytes(point, "little")
    sign, y = y >> 255, (y & ((1 << 255) - 1)) % p
    u, v = (y * y - 1) % p, (d * y * y + 1) % p
    x2 = u * pow(v, -1, p) % p
    x = pow(x2, (p + 3) // 8, p)
    if (x * x - x2) % p:
        x = x * pow(2, (p - 1) // 4, p) % p
    if (x * x - x2) % p:
        return True  # no point at all
    if x & 1 != sign:
        x = -x % p
    for _ in range(3):
        t = d * x * x * y * y % p
        x, y = 2 * x * y * pow(1 + t, -1, p) % p, (y * y + x * x) * pow(1 - t, -1, p) % p
    return x == 0 and y == 1
