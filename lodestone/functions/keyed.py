"""Keyed hashes and name-based ids from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block of SHA-256, which a keyed hash pads its key to.
_BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """(inner, outer) pad of a key of at most 64 bytes."""
    if len(key) > _BLOCK:
        raise ValueError("a key of at most 64 bytes")
    padded = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest of HMAC-SHA256 of a text in UTF-8."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in UTF-8 below a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    # the variant is the two high bits of the ninth byte
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


_SEALED = "enc:"


def sealed(key: bytes, message: Column) -> Column:
    """A text under AES-256-GCM with a random nonce of 12 bytes, as ``enc:`` and URL-safe Base64 of nonce, ciphertext and tag; null for null."""
    if len(key) != 32:
        raise ValueError("a key of 32 bytes")
    cipher = F.aes_encrypt(F.encode(message, "UTF-8"), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"))
    return F.concat(F.lit(_SEALED), F.translate(F.base64(cipher), "+/\r\n", "-_"))


def unsealed(key: bytes, payload: Column) -> Column:
    """What :func:`sealed` was given; a text without the prefix comes back as it is, one that the key doesn't open as ``<encrypted: InvalidTag>``."""
    if len(key) != 32:
        raise ValueError("a key of 32 bytes")
    body = F.translate(F.substring(payload, len(_SEALED) + 1, 2**31 - 1), "-_", "+/")
    # nonce and tag are 28 bytes, 38 characters and more; less, or other characters, can't be decoded
    whole = body.rlike("^[A-Za-z0-9+/]{38,}={0,2}$")
    data = F.try_to_binary(F.when(whole, body), F.lit("base64"))
    opened = F.try_aes_decrypt(data, F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"))
    text = F.coalesce(F.decode(opened, "UTF-8"), F.lit("<encrypted: InvalidTag>"))
    return F.when(F.startswith(payload, F.lit(_SEALED)), text).otherwise(payload)
