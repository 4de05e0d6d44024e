"""Replacement texts for spans, and writing them into a text: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def redacted(entity: Column) -> Column:
    return F.concat(F.lit("<"), entity, F.lit(":REDACTED>"))


def masked(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def tokenized(entity: Column) -> Column:
    return F.concat(F.lit("<"), entity, F.lit(":TOKEN>"))


def replaced(entity: Column, literal: str | None) -> Column:
    """The literal; an empty one gives a marker."""
    return F.lit(literal) if literal else F.concat(F.lit("<"), entity, F.lit(":REPLACED>"))


def blake2b(values: Column) -> Column:
    """Hex digests of an array of values; there is no built-in form, so an Arrow function makes them."""

    @F.pandas_udf("array<string>")
    def run(rows):
        import hashlib

        return rows.map(lambda row: None if row is None else [hashlib.blake2b(v.encode()).hexdigest() for v in row])

    return run(values)


def hashed(entity: Column, value: Column, algo: str = "sha256", digest: Column | None = None) -> Column:
    """Marker with the first 16 hex digits; a blake2b digest is made beforehand or, outside arrays, here."""
    if algo in ("sha256", "sha512"):
        digest = F.sha2(value, int(algo[3:]))
    elif algo == "blake2b":
        digest = blake2b(F.array(value))[0] if digest is None else digest
    else:
        raise ValueError(f"unknown hash {algo}")
    return F.concat(F.lit("<"), entity, F.lit(f":HASH:{algo}="), F.substring(digest, 1, 16), F.lit(">"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column under a driver-side key, from sha2 alone."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def vault_token(key: bytes, entity: Column, value: Column, prefix: str = "vault_tok_") -> Column:
    """A token that is the same for equal (entity, value) under one key; set `prefix` to that of tokens already in use."""
    message = F.concat(F.encode(entity, "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "UTF-8"))
    return F.concat(F.lit(prefix), F.lower(entity), F.lit("_"), F.substring(hmac_sha256(key, message), 1, 20))


def splice(text: Column, edits: Column) -> Column:
    """`text` with edits (start, end, replacement), sorted and without overlaps, written in."""
    end = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(edits, end, lambda a, e: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, e["start"] - a["at"]), e["replacement"]).alias("out"), e["end"].alias("at")))
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def without_overlaps(edits: Column) -> Column:
    """Of edits sorted by (start, -priority, -length), those that begin at or after the end of the last kept."""
    return F.aggregate(edits, F.slice(edits, 1, 0), lambda kept, e: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= e["start"], F.concat(kept, F.array(e))).otherwise(kept))


def _fernet_keys(key: str) -> tuple[bytes, bytes]:
    """(signing key, encryption key) of a url-safe base64 key of 32 bytes."""
    import base64
    import binascii

    try:
        raw = base64.urlsafe_b64decode(key)
    except (ValueError, binascii.Error):
        raw = b""
    if len(raw) != 32:
        raise ValueError("an encryption key is 32 bytes as url-safe base64")
    return raw[:16], raw[16:]


def _hex(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def sealed(value: Column, key: str, at: int) -> Column:
    """A token of the Fernet form: version, time `at` in seconds, initialisation vector, AES-128-CBC text and HMAC-SHA256.

    The vector is a keyed hash of the value, so that a task that runs again writes the
    same token; equal values have equal tokens.
    """
    signing, secret = _fernet_keys(key)
    plain = F.encode(value, "UTF-8")
    iv = F.unhex(F.substring(hmac_sha256(signing, F.concat(_hex(b"iv"), plain)), 1, 32))
    body = F.concat(_hex(b"\x80" + at.to_bytes(8, "big")), F.aes_encrypt(plain, _hex(secret), F.lit("CBC"), F.lit("PKCS"), iv))
    return F.translate(F.base64(F.concat(body, F.unhex(hmac_sha256(signing, body)))), "+/\r\n", "-_")


def unsealed(token: Column, key: str) -> Column:
    """The value of such a token; null where it was not made with the key."""
    signing, secret = _fernet_keys(key)
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    size = F.octet_length(raw)
    body, mark = F.substr(raw, F.lit(1), size - 32), F.substr(raw, size - 31, F.lit(32))
    good = (size >= 73) & (F.unhex(hmac_sha256(signing, body)) == mark)
    return F.when(good, F.decode(F.try_aes_decrypt(F.substr(body, F.lit(10), size - 41), _hex(secret), F.lit("CBC"), F.lit("PKCS")), "UTF-8"))


def encrypted(entity: Column, value: Column, key: str, at: int) -> Column:
    return F.concat(F.lit("<"), entity, F.lit(":ENC:"), sealed(value, key, at), F.lit(">"))
