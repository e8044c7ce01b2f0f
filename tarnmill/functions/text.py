"""Text, identifier and digest expressions, all evaluated in the JVM."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the built-in word tokenizer, spelt out because engines differ on what white space is.
SEPARATORS = "[ \\t\\n\\r\\f]+"


def not_blank(text: Column) -> Column:
    """True if the text has a character that Unicode does not count as white space (separators 1C to 1F included)."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def identifier(value: Column, numeric: bool = False) -> Column:
    """A source id as a string; null, empty and (for numbers) zero mean that there is none."""
    absent = value.isNull() | (value == 0) if numeric else value.isNull()
    return F.when(absent, "").otherwise(value.cast("string"))


def digest_modulo(digest: Column, modulus: int) -> Column:
    """A 256-bit hexadecimal digest modulo a number below 2**31, folded over eight 32-bit limbs."""
    if not 0 < modulus < 1 << 31:
        raise ValueError("the modulus must lie between 1 and 2**31 - 1")
    limb = lambda i: F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long")
    out = F.lit(0).cast("long")
    for i in range(8):
        out = (out * F.lit(1 << 32) + limb(i)) % F.lit(modulus)
    return out


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def escapes_root(path: Column) -> Column:
    """True for absolute paths and those with a parent step."""
    return path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")


def list_digest(values: Column) -> Column:
    """Digest of a list of integers in its JSON form."""
    return F.sha2(F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]")), 256)


def canonical_digest(value) -> str:
    """Digest of a JSON value with sorted keys; identifies a recipe."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def word_tokens(text: Column, end: str = "<eos>") -> Column:
    """The built-in tokenizer: separated words, then exactly one end token."""
    return F.concat(F.filter(F.split(text, SEPARATORS), lambda w: w != ""), F.array(F.lit(end)))
