"""Column expressions on text: prices, addresses, ids, secrets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING = ("ref", "cmpid", "emag_click_id", "fbclid", "gclid", "gclsrc", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid", "spm", "_ga")
#: Fixed value: the name space of ids made of an address (RFC 4122).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def valid_price(x: Column) -> Column:
    """The number if it is finite and positive, else null."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def local_price(raw: Column) -> Column:
    """``1.234,56 Lei`` to 1234.56: dots part thousands, a comma the decimals."""
    bare = F.trim(F.regexp_replace(raw, "(?i)lei|ron", ""))
    return valid_price(F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".").try_cast("double"))


def machine_price(raw: Column) -> Column:
    """A plain decimal as it is, anything else as a local price."""
    plain = F.trim(raw).try_cast("double")
    return F.when(plain.isNotNull(), valid_price(plain)).otherwise(local_price(raw))


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.``, no closing slash, no fragment, no tracking parameters, the others sorted."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.regexp_replace(part(3), "/+$", "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lower(part(1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 id of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def offer_uuid(retailer: Column, sku: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("offer"), retailer, sku))


def product_uuid(title: Column) -> Column:
    return uuid5(F.concat(F.lit("product:"), title))


def fingerprint(retailer: Column, sku: Column) -> Column:
    return F.concat(F.lit("pid-v1:"), F.sha2(F.concat_ws(":", retailer, sku).cast("binary"), 256))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC as two hashes over the padded key (up to 64 bytes)."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("keys over 64 bytes are hashed first; give the hash")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


#: Shapes of secrets. A bot's token, a model provider's token, and ids of RFC 4122.
SECRETS = {
    "bot_token": r"bot[0-9]{5,16}:[A-Za-z0-9_-]{34,36}",
    "provider_token": r"hf_[A-Za-z0-9]{20,}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}


def redact_secrets(text: Column) -> Column:
    for pattern in SECRETS.values():
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def secret_hits(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in SECRETS.items()}


#: What a text for a prompt must not hold.
UNSAFE = r"(?i)[<>]|javascript:|data:"


def sanitize(text: Column, most: int = 200, rounds: int = 3) -> Column:
    """Takes out ``<``, ``>``, ``javascript:`` and ``data:`` until the rest joins to none of them, then white space at the ends, and cuts to ``most`` characters.

    After ``rounds`` rounds few texts have one left. Each further round takes a colon away, so as many rounds as colons end it.
    """
    once = lambda t: F.regexp_replace(t, UNSAFE, "")
    for _ in range(rounds):
        text = once(text)
    again = F.aggregate(F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))), text, lambda t, _: once(t))
    text = F.when(F.rlike(text, F.lit(UNSAFE)), again).otherwise(text)
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, most)


def fold(text: Column) -> Column:
    """Lower case without the marks of the Latin letters that listings use; trademark signs become spaces."""
    marked, plain = "ăâáàäãåāçćčďéèêëěíìîïłñńňóòôöõőøřśšșşťțţúùûüůűýÿźžż®™©", "aaaaaaaacccdeeeeeiiiilnnnooooooorsssstttuuuuuuyyzzz   "
    return F.translate(F.lower(text), marked, plain)


#: Signs of trade marks: they part words, and go before decomposition makes letters of them.
SIGNS = {ord(c): " " for c in "®™©"}


def plain_letters(text: str) -> str:
    """Case folded, compatibility decomposition, without combining marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(SIGNS).casefold()) if not unicodedata.combining(c))


def fold_all(text: Column) -> Column:
    """Like ``fold`` for every script and sign, in Arrow batches."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(plain_letters, na_action="ignore")

    return folded(text)
