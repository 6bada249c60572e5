"""Identifiers in text: ``scheme:blob:<id>`` and ``scheme:obj:<id>:<secret>[:<revision>]``, base64url without padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import URI_SCHEME

_BLOB, _OBJECT = f"{URI_SCHEME}:blob:", f"{URI_SCHEME}:obj:"


def base64url(v: Column) -> Column:
    return F.translate(F.rtrim(F.base64(v), F.lit("=")), "+/", "-_")


def from_base64url(v: Column) -> Column:
    """Null for text that is no base64url without padding."""
    whole = F.concat(F.translate(v, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(v) % 4) % 4))
    return F.when(v.rlike("^[A-Za-z0-9_-]*$") & (F.length(v) % 4 != 1), F.try_to_binary(whole, F.lit("base64")))


def blob_uri(blob_id: Column) -> Column:
    return F.concat(F.lit(_BLOB), base64url(blob_id))


def object_uri(object_id: Column, secret: Column, revision: Column | None = None) -> Column:
    base = F.concat(F.lit(_OBJECT), base64url(object_id), F.lit(":"), base64url(secret))
    return base if revision is None else F.concat(base, F.coalesce(F.concat(F.lit(":"), revision.cast("string")), F.lit("")))


def without_revision(uri: Column) -> Column:
    return F.concat_ws(":", F.slice(F.split(uri, ":"), 1, 4))


def at_revision(uri: Column, revision: Column) -> Column:
    return F.concat(without_revision(uri), F.lit(":"), revision.cast("string"))


def parse(uri: Column) -> Column:
    """struct(kind, id, secret, revision, error). Parts after the revision are ignored. Each step's values are computed
    once and handed to the next."""
    kind = F.when(uri.startswith(_BLOB), "blob").when(uri.startswith(_OBJECT), "object")
    return _once(F.struct(uri.alias("uri"), kind.alias("kind"), F.split(uri, ":").alias("parts")), lambda x: _once(_decoded(x), _judged))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(x: Column) -> Column:
    kind, parts = x["kind"], x["parts"]
    part = lambda i: F.get(parts, F.lit(i))
    one = F.when(kind == "blob", F.substring(x["uri"], len(_BLOB) + 1, 1 << 30)).when(kind == "object", part(2))
    secret = F.when(kind == "object", from_base64url(F.coalesce(part(3), F.lit("?"))))
    revision = F.when(kind == "object", F.when(part(4).rlike(r"^\+?[0-9]+$"), part(4)).try_cast("bigint"))
    return F.struct(x["uri"].alias("uri"), kind.alias("kind"), F.size(parts).alias("parts"), from_base64url(one).alias("id"), secret.alias("secret"), revision.alias("revision"))


def _judged(x: Column) -> Column:
    uri, kind, parts, id_, secret, revision = (x[c] for c in ("uri", "kind", "parts", "id", "secret", "revision"))
    error = (
        F.when(~uri.startswith(f"{URI_SCHEME}:"), "scheme")
        .when(kind.isNull(), "type")
        .when((kind == "object") & (parts < 4), "component")
        .when(id_.isNull(), "base64")
        .when(F.octet_length(id_) != 32, "length")
        .when((kind == "object") & secret.isNull(), "base64")
        .when((kind == "object") & (F.octet_length(secret) != 32), "length")
        .when((kind == "object") & (parts > 4) & revision.isNull(), "revision")
    )

    def made(e: Column) -> Column:
        good = lambda v: F.when(e.isNull(), v)
        return F.struct(good(kind).alias("kind"), good(id_).alias("id"), good(secret).alias("secret"), good(revision).alias("revision"), e.alias("error"))

    return _once(error, made)
