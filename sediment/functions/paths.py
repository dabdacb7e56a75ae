"""Predicates on member paths and prefixes, and sets of profiles, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions import probe
from sediment.functions.media_type import profile_of_essence
from sediment.functions.profiles import EXTENSIONS, OFFICE_PARTS, OOXML, PROFILES, ZIP, registry

# The longest path and extension.
MAX_PATH, MAX_EXTENSION = 4096, 8


def extension(path: Column) -> Column:
    """What follows the last dot of the last component, one to eight bytes, ASCII letters lowered; else null."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.*\.([^.]+)$", 1)
    lowered = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when((found != "") & (F.octet_length(found) <= MAX_EXTENSION), lowered)


def media_type_of_name(path: Column) -> Column:
    """The media type of a name's extension, by a literal map; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(EXTENSIONS.items()) for x in pair]), extension(path))


def is_wrapped_tar(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:tar\.gz|tgz)$")


def is_safe(path: Column) -> Column:
    """Relative, inside its root, and not too long."""
    return (F.octet_length(path) <= MAX_PATH) & ~path.rlike(r"^[/\\]") & ~F.array_contains(F.split(path, "/"), "..")


def is_xml_part(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(?:xml|rels)$")


def office_kind(name: Column) -> Column:
    """The Office kind whose main part this is; null for any other part."""
    out = F.lit(None).cast("string")
    for kind, part in OFFICE_PARTS.items():
        out = F.when(name == part, kind).otherwise(out)
    return out


def container_kind(prefix: Column) -> Column:
    """gzip, zip or tar by the first bytes. The checksum of a tar header without its magic counts as well."""
    p = F.substring(prefix, 1, 512)
    told = F.conv(F.regexp_extract(F.substring(p, 149, 8).cast("string"), r"^ *([0-7]+)", 1), 8, 10).cast("long")
    values = F.transform(F.regexp_extract_all(F.hex(p), F.lit("(..)"), 1), lambda h, i: F.when((i >= 148) & (i < 156), F.lit(32)).otherwise(F.conv(h, 16, 10).cast("long")))
    summed = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    tar = (F.octet_length(p) >= 512) & ((F.hex(F.substring(p, 258, 5)) == F.lit("ustar".encode().hex())) | (told.isNotNull() & (told > 0) & (told == summed)))
    first = F.hex(F.substring(p, 1, 4))
    return F.when(F.substring(first, 1, 4) == "1F8B", "gzip").when(first.isin("504B0304", "504B0506"), "zip").when(tar, "tar")


def member_type(path: Column, prefix: Column) -> Column:
    """struct<media_type, container> of a member by its path and first bytes, as the decomposer infers it."""
    named, kind, listed = media_type_of_name(path), container_kind(prefix), registry(2)
    holders = [e for e in sorted(set(EXTENSIONS.values())) if listed.get(e) in (ZIP, OOXML) or e in ("application/x-tar", "application/gzip")]
    holds = F.coalesce(named.isin(*holders), F.lit(False)) | is_wrapped_tar(path)
    inside = kind.isNotNull() & (holds | named.isNull())
    # a name types the bytes unless they show a profile other than the one its type has
    stands = probe.reconciled(probe.detected(prefix), profile_of_essence(named)).isNotNull()
    return F.struct(F.when(inside | (named.isNotNull() & stands), named).alias("media_type"), F.when(inside, kind).alias("container"))


def set_bits(names: Column) -> Column:
    """A set of profiles as bits in registry order, for bit_or over groups."""
    out = F.lit(0)
    for i, name in enumerate(PROFILES):
        out = out + F.when(F.array_contains(names, name), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def set_names(bits: Column) -> Column:
    """The profiles of a set of bits, in registry order."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(PROFILES)]))
