"""Column builders: signals, flags, addresses and paths in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

#: Word boundaries, blanks and word characters follow Unicode; letters match in either case.
ANY_CASE = "(?iU)"
AS_IS = "(?U)"


def found(text: Column, pattern: str, group: int = 0, flags: str = ANY_CASE) -> Column:
    """Distinct matches in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(flags + pattern), F.lit(group)))


def has(text: Column, pattern: str, flags: str = ANY_CASE) -> Column:
    return F.coalesce(text, F.lit("")).rlike(flags + pattern)


def top_level_domains(domains: Column) -> Column:
    """Top-level domains by how many domains have them (most first, then by name)."""
    ends = F.filter(F.transform(domains, lambda d: F.element_at(F.split(F.lower(d), r"\."), -1)), lambda x: x != "")
    return _ranked(ends)


def _ranked(ends: Column) -> Column:
    counted = F.transform(F.array_distinct(ends), lambda e: F.struct((-F.size(F.filter(ends, lambda x: x == e))).alias("n"), e.alias("e")))
    return F.transform(F.array_sort(counted), lambda x: x["e"])


def signals(text: Column) -> dict[str, Column]:
    """Counts and flags of a text, by name."""
    domains = found(text, K.DOMAIN)
    top = top_level_domains(domains)
    nth = {f"top_tld_{i + 1}": F.coalesce(F.get(top, F.lit(i)), F.lit("")) for i in range(3)}
    return {
        "n_urls": F.size(found(text, K.URL)),
        "n_domains": F.size(domains),
        "n_md5": F.size(found(text, K.MD5)),
        "n_sha1": F.size(found(text, K.SHA1)),
        "n_sha256": F.size(found(text, K.SHA256)),
        "has_known_registry_domain": F.arrays_overlap(F.transform(domains, lambda d: F.lower(d)), F.array(*[F.lit(r) for r in K.REGISTRIES])),
        **nth,
        "has_jwt": has(text, K.JWT, AS_IS),
        "has_base64_blob": has(text, K.BASE64, AS_IS),
        "has_azure_secret_hint": has(text, K.CLOUD_SECRET),
    }


def command_flags(text: Column) -> dict[str, Column]:
    return {name: has(text, pattern) for name, pattern in K.COMMAND_FLAGS.items()}


def addresses(text: Column) -> Column:
    return found(text, K.IP, flags=AS_IS)


def paths(text: Column) -> Column:
    """Windows paths, then Unix paths; trimmed, each once."""
    both = F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AS_IS + K.WINDOWS_PATH), F.lit(0)), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AS_IS + K.UNIX_PATH), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(both, lambda p: F.trim(p)), lambda p: p != ""))
