"""Column builders: tolerant casts, timestamps, keys, lists, priorities."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IOC_PRIORITY, IOC_STAGE, STAGES, TACTIC_STAGE


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty text and ``nan`` (an absent CSV field) become null."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def safe_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(float(default)))


def safe_long(c: Column, default: int = 0) -> Column:
    """Whole part of a number; text, NaN and infinities give the default."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(d) & (F.abs(d) < F.lit(9.2e18)), d).try_cast("bigint"), F.lit(default).cast("bigint"))


def csv_list(c: Column) -> Column:
    """Non-empty trimmed items of a comma list; empty array for null."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]Z", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS")
DAY_FIRST_FORMATS = ("dd/MM/yyyy, HH:mm:ss.SSS", "dd/MM/yyyy, HH:mm:ss", "dd/MM/yyyy, hh:mm:ss a", "dd/MM/yyyy HH:mm:ss.SSS", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")


def unix_seconds(c: Column, accept_epoch: bool = False) -> Column:
    """Unix seconds (double) of a timestamp text in UTC, null where it isn't one.

    Text is ISO-like if it begins with a digit and has a dash in its first ten characters,
    otherwise the day comes first. Bare epoch numbers are null unless accepted.
    """
    s = blank_to_null(c)
    iso = F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in ISO_FORMATS])
    day = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DAY_FIRST_FORMATS])
    looks = s.rlike("^[0-9]") & F.substring(s, 1, 10).contains("-")
    seconds = F.unix_micros(F.when(looks, iso).otherwise(day)) / F.lit(1e6)
    if accept_epoch:
        seconds = F.coalesce(seconds, F.when(s.rlike(r"^[0-9]{9,11}(\.[0-9]+)?$"), s.try_cast("double")))
    return seconds


def event_time(ts: Column, order: Column, precision: str = "double") -> Column:
    """Time of an event: its timestamp, else its order; ``float32`` rounds like stored graphs."""
    t = F.coalesce(ts, order.cast("double"))
    return t.cast("float").cast("double") if precision == "float32" else t


def host_prefix(scenario: Column, host: Column | None, ip: Column | None = None) -> Column:
    h = blank_to_null(host) if host is not None else F.lit(None).cast("string")
    i = blank_to_null(ip) if ip is not None else F.lit(None).cast("string")
    return F.when(h.isNotNull(), F.concat_ws("::", scenario, h)).when(i.isNotNull(), F.concat_ws("::", scenario, F.lit("ip"), i)).otherwise(F.concat(scenario, F.lit("::host::UNKNOWN")))


def proc_key(prefix: Column, pid: Column | None, name: Column | None) -> Column:
    p = blank_to_null(pid) if pid is not None else F.lit(None).cast("string")
    n = blank_to_null(name) if name is not None else F.lit(None).cast("string")
    return F.when(p.isNotNull(), F.concat(prefix, F.lit("::proc::"), p)).when(n.isNotNull(), F.concat(prefix, F.lit("::procname::"), n)).otherwise(F.concat(prefix, F.lit("::proc::UNKNOWN")))


def net_key(ip: Column | None, port: Column | None = None, domain: Column | None = None) -> Column:
    """``domain|ip:port``, ``domain``, ``ip:port`` (``ip`` for port 0) or ``UNKNOWN_NET``."""
    none = F.lit(None).cast("string")
    i, d = (blank_to_null(x) if x is not None else none for x in (ip, domain))
    p = safe_long(port) if port is not None else F.lit(0).cast("bigint")
    return (
        F.when(d.isNotNull() & i.isNotNull(), F.concat(d, F.lit("|"), i, F.lit(":"), p.cast("string")))
        .when(d.isNotNull(), d)
        .when(i.isNotNull() & (p != 0), F.concat(i, F.lit(":"), p.cast("string")))
        .when(i.isNotNull(), i)
        .otherwise(F.lit("UNKNOWN_NET"))
    )


def file_key(path: Column) -> Column:
    return F.coalesce(blank_to_null(path), F.lit("UNKNOWN_FILE"))


def host_proc(scenario: Column, host: Column | None = None, ip: Column | None = None) -> Column:
    """Stand-in process of a host, for sensors that don't know processes."""
    return F.concat(host_prefix(scenario, host, ip), F.lit("::proc::HOST"))


#: Named character references: those that Python's standard library lists for HTML 4, and ``apos``.
ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'"}


def unescaped(c: Column) -> Column:
    """Character references (decimal, hexadecimal, named ones of ENTITIES) as what they stand for,
    in one pass; others stay."""

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(ref.rlike("^#[0-9]"), F.substring(ref, 2, 9).try_cast("bigint")).when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10).cast("bigint"))
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(number.isNull(), F.try_element_at(_literal_map(ENTITIES), ref)).when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when((ref != "") & char.isNotNull(), F.concat(char, F.substring(piece, F.length(ref) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(c, "&")
    return F.when(c.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), ""))).otherwise(c)


def event_data(c: Column) -> Column:
    """Name/value pairs of an event's XML as a map; of repeated names the last counts
    (needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``)."""
    pattern = F.lit(r'(?i)<Data\s+Name="([^"]+)"[^>]*>([^<]*)</Data>')
    text = F.coalesce(c, F.lit(""))
    names = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.trim(x))
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: F.trim(unescaped(x)))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"] != "")
    return F.map_from_arrays(F.transform(pairs, lambda p: p["n"]), F.transform(pairs, lambda p: p["v"]))


def port_of_key(key: Column) -> Column:
    """Port at the end of a network key, null unless it lies within 1 to 65535."""
    k = F.element_at(F.split(F.lower(F.trim(key)), r"\|"), -1)
    p = F.when(k.contains(":"), F.trim(F.element_at(F.split(k, ":"), -1)).try_cast("bigint"))
    return F.when((p > 0) & (p < 65536), p)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def primary_type(types: Column) -> Column:
    """The type of highest priority in an array; unknown ones come last, by name; else ''."""
    order = _literal_map({t: i for i, t in enumerate(IOC_PRIORITY)})
    clean = F.filter(F.transform(types, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    ranked = F.transform(clean, lambda x: F.struct(F.coalesce(F.element_at(order, x), F.lit(999)).alias("p"), x.alias("x")))
    return F.coalesce(F.array_min(ranked)["x"], F.lit(""))


def stage_of_type(ioc_type: Column, stages: dict[str, str] | None = None) -> Column:
    """Stage of an indicator type; '' for none."""
    return F.coalesce(F.element_at(_literal_map(stages or IOC_STAGE), ioc_type), F.lit(""))


def stage_index(stage: Column) -> Column:
    """1 to 7 in the order of stages; 0 for none."""
    return F.coalesce(F.element_at(_literal_map({s: i + 1 for i, s in enumerate(STAGES)}), stage), F.lit(0))


def stage_of_tactic(tactic: Column) -> Column:
    """Stage of a tactic, written with blanks, underscores or dashes in any case."""
    t = F.regexp_replace(F.lower(F.trim(tactic)), "[ _]", "-")
    return F.coalesce(F.element_at(_literal_map(TACTIC_STAGE), t), F.lit(""))


def ordered_stages(stages: Column) -> Column:
    """The stages of an array, each once, in the order of an attack."""
    return F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(stages, s))


def lcs_of_ordered(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays in stage order: both are subsequences of the
    same order, so it is what they share."""
    return F.size(F.array_intersect(a, b))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of any two arrays, by dynamic programming over rows."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.get(b, j - 1) == x, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        steps = F.filter(F.sequence(F.lit(0), F.size(b)), lambda j: j > 0)
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, zero, row), -1)


def bucket(value: Column, buckets: int) -> Column:
    """Deterministic bucket of a text (first 28 bits of its md5), equal in any engine."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 7), 16, 10).cast("bigint") % buckets


def draw(*parts: Column | str) -> Column:
    """A whole number from 0 to 2^52 - 1 (first 52 bits of an md5 of the parts, as text with
    colons between), equal in any engine."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def scenario_of_path(path: Column) -> Column:
    """Scenario id such as ``sc3`` in a directory name, else ''."""
    return F.regexp_extract(path, r"(sc[0-9]+)", 1)


def number_text(value: Column, digits: int = 4) -> Column:
    """A number with fixed digits, ``--`` for null."""
    return F.coalesce(F.format_string(f"%.{digits}f", value.cast("double")), F.lit("--"))
