"""Scalar expressions: severities, identities, globs, image references, package urls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities and their ranks, aliases, URL namespace of RFC 4122.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "unknown": 0}
SEVERITY_ALIAS = {"negligible": "low", "moderate": "medium", "none": "info", "": "info"}
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
# Names of package ecosystems in advisory feeds (lower case) and in package urls, and the feeds' labels.
ECOSYSTEMS = {
    "npm": "npm", "pypi": "pypi", "go": "golang", "golang": "golang", "maven": "maven", "rubygems": "gem", "gem": "gem", "crates.io": "cargo", "cargo": "cargo",
    "packagist": "composer", "composer": "composer", "nuget": "nuget", "pub": "pub", "hex": "hex", "swifturl": "swift",
}
FEED_LABELS = {
    "npm": "npm", "pypi": "PyPI", "python": "PyPI", "golang": "Go", "gem": "RubyGems", "cargo": "crates.io", "composer": "Packagist", "php": "Packagist", "maven": "Maven",
    "java": "Maven", "nuget": "NuGet", "hex": "Hex", "pub": "Pub",
}


def severity_rank(severity: Column) -> Column:
    """critical 5 to unknown 0; anything else 0."""
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def severity_order(severity: Column, info_apart: bool = False) -> Column:
    """Order of lists: critical first; info has a place of its own in status lists only."""
    names = ["critical", "high", "medium", "low", *(["info"] if info_apart else [])]
    out = F.lit(len(names) + 1)
    for k, name in enumerate(names, 1):
        out = F.when(severity == name, F.lit(k)).otherwise(out)
    return out


def normalize_severity(severity: Column, unknown: str = "unknown") -> Column:
    """Lower-case and trimmed, aliases resolved; what isn't known becomes `unknown` (inventory) or `info` (scanners)."""
    s = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    for a, b in SEVERITY_ALIAS.items():
        s = F.when(s == a, F.lit(b)).otherwise(s)
    return F.when(s.isin(*(k for k in SEVERITY_RANK if k != "unknown")), s).otherwise(F.lit(unknown))


def first_value(*values: Column, default: str = "") -> Column:
    """The first value that is neither null nor empty, as text."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values), F.lit(default))


def stable_id(namespace: str, *parts: Column, prefix: str = "lodestack") -> Column:
    """UUIDv5 of the colon-joined parts (null: empty), by built-in expressions."""
    name = F.concat_ws(":", F.lit(prefix), F.lit(namespace), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.shiftright(F.conv(F.substring(h, 17, 2), 16, 10).cast("int"), 0).bitwiseAND(63).bitwiseOR(128).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def glob_regex(pattern: str) -> str:
    """A whole-match regular expression of a shell glob whose * crosses slashes; [abc], [a-z] and [!abc] are classes."""
    out = ""
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S):
        if len(token) > 2:
            not_, inner = ("^", token[2:-1]) if token[1] == "!" else ("", token[1:-1])
            out += f"[{not_}{re.sub(r'([\\^\[\]&])', r'\\\1', inner)}]"
        elif token != "*" or not out.endswith(".*"):  # several stars mean one, which does not go back over the others
            out += ".*" if token == "*" else "." if token == "?" else re.escape(token)
    return f"^(?s:{out})$"


def any_glob(value: Column, patterns: list[str]) -> Column:
    """Whether any of these globs matches; no pattern matches nothing."""
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(glob_regex(p))
    return found


def allowed(value: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion beats inclusion; no inclusion includes all."""
    return (any_glob(value, include) if include else F.lit(True)) & ~any_glob(value, exclude)


def purl_ecosystem(purl: Column, fallback: Column | None = None) -> Column:
    """The type of a package url, else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(purl, r"^pkg:([^/@]+)", 1), F.lit("")), fallback if fallback is not None else F.lit("unknown"))


def image_reference(ref: Column, library: bool = True) -> Column:
    """registry, repository, tag, digest of an image reference; the defaults are docker.io, library/ and latest."""
    ref = F.trim(ref)
    digest = F.nullif(F.regexp_extract(ref, r"@(sha256:[0-9a-fA-F]+)$", 1), F.lit(""))
    bare = F.regexp_replace(ref, r"@.*$", "")
    tag = F.nullif(F.regexp_extract(bare, r":([^:/]+)$", 1), F.lit(""))
    path = F.regexp_replace(bare, r":[^:/]+$", "")
    host = F.regexp_extract(path, r"^([^/]*[.:][^/]*|localhost)/", 1)
    rest = F.when(host != "", F.expr("null").cast("string")).otherwise(path)
    rest = F.coalesce(rest, F.regexp_replace(path, r"^[^/]+/", ""))
    registry = F.when(host == "", F.lit("docker.io")).otherwise(host)
    repository = F.when((host == "") & ~rest.contains("/"), F.concat(F.lit("library/"), rest)).otherwise(rest) if library else rest
    tag = F.when(tag.isNull() & digest.isNull(), F.lit("latest")).otherwise(tag)
    return F.struct(registry.alias("registry"), repository.alias("repository"), tag.alias("tag"), digest.alias("digest"))


def registry_type(host: Column) -> Column:
    """Kind of a registry by its host name."""
    return (
        F.when(host.rlike(r"\.dkr\.ecr\..*amazonaws\.com"), "ecr").when(host.rlike(r"(^|\.)ghcr\.io$"), "ghcr").when(host.rlike(r"docker\.io$"), "dockerhub").when(host.rlike(r"quay\.io$"), "quay").when(host.rlike(r"gcr\.io$|pkg\.dev$"), "gcr").when(host.rlike(r"azurecr\.io$"), "acr").otherwise("other")
    )


def percent_encoded(value: Column) -> Column:
    """All but letters, digits and -._~ as percent codes of UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def safe_url(url: Column) -> Column:
    """The url if it is http or https, else empty."""
    return F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.lit(""))


def contains_any(term: str, *columns: Column) -> Column:
    """Case-insensitive substring search over columns; % and _ of the term are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.ilike(c, F.lit(f"%{term}%")), F.lit(False))
    return found


def _looked_up(value: Column, table: dict[str, str], default: Column) -> Column:
    """One look-up in a literal map, so that the value stands in the plan once."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), default)


def ecosystem_name(value: Column) -> Column:
    """The package url type of a feed's ecosystem; a suffix after a colon is left out, other names stay in lower case."""
    base = F.trim(F.split_part(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(":"), F.lit(1)))
    return _looked_up(base, ECOSYSTEMS, base)


def osv_ecosystem(value: Column) -> Column:
    """The feed's label of an ecosystem under any of its names, empty if it has none."""
    return _looked_up(ecosystem_name(value), FEED_LABELS, F.lit(""))


def ecosystems_match(a: Column, b: Column) -> Column:
    """Equal under their package url types, or one of them empty."""
    a, b = ecosystem_name(a), ecosystem_name(b)
    return (a == "") | (b == "") | (a == b)
