"""Link hosts and blocklist entries."""

from pyspark.sql import Column, functions as F

# scheme, optional userinfo, host or [ipv6], optional port, then the path, query or fragment
_HOST = (r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[A-Za-z0-9\-._~:!$&'()*+,;=%@]*@)?"
         r"(\[[^\[\]/?#\s]*\]|(?:[A-Za-z0-9\-._~!$&'()*+,;=<>\"%]|[^\x00-\x7F])*)"
         r"(?::[0-9]*)?(?:[/?#]|$)")


def host(link: Column) -> Column:
    """Lower-case host of a link, without port, userinfo and brackets; `''` when malformed."""
    link = F.coalesce(link, F.lit(""))
    before_fragment = F.substring_index(link, "#", 1)
    fragment = F.substr(link, F.length(before_fragment) + 1)
    before_query = F.substring_index(before_fragment, "?", 1)
    raw = F.regexp_extract(link, _HOST, 1)
    broken = before_fragment.rlike(r"[\x00-\x1f\x7f]") | (
        F.contains(link, F.lit("%")) & (_bad_escape(before_query) | _bad_escape(fragment)))
    name = F.when(raw.contains("%"), _unescaped(raw)).otherwise(raw)
    name = F.when(name.startswith("["), F.regexp_replace(name, r"^\[|\]$", "")).otherwise(name)
    return F.when(broken, F.lit("")).otherwise(F.lower(name))


def _bad_escape(part: Column) -> Column:
    return F.regexp_replace(part, "%[0-9A-Fa-f]{2}", "").contains("%")


def _unescaped(raw: Column) -> Column:
    """Decode `%C3%A9` in a host; only bytes above ASCII and `%25` may be escaped there."""
    allowed = ~F.regexp_replace(raw, "%(?:[89A-Fa-f][0-9A-Fa-f]|25)", "").contains("%")
    plain = F.replace(raw, F.lit("+"), F.lit("%2B"))
    return F.when(allowed, F.coalesce(F.try_url_decode(plain), F.lit(""))).otherwise(F.lit(""))


def suffixes(name: Column) -> Column:
    """The host itself, then what follows each dot, longest first."""
    return F.get(each_suffixes(F.array(name)), F.lit(0))


def each_suffixes(names: Column) -> Column:
    """`suffixes` of every host in an array. Nested lambdas keep each step to one evaluation."""
    parts = F.transform(names, lambda name: F.split(name, r"\."))
    return F.transform(parts, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def blocklist_entry(value: Column) -> Column:
    """Trimmed, lower-case, without one leading `*.` and then one leading `.`."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"^(?:\*\.)?\.?", "")


def blocklist_entries(values: list[str]) -> list[str]:
    """`blocklist_entry` for a configured list: a set without empty entries, in first-seen order."""
    clean = (v.strip().lower().removeprefix("*.").removeprefix(".") for v in values)
    return list(dict.fromkeys(v for v in clean if v))
