"""Host and registered domain of a url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: second labels under which the registries of country domains register names.
SECOND_LABELS = ("ac", "asn", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "gv", "id", "ind", "info", "mil", "ne", "net", "nom", "or", "org", "plc", "sch", "web")


def read_suffixes(text: str) -> tuple[str, ...]:
    """Rules of a public suffix list: a rule per line, comments after ``//``; ``*.x`` and ``!y.x`` as they stand."""
    return tuple(r for line in text.splitlines() if (r := line.split("//")[0].split("\t")[0].strip().lower()))


def netloc(url: Column) -> Column:
    """Lower-case authority with port and user, one leading ``www.`` removed; '' for null or authority-less urls."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def suffix_labels(labels: Column, rules: tuple[str, ...] | None = None) -> Column:
    """How many labels the public suffix of a host has.

    By ``rules`` of a public suffix list where given: the longest matching rule
    holds, an exception one label less, and a host that none matches has a
    suffix of one label.  Without a list a country domain of two letters has
    two where the label before it is one of SECOND_LABELS, any other one.
    """
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    has = lambda n: F.size(labels) >= n
    if rules is None:
        return F.when(has(2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LABELS), 2).otherwise(1)
    by: dict[tuple[str, int], list[str]] = {}
    for r in rules:
        kind = "except" if r.startswith("!") else "any" if r.startswith("*.") else "plain"
        rest = r.lstrip("!").removeprefix("*.")
        by.setdefault((kind, rest.count(".") + 1), []).append(rest)
    found = [F.lit(1)]
    for (kind, n), names in by.items():
        if kind != "except":
            k = n + (kind == "any")
            found.append(F.when(has(k) & last(n).isin(*names), k).otherwise(0))
    most = F.greatest(*found) if len(found) > 1 else found[0]
    for (kind, n), names in by.items():
        if kind == "except":
            most = F.when(has(n) & last(n).isin(*names), n - 1).otherwise(most)
    return most


def registered_domain(url: Column, rules: tuple[str, ...] | None = None) -> Column:
    """The label before the public suffix with it; hosts without one, bare suffixes and addresses fall back to the authority."""
    host = F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    n = suffix_labels(labels, rules)
    named = (F.size(labels) > n) & ~host.rlike(r"^\d+(?:\.\d+){3}$") & ~host.rlike(r"^\[")
    return F.when(named, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n, F.lit(1)), n + 1))).otherwise(netloc(url))
