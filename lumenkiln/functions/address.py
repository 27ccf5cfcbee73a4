"""Addresses: street numbers, tokens, normalisation rules, provider payloads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffixes and what else they are called.
SUFFIXES = [
    ("ave", "avenue"), ("st", "street"), ("rd", "road"), ("dr", "drive"), ("blvd", "boulevard"), ("ln", "lane"),
    ("ct", "court"), ("pl", "place"), ("pkwy", "parkway"), ("ter", "terrace"), ("cir", "circle"),
]
_OTHER = {a: b for pair in SUFFIXES for a, b in (pair, pair[::-1])}


def street_number(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"^\s*(\d+[A-Za-z\-]?)\b", 1), F.lit(""))


def token_groups(address: str, most: int = 3) -> list[list[str]]:
    """Alternatives for each token: the first number, then street words until a suffix."""
    tokens = re.findall(r"[a-z0-9]+", address.lower())
    number = next((i for i, t in enumerate(tokens) if re.search(r"\d", t)), None)
    head = [] if number is None else [[tokens[number]]]
    street: list[list[str]] = []
    for token in tokens[0 if number is None else number + 1 :][:most]:
        street.append([token, _OTHER[token]] if token in _OTHER else [token])
        if token in _OTHER:
            break
    return head + street


def address_matches(column: Column, address: str) -> Column:
    """Every group has an alternative that the address holds."""
    groups = token_groups(address)
    if not groups:
        return F.lit(False)
    return reduce(and_, [reduce(or_, [F.lower(column).like(f"%{t}%") for t in group]) for group in groups])


def address_tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """An empty list or None is a wildcard."""

    name: str
    normalized_street: str
    city: str | None = None
    states: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    street_contains: list[str] = field(default_factory=list)
    street_numbers: list[str] = field(default_factory=list)

    def fits(self, *, city: Column, state: Column, country: Column, street: Column, number: Column) -> Column:
        terms = [F.lit(True)]
        if self.city:
            terms.append(F.lower(F.trim(city)) == self.city.lower())
        for column, values in ((state, self.states), (country, self.countries), (number, self.street_numbers)):
            if values:
                terms.append(F.lower(F.trim(column)).isin(*[v.lower() for v in values]))
        if self.street_contains:
            terms.append(reduce(or_, [F.instr(F.lower(street), v.lower()) > 0 for v in self.street_contains]))
        return F.coalesce(reduce(and_, terms), F.lit(False))

    def version(self, ruleset: str) -> str:
        return f"{self.name}@{ruleset}"[:64]


def first_rule(rules: list[Rule], ruleset: str, **columns: Column) -> Column:
    """struct(name, street, version) of the first rule that fits, or null."""
    out = F.lit(None).cast("struct<name:string,street:string,version:string>")
    for rule in reversed(rules):
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.normalized_street).alias("street"), F.lit(rule.version(ruleset)).alias("version"))
        out = F.when(rule.fits(**columns), value).otherwise(out)
    return out


def display_name(street: Column, city: Column, state: Column, postal: Column, country: Column) -> Column:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    region = F.nullif(F.concat_ws(" ", part(state), part(postal)), F.lit(""))
    return F.concat_ws(", ", part(street), part(city), region, part(country))


def reuse_allowed(original: Column, rule_version: Column, current_version: Column) -> Column:
    return original.isNotNull() | rule_version.isNull() | F.coalesce(rule_version == current_version, F.lit(False))


PAYLOAD = (
    "Title string, PlaceId string, Position array<double>, TimeZone struct<Name:string>, Address struct<Label:string,AddressNumber:string,Street:string,Locality:string,District:string,"
    "SubDistrict:string,SubRegion:struct<Name:string>,Region:struct<Name:string,Code:string>,PostalCode:string,Country:struct<Name:string,Code2:string>>"
)


def provider_address(payload: Column) -> Column:
    """Our address columns from a reverse-geocoder's JSON item, with fallbacks."""
    p = F.from_json(payload, PAYLOAD)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = p["Address"]
    street = text(F.concat_ws(" ", text(a["AddressNumber"]), text(a["Street"])))
    city, state, country = text(a["Locality"]), F.coalesce(text(a["Region"]["Name"]), text(a["Region"]["Code"])), text(a["Country"]["Name"])
    coords = F.concat_ws(", ", F.get(p["Position"], 1).cast("string"), F.get(p["Position"], 0).cast("string"))
    shown = F.coalesce(text(p["Title"]), text(a["Label"]), F.nullif(F.concat_ws(", ", city, state, country), F.lit("")), coords)
    return F.struct(
        shown.alias("display_name"), street.alias("street_address"), text(a["AddressNumber"]).alias("street_number"),
        F.coalesce(text(a["District"]), text(a["SubDistrict"])).alias("neighborhood"), city.alias("city"), text(a["SubRegion"]["Name"]).alias("county"),
        state.alias("state"), text(a["PostalCode"]).alias("postal_code"), country.alias("country"), text(a["Country"]["Code2"]).alias("country_code"),
        text(p["TimeZone"]["Name"]).alias("time_zone"), p["PlaceId"].alias("place_id"),
    )
