"""Settings: weights, thresholds and the fixed reference vocabularies that results must agree on."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

DEFAULTS: dict[str, Any] = {
    "matching": {
        "weights": {"name": 0.20, "datatype": 0.10, "semantic": 0.20, "value_overlap": 0.25, "distribution": 0.05, "pattern": 0.10, "cardinality": 0.10},
        "min_candidate_score": 0.35,
        "lsh_pair_threshold": 5000,
        "lsh_threshold": 0.3,
        "minhash_permutations": 128,
        "sketch_size": 20_000,
        "flooding": {"enabled": True, "max_iterations": 10, "epsilon": 0.001, "alpha": 0.5, "beta": 0.15, "center": 0.6, "gamma": 0.35},
        "fk_min_containment": 0.9,
        "identifier_min_overlap": 0.05,
        "crosswalk": {"max_small": 80, "max_large": 400, "min_coverage": 0.5, "min_injectivity": 0.8, "max_hallucinated": 0.2},
    },
    "resolution": {"max_block": 2000, "refine_block": 150, "window": 5, "em_iterations": 25, "prior": 0.01, "label_weight": 20.0},
    "thresholds": {"high": 0.90, "medium": 0.70},
    "modes": {
        "strict": {"auto_merge": 0.95, "review": 0.90, "min_edge": 0.85, "entity_merge": 0.90, "entity_review": 0.50},
        "balanced": {"auto_merge": 0.90, "review": 0.70, "min_edge": 0.55, "entity_merge": 0.50, "entity_review": 0.20},
        "permissive": {"auto_merge": 0.75, "review": 0.55, "min_edge": 0.40, "entity_merge": 0.35, "entity_review": 0.15},
    },
    "merge": {
        "mode": "balanced", "strategy": "majority_vote", "key_uniqueness": 0.98, "entity_uniqueness": 0.999, "min_agreement": 0.5, "verify_sample": 20_000,
        "lookup_containment": 0.80, "entity_overlap": 0.30, "entity_shared": 0.02, "vendor_prefixes": ["tpep", "lpep"], "base_currency": "USD",
    },
    "graph": {"path_cost": "neglog"},
}

# Aliases of places by domain, and the semantic type a domain belongs to.
DOMAINS = {
    "indian_cities": {"bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "new delhi": "delhi", "gurgaon": "gurugram", "poona": "pune"},
    "us_cities": {"new york city": "new york", "nyc": "new york", "la": "los angeles", "sf": "san francisco", "san fran": "san francisco"},
    "nyc_boroughs": {"kings": "brooklyn", "kings county": "brooklyn", "richmond": "staten island", "richmond county": "staten island",
                     "new york county": "manhattan", "bronx county": "bronx", "queens county": "queens"},
    "countries": {"usa": "united states", "us": "united states", "united states of america": "united states", "uk": "united kingdom",
                  "great britain": "united kingdom", "bharat": "india"},
}
DOMAIN_TYPES = {"indian_cities": "CITY", "us_cities": "CITY", "countries": "COUNTRY", "nyc_boroughs": "BOROUGH"}
STATE_SUFFIX = r",\s*(ny|new york|ca|california|india)$"
GEO_SUFFIXES = (STATE_SUFFIX, r"\s+county$")

# Static exchange rates to USD of 2026-01-02, and currency symbols.
FX_TO_USD = {"USD": 1.0, "INR": 0.0117, "EUR": 1.08, "GBP": 1.27, "JPY": 0.0068, "AED": 0.2723}
CURRENCY_SYMBOLS = {"$": "USD", "₹": "INR", "Rs": "INR", "Rs.": "INR", "€": "EUR", "£": "GBP", "¥": "JPY"}

# Abbreviations in column names.
ABBREVIATIONS = {
    "cust": "customer", "cus": "customer", "cst": "customer", "no": "number", "num": "number", "nbr": "number", "nr": "number", "id": "identifier",
    "ident": "identifier", "amt": "amount", "qty": "quantity", "dt": "date", "ts": "timestamp", "addr": "address", "tel": "phone", "ph": "phone",
    "mob": "mobile", "fname": "first_name", "lname": "last_name", "dob": "birth_date", "pu": "pickup", "do": "dropoff", "loc": "location",
    "desc": "description", "cat": "category", "txn": "transaction", "trx": "transaction", "tx": "transaction", "ord": "order", "prod": "product",
    "pct": "percent", "pop": "population", "geo": "geographic", "nta": "neighborhood_tabulation_area", "fips": "fips", "zip": "zipcode",
    "postcode": "zipcode", "st": "state", "ctry": "country", "cnty": "county", "boro": "borough", "dist": "distance", "pax": "passenger",
    "emp": "employee", "dept": "department", "mgr": "manager", "yr": "year", "mo": "month", "curr": "currency", "ccy": "currency", "upd": "updated",
    "crt": "created", "cnt": "count", "avg": "average", "med": "median", "inc": "income", "hh": "household",
}
# Sets of words that mean the same in column names.
SYNONYMS = (
    ("customer", "client", "buyer", "consumer", "cust", "shopper", "account_holder"),
    ("identifier", "id", "key", "code", "number", "no", "uid", "ref", "reference"),
    ("name", "full_name", "fullname", "title", "label"),
    ("city", "town", "location", "municipality", "locality", "place", "city_name"),
    ("amount", "spent", "total", "value", "price", "cost", "fare", "sum", "purchase", "payment"),
    ("date", "day", "time", "timestamp", "datetime", "when", "created", "updated"),
    ("email", "mail", "email_address", "e_mail"),
    ("phone", "telephone", "mobile", "cell", "contact_number"),
    ("country", "nation", "ctry"),
    ("zipcode", "zip", "postal", "postcode", "pincode"),
    ("borough", "boro", "county", "district"),
    ("zone", "area", "neighborhood", "neighbourhood", "region", "tabulation"),
    ("population", "pop", "residents", "inhabitants"),
    ("income", "earnings", "salary", "wage"),
    ("transaction", "txn", "order", "sale", "purchase"),
    ("quantity", "qty", "count", "units"),
    ("currency", "ccy", "curr"),
    ("pickup", "pu", "origin", "start", "source"),
    ("dropoff", "do", "destination", "end", "dest"),
    ("distance", "dist", "length", "miles"),
    ("latitude", "lat"),
    ("longitude", "lon", "lng", "long"),
)
# Opaque column codes of public tables and what they mean.
GLOSSARY = {
    "B01003_001E": "total_population", "B19013_001E": "median_household_income", "B25064_001E": "median_gross_rent",
    "B17001_002E": "population_below_poverty", "B17001_001E": "poverty_status_population", "B08301_001E": "total_workers",
    "B08301_010E": "workers_public_transit_commute", "NAME": "geography_name",
}


def settings(**overrides: Any) -> dict[str, Any]:
    """The defaults with ``overrides`` merged in, dictionaries deeply."""
    def merge(base: dict, extra: dict) -> dict:
        for k, v in extra.items():
            base[k] = merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
        return base
    return merge(deepcopy(DEFAULTS), overrides)
