"""Address parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import constants as K
from kinlink.functions.text import fold_latin, is_native, lookup, zero_strip

# Patterns of house numbers, identifiers and halves.
HOUSE = r"^[#\s]*([0-9]+)(?:-?([a-z]))?(?![a-z0-9])"
IDENT = r"[a-z0-9]+(?:[/-][a-z0-9]+)+|(?<![a-z0-9])[0-9]+[a-z]{0,2}(?![a-z0-9])"
HALF = r"\b1\s*/\s*2\b"


def components(address: Column, unquote: bool = False) -> Column:
    """Comma-separated parts without empty ones and placeholders; `unquote` takes off wrapping quotes."""
    parts = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda c: F.trim(c))
    if unquote:
        parts = F.transform(parts, lambda c: F.trim(F.regexp_replace(c, "^[\"']+|[\"']+$", "")))
    return F.filter(parts, lambda c: (c != "") & ~F.lower(c).isin(K.NULL_PLACEHOLDERS))


def state_of_component(c: Column, country: Column) -> Column:
    key = F.when(is_native(c), c).otherwise(F.trim(fold_latin(c), F.lit(" .")))
    anywhere = F.when(F.length(key) > 3, lookup(K.states_anywhere(), key))
    return F.coalesce(lookup(K.states(), F.concat(country, F.lit("|"), key)), anywhere)


def state_position(parts: Column, country: Column) -> Column:
    """1-based place of the right-most part that names a state; 0 if none."""
    found = F.transform(parts, lambda c, i: F.when(state_of_component(c, country).isNotNull(), i + 1).otherwise(0))
    return F.coalesce(F.array_max(found), F.lit(0))


def canonical_tokens(s: Column) -> Column:
    """Address words in short form: ordinals and numbers as digits, cities' and words' variants folded, words without a
    place dropped."""
    variants = {v: c for c, vs in K.ADDRESS_WORDS.items() for v in vs}
    ordinals = {w: str(i + 1) for i, w in enumerate(K.ORDINALS)}

    def canon(t):
        city = F.coalesce(lookup(K.CITY_ALIASES, t), t)
        word = F.coalesce(lookup(variants, city), city)
        return (
            F.when(t.rlike("^[0-9]+(st|nd|rd|th)$"), F.regexp_extract(t, "^([0-9]+)", 1))
            .when(lookup(ordinals, t).isNotNull(), lookup(ordinals, t))
            .when(t.rlike("^[0-9]+$"), zero_strip(t))
            .otherwise(F.when(word.isin(K.ADDRESS_DROP), F.lit(None)).otherwise(word))
        )

    return F.filter(F.transform(F.regexp_extract_all(s, F.lit("([a-z0-9]+)")), canon), lambda t: t.isNotNull())


def identifiers(folded: Column) -> Column:
    """Composite house identifiers, first seen first: separators and labels off, zeros stripped, ordinals left out."""
    raw = F.flatten(F.transform(folded, lambda c: F.regexp_extract_all(F.replace(c, F.lit("#"), F.lit(" ")), F.lit(IDENT), F.lit(0))))
    raw = F.filter(raw, lambda t: t.rlike("[0-9]") & ~t.rlike("^[0-9]+(st|nd|rd|th)$"))
    bare = F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, "[-/]", ""), f"^(?:{'|'.join(K.IDENT_LABELS)})(?=[0-9])", ""))
    stripped = F.transform(bare, lambda t: F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0")))
    return F.array_distinct(F.filter(stripped, lambda t: t.rlike("[0-9]")))


def parse_addresses(df: DataFrame, address: str = "business_address", country: str = "country", unquote: bool = False) -> DataFrame:
    """df with state, hn, hn_suf, half, nums, addr_toks, street, city, addr_empty, idents."""
    out = df.withColumn("__parts", components(F.col(address), unquote)).withColumn("__at", state_position(F.col("__parts"), F.col(country)))
    state = F.when(F.col("__at") > 0, state_of_component(F.get("__parts", F.col("__at") - 1), F.col(country))).otherwise("")
    out = out.withColumn("state", state).withColumn("__rest", F.transform(F.filter("__parts", lambda c, i: i + 1 != F.col("__at")), fold_latin))
    out = out.withColumn("half", F.exists("__rest", lambda c: c.rlike(HALF)).cast("int")).withColumn("__rest", F.transform("__rest", lambda c: F.regexp_replace(c, HALF, " ")))
    out = out.withColumn("__numbered", F.coalesce(F.get(F.filter("__rest", lambda c: c.rlike(HOUSE)), F.lit(0)), F.lit("")))
    tokens = F.transform("__rest", canonical_tokens)
    out = out.withColumn("__toks", tokens)
    typed = F.get(F.filter("__toks", lambda t: F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")).isin(K.STREET_TYPES)), F.lit(0))
    own = canonical_tokens(F.regexp_replace("__numbered", HOUSE, ""))
    plain = F.filter("__rest", lambda c: ~c.rlike("[0-9]"))
    city = F.trim(F.coalesce(F.try_element_at(plain, F.lit(-1)), F.lit("")), F.lit(" ."))
    out = out.withColumns(
        {
            "hn": zero_strip(F.regexp_extract("__numbered", HOUSE, 1)),
            "hn_suf": F.regexp_extract("__numbered", HOUSE, 2),
            "street": F.when(F.size(own) > 0, own).otherwise(F.coalesce(typed, F.array().cast("array<string>"))),
            "nums": F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("__rest", lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)")))), zero_strip))),
            "addr_toks": F.flatten("__toks"),
            "city": F.coalesce(lookup(K.CITY_ALIASES, city), city),
            "addr_empty": (F.size("__parts") == 0).cast("int"),
            "idents": identifiers(F.col("__rest")),
        }
    )
    return out.drop("__parts", "__at", "__rest", "__numbered", "__toks")


def state_of(address: Column, country: Column) -> Column:
    """The state alone, without the check for placeholders."""
    parts = F.transform(F.split(address, ","), lambda c: F.trim(c))
    at = state_position(parts, country)
    return F.when(at > 0, state_of_component(F.get(parts, at - 1), country)).otherwise("")


def address_key(state: Column, idents: Column, hn: Column, street: Column, city: Column) -> Column:
    """`state|identifiers or number|first street word|city`; '' without a number."""
    number = F.coalesce(F.nullif(F.array_join(idents, " "), F.lit("")), hn)
    return F.when(number == "", "").otherwise(F.concat_ws("|", state, number, F.coalesce(F.get(street, F.lit(0)), F.lit("")), city))


def gazetteer_state(address: Column, prefixes: dict[str, str]) -> Column:
    """State by the first two digits of a five-digit postal code."""
    return F.coalesce(lookup(prefixes, F.regexp_extract(address, r"\b([0-9]{2})[0-9]{3}\b", 1)), F.lit(""))
