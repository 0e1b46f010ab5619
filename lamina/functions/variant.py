"""State values that keep their type: numbers, booleans and texts as VARIANT, a scene's state as a VARIANT object.

A text is read as the editor reads it (as ``numbers.state_value`` does): true and false are booleans, what is a number is one (whole ones as BIGINT, others as DOUBLE), all else a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import lit, number, number_text

STATE = "map<string,variant>"
#: Whole numbers below this are kept as such; a double holds all of them.
WHOLE = 2**53


def bound(x: Column, use) -> Column:
    """``use`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def typed(text: Column) -> Column:
    """The VARIANT that a state text means; null is an empty text."""
    whole = lambda n: (n == F.floor(n)) & (F.abs(n) < WHOLE)
    of_number = lambda n: F.when(whole(n), n.cast("bigint").cast("variant")).otherwise(n.cast("variant"))

    def of(t: Column) -> Column:
        read = bound(F.when(t != "", number(t)), lambda n: F.when(n.isNull(), t.cast("variant")).otherwise(of_number(n)))
        return F.when(t.isin("true", "false"), (t == "true").cast("variant")).otherwise(read)

    return bound(F.trim(F.coalesce(text, F.lit(""))), of)


def typed_state(state: Column) -> Column:
    """A map of texts as a VARIANT object; null stays null."""
    return F.to_variant_object(F.transform_values(state, lambda _, v: typed(v)))


def entries(state: Column) -> Column:
    """An object's values by key; null or another value than an object has none."""
    object_ = F.when(F.schema_of_variant(state).startswith("OBJECT"), state)
    return F.coalesce(object_.cast(STATE), F.create_map().cast(STATE))


def get(held: Column, key) -> Column:
    """The VARIANT of a key among ``entries``, whatever signs the key has; null if it isn't there."""
    return F.try_element_at(held, lit(key))


def put(state: Column, key, value: Column) -> Column:
    """``state`` with ``key`` set to a VARIANT, whether or not it was there."""
    kept = F.map_filter(entries(state), lambda k, _: k != lit(key))
    return F.to_variant_object(F.map_concat(kept, F.create_map(lit(key), value)))


def kind(value: Column) -> Column:
    """number, boolean, text, or null where there is no value."""
    t = F.schema_of_variant(value)
    return F.when(t == "BOOLEAN", "boolean").when(t == "STRING", "text").when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "number")


def text(value: Column) -> Column:
    """The value as the editor shows it."""
    return bound(kind(value), lambda k: shown(value, k))


def shown(value: Column, of_kind: Column) -> Column:
    return F.when(of_kind == "number", number_text(F.try_variant_get(value, "$", "double"))).otherwise(F.try_variant_get(value, "$", "string"))


def matches(value: Column, expected: Column) -> Column:
    """Blank ``expected`` asks whether the value is there and not false, 0 or empty; else kind and value must be those that the text means."""
    t = F.trim(F.coalesce(expected, F.lit("")))

    def of(k: Column) -> Column:
        # A value is read as its own kind alone: reading a text as a number is slow to fail.
        holds = F.when(k == "boolean", F.try_variant_get(value, "$", "boolean")).when(k == "number", F.try_variant_get(value, "$", "double") != 0).otherwise(F.try_variant_get(value, "$", "string") != "")
        same = lambda w: k.eqNullSafe(kind(w)) & shown(value, k).eqNullSafe(text(w))
        return F.when(t == "", F.coalesce(holds, F.lit(False))).otherwise(bound(typed(t), same))

    return bound(kind(value), of)
