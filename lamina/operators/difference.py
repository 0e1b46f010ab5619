"""What differs between two versions of nested records, by a tree of hashes.

A record has a hash of its own fields, one for each of its lists, and a root made of these; an element of a list has one too. Records whose roots agree
are dropped before any list is exploded, and of the others only lists whose hashes differ are, so the work follows the changes and not the library.

Hashes are SHA-256 of a canonical JSON text: fields that are null are absent, maps are in order of their keys, lists in their own order.
A record's key is in a version once; records with a null key are left out. Elements of a list are told apart by id and, where an id is there again, by its how-manieth it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and has_map(kind.elementType)


def canonical(x: Column, kind: DataType) -> Column:
    """``x`` with its maps as entries in order of their keys, which can be compared."""
    if not has_map(kind):
        return x
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(canonical(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: canonical(e, kind.elementType))
    return F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value"))))


def record_hash(x: Column, kind: DataType) -> Column:
    """Null has a hash of its own."""
    return F.sha2(F.coalesce(F.to_json(F.struct(canonical(x, kind).alias("x"))), F.lit("")), 256)


def paths(a: Column, b: Column, kind: DataType, at: str = "") -> Column:
    """Dotted names of what differs in two values, in order of the schema; maps by key, lists as a whole."""
    if isinstance(kind, StructType):
        inner = [paths(a[f.name], b[f.name], f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields]
        both = F.concat(*inner) if inner else F.array().cast("array<string>")
        return F.when(a.isNull() != b.isNull(), F.array(F.lit(at))).otherwise(both)
    if isinstance(kind, MapType):
        keys = F.array_sort(F.array_union(F.coalesce(F.map_keys(a), F.array().cast(ArrayType(kind.keyType))), F.coalesce(F.map_keys(b), F.array().cast(ArrayType(kind.keyType)))))
        value = lambda m, k: canonical(F.try_element_at(m, k), kind.valueType)
        return F.transform(F.filter(keys, lambda k: ~value(a, k).eqNullSafe(value(b, k))), lambda k: F.concat(F.lit(f"{at}."), k.cast("string")))
    differs = ~canonical(a, kind).eqNullSafe(canonical(b, kind))
    return F.when(differs, F.array(F.lit(at))).otherwise(F.array().cast("array<string>"))


def tree(records: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """key, record (its own fields), lists, and hashes: own, one for each list (``<list>_hash``), root."""
    own = [c for c in records.columns if c != key and c not in lists]
    kind = StructType([records.schema[c] for c in own])
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key), F.struct(*own).alias("record") if own else F.struct(F.lit(True).alias("there")).alias("record"), *lists)
    for name in lists:
        of = records.schema[name].dataType.elementType
        rows = rows.withColumn(f"{name}_hash", F.sha2(F.array_join(F.transform(F.coalesce(name, F.array().cast(records.schema[name].dataType)), lambda e: record_hash(e, of)), ","), 256))
    rows = rows.withColumn("own", record_hash(F.col("record"), kind) if own else F.lit(""))
    return rows.withColumn("root", F.sha2(F.concat_ws(",", "own", *(f"{n}_hash" for n in lists)), 256))


def changes(old: DataFrame, new: DataFrame, key: str, lists: dict[str, str] | None = None) -> DataFrame:
    """key, list, id, occurrence, change, moved, paths, was, now: one row for each thing that differs between two versions of one schema.

    ``lists`` names arrays of structs and the field that is their elements' id. For a record itself list and id are null. change is inserted, deleted or changed; null for an
    element that has only moved, that is, whose place among the elements that both versions have is another one. ``was`` and ``now`` are its places in the lists, from 0.
    The lists of a record that is inserted or deleted aren't gone through.
    """
    lists = lists or {}
    a, b = tree(old, key, tuple(lists)), tree(new, key, tuple(lists))
    kind = StructType([old.schema[c] for c in old.columns if c != key and c not in lists])
    side = lambda df, name, *columns: df.select(key, F.struct(*columns).alias(name))
    # Records without their lists, and lists of the records that both have: nothing is joined that the other side doesn't need.
    records = side(a, "a", "record", "own").join(side(b, "b", "record", "own"), key, "full")
    fate = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a.own") != F.col("b.own"), "changed")
    nothing, none = F.array().cast("array<string>"), F.lit(None)
    found = F.when(fate == "changed", paths(F.col("a.record"), F.col("b.record"), kind)).otherwise(nothing)
    out = records.withColumn("change", fate).filter("change IS NOT NULL")
    out = out.select(key, none.cast("string").alias("list"), none.cast("string").alias("id"), none.cast("int").alias("occurrence"), "change", F.lit(False).alias("moved"), found.alias("paths"), none.cast("int").alias("was"), none.cast("int").alias("now"))
    of = lambda name: (F.col(name), F.unhex(f"{name}_hash").alias(f"{name}_hash"))
    return reduce(DataFrame.unionByName, [element_changes(side(a, "a", *of(name)).join(side(b, "b", *of(name)), key), key, name, field, old.schema[name].dataType.elementType) for name, field in lists.items()], out)


def element_changes(both: DataFrame, key: str, name: str, field: str, kind: StructType) -> DataFrame:
    """``changes`` inside the list ``name`` of records (key, a, b) that are in both versions.

    Elements of both lists are exploded together, so all that follows groups by the key by which the records were joined and shuffles nothing again.
    """
    differing = both.filter(F.col(f"a.{name}_hash") != F.col(f"b.{name}_hash"))
    of = lambda side: F.transform(F.coalesce(f"{side}.{name}", F.array().cast(ArrayType(kind))), lambda e, i: F.struct(F.lit(side == "b").alias("later"), i.alias("at"), e.alias("e")))
    rows = differing.select(key, F.explode(F.concat(of("a"), of("b"))).alias("x")).select(key, "x.*").withColumn("id", F.col(f"e.{field}").cast("string"))
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key, "id", "later").orderBy("at")).cast("int"))
    one = lambda later, c: F.any_value(F.when(F.col("later") == F.lit(later), F.col(c)), F.lit(True))
    rows = rows.groupBy(key, "id", "occurrence").agg(one(False, "at").alias("was"), one(True, "at").alias("now"), one(False, "e").alias("a"), one(True, "e").alias("b"))
    shared = (F.col("was").isNotNull() & F.col("now").isNotNull()).cast("int")
    rank = lambda at: F.sum(shared).over(Window.partitionBy(key).orderBy(at))
    moved = F.when(shared == 1, rank("was") != rank("now")).otherwise(False)
    fate = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "deleted").when(record_hash(F.col("a"), kind) != record_hash(F.col("b"), kind), "changed")
    found = F.when(fate == "changed", paths(F.col("a"), F.col("b"), kind)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("moved", moved).withColumn("change", fate).filter("moved OR change IS NOT NULL")
    return rows.select(key, F.lit(name).alias("list"), "id", "occurrence", "change", "moved", found.alias("paths"), "was", "now")


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one schema with ``more``: how many more there are in ``new`` than in ``old`` (negative: fewer); equal counts go. Partial sums, so a row that is there a million times is one."""
    kind = old.schema
    signed = lambda df, n: df.select(F.struct(*kind.names).alias("row"), F.lit(n).cast("long").alias("n"))
    rows = signed(old, -1).unionByName(signed(new.select(*kind.names), 1)).withColumn("hash", record_hash(F.col("row"), kind))
    return rows.groupBy("hash").agg(F.any_value("row").alias("row"), F.sum("n").alias("more")).filter("more <> 0").select("row.*", "more")
