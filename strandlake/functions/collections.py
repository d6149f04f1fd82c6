"""Functions on arrays, stacks, maps and multimaps (maps of arrays), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("arrays of different lengths"))).otherwise(value)


def map2(a: Column, b: Column, f) -> Column:
    """f(x, y) of the elements of two arrays of one length; other lengths are an error."""
    return _same_length(a, b, F.zip_with(a, b, f))


def map2i(a: Column, b: Column, f) -> Column:
    """f(i, x, y), i from 0."""
    return _same_length(a, b, F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda e, i: f(i, e["x"], e["y"])))


def reverse_indexed(a: Column) -> Column:
    """array<struct<i, x>>: an array from its end, with the places from 0."""
    return F.reverse(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))))


def add_at(a: Column, i: Column, by: Column) -> Column:
    """An array with `by` added at the place i, from 0; a place outside is an error."""
    bad = (i < 0) | (i >= F.size(a))
    return F.when(bad, F.raise_error(F.lit("no such place"))).otherwise(F.transform(a, lambda x, k: F.when(k == i, x + by).otherwise(x)))


def replace_part(a: Column, at: Column, part: Column) -> Column:
    """An array with `part` put over its elements from `at` on; a part that does not fit is an error."""
    bad = (at < 0) | (at + F.size(part) > F.size(a))
    return F.when(bad, F.raise_error(F.lit("a part outside"))).otherwise(F.concat(F.slice(a, F.lit(1), at), part, F.slice(a, at + F.size(part) + 1, F.size(a))))


def push(stack: Column, x: Column) -> Column:
    return F.array_append(stack, x)


def top(stack: Column) -> Column:
    """The last element; an empty stack is an error."""
    return F.when(F.size(stack) == 0, F.raise_error(F.lit("an empty stack"))).otherwise(F.try_element_at(stack, F.lit(-1)))


def pop(stack: Column) -> Column:
    """The stack without its last element; an empty stack is an error."""
    return F.when(F.size(stack) == 0, F.raise_error(F.lit("an empty stack"))).otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))


def map_replace(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def bindings(m: Column) -> Column:
    """array<struct<key, value>> in the order of the keys."""
    return F.array_sort(F.map_entries(m))


def find_next(m: Column, key: Column) -> Column:
    """The entry of the smallest key above `key`; null if there is none."""
    return F.array_min(F.filter(F.map_entries(m), lambda e: e["key"] > key))


def multimap_add(m: Column, key: Column, value: Column) -> Column:
    """A multimap with a value added to a key's set."""
    have = F.coalesce(F.try_element_at(m, key), F.array_remove(F.array(value), value))
    return map_replace(m, key, F.array_sort(F.array_union(have, F.array(value))))


def multimap_add_set(m: Column, key: Column, values: Column) -> Column:
    return map_replace(m, key, F.array_sort(F.array_union(F.coalesce(F.try_element_at(m, key), F.slice(values, F.lit(1), F.lit(0))), values)))


def multimap_remove(m: Column, key: Column, value: Column) -> Column:
    """A multimap without a value of a key, and without the key if it was the last."""
    return F.map_filter(F.transform_values(m, lambda k, v: F.when(k == key, F.array_remove(v, value)).otherwise(v)), lambda _, v: F.size(v) > 0)


def multimap_split(m: Column, key: Column) -> Column:
    """struct<below, at, above>: the entries under, of, and over a key."""
    part = lambda f: F.map_filter(m, lambda k, _: f(k))
    return F.struct(part(lambda k: k < key).alias("below"), F.try_element_at(m, key).alias("at"), part(lambda k: k > key).alias("above"))


def multimap_min(m: Column) -> Column:
    """struct<key, value>: the smallest value of the smallest key."""
    return F.transform(F.slice(bindings(m), F.lit(1), F.lit(1)), lambda e: F.struct(e["key"].alias("key"), F.array_min(e["value"]).alias("value")))[0]


def multimap_max(m: Column) -> Column:
    return F.transform(F.slice(F.reverse(bindings(m)), F.lit(1), F.lit(1)), lambda e: F.struct(e["key"].alias("key"), F.array_max(e["value"]).alias("value")))[0]


def by_length(s: Column) -> Column:
    """A key that orders strings by length, then by bytes."""
    return F.struct(F.length(s), s)
