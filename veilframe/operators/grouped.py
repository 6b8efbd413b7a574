"""Work that needs a group's rows one after the other, streamed from sorted partitions; work on images one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def in_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[dict]], Iterable[tuple]], added: str, arrays: bool = False) -> DataFrame:
    """The rows that fn makes of each group's rows, with the group's keys before them. added: DDL of fn's columns.

    One shuffle by the keys; a partition's groups come sorted by keys and order, and fn gets an iterator over the rows as
    dicts, so that only what fn itself keeps of a group is in memory. Groups of null keys are groups like others.
    arrays: fn gets arrays of numbers as numpy arrays, not lists.
    """
    kinds = T._parse_datatype_string(added)
    schema = T.StructType([df.schema[k] for k in keys] + kinds.fields)
    arrow = to_arrow_schema(schema)
    most = 64 if any(isinstance(f.dataType, T.ArrayType) for f in kinds) else 4096  # images' pixels are handed over a few at a time

    def run(batches):
        out: list = []
        for key, group in groupby(rows_of(batches, arrays), _key(keys)):
            out += [key + tuple(x) for x in fn(group)]
            if len(out) >= most:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def many_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], tuple], added: str) -> DataFrame:
    """What fn makes of groups, with the groups' keys before it, for work that numpy can do on many groups at once.

    fn gets the rows of whole groups, sorted as in in_groups(), with the number of each group's first row, and returns the numbers of the rows
    whose keys its rows have, and added's columns. A batch of Arrow's is in memory at a time, and as much more as its last group has.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(added).fields)
    arrow = to_arrow_schema(schema)

    def made(t, starts):
        rows, columns = fn(t, starts)
        values = [t.column(k).take(pa.array(rows)) for k in keys] + list(columns)
        values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
        return pa.RecordBatch.from_arrays([(v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def run(batches):
        held: list = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ends = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            held.append(b)
            if ends == last:
                continue
            last = ends
            t = pa.Table.from_batches(held).combine_chunks()
            starts = _first_rows(t, keys)
            if len(starts) > 1:
                yield made(t.slice(0, int(starts[-1])), starts[:-1])
            held = t.slice(int(starts[-1])).to_batches()
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _first_rows(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each group's first row in sorted rows."""
    first = np.ones(t.num_rows, bool)
    first[1:] = False
    for k in keys:
        code = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(first)


def each_image(df: DataFrame, keys: list[str], fn: Callable[[dict], Iterable[tuple]], added: str) -> DataFrame:
    """The rows that fn makes of each row of df, with the row's keys before them. Rows stay where they are: nothing is shuffled.

    fn gets a row as a dict; arrays of numbers (an image's pixels) are numpy arrays, not lists. Images are handed over a few
    at a time, whatever the number of rows in Arrow's batches.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(added).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            out: list = []
            for r in rows_of([b], arrays=True):
                key = tuple(r[k] for k in keys)
                out += [key + tuple(x) for x in fn(r)]
                if len(out) >= 64:
                    yield _batch(out, arrow)
                    out = []
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _key(keys: list[str]) -> Callable[[dict], tuple]:
    return itemgetter(*keys) if len(keys) > 1 else lambda r: (r[keys[0]],)


def rows_of(batches: Iterable[pa.RecordBatch], arrays: bool = False, most: int = 8192) -> Iterator[dict]:
    """Rows of Arrow batches as dicts of Python values (arrays: those of numbers as numpy arrays), converted a column at a time, and about
    a megabyte of the batch at once."""
    for b in batches:
        names = b.schema.names
        step = max(1, min(most, b.num_rows * 1_000_000 // max(1, b.nbytes)))
        for start in range(0, b.num_rows, step):
            part = b.slice(start, step)
            for values in zip(*[_values(c, arrays) for c in part.columns], strict=True):
                yield dict(zip(names, values))  # noqa: B905


def _values(c: pa.Array, arrays: bool) -> Iterable:
    kind = c.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        if not c.null_count:
            return c.to_numpy(zero_copy_only=False).tolist()
        own = c.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
        return [v if there else None for v, there in zip(own, c.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return c.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind) and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)) and not c.flatten().null_count:
        return _lists(c, arrays)
    return c.to_pylist()


def _lists(c: pa.ListArray, arrays: bool) -> Iterator:
    """A list column's values one after the other, cut out of the flat array."""
    ends = np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat, start = c.flatten().to_numpy(zero_copy_only=False), 0
    for end, there in zip(ends.tolist(), c.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True):
        own = flat[start:end]
        start = end
        yield (own if arrays else own.tolist()) if there else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
