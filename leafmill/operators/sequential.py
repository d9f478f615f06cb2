"""Rules that need each key's rows one after another, with a small state between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Arrow's types of the columns that rules return.
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

Step = Callable[..., Iterable[tuple]]
End = Callable[[], Iterable[tuple]]


def nothing_more() -> Iterable[tuple]:
    """The end of a rule that has returned all of its rows already."""
    return ()


def carried(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], tuple[Step, End]], types: dict[str, str]) -> DataFrame:
    """The keys with the rows that a rule returns for each row of its key, in order, and at the key's end.

    ``begin`` gives the two functions of a new key: one of a row's other columns,
    and one for the end.  A key's rows are sorted by Spark and streamed through
    one task in batches: only the state of one key at a time is held, so a hot key
    takes time but no memory.  Rows equal in ``order`` follow their other columns.
    Null keys are one key; an empty table gives an empty result.
    """
    width = len(keys)
    rest = [c for c in order if c not in keys]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *rest, *(c for c in rows.columns if c not in {*keys, *rest}))
    columns = [*keys, *(c for c in rows.columns if c not in keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, end, schema = None, None, nothing_more, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            parts = zip(*out, strict=True) if out else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in range(width)), *((n, _TYPES[t]) for n, t in types.items())])
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or row[:width] != key:
                    out.extend((*key, *x) for x in end())
                    key, (step, end) = row[:width], begin()
                out.extend((*key, *x) for x in step(*row[width:]))
            yield batch_of(out)
        if schema:
            yield batch_of([(*key, *x) for x in end()])

    told = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items()))
    returned = StructType([*(rows.schema[k] for k in keys), *told])
    return dealt.select(*columns).mapInArrow(run, returned)
