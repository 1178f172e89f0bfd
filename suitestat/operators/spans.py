"""Nesting of call spans by one sorted sweep with a stack."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def nest(calls: DataFrame, *keys: str, wanted: str | None = None) -> DataFrame:
    """SYM-14: calls with parent_id and host_id, and ancestors for rows in which the column wanted is true.

    calls: keys (a method), call_id, start, stop (numbers, such as line * 10000 + column)
    and any others.  parent_id: the innermost call whose span strictly contains the row's
    (of equal spans the least call_id), null at the top.  host_id: the innermost one that
    starts elsewhere, so that the row stands in its arguments.  ancestors, the outer ones
    first: call_id, in_arguments (the row stands in its arguments, not in its receiver)
    and near (it is the parent).

    Rows are sorted by start, and by stop from the largest, within a method; a task keeps
    the open spans only, so work is linear in calls that nest, and memory is their depth.
    Spans that cross (none in real code) are looked through for the smallest that
    contains.  Null spans have no parent and contain nothing.
    """
    import pyarrow as pa

    schema = StructType(calls.schema.fields)
    kind = calls.schema["call_id"].dataType
    schema = schema.add("parent_id", kind).add("host_id", kind)
    if wanted:
        schema = schema.add("ancestors", StructType.fromDDL(f"x array<struct<call_id:{kind.simpleString()},in_arguments:boolean,near:boolean>>")["x"].dataType)
    places = [calls.columns.index(c) for c in (*keys, "call_id", "start", "stop")]
    n_keys, flag = len(keys), calls.columns.index(wanted) if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now: tuple | None = None
        stack: list[tuple] = []  # (start, stop, id, parent, host), the outer ones first
        crossed = False
        for batch in batches:
            columns = [batch.column(p).to_pylist() for p in places]
            flags = batch.column(flag).to_pylist() if wanted else None
            parents, hosts, lists = [], [], []
            for i, (*key, call, start, stop) in enumerate(zip(*columns, strict=True)):
                if (key := tuple(key)) != now:
                    now, stack, crossed = key, [], False
                if start is None or stop is None:
                    parents.append(None)
                    hosts.append(None)
                    lists.append([])
                    continue
                while stack and stack[-1][1] < start:
                    stack.pop()
                if not stack:
                    crossed = False
                top = stack[-1] if stack else None
                crossed = crossed or top is not None and top[1] < stop
                if crossed:
                    stack = [s for s in stack if s[1] >= start]
                    around = sorted((s for s in stack if s[1] >= stop and s[:2] != (start, stop)), key=lambda s: (s[0] - s[1], s[2]))
                    parent = min(around, key=lambda s: (s[1] - s[0], s[2]))[2] if around else None
                    host = next((s[2] for s in reversed(around) if s[0] != start), None)
                elif top is None:
                    parent = host = None
                elif top[:2] == (start, stop):  # an equal span: the same place
                    parent, host = top[3], top[4]
                else:
                    parent, host = top[2], top[2] if top[0] != start else top[4]
                parents.append(parent)
                hosts.append(host)
                if wanted and flags[i]:
                    if not crossed:
                        around = [s for s in stack if s[:2] != (start, stop)]
                    inner = [*around[1:], (start,)]
                    lists.append([{"call_id": s[2], "in_arguments": s[0] != c[0], "near": k + 1 == len(around)} for k, (s, c) in enumerate(zip(around, inner, strict=False))])
                else:
                    lists.append([])
                if not stack or stack[-1][:2] != (start, stop):
                    stack.append((start, stop, call, parent, host))
            new = [pa.array(parents, arrow.field("parent_id").type), pa.array(hosts, arrow.field("host_id").type)]
            if wanted:
                new.append(pa.array(lists, arrow.field("ancestors").type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=arrow.names)

    ordered = calls.repartition(*keys) if keys else calls.coalesce(1)
    return ordered.sortWithinPartitions(*keys, "start", F.desc("stop"), "call_id").mapInArrow(run, schema)
