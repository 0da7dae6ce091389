"""Folds over the ordered rows of each document, for walks that no window expresses.

Rows are dealt by document and sorted, and stream through Arrow batches of many documents: a document costs its rows, not
a call into pandas. Columns that a walk does not look at never become Python objects; rows of the result pick them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

#: A walk: the rows of one document, as tuples whose first member is its id, to rows of the result. Their last members are
#: places, one for each column of ``carry``: that of the row from which it is taken, or None.
Walk = Callable[[list[tuple]], Iterable[tuple]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only between documents. The first column is the document's id."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        if not held or held[-1].column(0)[-1].as_py() != ids[0].as_py():
            if held:
                yield pa.Table.from_batches(held)
            held = []
        last = ids[-1].as_py()
        if ids[0].as_py() != last:
            same = ids.is_null() if last is None else pc.equal(ids, last).fill_null(False)
            at = pc.index(same, True).as_py()
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def fold(rows: DataFrame, order: list[str], walk: Walk, ddl: str, look: list[str], carry: Iterable[str] = ()) -> DataFrame:
    """``walk`` over the rows of each doc_id in the order of ``order``; ``ddl`` names its columns, those of ``carry`` follow.

    ``look``: the columns that the walk sees, after doc_id. Rows without an id are a document.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = list(carry)
    made = _parse_datatype_string(ddl)
    assert isinstance(made, StructType)
    kinds, wide = to_arrow_schema(made), len(made)
    slim = ["doc_id", *look]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            seen = zip(*(table.column(c).to_pylist() for c in slim))
            out: list[tuple] = []
            at = 0
            picks: list[list[int | None]] = [[] for _ in carry]
            for _, group in groupby(seen, itemgetter(0)):
                own = list(group)
                for row in walk(own):
                    out.append(row[:wide])
                    for into, pick in zip(picks, row[wide:]):
                        into.append(None if pick is None else at + pick)
                at += len(own)
            cells = zip(*out) if out else [[] for _ in kinds]
            columns = [pa.array(c, f.type) for c, f in zip(cells, kinds)]
            columns += [table.column(c).combine_chunks().take(pa.array(where, pa.int64())) for c, where in zip(carry, picks)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, [*kinds.names, *carry])

    dealt = rows.select(*slim, *(c for c in carry if c not in slim))
    schema = StructType([*made.fields, *(dealt.schema[c] for c in carry)])
    schema = StructType([type(f)(f.name, f.dataType, True) for f in schema.fields])
    return dealt.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)
