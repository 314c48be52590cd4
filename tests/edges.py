"""Odd copies of the test tables: empty ones, rows that are all null, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASHING = ("key", "name", "record", "value", "n", "rank", "window", "at", "entity", "slice", "start", "end", "piece", "row_id", "label", "position", "field", "ids", "center", "node", "token", "view", "__rank", "__key0", "v", "day")


def write(to: Path, kind: str) -> str:
    to.mkdir(exist_ok=True)
    for p in Path(SOURCE).glob("*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "null":
            t = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema})
        elif kind == "repeated":
            t = pa.concat_tables([t, t])
        elif kind == "clashing":
            have = {c.lower() for c in t.column_names}
            for c in CLASHING:
                if c not in have:
                    t = t.append_column(c, pa.array(["x"] * t.num_rows))
        pq.write_table(t, to / p.name)
    return str(to)


def rows(df) -> list:
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))
