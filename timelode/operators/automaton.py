"""Many keys found in texts in one pass.

The keys are one Aho-Corasick automaton, built once a task; a text costs its length
and what is found in it, whatever the number of keys. Keys are a bounded list of a
caller (``MOST_KEYS``) and go to the tasks with the code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_KEYS = 1_000_000


class Finder:
    """Places of keys in a list, found in texts as substrings."""

    def __init__(self, keys: Sequence[str]) -> None:
        import ahocorasick

        if len(keys) > MOST_KEYS:
            raise ValueError(f"{len(keys)} keys; at most {MOST_KEYS} go to a task")
        # an empty key is in every text; equal keys share their place in the automaton
        self._always, places = [], {}
        for i, key in enumerate(keys):
            places.setdefault(key, []).append(i) if key else self._always.append(i)
        self._find = None
        if places:
            self._find = ahocorasick.Automaton()
            for key, own in places.items():
                self._find.add_word(key, own)
            self._find.make_automaton()

    def found(self, text: str | None) -> list[int]:
        """Places of the keys in the text, each once, in order; none in a null."""
        if text is None:
            return []
        out = set(self._always)
        if self._find is not None:
            for _, own in self._find.iter(text):
                out.update(own)
        return sorted(out)


def find(rows: DataFrame, text: Column, keys: Sequence[str], name: str = "found") -> DataFrame:
    """rows with an array of the places of the keys that the text holds. Other columns
    pass as they are."""
    keys, own = list(keys), "text_to_search_"
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(keys)
        for batch in batches:
            found = pa.array([finder.found(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], name])

    return rows.withColumn(own, text).mapInArrow(run, schema)
