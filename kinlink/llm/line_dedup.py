"""Line dedup by winnowing over line hashes.

Lines are what stands between newlines; blank lines (white space alone) don't count and stay. A run is `window` lines or
more in a row, or one line of `long` words or more. A run that stands earlier too, by (doc_id, line number), is repeated,
and every line inside a repeated run goes. A single line under `long` words that recurs between other lines stays.

1. Winnowing: each window of lines selects one of them as its fingerprint: a long one before a short one, then the least
   hash, the rightmost of equals. Long lines select themselves. The choice depends on the window's lines alone, so each
   repeated run is guaranteed to share a fingerprint with its earlier copy. Only selected lines are stored, each with
   the hashes of the windows that selected it.
2. Positions of equal fingerprints are joined; those that stand in one place only fall away.
3. Around each joined position the match is extended to both sides, over every window that selected it, as far as
   the lines there agree with an earlier place; overlapping matches grow together to whole runs.
4. Lines of later runs go. Only documents that may lose a line are shuffled.

Lines are compared by 64-bit hashes. Defined cases: a null text has no lines, stays null and loses nothing; a null doc_id
comes first in order; rows that repeat a doc_id count as the same document; all columns stay, but for those named like
the two counts, in place of which the counts stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared, tokens

WINDOW, LONG = 2, 5
#: Stands in place of the window's offset for a long line on its own.
ALONE = -1

_newline = np.zeros(256, dtype=bool)
_newline[0x0A] = True
_PRINTS = "id long, row long, line long, print long, offsets array<int>, wholes array<long>"


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, numbers of words and bounds, by text, of the lines that aren't blank."""
    starts, ends = tokens.spans(data, offsets, _newline)
    first, _ = tokens.spans(data, offsets, tokens.SPACE_SEPARATED)
    n = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    starts, ends, n = starts[n > 0], ends[n > 0], n[n > 0]
    return starts, ends, n, np.searchsorted(starts, offsets)


def _selected(h: np.ndarray, long: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: the number of the line that it selects, the window's offset and its hash. Long lines on their
    own come with the offset ALONE."""
    n = max(0, len(h) - window + 1)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n else np.zeros(0, np.int64)
    best = inside.copy()
    for i in range(1, window):
        at = inside + i
        better = (long[at] & ~long[best]) | ((long[at] == long[best]) & (h[at] <= h[best]))
        best = np.where(better, at, best)
    alone = np.flatnonzero(long)
    line = np.concatenate([best, alone])
    offset = np.concatenate([best - inside, np.full(len(alone), ALONE)])
    return line, offset, np.concatenate([tokens.grams(h, window)[inside] if n else h[:0], tokens.mix(h[alone])])


def _prints(window: int, long: int):
    def run(batches):
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column("text"))
            ids, rows = batch.column("id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
            for a, b in tokens.slices(offsets, 4 << 20):
                at, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                starts, ends, n, bounds = _lines(raw, at)
                h = tokens.span_hashes(raw, starts, ends)
                doc = np.repeat(np.arange(a, b), np.diff(bounds))
                line, offset, whole = _selected(h, n >= long, doc, window)
                if not len(line):
                    continue
                order = np.lexsort((offset, line))
                line, offset, whole = line[order], offset[order], whole[order]
                head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                own, cuts = line[head], pa.array(np.append(head, len(line)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[own]]), pa.array(rows[doc[own]]), pa.array(own - bounds[:-1][doc[own] - a], pa.int64()), pa.array(h[own].view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(offset, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(whole.view(np.int64)))],
                    names=["id", "row", "line", "print", "offsets", "wholes"],
                )

    return run


def _without(place: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, gone = batch.column(place), batch.column(batch.num_columns - 1)
            data, offsets = tokens.text_buffer(texts)
            _, _, _, bounds = _lines(data, offsets)
            n_lines, out, n_removed = np.diff(bounds), [], []
            for i in range(len(texts)):
                lost = gone[i].as_py()
                n_removed.append(len(lost or ()))
                if not lost:
                    out.append(texts[i].as_py())
                    continue
                lost, number, kept = set(lost), 0, []
                for part in texts[i].as_py().split("\n"):
                    full = bool(part.strip(" \t\v\f\r"))
                    if not (full and number in lost):
                        kept.append(part)
                    number += full
                out.append("\n".join(kept))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    return run


def repeated_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(id, row, gone: sorted numbers of the lines that go) of docs (id, row, text)."""
    seen = shared.stored(docs.mapInArrow(shared.lean(_prints(window, long)), _PRINTS), "prints")
    places = seen.groupBy("print").agg(F.min(F.struct("id", "line")).alias("a"), F.max(F.struct("id", "line")).alias("b"), F.count(F.lit(1)).alias("n"))
    met = shared.stored(places.where("a <> b").select("print", "n"), "met")
    each = F.explode(F.arrays_zip("offsets", "wholes")).alias("w")
    near = shared.keyed_join(seen, met, "print").select("id", "row", "line", each)
    start = F.when(F.col("w.offsets") == ALONE, F.col("line")).otherwise(F.col("line") - F.col("w.offsets")).alias("start")
    near = shared.stored(near.select("id", "row", start, F.when(F.col("w.offsets") == ALONE, 1).otherwise(window).alias("size"), F.col("w.wholes").alias("whole")), "near")
    place = F.struct("id", "start")
    first = near.groupBy("whole").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count(F.lit(1)).alias("n"))
    first = shared.stored(first.where("f <> l").select("whole", "f", "n"), "firsts")
    later = shared.keyed_join(near, first, "whole").where(place > F.col("f"))
    runs = later.groupBy("id", "row").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    lines = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    return runs.select("id", "row", F.array_sort(F.array_distinct(lines)).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with later repeated runs cut from the text, and the numbers of lines and of removed ones."""
    docs = docs.drop(*counts)
    id_, text = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.col(text_col).cast("string")
    row = F.xxhash64(id_, F.coalesce(text, F.lit("")))
    # Rows that repeat as a whole lose the same lines.
    gone = repeated_lines(docs.select(id_.alias("id"), text.alias("text"), row.alias("row")), window, long).groupBy("row").agg(F.first("gone").alias("gone"))
    key, lost, maybe = shared.fresh([*docs.columns, *counts], "row", "gone", "maybe")
    gone = shared.stored(gone.select(F.col("row").alias(key), F.col("gone").alias(lost)), "gone")
    marked = shared.sieve(docs.withColumn(key, row), F.col(key), gone, key, maybe)
    cut = marked.where(F.col(maybe)).join(gone, key, "left").select(*docs.columns, lost)
    whole = marked.where(~F.col(maybe)).select(*docs.columns, F.lit(None).cast("array<long>").alias(lost))
    names = [*docs.columns, *counts]
    return cut.union(whole).mapInArrow(shared.lean(_without(docs.columns.index(text_col), names)), docs.schema.add(counts[0], "long").add(counts[1], "long"))
