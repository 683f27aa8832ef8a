"""Buckets of equal windows over a corpus, refined only where they are not yet decided.

Shared by the substring (bytes) and the n-gram (words) dedup. A window is ``length``
consecutive symbols of one document. Work goes in three steps:

1. Every window belongs to the q-gram of least hash inside it (its anchor), and equal
   windows have equal anchors at equal distance. Neighbouring windows of one anchor
   form a range. Each range goes to the bucket of its anchor's q-gram: about one
   posting for 35 bytes. A q-gram bucket of one posting is decided: its windows
   stand nowhere else.
2. Inside a bucket, postings are sorted by the identifier of the whole range, then by
   place. Ranges equal to an earlier one are decided: all their windows repeat.
3. Only the first ranges of buckets that hold several different ranges stay open. For
   bytes their text goes to the bucket, where ``suffixes`` refines all its suffixes by
   bucket pointers. Windows of words, and of q-grams that too many ranges hold, are
   bucketed one by one by their own identifiers.

Postings travel as packed arrays, one per task and bucket, and equal ranges of a task
travel once, so that a passage which a third of the corpus shares costs each bucket one
posting a task. Of a q-gram that a task finds in very many different ranges a few are
posted, which is enough to leave all of them open. No step pairs up the members of a
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASES, STEP, U, byte_ids, grams, joined, mixed, sliding_min, slices, small, word_hashes, words
from .common import small_batches, written
from .suffixes import bucket_pointers

#: Postings packed at once, which with STEP bounds a task's memory.
PACK = 1 << 19
#: Bytes of text whose postings share a bucket of the exchange; buckets at least, and
#: partitions at most, each of which takes its buckets one after the other.
BUCKET_BYTES, LEAST_BUCKETS, MOST_PARTS = 8 << 20, 16, 1 << 16
#: Bytes of open text, or of postings of open windows, that share a bucket.
OPEN_BYTES = 2 << 20
#: Ranges that hold one q-gram from which their windows are bucketed one by one.
HOT = 5_000
#: Ranges are cut so that a mark fits: start << 10 | length << 2 | hot << 1 | open.
WIDE = 200


@dataclass(frozen=True)
class Shape:
    """What repeats: ``length`` symbols; buckets start from ``q`` of them.

    ``within``: an earlier window of the same document counts as well.
    """

    length: int
    q: int
    by_word: bool
    within: bool

    def ids(self, sym: np.ndarray, n: int, have: np.ndarray | None = None, h: int = 0, base: np.uint64 = BASES[0]) -> np.ndarray:
        """Identifiers of ``n`` symbols from each position on: Rabin-Karp for words, by
        doubling (from those of ``h``) for bytes."""
        return mixed(grams(sym, n, base)) if self.by_word else byte_ids(sym, n, have, h, base)


def symbols(shape: Shape, texts: list[bytes]):
    """(symbols of all texts, first symbol of each text, end of each text)."""
    if not shape.by_word:
        raw, begin = joined(texts)
        return raw, begin[:-1], begin[1:] - 1
    out, counts = [], []
    for lo, hi in slices(np.array([len(t) for t in texts], np.int64), STEP):
        raw, begin = joined(texts[lo:hi])
        first, last = words(raw)
        hashes = [word_hashes(raw[a:b], first[i:j] - a, last[i:j] - a) for i, j, a, b in _runs(first, last)]
        out.append(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        counts.append(np.diff(np.searchsorted(first, begin)))
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    end = np.cumsum(count)
    return np.concatenate([np.zeros(0, np.uint64), *out]), end - count, end


def _runs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Words i to j and the bytes a to b that hold them, about STEP bytes at a time."""
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + STEP)))
        yield i, j, int(first[i]), int(last[j - 1])
        i = j


def ranges(shape: Shape, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """(bucket, range identifier, text number, first window, number of windows) arrays."""
    k, n = shape.length, len(sym)
    wide = min(k - shape.q + 1, WIDE)
    for lo in range(0, n, STEP):
        part = sym[lo : lo + STEP + k - 1]
        if len(part) < k:
            break
        at = np.arange(lo, lo + len(part) - k + 1)
        owner = np.searchsorted(start, at, "right") - 1
        # empty texts share their start with the next: the last of them owns it
        ok = at + k <= end[owner]
        at, owner = at[ok], owner[ok]
        if not len(at):
            continue
        q = shape.ids(part, shape.q)
        whole = shape.ids(part, k, q, shape.q)
        least = sliding_min((q & ~U(0xFFFFFFFF)) | np.arange(len(q), dtype=np.uint64), k - shape.q + 1)
        anchor = (least & U(0xFFFFFFFF)).astype(np.int64)[at - lo]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        a = np.flatnonzero(new)
        size = np.diff(np.append(a, len(at)))
        assert size.max() <= wide
        first = at[a]
        shift = (anchor[a] - (first - lo)).astype(np.uint64)
        ident = mixed(mixed(whole[first - lo] + shift * BASES[1]) + whole[first - lo + size - 1] * U(3) + size.astype(np.uint64))
        yield q[anchor[a]], ident, owner[a], first - start[owner[a]], size


# Packed arrays: columns by byte planes, which the shuffle's compression likes.
_KINDS = {"group": (np.int64, 8), "key": (np.uint64, 6), "more": (np.uint64, 6), "doc": (np.int64, 8), "at": (np.int64, 5), "size": (np.uint8, 1), "hot": (np.uint8, 1), "wide": (np.int64, 6)}


def packed(cols: dict[str, np.ndarray]) -> bytes:
    out = []
    for name, values in cols.items():
        kind, width = _KINDS[name]
        b = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
        out.append(np.ascontiguousarray(b[:, :width].T).tobytes())
    return b"".join(out)


def unpacked(blobs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    got: dict[str, list] = {n: [] for n in names}
    row = sum(_KINDS[n][1] for n in names)
    for blob in blobs:
        n, at = len(blob) // row, 0
        for name in names:
            kind, width = _KINDS[name]
            planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
            full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
            full[:, :width] = planes.T
            got[name].append(full.view(kind)[:, 0])
            at += n * width
    return {n: np.concatenate(v) if v else np.zeros(0, _KINDS[n][0]) for n, v in got.items()}


def _by_bucket(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by their bucket, the buckets that occur, and where each begins."""
    order = np.argsort(to, kind="stable")
    used, begin = np.unique(to[order], return_index=True)
    return order, used, np.append(begin, len(to))


def _dealt(cols: dict[str, np.ndarray], buckets: int, name: str = "postings", to: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket: its number and its packed postings."""
    order, used, cut = _by_bucket((cols["key"] % U(buckets)).astype(np.int64) if to is None else to)
    cols = {n: v[order] for n, v in cols.items()}
    blobs = [packed({n: v[a:z] for n, v in cols.items()}) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    return pa.record_batch([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", name])


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of one bucket in one partition; partitions grow in number with the buckets."""
    now = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(now, min(buckets, MOST_PARTS)), "bucket")


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], list[bool]]:
    ids = batch.column("rep_id")
    ok = ids.is_valid().to_numpy(zero_copy_only=False)
    values = batch.column("rep_text").cast(pa.large_binary()).to_pylist()
    return ids.fill_null(0).to_numpy(), [v or b"" for v in values], ok


def _first_of(order_by: tuple[np.ndarray, ...], *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and where in it a new group of equal ``same`` begins."""
    order = np.lexsort((*reversed(order_by), *reversed(same)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([s[order][1:] != s[order][:-1] for s in same], axis=0)
    return order, new


def _repeats(shape: Shape, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows, sorted by group and place, repeat an earlier one of their group."""
    if shape.within:
        return ~new
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def _own(at: np.ndarray, size: np.ndarray, open_: bool, hot: np.ndarray | bool = False) -> np.ndarray:
    return at << 10 | size.astype(np.int64) << 2 | np.asarray(hot, np.int64) << 1 | int(open_)


def _marks(doc: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(mark, pa.int64())], names=["rep_id", "mark"])


def _range_postings(shape: Shape, buckets: int, few: int):
    """(bucket, postings, known): the ranges of a task. Equal ones travel once, the others
    of them are known to repeat. ``few``: different ranges of one q-gram that a flush
    posts; where it finds more, all of them are open and hot, and the posted ones say so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            key, more, doc, at, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, more = key & U((1 << 48) - 1), more & U((1 << 48) - 1)
            order, new = _first_of((doc, at), key, more)
            key, more, doc, at, size = (x[order] for x in (key, more, doc, at, size))
            again = _repeats(shape, new, doc)
            # ranges are in order of key and identifier: count the different ones of a key
            head = np.append(True, key[1:] != key[:-1])
            different = np.cumsum(new)
            nth = different - different[np.flatnonzero(head)][np.cumsum(head) - 1]
            hot = np.maximum.reduceat(nth, np.flatnonzero(head))[np.cumsum(head) - 1] >= few
            left = ~again & (nth >= few)
            stay = np.sort(order[~again & ~left])
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            s = back[stay]
            yield _with_nulls(_dealt({"key": key[s], "more": more[s], "doc": doc[s], "at": at[s], "size": size[s], "hot": hot[s]}, buckets))
            if again.any() or left.any():
                marks = np.concatenate([_own(at[again], size[again], False), _own(at[left], size[left], True, True)])
                yield _with_nulls(_packed_marks(np.concatenate([doc[again], doc[left]]), marks, buckets))

        for batch in small(batches, "rep_text"):
            ids, texts, ok = _texts(batch)
            for lo, hi in slices(np.array([len(t) if o else 0 for t, o in zip(texts, ok, strict=True)], np.int64), STEP):
                part = [t if o else b"" for t, o in zip(texts[lo:hi], ok[lo:hi], strict=True)]
                for key, more, owner, at, size in ranges(shape, *symbols(shape, part)):
                    held.append((key, more, ids[lo:hi][owner], at, size))
                    if sum(len(x[0]) for x in held) >= PACK:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _packed_marks(doc: np.ndarray, mark: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marks that need no bucket: they pass through the exchange as they are."""
    return _dealt({"doc": doc, "wide": mark}, buckets, "known", (mixed(doc.astype(np.uint64)) % U(buckets)).astype(np.int64))


def _with_nulls(batch: pa.RecordBatch, names: tuple[str, ...] = ("postings", "known")) -> pa.RecordBatch:
    cols = {n: pa.nulls(batch.num_rows, pa.binary()) for n in names} | {n: batch.column(n) for n in batch.schema.names}
    return pa.record_batch([cols[n] for n in ("bucket", *names)], names=["bucket", *names])


def _blobs(table: pa.Table, name: str) -> list[bytes]:
    return [x for x in table.column(name).to_pylist() if x is not None]


def _known(table: pa.Table) -> pa.RecordBatch:
    c = unpacked(_blobs(table, "known"), ("doc", "wide"))
    return _marks(c["doc"], c["wide"])


def _refine_ranges(shape: Shape):
    """One bucket of the exchange -> (rep_id, mark): repeated ranges and open ones."""

    def run(table: pa.Table) -> pa.Table:
        c = unpacked(_blobs(table, "postings"), ("key", "more", "doc", "at", "size", "hot"))
        if not len(c["key"]):
            return pa.Table.from_batches([_known(table)])
        order, new = _first_of((c["doc"], c["at"]), c["key"], c["more"])
        key, doc, at, size, hot = (c[n][order] for n in ("key", "doc", "at", "size", "hot"))
        again = _repeats(shape, new, doc)
        head = np.append(True, key[1:] != key[:-1])
        begin, bucket = np.flatnonzero(head), np.cumsum(head) - 1
        different = np.bincount(bucket, new)[bucket]
        told = np.maximum.reduceat(hot, begin)[bucket] > 0
        several = (different > 1) | told
        if not shape.within:
            several &= told | (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[bucket]
        open_ = several & ~again
        return pa.Table.from_batches([
            _known(table),
            _marks(doc[again], _own(at[again], size[again], False)),
            _marks(doc[open_], _own(at[open_], size[open_], True, (told | (different > HOT))[open_])),
        ])

    return run


_OPEN = ("postings", "known", "places", "pieces")


def _open_postings(shape: Shape, buckets: int):
    """What is still open of each text: the text of its ranges, by the q-gram that bounds
    their bucket, or their windows, by their own identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts_of: list[tuple] = []

        def flush():
            key, tail, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, new = _first_of((doc, at), key, tail)
            key, tail, doc, at = (x[order] for x in (key, tail, doc, at))
            again = _repeats(shape, new, doc)
            s = ~again
            place = np.lexsort((at[s], doc[s]))
            low, high = key[s][place] & U((1 << 48) - 1), key[s][place] >> U(48)
            yield _with_nulls(_dealt({"key": low, "more": high | tail[s][place].astype(np.uint64) << U(16), "doc": doc[s][place], "at": at[s][place]}, buckets), _OPEN)
            if again.any():
                yield _with_nulls(_packed_marks(doc[again], _own(at[again], np.ones(again.sum(), np.int64), False), buckets), _OPEN)

        def flush_texts():
            doc, at, size = (np.concatenate([t[i] for t in texts_of]) for i in range(3))
            pieces = [p for t in texts_of for p in t[3]]
            texts_of.clear()
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            begin = np.cumsum(size + shape.length - 1) - (size + shape.length - 1)
            q = shape.ids(raw, shape.q)
            # the anchor of a range is that of its first window
            inside = begin[:, None] + np.arange(shape.length - shape.q + 1)
            key = q[begin + np.argmin(q[inside] >> U(32), 1)]
            order, used, cut = _by_bucket((key % U(buckets)).astype(np.int64))
            runs = list(zip(cut[:-1], cut[1:], strict=True))
            places = [packed({"doc": doc[order[a:z]], "at": at[order[a:z]], "size": size[order[a:z]]}) for a, z in runs]
            joined_ = [b"".join([pieces[i] for i in order[a:z].tolist()]) for a, z in runs]
            cols = [pa.array(used, pa.int64()), pa.array(places, pa.binary()), pa.array(joined_, pa.binary())]
            yield _with_nulls(pa.record_batch(cols, names=["bucket", "places", "pieces"]), _OPEN)

        weight = 0
        for batch in small(batches, "rep_text"):
            ids = batch.column("rep_id").to_numpy(zero_copy_only=False)
            texts = batch.column("rep_text").cast(pa.large_binary())
            for i, marks in enumerate(batch.column("rep_marks")):
                marks = marks.values.to_numpy()
                marks = np.sort(marks[marks & 1 == 1])
                text = texts[i].as_py() or b""
                alone = np.ones(len(marks), bool) if shape.by_word else marks & 2 == 2
                if alone.any():
                    sym, start, _ = symbols(shape, [text])
                    for lo, at in _places(marks[alone], sym, shape):
                        part = sym[lo : int(at[-1]) + shape.length]
                        whole = [shape.ids(part, shape.length, base=b) for b in BASES]
                        if not len(whole[0]):
                            continue
                        at = at[at - lo < len(whole[0])]
                        held.append((whole[0][at - lo], (whole[1][at - lo] >> U(40)).astype(np.uint64) & U(0xFFFF), np.full(len(at), ids[i]), at))
                    if sum(len(x[0]) for x in held) >= PACK:
                        yield from flush()
                if not alone.all():
                    m = marks[~alone]
                    at, size = m >> 10, (m >> 2) & 0xFF
                    fits = at + size + shape.length - 1 <= len(text)
                    at, size = at[fits], size[fits]
                    to = at + size + shape.length - 1
                    texts_of.append((np.full(len(at), ids[i]), at, size, [text[a:z] for a, z in zip(at.tolist(), to.tolist(), strict=True)]))
                    weight += int((to - at).sum())
                    if weight >= STEP:
                        yield from flush_texts()
                        weight = 0
        if held:
            yield from flush()
        if weight:
            yield from flush_texts()

    return run


def _places(marks: np.ndarray, sym: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray]]:
    """The windows of the open ranges, in runs that lie close together."""
    at, size = marks >> 10, (marks >> 2) & 0xFF
    every = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    # marks of rows that share an id may lie beyond this text
    every = np.unique(every[every + shape.length <= len(sym)])
    cut = np.flatnonzero(np.diff(every) > 4 * shape.length) + 1
    for run in np.split(every, cut):
        for i in range(0, len(run), STEP):
            part = run[i : i + STEP]
            if len(part):
                yield int(part[0]), part


def _runs_of(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Marks of repeated windows, neighbouring ones as ranges."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    new |= (np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))) % WIDE == 0
    begin = np.flatnonzero(new)
    return _marks(doc[begin], _own(at[begin], np.diff(np.append(begin, len(doc))), False))


def _refine_open(shape: Shape):
    """One bucket of the exchange -> (rep_id, mark) of the repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        c = unpacked(_blobs(table, "postings"), ("key", "more", "doc", "at"))
        order, new = _first_of((c["doc"], c["at"]), c["key"], c["more"])
        doc, at = c["doc"][order], c["at"][order]
        again = _repeats(shape, new, doc)
        out = [_known(table), _runs_of(doc[again], at[again])]
        p = unpacked(_blobs(table, "places"), ("doc", "at", "size"))
        if len(p["doc"]):
            raw, size = np.frombuffer(b"".join(_blobs(table, "pieces")), np.uint8), p["size"].astype(np.int64)
            long = size + shape.length - 1
            end = np.cumsum(long)
            pointer = bucket_pointers(raw, np.repeat(end, long), shape.length)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            mine = pointer[np.repeat(end - long, size) + step]
            shared = np.flatnonzero(np.bincount(mine, minlength=len(raw))[mine] > 1)
            row = np.repeat(np.arange(len(size)), size)[shared]
            doc, at, mine = p["doc"][row], p["at"][row] + step[shared], mine[shared]
            order, new = _first_of((doc, at), mine)
            again = order[_repeats(shape, new, doc[order])]
            out.append(_runs_of(doc[again], at[again]))
        return pa.Table.from_batches(out)

    return run


def repeated_windows(docs: DataFrame, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs`` as rep_id, rep_text and the marks of its repeated windows,
    rep_marks and rep_more, to be read with ``covered``. Rows with a null id repeat nothing.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("rep_id"), F.col(text_col).alias("rep_text"))
    total = int(base.agg(F.sum(F.octet_length("rep_text"))).first()[0] or 0)
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    few = max(4, HOT // (1 + total // (PACK * 35)))
    out = "rep_id long, mark long"
    posted = base.mapInArrow(_range_postings(shape, buckets, few), "bucket long, postings binary, known binary")
    marks = dealt(posted, buckets).groupBy("bucket").applyInArrow(_refine_ranges(shape), out)
    marks = written(marks.groupBy("rep_id").agg(F.collect_list("mark").alias("rep_marks")))
    opened = F.filter("rep_marks", lambda m: m.bitwiseAND(1) == 1)
    per = F.lit(25 if shape.by_word else shape.length + 40)
    weight = marks.agg(F.sum(F.size(opened).cast("long") * per)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(weight) // OPEN_BYTES)
    # one exchange of the texts serves both joins: neither adds a test for null ids
    known = marks.filter("rep_id is not null").withColumnRenamed("rep_id", "mark_id")
    named = base.filter("rep_id is not null")
    some = named.join(known.filter(F.size(opened) > 0), F.col("rep_id") == F.col("mark_id"))
    posted = some.select("rep_id", "rep_text", "rep_marks").mapInArrow(_open_postings(shape, buckets), "bucket long, " + ", ".join(f"{n} binary" for n in _OPEN))
    more = dealt(posted, buckets).groupBy("bucket").applyInArrow(_refine_open(shape), out)
    more = more.groupBy("rep_id").agg(F.collect_list("mark").alias("rep_more")).withColumnRenamed("rep_id", "more_id")
    held = named.join(known, F.col("rep_id") == F.col("mark_id"), "left").drop("mark_id")
    held = held.join(more, F.col("rep_id") == F.col("more_id"), "left").drop("more_id")
    return held.unionByName(base.filter("rep_id is null"), allowMissingColumns=True)


def covered(shape: Shape, n: int, *marks) -> np.ndarray | None:
    """Which of a text's ``n`` symbols a repeated window covers; None for none."""
    got = [np.asarray(m, np.int64) for m in marks if m is not None and len(m)]
    every = np.concatenate([np.zeros(0, np.int64), *got])
    every = every[every & 1 == 0]
    if not len(every):
        return None
    at, size = every >> 10, (every >> 2) & 0xFF
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(at, n), 1)
    np.add.at(step, np.minimum(at + size - 1 + shape.length, n), -1)
    return np.cumsum(step[:n]) > 0
