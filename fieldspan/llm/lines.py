"""Line dedup in DataFrame functions only, over content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines ends a chunk wherever it
is 0 modulo ``spread``; a line put in or left out moves the boundaries near it only.
``dedup_lines`` takes out whole chunks; ``dedup_runs`` grows repeats over their ends too
and so takes out every repeated passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Mean lines of a chunk, and the lines and characters from which a chunk may go.
SPREAD, LEAST_LINES, LEAST_CHARS = 3, 2, 80


def chunked(docs: DataFrame, text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """``docs`` plus ``ld_chunks``: the text's chunks, whose join by newline is the text."""
    # one expression with each array bound once: the optimiser would otherwise put the
    # split into the lambdas and run it again for every line
    ends = f"""concat(filter(sequence(0, size(h) - 1), i -> i < size(h) - 1 and
        pmod(xxhash64(h[greatest(i - 1, 0)], h[i]), {spread}) = 0), array(size(h) - 1))"""
    cut = f"""transform(array(split(coalesce(`{text_col}`, ''), '\n')), s ->
        transform(array(transform(s, l -> xxhash64(l))), h ->
        transform(array({ends}), e ->
        transform(e, (x, i) -> transform(array(case when i = 0 then 0 else e[greatest(i - 1, 0)] + 1 end),
            a -> array_join(slice(s, a + 1, x - a + 1), '\n'))[0]))[0])[0])[0]"""
    return docs.withColumn("ld_chunks", F.expr(cut))


def _parts(docs: DataFrame) -> DataFrame:
    """(ld_id, ld_no, ld_text, ld_key) of the chunks that are long enough to go."""
    parts = docs.select("ld_id", F.posexplode("ld_chunks").alias("ld_no", "ld_text"))
    long = (F.length("ld_text") >= LEAST_CHARS) & (F.size(F.filter(F.split("ld_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) >= LEAST_LINES)
    return parts.filter(long).withColumn("ld_key", F.xxhash64("ld_text"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(ld_id, ld_gone): number and hash of each document's chunks that stand earlier.

    Earlier means a smaller id, or the same document further up. Chunks of fewer than
    ``LEAST_LINES`` lines or ``LEAST_CHARS`` characters stay. Counting goes by hash
    alone, 8 bytes a chunk and summed before the shuffle; only the texts of chunks
    whose hash repeats move, and are compared byte by byte with the first of their hash.
    """
    slim = docs.select(F.col(id_col).alias("ld_id"), text_col)
    found = _parts(chunked(slim, text_col, spread)).select("ld_id", "ld_no", "ld_key")
    keys = found.groupBy("ld_key").agg(F.count(F.lit(1)).alias("ld_n")).filter("ld_n > 1").select("ld_key")
    again = written(found.join(keys, "ld_key", "left_semi").groupBy("ld_id").agg(F.collect_set("ld_no").alias("ld_some")))
    base = docs.select(id_col, text_col)
    held = chunked(base.join(again, base[id_col] == again["ld_id"]), text_col, spread)
    parts = _parts(held.withColumn("ld_chunks", F.expr("transform(ld_chunks, (c, i) -> case when array_contains(ld_some, i) then c end)")))
    at = F.struct("ld_id", "ld_no")
    # by the texts themselves: chunks of one hash that differ are compared with their like
    model = written(parts.groupBy("ld_key", "ld_text").agg(F.min(at).alias("ld_first"), F.count(F.lit(1)).alias("ld_n")).filter("ld_n > 1"))
    gone = spread_join(parts, model, ["ld_key", "ld_text"], "ld_n", F.col("ld_id")).filter(at > F.col("ld_first"))
    return gone.groupBy("ld_id").agg(F.collect_list(F.struct("ld_no", "ld_key")).alias("ld_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of ``text_col``, plus
    ``ld_lines_removed``.

    Rows with a null id are compared as if their id came before all others and are
    left as they are; null and empty texts stay; a text that is wholly repeated
    becomes empty but its row stays; rows that share an id share their removals.
    Two different chunks with one hash are told apart by their bytes. Input columns that
    start with ``ld_`` are dropped.
    """
    cols = [c for c in docs.columns if not c.startswith("ld_")]
    docs = docs.select(*cols)
    gone = repeated_chunks(docs, id_col, text_col, spread)
    df = docs.join(gone, docs[id_col] == gone["ld_id"], "left").drop("ld_id")
    df = chunked(df, text_col, spread)
    kept = "array_join(filter(ld_chunks, (c, i) -> not array_contains(ld_gone, struct(i as ld_no, xxhash64(c) as ld_key))), '\n')"
    lost = "aggregate(filter(ld_chunks, (c, i) -> array_contains(ld_gone, struct(i as ld_no, xxhash64(c) as ld_key))), 0L, (a, c) -> a + size(split(c, '\n')))"
    df = df.withColumn(text_col, F.when(F.col("ld_gone").isNull(), F.col(text_col)).otherwise(F.expr(kept)))
    df = df.withColumn("ld_lines_removed", F.coalesce(F.expr(lost), F.lit(0)).cast("long"))
    return df.select(*cols, "ld_lines_removed")


#: Lines a passage may need to reach ``LEAST_CHARS``: each has a character and a newline.
WIDEST = LEAST_CHARS // 2 + 1
_WORDY = r"[^\\x20\\x09-\\x0D]"
#: The lines of a text that are not blank.
_LINES = "filter(split(coalesce(`{text}`, ''), '\n'), x -> x rlike '" + _WORDY + "')"
#: A passage is one long: its first line times 2^32 plus its number of lines.
_START, _SIZE = "cast(shiftright({w}, 32) as int)", "cast({w} & 4294967295 as int)"


def _slice(array: str, w: str) -> str:
    """The part of ``array`` that the passage ``w`` covers."""
    return f"slice({array}, {_START.format(w=w)} + 1, {_SIZE.format(w=w)})"


def _passages(docs: DataFrame, text_col: str, spread: int) -> DataFrame:
    """(ld_id, ld_whole, ld_w, ld_key, ld_in): chunks and grown lines of each text.

    Chunks (``ld_whole``) end at a line where the rolling hash of it and the line above is
    0 modulo ``spread``. Chunks are cut once more at every line, and each line grows line by
    line, forwards and backwards over chunk ends, into the fewest lines that may go; what
    stops it follows from its lines alone, so that equal passages have equal parts and the
    parts of a passage cover it. ``ld_in`` is the chunk that holds a grown line wholly.
    Passages under ``LEAST_LINES`` or ``LEAST_CHARS`` are not given; blank lines do not count.
    """
    done = f"a.k >= {LEAST_LINES} and a.t >= {LEAST_CHARS}"
    reach = f"""aggregate(part, named_struct('t', -1, 'k', 0), (a, x) -> case when {done} then a
        else named_struct('t', a.t + 1 + x, 'k', a.k + 1) end, a -> case when {done} then a.k end)"""
    ahead = reach.replace("part", f"slice(l, i + 1, {WIDEST})")
    back = reach.replace("part", f"reverse(slice(l, greatest(i - {WIDEST - 1}, 0) + 1, least(i + 1, {WIDEST})))")
    ends = f"""concat(filter(sequence(0, size(h) - 1), i -> i < size(h) - 1 and
        pmod(xxhash64(h[greatest(i - 1, 0)], h[i]), {spread}) = 0), array(size(h) - 1))"""
    at = "(cast({i} as bigint) * 4294967296 + {k})"
    own = at.format(i="x", k="(y - x + 1)")
    whole = f"""case when y - x + 1 >= {LEAST_LINES} and aggregate(slice(l, x + 1, y - x + 1), y - x, (t, n) -> t + n) >= {LEAST_CHARS}
        then array(named_struct('whole', true, 'w', {own}, 'in', {own})) else array() end"""
    # a passage that both its first and its last line grow into is given by the first
    grown = f"""concat(
        transform(filter(sequence(x, y), i -> f[i] is not null), i ->
            named_struct('whole', false, 'w', {at.format(i="i", k="f[i]")}, 'in', case when i + f[i] - 1 <= y then {own} end)),
        transform(filter(sequence(x, y), i -> b[i] is not null and not (f[i - b[i] + 1] <=> b[i])), i ->
            named_struct('whole', false, 'w', {at.format(i="(i - b[i] + 1)", k="b[i]")}, 'in', case when i - b[i] + 1 >= x then {own} end)))"""
    find = f"""transform(array({_LINES.format(text=text_col)}), s -> case when size(s) >= {LEAST_LINES} then
        transform(array(transform(s, x -> xxhash64(x))), h -> transform(array(transform(s, x -> length(x))), l ->
        transform(array(transform(sequence(0, size(l) - 1), i -> {ahead})), f -> transform(array(transform(sequence(0, size(l) - 1), i -> {back})), b ->
        transform(array({ends}), e -> transform(
            flatten(transform(e, (y, q) -> transform(array(case when q = 0 then 0 else e[greatest(q - 1, 0)] + 1 end), x -> concat({whole}, {grown}))[0])),
            c -> named_struct('ld_whole', c.whole, 'ld_w', c.w, 'ld_key', xxhash64({_slice("h", "c.w")}), 'ld_in', c.in)))[0])[0])[0])[0])[0] end)[0]"""
    return docs.select("ld_id", F.expr(find).alias("ld_all")).select("ld_id", F.inline("ld_all"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(ld_id, ld_gone): the passages of each document's lines that stand earlier.

    Earlier means under a smaller id, or further up in the same document without an
    overlap. Chunks are counted first. Of a chunk whose hash stands earlier the grown lines
    inside are left out, as they go with it; those of its first place and those over chunk
    ends are counted in turn. Counting goes by hash, 8 bytes a passage and summed before
    the shuffle; the texts of what repeats are compared byte by byte.
    """
    slim = docs.select(F.col(id_col).alias("ld_id"), text_col)
    found = written(_passages(slim, text_col, spread))
    place = F.struct("ld_id", "ld_w")

    def again(rows: DataFrame) -> DataFrame:
        model = written(rows.groupBy("ld_key").agg(F.min(place).alias("ld_first"), F.count(F.lit(1)).alias("ld_n")).filter("ld_n > 1"))
        return spread_join(rows, model, ["ld_key"], "ld_n", place)

    chunks = written(again(found.filter("ld_whole")).select("ld_id", "ld_w", "ld_key", (place > F.col("ld_first")).alias("ld_later")))
    later = chunks.filter("ld_later").select(F.col("ld_id").alias("ld_of"), F.col("ld_w").alias("ld_chunk")).distinct()
    grown = found.filter("not ld_whole").join(later, F.col("ld_id").eqNullSafe(F.col("ld_of")) & (F.col("ld_in") == F.col("ld_chunk")), "left_anti")
    some = chunks.select("ld_id", "ld_w", "ld_key").union(again(written(grown.select("ld_id", "ld_w", "ld_key"))).select("ld_id", "ld_w", "ld_key"))
    some = written(some.groupBy("ld_id").agg(F.collect_set(F.struct("ld_w", "ld_key")).alias("ld_some")))
    base = docs.select(id_col, text_col)
    # null ids come before all others and must be compared too
    held = base.join(some, base[id_col].eqNullSafe(some["ld_id"]))
    cut = f"""transform(array({_LINES.format(text=text_col)}), s ->
        transform(array(transform(s, x -> xxhash64(x))), h -> transform(filter(ld_some, c -> c.ld_key = xxhash64({_slice("h", "c.ld_w")})), c ->
        named_struct('ld_w', c.ld_w, 'ld_key', c.ld_key, 'ld_text', array_join({_slice("s", "c.ld_w")}, '\n'))))[0])[0]"""
    parts = written(held.select("ld_id", F.expr(cut).alias("ld_all")).select("ld_id", F.inline("ld_all")))
    like = ["ld_key", "ld_text"]
    model = written(parts.groupBy(*like).agg(F.min(place).alias("ld_first"), F.count(F.lit(1)).alias("ld_n")).filter("ld_n > 1"))
    below = f"{_START.format(w='ld_w')} >= {_START.format(w='ld_first.ld_w')} + {_SIZE.format(w='ld_w')}"
    apart = f"ld_id > ld_first.ld_id or (ld_first.ld_id is null and ld_id is not null) or (ld_id = ld_first.ld_id and {below})"
    gone = spread_join(parts, model, like, "ld_n", place).filter(apart)
    return gone.groupBy("ld_id").agg(F.collect_set(F.struct("ld_w", "ld_key")).alias("ld_gone"))


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """``docs`` without repeated passages in ``text_col``, plus ``ld_lines_removed``.

    A line goes if it lies in neighbouring lines, at least ``LEAST_LINES`` and
    ``LEAST_CHARS`` characters with newlines, that stand earlier as neighbours, at any
    ``spread``: content-defined chunks that repeat, and lines grown over their ends. Blank
    lines neither count nor part neighbours; they go with the line above, those at the
    head with the first line. Ids, nulls and columns are dealt with as in ``dedup_lines``.
    """
    cols = [c for c in docs.columns if not c.startswith("ld_")]
    docs = docs.select(*cols)
    gone = repeated_passages(docs, id_col, text_col, spread)
    df = docs.join(gone, docs[id_col] == gone["ld_id"], "left").drop("ld_id")
    # p: where the lines that are not blank stand; line u takes the blank ones below along
    head, tail = "case when u = 0 then 0 else p[u] end", "case when u = size(p) - 1 then size(s) else p[u + 1] end"
    out = f"""case when ld_gone is not null then transform(array(split(`{text_col}`, '\n')), s ->
        transform(array(filter(sequence(0, size(s) - 1), i -> s[i] rlike '{_WORDY}')), p ->
        transform(array(transform(p, i -> xxhash64(s[i]))), h ->
        transform(array(array_except(case when size(p) = 0 then array() else sequence(0, size(p) - 1) end, flatten(transform(
            filter(ld_gone, c -> c.ld_key = xxhash64({_slice("h", "c.ld_w")})),
            c -> sequence({_START.format(w="c.ld_w")}, {_START.format(w="c.ld_w")} + {_SIZE.format(w="c.ld_w")} - 1))))), k ->
        case when size(k) < size(p) then named_struct('text', array_join(transform(k, u -> array_join(slice(s, {head} + 1, {tail} - {head}), '\n')), '\n'),
            'lost', size(s) - aggregate(k, 0, (a, u) -> a + {tail} - {head})) end)[0])[0])[0])[0] end"""
    df = df.withColumn("ld_out", F.expr(out))
    df = df.withColumn(text_col, F.when(F.col("ld_out").isNull(), F.col(text_col)).otherwise(F.col("ld_out.text")))
    return df.select(*cols, F.coalesce("ld_out.lost", F.lit(0)).cast("long").alias("ld_lines_removed"))
