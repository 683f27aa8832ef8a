"""N-gram Jaccard join by a token-group matrix, exact, as connected components.

Texts with one shingle set form a class. A class can link with another only if most of
its shingles stand in other classes too: one count of (a hash range of) all shingles
ends the search for nearly all texts. The rest is partitioned into groups of similar
classes, first by a min-hash and then by the links found inside, so that a family of
near copies becomes one group. The token-group matrix then holds (shingle, group)
pairs: a class opens only groups in which enough of its rarest shingles occur, and is
compared there with the members, block by block, unless a link has joined them before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASES, STEP, U, grams, joined, mixed, slices, small, word_hashes, words
from .common import small_batches, spread_join, written
from .repeats import BUCKET_BYTES, LEAST_BUCKETS, PACK, _blobs, _dealt, _packed_marks, _texts, _with_nulls, dealt, unpacked

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows of a part of a min-hash group and of a block that is opened at once.
PART, BLOCK = 512, 256
#: Share of all hashes that a class counts, by its number of shingles, at 85 percent; it
#: grows with the share that may be missing. Above 200 the shingles left out keep what it
#: counts more than 6 deviations over what may be missing.
SHARES = ((200, 1.0), (1000, 0.375), (float("inf"), 0.25))
KEY = U((1 << 48) - 1)
#: Classes whose links and labels share a file.
NODES = 50_000
#: Of the two min-hashes.
SALTS = (0x5BF03635, 0x2545F491)


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, sorted by both."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in slices(np.array([len(t) for t in texts], np.int64), STEP):
        raw, begin = joined(texts[lo:hi])
        raw = _LOWER[raw]
        start, end = words(raw)
        h, i = np.zeros(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + STEP)))
            a = int(start[i])
            h[i:j] = word_hashes(raw[a : int(end[j - 1])], start[i:j] - a, end[i:j] - a)
            i = j
        first = np.searchsorted(start, begin)
        count = np.diff(first)
        g = mixed(grams(h, n, BASES[0]))
        owner = np.repeat(np.arange(hi - lo), np.maximum(count - n + 1, 0))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0)) + first[:-1][owner]
        short = np.flatnonzero((count > 0) & (count < n))
        whole = [mixed(grams(h[first[t] : first[t + 1]], int(count[t]), BASES[1]) + U(count[t]))[0] for t in short]
        owner, value = np.concatenate([owner, short]), np.concatenate([g[at], np.array(whole, np.uint64)])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owners.append(owner[new] + lo)
        hashes.append(value[new])
    return np.concatenate(owners), np.concatenate(hashes)


def _limit(n: np.ndarray, shares) -> np.ndarray:
    """Below which key a class of ``n`` shingles counts them."""
    at = np.searchsorted(np.array([m for m, _ in shares], np.float64), n)
    return np.array([int(s * (1 << 48)) for _, s in shares], np.uint64)[at]


def _keys(n: np.ndarray, owner: np.ndarray, h: np.ndarray, percent: int, shares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, keys, counted) of the shingles that take part.

    A class counts shingles by its own size, but shows all that a smaller partner may
    count: one of ``percent`` of its size.
    """
    key = mixed(h) & KEY
    shown = np.flatnonzero(key < _limit(-(-n * percent // 100), shares)[owner])
    return shown, key[shown], (key[shown] < _limit(n, shares)[owner[shown]]).astype(np.uint8)


def _sums(n_texts: int, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Size and two 64-bit digests of each text's set."""
    begin = np.searchsorted(owner, np.arange(n_texts + 1))
    out = [np.diff(begin)]
    for salt in BASES:
        prefix = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h ^ salt), out=prefix[1:])
        out.append(mixed(prefix[begin[1:]] - prefix[begin[:-1]] + out[0].astype(np.uint64)).view(np.int64))
    return tuple(out)


def _sets_of(batch: pa.RecordBatch, n: int):
    ids, texts, ok = _texts(batch)
    texts = [t if o else b"" for t, o in zip(texts, ok, strict=True)]
    owner, h = shingles(texts, n)
    return ids, len(texts), owner, h, *_sums(len(texts), owner, h)


def _slim(n: int, percent: int, shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "rep_text"):
            _, texts, ok = _texts(batch)
            owner, h = shingles(texts, n)
            size, one, two = _sums(len(texts), owner, h)
            shown, _, counted = _keys(size, owner, h, percent, shares)
            counted = np.bincount(owner[shown], counted, len(texts)).astype(np.int64)
            cols = [batch.column("rep_id"), pa.array(size), pa.array(counted), pa.array(one), pa.array(two)]
            yield pa.record_batch(cols, names=["rep_id", "n", "counted", "one", "two"])

    return run


def _class_postings(n: int, buckets: int, percent: int, shares):
    """(bucket, postings, known): who shows which shingle, and per class how many of the
    shingles it counts are known to be shared and not posted.

    A shingle that three classes or more of a task hold is shared whatever other tasks
    hold: two of the classes are posted for it and the others know. So a bucket gets at
    most two postings a flush of a shingle that a third of the corpus holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            key, own, counted = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((own, key))
            key, own, counted = key[order], own[order], counted[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            key, own, counted = key[new], own[new], counted[new]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            knows = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key)))) > 1
            who, at = np.unique(own, return_inverse=True)
            known = np.bincount(at, counted * knows, len(who)).astype(np.int64)
            yield _with_nulls(_dealt({"key": key[~knows], "doc": own[~knows], "size": counted[~knows]}, buckets))
            yield _with_nulls(_packed_marks(who, known, buckets))

        for batch in small(batches, "rep_text"):
            _, _, owner, h, size, one, _ = _sets_of(batch, n)
            shown, key, counted = _keys(size, owner, h, percent, shares)
            held.append((key, one[owner[shown]], counted))
            if sum(len(x[0]) for x in held) >= PACK:
                yield from flush()
        if held:
            yield from flush()

    return run


def _shared_counts(table: pa.Table) -> pa.Table:
    """Per class: how many of the shingles it counts here another class shows as well, and
    how many more are known. A text's shingles are posted or known within one flush, so
    the least number known in any flush of the class's copies bounds those not posted.
    """
    least = unpacked(_blobs(table, "known"), ("doc", "wide"))
    sure, at = np.unique(least["doc"], return_inverse=True)
    known = np.full(len(sure), np.iinfo(np.int64).max)
    np.minimum.at(known, at, least["wide"])
    c = unpacked(_blobs(table, "postings"), ("key", "doc", "size"))
    order = np.lexsort((c["doc"], c["key"]))
    key, own, counted = c["key"][order], c["doc"][order], c["size"][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own, counted = key[new], own[new], counted[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    token = np.cumsum(head) - 1
    several = np.bincount(token)[token] > 1 if len(key) else head
    who, count = np.unique(own[several & (counted > 0)], return_counts=True)
    return pa.table({
        "one": pa.array(np.concatenate([who, sure]), pa.int64()),
        "shared": pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(sure), pa.int64())]),
        "known": pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(known, pa.int64())]),
    })


def _set_rows(n: int):
    """(x, n, key, key2, set): the whole sorted set and two min-hashes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "rep_text"):
            ids, count, owner, h, size, _, _ = _sets_of(batch, n)
            begin = np.searchsorted(owner, np.arange(count + 1))
            keys = [np.minimum.reduceat(mixed(h ^ U(salt)), begin[:-1]).view(np.int64) if len(h) else np.zeros(count, np.int64) for salt in SALTS]
            sets = [h[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.record_batch([pa.array(ids), pa.array(size), *map(pa.array, keys), pa.array(sets, pa.binary())], names=["x", "n", "key", "key2", "set"])

    return run


def links(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, ask: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different groups, at least one of each pair in ``ask``.

    The links join the same groups as all such links would: a pair that earlier ones
    have joined is not compared. Rows central to the others come first.
    """
    size = np.array([len(s) for s in sets], np.int64)
    token, local = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    often = np.bincount(local)
    central = np.add.reduceat(often[local], begin) / size
    _, label = np.unique(group, return_inverse=True)
    out, flag = [], np.zeros(len(token), bool)
    for i in np.lexsort((ids, -central)):
        if not ask[i]:
            continue
        other = label != label[i]
        if not other.any():
            continue
        mine = local[begin[i] : begin[i] + size[i]]
        flag[mine] = True
        common = np.add.reduceat(flag[local].astype(np.int64), begin)
        flag[mine] = False
        hit = other & (100 * common >= percent * (size + size[i] - common))
        for j in np.flatnonzero(hit):
            if label[j] != label[i]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return out


def _edge_table(pairs: list[tuple[int, int]]) -> pa.Table:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(a[:, 0]), "v": pa.array(a[:, 1])})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]


def _within(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, group = table.column("x").to_numpy(), table.column("c").to_numpy()
        if len(np.unique(group)) < 2:
            return _edge_table([])
        return _edge_table(links(ids, _sets(table), group, np.ones(len(ids), bool), percent))

    return run


def _across(percent: int):
    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        if not members.num_rows or not asking.num_rows:
            return _edge_table([])
        ids, group = (np.concatenate([t.column(c).to_numpy() for t in (members, asking)]) for c in ("x", "c"))
        ask = np.arange(len(ids)) >= members.num_rows
        return _edge_table(links(ids, _sets(members) + _sets(asking), group, ask, percent))

    return run


def components(nodes: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(x, c): for each x of ``nodes`` the least node that ``edges`` (u, v) reach from it.

    Each pass hooks every component to its least neighbour, follows the hooks eight
    steps by doubling, and renames; passes end when no edge joins two components.
    ``parts``: files that the tables of nodes go to.
    """
    comps = nodes.select("x", F.col("x").alias("c"))
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), parts)
    while True:
        cu, cv = comps.toDF("u", "cu"), comps.toDF("v", "cv")
        live = edges.join(cu, "u").join(cv, "v").filter("cu <> cv").select(F.greatest("cu", "cv").alias("hi"), F.least("cu", "cv").alias("lo"))
        hook = written(live.groupBy("hi").agg(F.min("lo").alias("lo")), parts)
        if hook.isEmpty():
            return comps
        for _ in range(3):
            on = hook.toDF("lo", "next")
            hook = hook.join(on, "lo", "left").select("hi", F.coalesce("next", "lo").alias("lo"))
        comps = written(comps.join(hook.withColumnRenamed("hi", "c"), "c", "left").select("x", F.coalesce("lo", "c").alias("c")), parts)


def _parted(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` plus ``part``: the rows of one ``key`` in parts of about ``most``, without
    keys of one row. The rows of a hot key are spread before they meet their count."""
    count = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    rows = spread_join(rows, count, ["key"], "many", F.col("x"), least_rows=most)
    return rows.withColumn("part", F.pmod(F.xxhash64("x"), F.ceil(F.col("many") / most))).drop("many")


def _tokens(buckets: int, percent: int, shares):
    """(shingle, class, group) postings of the token-group matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "set"):
            sets, size = _sets(pa.table(batch)), batch.column("n").to_numpy()
            owner, h = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
            shown, key, counted = _keys(size, owner, h, percent, shares)
            x, c = batch.column("x").to_numpy()[owner[shown]], batch.column("c").to_numpy()[owner[shown]]
            yield _dealt({"key": key, "doc": x, "group": c, "size": counted}, buckets)

    return run


def _matrix(table: pa.Table) -> pa.Table:
    """Shingles of several groups: (x, t, groups) where x counts t, and (null, t, c)."""
    c = unpacked(_blobs(table, "postings"), ("key", "doc", "group", "size"))
    order = np.lexsort((c["group"], c["key"]))
    key, x, group, counted = (c[n][order] for n in ("key", "doc", "group", "size"))
    head, new = np.ones(len(key), bool), np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    new[1:] = head[1:] | (group[1:] != group[:-1])
    token = np.cumsum(head) - 1
    groups = np.bincount(token, new)[token].astype(np.int64) if len(key) else np.zeros(0, np.int64)
    entry = (groups > 1) & new
    some = (groups > 1) & (counted > 0)
    t = key.astype(np.int64)
    return pa.table({
        "x": pa.concat_arrays([pa.array(x[some], pa.int64()), pa.nulls(int(entry.sum()), pa.int64())]),
        "t": pa.array(np.concatenate([t[some], t[entry]])),
        "g": pa.array(np.concatenate([groups[some], group[entry]])),
    })


def near_groups(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row for each row of ``docs``.

    Two rows link if 100 * |A & B| >= percent * |A | B| over their sets of distinct
    ``n``-word shingles of the text with A-Z lower-cased; a text of fewer words has the
    whole as its one shingle. ``component_id`` is the least id that links reach. Null,
    empty and blank texts have no shingles and link with nothing; rows with a null id
    take no part and have a null component. Rows with shingles that share an id are one
    node, whatever their texts. No link between different texts is lost; shingles are
    equal if their 64-bit hashes are.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("rep_id"), F.col(text_col).alias("rep_text"))
    # of n shingles at most `spare` may be missing from a partner
    spare = F.expr(f"n - cast(ceil(n * {percent} / 100.0) as bigint)")
    shares = tuple((most, min(1.0, share * (100 - percent) / 15)) for most, share in SHARES)
    kinds = "rep_id long, n long, counted long, one long, two long"
    slim = written(base.mapInArrow(_slim(n, percent, shares), kinds))
    if not slim.filter((F.col("n") > 0) & (F.col("counted") <= spare)).isEmpty():
        # a text whose counted shingles might all be missing from a partner: count all
        shares = ((float("inf"), 1.0),)
        slim = written(base.mapInArrow(_slim(n, percent, shares), kinds))
    by_id = slim.filter("n > 0 and rep_id is not null").groupBy("rep_id").agg(F.min("one").alias("one"), F.max("one").alias("other"))
    if not by_id.filter("one <> other").isEmpty():
        return _by_text(base, n, percent).toDF(id_col, "n_shingles", "component_id")
    total = base.agg(F.sum(F.octet_length("rep_text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total) // BUCKET_BYTES)
    classes = slim.filter("n > 0 and rep_id is not null").groupBy("one", "two", "n").agg(F.min("rep_id").alias("x"), F.first("counted").alias("counted"), F.count(F.lit(1)).alias("copies"))
    postings = base.filter("rep_id is not null").mapInArrow(_class_postings(n, buckets, percent, shares), "bucket long, postings binary, known binary")
    shared = dealt(postings, buckets).groupBy("bucket").applyInArrow(_shared_counts, "one long, shared long, known long")
    shared = shared.groupBy("one").agg((F.coalesce(F.sum("shared"), F.lit(0)) + F.min("known")).alias("shared"))
    live = classes.join(shared, "one", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("counted") - spare)
    live = written(live.select(F.col("x").alias("rep_id"), "counted", spare.alias("spare")))
    parts = -(-live.count() // NODES) or 1
    edges = [live.select(F.col("rep_id").alias("u"), F.col("rep_id").alias("v")).limit(0)]
    sets = base.join(live.select("rep_id"), "rep_id", "left_semi").mapInArrow(_set_rows(n), "x long, n long, key long, key2 long, set binary")
    sets = written(sets.dropDuplicates(["x"]))
    # groups: parts of the classes with one min-hash, then their central classes by either
    # of two min-hashes, which also joins the parts of a hot one
    kind = "u long, v long"
    edges.append(written(_parted(sets.drop("key2").withColumn("c", F.col("x")), PART).groupBy("key", "part").applyInArrow(_within(percent), kind).repartition(parts)))
    comps = components(sets, edges[-1], parts)
    degree = edges[-1].groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("degree"))
    ranked = comps.join(degree, "x", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = ranked.groupBy("c").agg(F.max_by("x", F.struct("degree", -F.col("x"))).alias("x"))
    hubs = written(hubs, parts)
    for key in ("key", "key2"):
        heads = sets.select("x", "n", F.col(key).alias("key"), "set").join(hubs, "x")
        edges.append(written(_parted(heads, PART).groupBy("key", "part").applyInArrow(_within(percent), kind).repartition(parts)))
    comps = components(sets, reduce(DataFrame.union, edges), parts)
    # the matrix. A class has `own` shingles that no other group holds: no partner in
    # another group has them, so it is done if these are more than may be missing
    grouped = sets.drop("key", "key2").join(comps, "x")
    matrix = dealt(grouped.mapInArrow(_tokens(buckets, percent, shares), "bucket long, postings binary"), buckets).groupBy("bucket").applyInArrow(_matrix, "x long, t long, g long")
    matrix = written(matrix)
    found = matrix.filter("x is not null").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("g", "t"))).alias("found"))
    able = found.join(live.withColumnRenamed("rep_id", "x"), "x").withColumn("own", F.col("counted") - F.size("found")).filter("own <= spare")
    able = written(able.join(sets.select("x", "n"), "x").join(comps, "x"))
    # targets: small groups of one min-hash share a bundle, large ones have their own
    sized = able.groupBy("c").agg(F.count(F.lit(1)).alias("members"))
    sized = sized.join(sets.select(F.col("x").alias("c"), "key"), "c")
    sized = sized.join(sized.groupBy("key").agg(F.sum("members").alias("total")), "key")
    part = F.pmod(F.xxhash64("c"), F.ceil(F.col("total") / BLOCK))
    bundle = F.when(F.col("members") > BLOCK // 4, F.xxhash64("c")).otherwise(F.xxhash64("key", part))
    sized = written(sized.select("c", "members", bundle.alias("to")), parts)
    able = able.join(sized, "c")
    targets = able.groupBy("to").agg(
        F.min("own").alias("least_own"), F.max(F.col("n") - F.col("own")).alias("most_free"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.max(F.struct("members", "c")).alias("largest"), F.count(F.lit(1)).alias("held"),
    )
    targets = written(targets, parts)
    # of spare + 1 - own of its rarest shared shingles a partner's group holds one
    rare = F.slice("found", F.lit(1), (F.col("spare") + 1 - F.col("own")).cast("int"))["t"]
    probes = able.select("x", "c", "n", "own", "members", F.size(rare).alias("asked"), F.explode(rare).alias("t_"))
    entries = matrix.filter("x is null").select("t", F.col("g").alias("c")).join(sized.select("c", "to"), "c").select("t", "to").distinct().join(targets, "to")
    # of two groups, the members of the smaller one ask; sizes and own shingles of both
    # bound what x and any member can share: at most n - own, of at least n + least_own
    may = [
        F.struct("members", "c") < F.col("largest"),
        100 * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least_own")),
        100 * F.col("most_free") >= percent * (F.col("n") + F.col("least_own")),
        100 * F.col("most_n") >= percent * F.col("n"),
        100 * F.col("n") >= percent * F.col("least_n"),
    ]
    asks = probes.join(entries, (F.col("t_") == F.col("t")) & reduce(lambda a, b: a & b, may))
    # the hits are counted: x shares with a group's union no more than what is left of its
    # shingles without its own and without those asked for that the group does not hold
    allowed = F.floor((100 * (F.col("n") - F.col("own")) - percent * F.col("n")) / percent)
    asks = asks.groupBy("x", "c", "to").agg(F.count(F.lit(1)).alias("hits"), *[F.first(c).alias(c) for c in ("held", "n", "own", "asked", "least_n")])
    overlap = F.col("n") - F.col("own") - F.col("asked") + F.col("hits")
    asks = asks.filter((100 + percent) * overlap >= percent * (F.col("n") + F.col("least_n")))
    asks = written(asks.select("x", "c", "to", "held", allowed.alias("allowed")))
    many = asks.groupBy("to").agg(F.count(F.lit(1)).alias("asking"), F.first("held").alias("held"), F.max("allowed").alias("allowed"))
    many = many.select("to", "allowed", F.ceil(F.col("held") / BLOCK).alias("blocks"), F.ceil(F.col("asking") / BLOCK).alias("chunks"))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    place = lambda name: F.pmod(F.xxhash64("x"), F.col(name))
    members = able.select("x", "c", "own", "to").join(many, "to").filter(F.col("own") <= F.col("allowed"))
    members = members.join(sets.select("x", "set"), "x").withColumn("block", place("blocks")).withColumn("chunk", each("chunks"))
    asking = asks.select("x", "c", "to").join(sets.select("x", "set"), "x").join(many, "to").withColumn("chunk", place("chunks")).withColumn("block", each("blocks"))
    cols = ["to", "block", "chunk", "x", "c", "set"]
    left, right = members.select(*cols), asking.select(*cols).toDF("to_", "block_", "chunk_", "x", "c", "set")
    opened = left.groupBy("to", "block", "chunk").cogroup(right.groupBy("to_", "block_", "chunk_")).applyInArrow(_across(percent), kind)
    edges.append(written(opened.repartition(parts)))
    comps = components(sets, reduce(DataFrame.union, edges), parts)
    # classes that no other can link with keep their own least id
    of = written(classes.join(comps, "x", "left").select("one", "two", "n", "copies", F.coalesce("c", "x").alias("least")))
    # rows without shingles or id have no class and are not joined at all
    has = F.col("rep_id").isNotNull() & (F.col("n") > 0)
    out = spread_join(slim.filter(has), of, ["one", "two", "n"], "copies", F.col("rep_id"), "left").select("rep_id", "n", "least")
    out = out.unionByName(slim.filter(~has).select("rep_id", "n", F.lit(None).cast("long").alias("least")))
    component = F.when(F.col("rep_id").isNotNull(), F.coalesce("least", "rep_id"))
    return out.select(F.col("rep_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _by_text(base: DataFrame, n: int, percent: int) -> DataFrame:
    """``near_groups`` where an id has several texts: each is a node, ids join them."""
    one, has = F.count(F.lit(1)).alias("many"), F.col("n_shingles") > 0
    rows = base.withColumn("node", F.when(F.col("rep_id").isNotNull(), F.xxhash64("rep_id", "rep_text")))
    found = written(near_groups(rows, n, percent, "node", "rep_text").toDF("node", "n_shingles", "c"))
    ids = written(rows.filter("node is not null").groupBy("node").agg(F.min("rep_id").alias("rep_id"), one))
    # repeated rows are alike in every column, so any deal of them will do
    own = spread_join(found.filter("node is not null"), ids, ["node"], "many", F.monotonically_increasing_id())
    own = written(own.select("rep_id", "n_shingles", "node", "c"))
    of = written(own.filter(has).select("rep_id", "c").distinct())
    parts = -(-of.count() // NODES) or 1
    lead = written(of.groupBy("rep_id").agg(F.min("c").alias("v"), one))
    edges = spread_join(of, lead, ["rep_id"], "many", F.col("c")).select(F.col("c").alias("u"), "v")
    nodes = written(of.groupBy(F.col("c").alias("x")).agg(F.min("rep_id").alias("low")), parts)
    comps = components(nodes, edges, parts).join(nodes, "x")
    least = written(comps.groupBy("c").agg(F.min("low").alias("least"), one), parts)
    named = spread_join(comps, least, ["c"], "many", F.col("x")).select(F.col("x").alias("c"), "least")
    named = written(named.join(own.filter(has).groupBy("c").agg(one), "c"))
    out = spread_join(own.filter(has), named, ["c"], "many", F.col("node")).select("rep_id", "n_shingles", "least")
    out = out.union(own.filter(~has).select("rep_id", "n_shingles", "rep_id"))
    null = F.lit(None).cast("long")
    return out.union(found.filter("node is null").select(null, "n_shingles", null))
