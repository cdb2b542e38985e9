"""N-gram Jaccard join by token-combination prefixes.

A text's set holds its distinct k-word shingles (A-Z lowered, words split on
ASCII white space); with fewer words, the whole sequence is one shingle; without
words the set is empty and links with nothing.  Two texts link when
100 * |intersection| >= percent * |union|; percent is 50 to 100.

Method.  Equal sets form a class first, by a 128-bit digest, and one
representative goes on; copies are never expanded into pairs.  Shingles that
recur often form the frequent class and come last in the global order (class,
hash).  A set of n shingles that needs an overlap of a takes a prefix of
n - a + 1, extended by 2 G.  Two linked sets then share at least 2 G + 1 shingles
within their extended prefixes, so G + 1 frequent ones or G + 1 others.  Dealing
the frequent ones into G groups by hash puts two in one group, so the pairs inside
the groups are indexed; the others are indexed alone.  This holds for any choice
of the frequent class, so that class may be bounded and approximate.

Each index key first offers pairs with its smallest member, the head (a star).
Sketches of two to four bits a shingle tell which members may link with the head
and which are near it, within twice the distance of a link; whole texts are compared
for the former.  Links give components, and only keys with several components stay open.
Distance is a metric, so in an open key a member that links with the head cannot
link with one that is not near it: linked members meet the near ones alone, once for
each head, however many keys they share, and the remaining members meet each other.
A single shingle that more than HOT remaining members share gives way to pairs of such
shingles, dealt into G groups as above; groups are cut into blocks before they meet.
Pairs are cut by size, by an exact lower bound of the symmetric difference (parity
bitmaps), among remaining members by the count of keys that a link needs, and by
sketches; whole texts decide.  Every link is thus either verified or inside one
component already.

Defined cases: a null text is empty; a null doc_id gets no links and a null
component; rows that repeat a doc_id are one node with the links of all their
texts; extra columns are not touched; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import components, largest, table
from gistmill.llm.kernel import Lookup, columns, mix, shingle_sets, strings

FREQUENT_COUNT = 24
FREQUENT_MOST = 1 << 20  # 8 MB sent to each executor
HOT = 32
BLOCK = 512
_SIG_WORDS = 8
_FLUSH = 3_000_000


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on the order of a set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
        b = mix(s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _groups(n: Column) -> Column:
    """groups_of as a column."""
    return F.when(n < 64, 1).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.floor(n / 32)))))


def groups_of(n: int) -> int:
    return 1 if n < 64 else 1 << ((n // 32).bit_length() - 1)


def group_counts(n: int, percent: int) -> set[int]:
    """G for a set of n shingles as the larger of a pair and as the smaller: G doubles
    at most once up to the largest partner."""
    return {groups_of(n), groups_of(100 * n // percent)}


def pairs_in_groups(shingles: np.ndarray, g: int) -> np.ndarray:
    """Keys of the pairs of shingles that a hash deals into one of g groups; lowest bit set."""
    where = (mix(shingles + np.uint64(7)) % np.uint64(g)).astype(np.int64)
    order = np.lexsort((shingles, where))
    shingles, where = shingles[order], where[order]
    out = [np.zeros(0, np.uint64)]
    for part in np.split(shingles, np.flatnonzero(np.diff(where)) + 1):
        i, j = np.triu_indices(len(part), 1)
        out.append(mix(mix(part[i]) * np.uint64(3) + part[j] + np.uint64(g)) | np.uint64(1))
    return np.concatenate(out)


def prefix_keys(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Index keys of a sorted set, and how many frequent shingles its extended prefix
    holds; `frequent` marks those of the set.  Single shingles have the lowest bit
    clear, pairs have it set."""
    n = len(s)
    if n * (100 - percent) < percent:
        return np.zeros(0, np.uint64), 0  # so few that only equal sets link
    p = n - -(-percent * n // 100) + 1
    gs = group_counts(n, percent)
    rare, often = s[~frequent], s[frequent]
    out = [rare[: p + 2 * max(gs)] & ~np.uint64(1)]
    for g in gs:
        out.append(pairs_in_groups(often[: max(0, p + 2 * g - len(rare))], g))
    return np.unique(np.concatenate(out)), len(often[: max(0, p + 2 * max(gs) - len(rare))])


def _hot_pairs(percent: int):
    """(rep, key) of the pairs of each set's hot shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n, hot = columns(batch, "rep", "n", "hot")
            reps, keys = [], []
            for i, r in enumerate(rep.to_pylist()):
                own = np.asarray(hot[i].values).view(np.uint64)
                keys += [np.unique(np.concatenate([pairs_in_groups(own, g) for g in group_counts(n[i].as_py(), percent)]))]
                reps += [np.full(len(keys[-1]), r, np.int64)]
            join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
            yield pa.RecordBatch.from_arrays([pa.array(join(reps, np.int64)), pa.array(join(keys, np.uint64).view(np.int64))], ["rep", "key"])

    return run


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether an odd number of shingles fall on i; the bits in which two
    sets differ are never more than the shingles in which they differ."""
    return (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)


def sketch(s: np.ndarray) -> bytes:
    """The set's size and its parity bitmap of two to four times as many bits."""
    bits = max(64 * _SIG_WORDS, 2 << max(0, len(s) - 1).bit_length())
    return len(s).to_bytes(8, "big") + np.packbits(parity(s, bits)).tobytes()


FAR, NEAR, MAY = 0, 1, 2


def nearness(one: bytes, two: bytes, percent: int) -> int:
    """What sketches allow: MAY link, NEAR (at most twice the distance of a link) or
    FAR, from sizes and the least difference.  A longer bitmap is folded to the
    other's length, which keeps the bound.  With t = percent / 100 a distance of
    D (1 - t) means |A ^ B| (2 - D (1 - t)) <= D (1 - t) (|A| + |B|)."""
    n, m = int.from_bytes(one[:8], "big"), int.from_bytes(two[:8], "big")
    x, y = np.frombuffer(one, np.uint8, offset=8), np.frombuffer(two, np.uint8, offset=8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = max(int(np.bitwise_count(x ^ y).sum()), abs(n - m))
    if differ * (100 + percent) <= (n + m) * (100 - percent) and 100 * min(n, m) >= percent * max(n, m):
        return MAY
    return NEAR if differ * percent <= (n + m) * (100 - percent) else FAR


def recurring(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that recur in `held`, ascending, and how often; `held` is emptied
    and sorted in place, so two copies of it are the most that is in memory."""
    x = np.concatenate(held)
    held.clear()
    x.sort()
    same = np.concatenate(([False], x[1:] == x[:-1], [False]))  # as the one before it
    first = np.flatnonzero(same[1:] & ~same[:-1])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return x[first], last - first + 1


def _sets_and_counts(k: int):
    """Rows of kind 0: doc_id, n, digest; of kind 1: a shingle that recurs within
    this task's distinct sets, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set = set()
        size = 0

        def row(kind, ids, n, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "doc_id", "n", "a", "b"])

        def flush():
            x, c = recurring(held)
            seen.clear()
            return row(1, pa.nulls(len(x), pa.int64()), c, x.view(np.int64), np.zeros(len(x), np.int64))

        for batch in batches:
            ids, text = columns(batch, "doc_id", "text")
            n, a, b = [], [], []
            for s in shingle_sets(strings(text), k):
                d = digest(s)
                n.append(len(s))
                a.append(d[0])
                b.append(d[1])
                if d not in seen:
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                    if size > _FLUSH:
                        yield flush()
                        size = 0
            yield row(0, ids, n, a, b)
        if held:
            yield flush()

    return run


def _keys(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Lookup(frequent.value)
        for batch in batches:
            ids, text = columns(batch, "doc_id", "text")
            a, b, sig, full, keys, n, often_in = [], [], [], [], [], [], []
            for s in shingle_sets(strings(text), k):
                d = digest(s)
                a.append(d[0])
                b.append(d[1])
                n.append(len(s))
                sig.append(np.packbits(parity(s, 64 * _SIG_WORDS)).tobytes())
                full.append(sketch(s))
                own, held = prefix_keys(s, often.find(s) >= 0, percent)
                keys.append(own.view(np.int64))
                often_in.append(held)
            cut = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(full, pa.binary()), pa.array(often_in, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))],
                ["rep", "n", "a", "b", "sig", "sketch", "often", "keys"],
            )

    return run


def links(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def _compare(read, judge):
    """Rows come sorted by (x, part, role): what x holds, then those to compare
    with it.  read: a column of payloads to one value each; judge: two values to a
    verdict, of which the largest over 0 is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, against = None, []
        for batch in batches:
            x, part, role, y = (c.to_numpy(zero_copy_only=False) for c in columns(batch, "x", "part", "role", "y"))
            a, b, v = [], [], []
            for i, value in enumerate(read(batch.column(batch.schema.get_field_index("payload")))):
                if at != (x[i], part[i]):
                    at, against = (x[i], part[i]), []
                if role[i] == 0:
                    against.append(value)
                elif verdict := max((int(judge(value, other)) for other in against), default=0):
                    a.append(x[i])
                    b.append(y[i])
                    v.append(verdict)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.int32())], ["x", "y", "v"])

    return run


def _judged(pairs: DataFrame, payload: DataFrame, read, judge, label: str) -> DataFrame:
    """(x, y, v): a verdict on each pair's payloads (y, payload), where it is over 0.  The
    payload of x goes once to each part of about 64 partners, that of y to each pair."""
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / 64).alias("parts"))
    dealt = pairs.join(parts, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"), "y")
    right = dealt.join(payload, "y").select("x", "part", F.lit(1).alias("role"), "y", "payload")
    heads = parts.select(F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"))
    left = heads.join(payload, "y").select(F.col("y").alias("x"), "part", F.lit(0).alias("role"), "y", "payload")
    rows = left.unionByName(right).repartition("x", "part").sortWithinPartitions("x", "part", "role")
    return table(rows.mapInArrow(_compare(read, judge), "x long, y long, v int"), label).groupBy("x", "y").agg(F.max("v").alias("v"))


def _linked(likely: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole texts link."""
    texts = docs.select(F.col("doc_id").alias("y"), F.col("text").alias("payload"))
    return _judged(likely.select("x", "y"), texts, lambda c: shingle_sets(strings(c), k), lambda s, t: links(s, t, percent), "links").select("x", "y")


def _facing(wide: DataFrame, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members that link with a head and those near it alone, once for each head,
    ready for _in_blocks with the head as the key; the head has met all of them."""
    sides = wide.where("rep <> head and (linked or near)").select(F.col("head").alias("key"), "rep", "component", "linked").distinct()
    sizes = sides.groupBy("key").agg(F.count_if("linked").alias("heads"), F.count_if(~F.col("linked")).alias("nears")).where("heads > 0 and nears > 0")
    sides = table(sides.join(sizes, "key").join(one, "rep"), "facing")
    p_side = sides.where("linked").select("key", "rep", "component", "set", F.col("heads").alias("here"), F.col("nears").alias("there"))
    q_side = sides.where("not linked").select("key", "rep", "component", "set", F.col("nears").alias("here"), F.col("heads").alias("there"))
    return p_side, q_side


def _in_blocks(p: DataFrame, q: DataFrame, may: Column) -> DataFrame:
    """p (alias p) joined with q (alias q) on their key, where `may` holds.  A key's
    rows are dealt into blocks of about BLOCK on each side, which meet pair by pair,
    so no task takes a whole large group.  p and q have the columns here and there:
    how many rows of the key this side and the other side hold."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("rep"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    left = p.withColumn("row", own("here")).withColumn("col", every("there"))
    right = q.withColumn("col", own("here")).withColumn("row", every("there"))
    return left.alias("p").join(right.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.row") == F.col("q.row")) & (F.col("p.col") == F.col("q.col")) & may)


def jaccard_join(docs: DataFrame, *, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = table(docs.mapInArrow(_sets_and_counts(k), "kind int, doc_id long, n long, a long, b long"), "sets")
    sets = base.where("kind = 0").select("doc_id", "n", "a", "b")
    counts = base.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT_COUNT)
    top = largest(counts, "c", FREQUENT_MOST, fill="a").select("a").toArrow()["a"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(top.astype(np.int64).view(np.uint64)))

    classes = table(sets.where("n > 0 and doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = docs.where("doc_id is not null").mapInArrow(_keys(k, percent, frequent), "rep long, n long, a long, b long, sig binary, sketch binary, often long, keys array<long>")
    keyed = table(keyed.join(classes.withColumnRenamed("rep", "r"), ["a", "b", "n"]).where("rep = r").select("rep", "n", "sig", "sketch", "often", "keys"), "keys")
    # dealt by key once, for the head of a key and for its members alike
    entries = keyed.select("rep", "n", F.explode("keys").alias("key")).repartition("key")
    shared = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("h"), F.max("rep").alias("last")).where("h.rep < last")
    live = table(entries.join(shared.select("key", F.col("h.rep").alias("head"), F.col("h.n").alias("head_n")), "key"), "live")

    # stars: each member against its head; a partner of a linked member has a size of 2 percent - 100 of the head's at least
    ratio = lambda n, m, least: 100 * F.least(n, m) >= least * F.greatest(n, m)
    stars = live.where((F.col("rep") != F.col("head")) & ratio(F.col("n"), F.col("head_n"), 2 * percent - 100)).select(F.col("head").alias("x"), F.col("rep").alias("y")).distinct()
    sketches = keyed.select(F.col("rep").alias("y"), F.col("sketch").alias("payload"))
    near = table(_judged(table(stars, "stars"), sketches, lambda c: c.to_pylist(), lambda s, t: nearness(s, t, percent), "near"), "nearness")
    linked = table(_linked(near.where(F.col("v") == MAY), docs, k, percent), "linked")
    starred = linked.select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = components(starred).select(F.col("node").alias("rep"), "component")

    placed = table(live.select("key", "rep", "head").join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key")
    several = classes.groupBy("rep").count().where("count > 1").select("rep")  # a link of one text says nothing of another's
    sure = linked.join(several, linked["x"] == several["rep"], "left_anti").join(several, linked["y"] == several["rep"], "left_anti")
    wide = placed.join(open_keys, "key").join(several.withColumn("several", F.lit(True)), "rep", "left")
    wide = wide.join(near.select(F.col("x").alias("head"), F.col("y").alias("rep"), F.lit(True).alias("near")), ["head", "rep"], "left")
    wide = wide.join(sure.select(F.col("x").alias("head"), F.col("y").alias("rep"), F.lit(True).alias("link")), ["head", "rep"], "left")
    by_head = ((F.col("rep") == F.col("head")) & F.col("several").isNull()) | F.col("link").isNotNull()
    wide = table(wide.select("key", "head", "rep", "component", by_head.alias("linked"), F.col("near").isNotNull().alias("near")), "wide")
    sizes = wide.groupBy("key").agg(F.count_if(~F.col("linked")).alias("others"))
    hot = (F.col("key").bitwiseAND(F.lit(1)) == 0) & (F.col("others") > HOT)
    rest = wide.where(~F.col("linked")).join(sizes, "key").withColumn("hot", hot)
    heated = table(rest.where("hot").join(keyed.select("rep", "n").distinct(), "rep").groupBy("rep", "n").agg(F.collect_set("key").alias("hot")), "hot")  # of one text each

    bits = [F.conv(F.hex(F.substring("sig", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"s{i}") for i in range(_SIG_WORDS)]
    one = keyed.select("rep", "n", "often", *bits).join(heated.select("rep", "n", F.size("hot").alias("heat")), ["rep", "n"], "left")
    one = table(one.select("rep", F.struct("n", (F.col("often") + F.coalesce("heat", F.lit(0))).alias("elsewhere"), *(f"s{i}" for i in range(_SIG_WORDS))).alias("set")), "members")
    combined = heated.mapInArrow(_hot_pairs(percent), "rep long, key long").distinct()
    combined = combined.join(wide.select("rep", "component").distinct(), "rep")
    combined = combined.join(combined.groupBy("key").agg(F.count("*").alias("others")).where("others > 1"), "key")
    direct = rest.where("not hot and others > 1").select("key", "rep", "component", "others").unionByName(combined.select("key", "rep", "component", "others"))
    direct = table(direct.join(one, "rep").withColumn("here", F.col("others")).withColumn("there", F.col("others")).drop("others"), "direct")

    differ = sum((F.bit_count(F.col(f"p.set.s{i}").bitwiseXOR(F.col(f"q.set.s{i}"))) for i in range(_SIG_WORDS)), F.lit(0))
    n, m = F.col("p.set.n"), F.col("q.set.n")
    may = (F.col("p.component") != F.col("q.component")) & ratio(n, m, percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))
    pair = [F.least("p.rep", "q.rep").alias("x"), F.greatest("p.rep", "q.rep").alias("y")]
    # linked sets share over 2 G shingles of their extended prefixes; those neither frequent nor hot are keys here,
    # all of them if no shared key has a head that one links with and the other is near
    least = 2 * _groups(F.greatest(n, m)) - F.least("p.set.elsewhere", "q.set.elsewhere")
    met = _in_blocks(direct, direct, may & (F.col("p.rep") < F.col("q.rep"))).select(*pair, least.alias("least"))
    met = met.groupBy("x", "y").agg(F.count("*").alias("held"), F.min("least").alias("least")).where(F.col("held") > F.col("least")).select("x", "y")
    across = met.unionByName(_in_blocks(*_facing(wide, one), may).select(*pair)).distinct()
    likely = _judged(table(across, "pairs"), sketches, lambda c: c.to_pylist(), lambda s, t: nearness(s, t, percent) == MAY, "likely")
    more = _linked(likely, docs, k, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))

    copies = sets.where("n > 0 and doc_id is not null").join(classes, ["a", "b", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(starred.unionByName(more).unionByName(copies))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, k: int = 3, percent: int = 90) -> DataFrame:
    """docs without those that have a smaller linked doc_id, one row for each
    remaining id.  Rows with a null doc_id stay."""
    keep = jaccard_join(docs, k=k, percent=percent).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def oracle(k: int = 3, percent: int = 90) -> str:
    """The same in DuckDB SQL, for small tables: it expands all pairs."""
    shingle = " || ' ' || ".join(f"l[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS l FROM documents),
i AS (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - {k} + 2))) AS i FROM w WHERE len(l) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < {k} THEN array_to_string(l, ' ') ELSE {shingle} END AS x FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, c.b FROM reach r JOIN ways c ON r.b = c.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id"""
