"""Operator 7, n-gram Jaccard join by a token-group matrix.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more are linked.

1.  One scan hashes every text to its shingle set: size, an order-independent 128-bit set print and
    three minimum hashes. Equal sets collapse inside the task first, then across tasks, to classes.
2.  Groups of similar documents: each class is compared with the smallest class that shares one of its
    minimum hashes (those left over again, up to STAR_ROUNDS times), so a group of n near copies costs n comparisons. Links found form the groups.
3.  Token-group matrix: every class posts its prefix tokens (a prefix covers any partner at the threshold), and a group keeps the
    union of its members' prefixes, with the bounds of sizes and places at each token. A token that meets one group only is closed.
    For the rest a class opens a group only where these bounds leave room for an overlap that reaches the threshold.
4.  Pairs in opened groups are bounded by the places of their first common token and by a parity bitmap (difference of bitmaps <=
    difference of sets); the rest are compared exactly, one pair of each two groups first, the others where groups are still apart.

Tokens common to many documents go last in the prefix order (counts are gathered from all documents), so
shared passages do not make long lists; any order is exact, the counts only steer the cost.

Null or empty texts have an empty set and are linked with nothing. Repeated ids and null ids are kept as
rows of their own (null first, ties by text). Sets are those of whole texts, whatever their length. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, row_keyed, save
from .graph import components
from .rolling import Poly, join_texts, mix, text_slices

#: A token found in this many classes or more counts as common; doubled until the common tokens fit HOT_MAX.
HOT_FROM, HOT_MAX = 48, 500_000
_WORD, _SHINGLE = Poly(71), Poly(72)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SLICE = 300_000


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of many texts: (hashes sorted within each text, owner of each, set sizes)."""
    raw, bounds = join_texts([t + b" " for t in texts])
    space = _SPACE[raw]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate(([True], space[:-1]))) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1 if len(raw) else start
    words = _WORD.spans(_WORD.prefix(_WORD.byte[_FOLD[raw]]), start, end)
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), made)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    s = first[:-1][owner] + offset
    e = np.minimum(s + width, first[1:][owner])
    h = _SHINGLE.spans(_SHINGLE.prefix(words), s, e)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, owner, np.bincount(owner, minlength=len(texts))


def _sliced(batches):
    """(row ids, texts) in slices of bounded bytes."""
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        for a, b, texts in text_slices(batch.column("text"), _SLICE):
            yield rows[a:b], texts


def _prints(h, owner, n):
    """Per text: two sums that identify the set, and three minimum hashes under different mixes."""
    out = []
    for salt in (0x9E37, 0x79B9, 0x7F4A, 0x7C15, 0x1CE4):
        out.append(mix(h ^ mix(np.full(1, salt, np.uint64))[0]))
    some = n > 0
    at = (np.cumsum(n) - n)[some]
    cols = []
    for k, v in enumerate(out):
        x = np.zeros(len(n), np.uint64)
        if len(v):
            x[some] = (np.add if k < 2 else np.minimum).reduceat(v, at)
        cols.append(x.view(np.int64))
    return cols


_PROFILE = "kind int, row long, n long, p1 long, p2 long, m1 long, m2 long, m3 long, lead long"


def _profile(width: int):
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in "row n p1 p2 m1 m2 m3 lead".split())])

    def run(batches):
        seen: dict = {}
        tokens, held = [], 0

        def counted(flush):
            nonlocal tokens, held
            if tokens and (flush or held > 800_000):
                v, c = np.unique(np.concatenate(tokens), return_counts=True)
                some = c >= 3
                tokens, held = [], 0
                z = np.zeros(int(some.sum()), np.int64)
                yield pa.record_batch([pa.array(np.full(len(z), 1, np.int32)), pa.array(v[some].view(np.int64)), pa.array(c[some]), *[pa.array(z)] * 6], schema=schema)

        for rows, texts in _sliced(batches):
            h, owner, n = shingles(texts, width)
            cols = _prints(h, owner, n)
            lead, fresh = np.array(rows, np.int64), np.zeros(len(rows), bool)
            for i, key in enumerate(zip(n.tolist(), cols[0].tolist(), cols[1].tolist())):
                if key[0]:
                    at = seen.setdefault(key, int(rows[i]))
                    fresh[i] = at == rows[i]
                    lead[i] = at
            if len(seen) > 80_000:
                seen.clear()
            tokens.append(h[fresh[owner]])
            held += len(tokens[-1])
            yield pa.record_batch([pa.array(np.zeros(len(rows), np.int32)), *map(pa.array, (np.array(rows, np.int64), n, *cols, lead))], schema=schema)
            yield from counted(False)
        yield from counted(True)

    return run


def _postings(width, num, den, hot_token, hot_count):
    """Prefix tokens of each text, once for each different set of a task; common tokens last. rem: tokens from this one on."""
    schema = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("rem", pa.int32())])

    def run(batches):
        seen: set = set()
        token, count = hot_token.value, hot_count.value
        for rows, texts in _sliced(batches):
            h, owner, n = shingles(texts, width)
            p1, p2 = _prints(h, owner, n)[:2]
            fresh = np.zeros(len(rows), bool)
            for i, key in enumerate(zip(n.tolist(), p1.tolist(), p2.tolist())):
                if key[0] and key not in seen:
                    fresh[i] = True
                    seen.add(key)
            if len(seen) > 80_000:
                seen.clear()
            keep = fresh[owner]
            h, owner = h[keep], owner[keep]
            rank = np.zeros(len(h), np.int64)
            if len(token) and len(h):
                at = np.minimum(np.searchsorted(token, h), len(token) - 1)
                rank = np.where(token[at] == h, count[at], 0)
            order = np.lexsort((h, rank, owner))
            h, owner = h[order], owner[order]
            size = np.bincount(owner, minlength=len(rows))
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            prefix = size - -(-size * num // den) + 1
            keep = place < prefix[owner]
            yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(np.array(rows, np.int64)[owner[keep]]), pa.array((size[owner] - place)[keep].astype(np.int32))], schema=schema)

    return run


def _shared(batches):
    """From postings sorted by token: those of tokens with two rows at least."""
    held = None
    for batch in batches:
        t, r, m = (c.to_numpy() for c in batch.columns)
        if held is not None:
            t, r, m = (np.concatenate(x) for x in zip(held, (t, r, m)))
        if not len(t):
            continue
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        known = keep[-1]
        keep[-1] = False
        held = tuple(np.repeat(x[-1:], 2 if known else 1) for x in (t, r, m))
        yield pa.record_batch([pa.array(x[keep]) for x in (t, r, m)], schema=batch.schema)
        if known:  # two copies of the last row stay held: its token is known to be shared
            continue
    if held is not None and len(held[0]) > 1:
        yield pa.record_batch([pa.array(x[:1]) for x in held], names=["token", "row", "rem"])


def _bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap of a set, four bits a token rounded up to a power of two: token h flips bit h mod its size."""
    bits = 1 << max(8, int(4 * len(h) - 1).bit_length())
    flips = np.bincount((mix(h) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _sketch(width):
    schema = pa.schema([("row", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for rows, texts in _sliced(batches):
            h, _, n = shingles(texts, width)
            cut = np.concatenate(([0], np.cumsum(n)))
            yield pa.record_batch([pa.array(np.array(rows, np.int64)), pa.array([_bitmap(h[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], schema=schema)

    return run


def _sets(width):
    schema = pa.schema([("row", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for rows, texts in _sliced(batches):
            h, _, n = shingles(texts, width)
            cut = np.concatenate(([0], np.cumsum(n)))
            yield pa.record_batch([pa.array(np.array(rows, np.int64)), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], schema=schema)

    return run


def _exact(num, den):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("a").to_numpy(), batch.column("b").to_numpy(), []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], schema=schema)

    return run


def _apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer folded to the size of the other: at most the sets' difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


_OPEN = "a long, b long, ga long, gb long, apart long"
STAR_ROUNDS = 3  # more rounds would only save comparisons of the matrix step
SALTS = 16  # a common minimum hash is dealt over this many parts


def _within(num, den):
    """Keep pairs that sizes and bitmaps do not rule out."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "ga", "gb", "apart")])

    def run(batches):
        for batch in batches:
            a, b, ga, gb, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "ga", "gb", "na", "nb"))
            apart = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("ba"), batch.column("bb"))], np.int64)
            most = (na + nb - np.maximum(apart, np.abs(na - nb))) // 2
            keep = den * most >= num * (na + nb - most)
            yield pa.record_batch([pa.array(c[keep]) for c in (a, b, ga, gb, apart)], schema=schema)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(row, id, n, component, component_id): links at intersection * den >= union * num; component is the smallest row reached, component_id its id."""
    spark = docs.sparkSession
    keyed, plain = row_keyed(docs, id_col, text_col)
    slim = keyed.select("row", "text")
    both = save(slim.mapInArrow(_profile(width), _PROFILE), "op7-profile")
    rows = both.where("kind = 0").drop("kind")

    # Equal sets: leaders of each task, then the smallest leader of each set.
    leads = rows.where("n > 0 and row = lead")
    first = leads.groupBy("n", "p1", "p2").agg(F.min("row").alias("cls"))
    classes = save(leads.join(first, ["n", "p1", "p2"]).select("row", "cls", "n", "m1", "m2", "m3"), "op7-classes")
    own = classes.where("row = cls")
    class_of = save(rows.where("n > 0").select("row", F.col("lead").alias("l")).join(classes.select(F.col("row").alias("l"), "cls"), "l").select("row", "cls"), "op7-class-of")

    # Common tokens, counted over all documents.
    counts = save(both.where("kind = 1").groupBy(F.col("row").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM), "op7-common")
    level = HOT_FROM
    while counts.where(F.col("n") >= level).count() > HOT_MAX:
        level *= 2
    got = counts.where(F.col("n") >= level).toPandas()
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    hot = [spark.sparkContext.broadcast(x) for x in (token[order], got["n"].to_numpy(np.int64)[order])]

    # Groups of similar classes: each with the smallest class that has the same minimum hash.
    def with_first(free: DataFrame) -> DataFrame:
        stars = []
        for m in ("m1", "m2", "m3"):
            lead = free.groupBy(m).agg(F.min("row").alias("b"), F.count("*").alias("many")).where("many > 1").drop("many")
            lead = lead.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            dealt = free.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
            stars.append(dealt.join(lead, [m, "salt"]).where("row <> b").select(F.col("b").alias("a"), F.col("row").alias("b")))
        return reduce(DataFrame.union, stars).distinct()

    star_pairs = with_first(own)
    sketches = None

    def wanted(pairs: DataFrame) -> DataFrame:
        return pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row")

    def picked(ids: DataFrame) -> DataFrame:
        return slim.join(checked_broadcast(ids, ids.count()), "row", "left_semi")

    def sides(pairs: DataFrame, value: DataFrame, *names: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(value.select(F.col("row").alias(side), *(F.col(n).alias(n[0] + side) for n in names)), side)
        return pairs

    def bounded(pairs: DataFrame, tag: str) -> DataFrame:
        """Candidate pairs (a, b, ga, gb) that may still be links."""
        sizes = sides(pairs, own, "n").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
        return save(sides(sizes, sketches, "bits").select("a", "b", "ga", "gb", "na", "nb", "ba", "bb").mapInArrow(_within(num, den), _OPEN), tag, True)

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        """The links among pairs of classes, by comparing their sets."""
        pairs = save(pairs.select("a", "b"), f"{tag}-pairs")
        sets = save(picked(save(wanted(pairs), f"{tag}-ids")).mapInArrow(_sets(width), "row long, tokens binary"), f"{tag}-sets")
        return save(sides(pairs, sets, "tokens").select("a", "b", "ta", "tb").mapInArrow(_exact(num, den), "a long, b long"), f"{tag}-links", True)

    def nearest(pairs: DataFrame, *keys: str) -> DataFrame:
        """Of each key the pair whose bitmaps differ least."""
        return pairs.groupBy(*keys).agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b")

    posts = slim.mapInArrow(_postings(width, num, den, *hot), "token long, row long, rem int")
    shared = save(posts.repartition(F.col("token")).sortWithinPartitions("token").mapInArrow(_shared, "token long, row long, rem int"), "op7-postings", True)
    shared = save(shared.join(class_of, "row").select("token", F.col("cls").alias("row"), "rem").distinct(), "op7-shared", True)

    star_pairs = save(star_pairs, "op7-stars")
    need = save(wanted(star_pairs).union(shared.select("row").distinct()).distinct(), "op7-need")
    sketches = save(picked(need).mapInArrow(_sketch(width), "row long, bits binary"), "op7-bitmaps")
    # A first class may share no more than a passage with those under its hash; those left over look for another one among themselves.
    star_links = None
    for k in range(STAR_ROUNDS):
        starred = bounded(star_pairs.select("a", "b", F.col("a").alias("ga"), F.col("b").alias("gb")), "op7-star-open")
        new = linked(nearest(starred, "b"), "op7-star")
        star_links = new if star_links is None else star_links.union(new)
        if k + 1 == STAR_ROUNDS or new.isEmpty():
            break
        star_pairs = save(with_first(own.join(wanted(star_links), "row", "left_anti")).join(star_pairs, ["a", "b"], "left_anti"), "op7-stars")
        if star_pairs.isEmpty():
            break

    # Matrix of tokens and groups; rows of tokens with one group only are closed.
    group = components(star_links)
    members = own.select("row", "n").join(group, "row", "left").select("row", "n", F.coalesce("component", "row").alias("grp"))
    members = save(members, "op7-members")
    matrix = save(shared.join(members, "row").select("token", "row", "n", "grp", "rem"), "op7-matrix")
    # At a pair's first common token the overlap is at most what is left of either set from there on: the position bound.
    fits = lambda n, rem, least_n, most_rem: f"{num + den} * least({rem}, {most_rem}) >= {num} * ({n} + {least_n})"
    of_token = matrix.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("n").alias("least_n"), F.max("rem").alias("most_rem")).where("lo < hi").drop("lo", "hi")
    matrix = matrix.join(of_token, "token").where(fits("n", "rem", "least_n", "most_rem")).drop("least_n", "most_rem")
    # Sizes and positions in a token's group bound the overlap before the group is opened.
    cells = matrix.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rem").alias("rem"))
    asks = matrix.alias("q").join(cells.alias("g"), F.expr(f"q.token = g.token and q.grp < g.grp and {den} * q.n >= {num} * g.lo and {den} * g.hi >= {num} * q.n and {fits('q.n', 'q.rem', 'g.lo', 'g.rem')}"))
    asks = asks.select(F.col("q.row").alias("a"), F.col("q.n").alias("na"), F.col("q.rem").alias("ra"), F.col("q.grp").alias("ga"), F.col("g.grp").alias("gb"), "q.token")
    inside = matrix.select("token", F.col("grp").alias("gb"), F.col("row").alias("b"), F.col("n").alias("nb"), F.col("rem").alias("rb"))
    near = f"{den} * least(na, nb) >= {num} * greatest(na, nb) and {fits('na', 'ra', 'nb', 'rb')}"
    opened = asks.join(inside, ["token", "gb"]).where(near).select("a", "b", "ga", "gb").distinct()
    opened = bounded(opened, "op7-cross-open")
    # One link is enough to join two groups: the likeliest pair first, the others where groups are still apart.
    first_links = linked(nearest(opened, "ga", "gb"), "op7-cross")
    joined = components(opened.join(first_links, ["a", "b"]).select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    for g in ("ga", "gb"):
        opened = opened.join(joined.select(F.col("row").alias(g), F.col("component").alias(f"{g}_now")), g, "left").withColumn(f"{g}_now", F.coalesce(f"{g}_now", g))
    rest = opened.where("ga_now <> gb_now").select("a", "b")
    cross = first_links.union(linked(rest, "op7-rest"))

    # Components of classes; then down to the smallest row of each, and over the leaders of tasks to all rows.
    comp = components(star_links.union(cross)).withColumnRenamed("row", "cls")
    low = class_of.groupBy("cls").agg(F.min("row").alias("low")).join(comp, "cls", "left").select("cls", "low", F.coalesce("component", "cls").alias("component"))
    low = low.select("cls", "component").join(low.groupBy("component").agg(F.min("low").alias("low")), "component").select("cls", "low")
    led = save(classes.select(F.col("row").alias("lead"), "cls").join(low, "cls").select("lead", "low"), "op7-led")
    out = rows.join(led, "lead", "left").select("row", "n", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("row")).alias("component"))
    if plain:
        return out.select("row", F.col("row").alias("id"), "n", "component", F.col("component").alias("component_id"))
    ids = keyed.select("row", "id")
    return out.join(ids, "row").join(ids.select(F.col("row").alias("component"), F.col("id").alias("component_id")), "component").select("row", "id", "n", "component", "component_id")
