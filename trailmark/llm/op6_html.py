"""Operator 6, main text of web pages by suffix arrays over the pages of a host, and page structure.

1.  A scanner splits each page into blocks and marks where they stand: inside an article, in page furniture (menus,
    headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles; these go), or in neither.
2.  The token streams of all other blocks meet by host, each different stream (content) once, so that copies of a page count once. A large
    host is dealt in shards of about SHARD_BYTES by content, so that no task holds more.
3.  A shard's streams are concatenated and their suffixes sorted (prefix doubling, which also gives the common prefixes of neighbours).
    Neighbours with a common prefix of `run` tokens share a substring; it is counted by different contents, and unique ones stay.
4.  Counts of shards are added up by host. Structure decides which repeated runs go: outside articles those of two contents; inside an
    article only those of most contents of the host (MOST_LEAST at least), since pages of one host may quote the same passage,
    which is text. What the shards of a large host can't settle alone is counted again over all of its contents, so
    the answer is that of one shard, whatever the size of the host. Overlapping runs go as one, of any length.

Null or empty html gives an empty text. Repeated ids and urls are pages of their own, as is a page with a null id or url (host: empty).
Html of any length is read whole. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked_broadcast, save
from .rolling import Poly, in_slices, mix

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("script style textarea title xmp iframe noembed noframes head noscript template svg math canvas object audio video select option button datalist".split())
FURNITURE = frozenset("nav aside footer form menu dialog".split())
CLOSED = FURNITURE - {"form"} | {"header"}
HEADS = frozenset("html body h1 h2 h3 h4 h5 h6".split())  # never furniture by a name of their own
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies cookie-notice cookie-banner consent notice notices "
    "alert popup modal newsletter subscribe subscription signup share sharing social related recommended comment comments comment-list comments-area respond disqus widget toolbar search login complementary contentinfo".split()
)
COMMENTS = frozenset("comment comments comment-list comments-area respond disqus".split())
_PARTS = frozenset(NAMED - {"search", "login", "notice", "alert", "social", "related", "menu", "share"})


def _named(attributes: str) -> tuple[frozenset, bool]:
    """(names of page furniture in the attributes, whether one of them is a whole name and not just a part of a longer one)."""
    if "=" not in attributes:
        return frozenset(), False
    words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split()
    out, whole = set(), False
    for w in words:
        if w in NAMED:
            out.add(w)
            whole = True
        else:
            ends = re.split(r"[-_]", w)
            if ends[0] not in ("no", "has", "with", "is"):
                out.update(x for x in (ends[0], ends[-1]) if x in _PARTS)
    return frozenset(out), whole


class _Region:
    """An element that looks like page furniture: its words, and whether nothing can save it."""

    def __init__(self, sure: bool):
        self.sure, self.words = sure, 0


def scan(page: str) -> list[tuple[bool, str]]:
    """(inside an article, text) of the blocks outside page furniture, in page order.

    Furniture by element goes if its end tag closes it, by a whole name always. A form, an element that has only part of a furniture name, and one
    that nothing closes go too, unless more than half of the page's words (those outside sure furniture) stand in it: then it wraps the page.
    """
    found: list[tuple[bool, str, tuple[_Region, ...]]] = []
    stack: list[tuple[str, bool, bool, tuple[_Region, ...], bool]] = []  # element, main, surely away, doubtful regions, comments
    main = away = False
    doubts: tuple[_Region, ...] = ()
    parts: list[str] = []
    where: tuple[bool, tuple[_Region, ...]] = (False, ())

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                found.append((where[0], text, where[1]))
            parts = []

    def state() -> None:
        nonlocal main, away, doubts
        main, away, doubts = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, False, ())

    at, n, raw = 0, len(page), ""
    while at < n:
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            raw = ""
            continue
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not away:
            if parts and where != (main, doubts):
                flush()
            where = (main, doubts)
            parts.append(text)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in CLOSED and stack[k][3] and (k == 0 or len(stack[k][3]) > len(stack[k - 1][3])):
                        stack[k][3][-1].sure = True  # its own end tag: furniture as meant
                    del stack[k:]
                    state()
                    break
            continue
        if tag in VOID:
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            raw = tag
            continue
        if tag in ("p", "li"):  # a new one ends the last
            for k in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    state()
                    break
                if stack[k][0] in BLOCK:
                    break
        names, whole = _named(attributes) if tag not in HEADS else (frozenset(), False)
        talk = (stack[-1][4] if stack else False) or whole and bool(names & COMMENTS)
        inside = doubts
        if tag in MAIN and not talk and not names & NAMED:
            here, gone, inside = True, False, ()
        else:
            here = main
            gone = away or tag in SKIP or whole or talk
            if not gone and (tag in FURNITURE or names or tag == "header" and not main):
                inside = (*doubts, _Region(False))
        if not attributes.endswith("/"):
            stack.append((tag, here, gone, inside, talk))
            main, away, doubts = here, gone, inside
    flush()
    if not any(regions for _, _, regions in found):
        return [(m, t) for m, t, _ in found]
    total = 0
    for _, text, regions in found:
        if any(r.sure for r in regions):
            continue
        words = text.count(" ") + 1
        total += words
        for r in regions:
            r.words += words
    return [(m, t) for m, t, regions in found if all(not r.sure and 2 * r.words > total for r in regions)]


_TOKEN, _SUFFIX, _PAGE = Poly(61), Poly(62), Poly(64)
#: Fixed value: contents that a run inside an article must be on to go (and more than half of the host's).
MOST_LEAST = 3
SHARD_BYTES = 4 << 20  # html of a shard
_SLICE = 2_000_000


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and each one's common prefix with the one before; no suffix may be another's start."""
    n, size, levels = len(ids), 1, [ids.astype(np.int64)]
    while True:
        rank, after = levels[-1], np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        key = rank * (max(n, int(rank.max(initial=0))) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank)
        size *= 2
        if not n or new[-1] == n - 1:
            break
    common = np.zeros(n, np.int64)
    for rank in reversed(levels):  # equal ranks are equal substrings of so many tokens
        size = 1 << (len(levels) - 1)
        levels.pop()
        x, y = order[1:] + common[1:], order[:-1] + common[1:]
        inside = (x < n) & (y < n)
        common[1:] += np.where(inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]), size, 0)
    return order, common


def _prints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prints of the tokens of many texts (blocks by lines), and how many each has."""
    raw = np.frombuffer("\n".join([*(t for t in texts if t), ""]).encode("utf-8", "surrogatepass"), np.uint8)
    cut = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate(([0], cut[:-1] + 1)) if len(cut) else cut
    return _TOKEN.spans(_TOKEN.prefix(_TOKEN.byte[raw]), starts, cut), np.array([t.count(" ") + t.count("\n") + 1 if t else 0 for t in texts], np.int64)


def _runs(prints: np.ndarray, owner: np.ndarray, hosts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where so many tokens of one text start, and prints of these runs by host."""
    at = np.flatnonzero(owner[: max(len(owner) - run + 1, 0)] == owner[run - 1 :])
    return at, mix(_SUFFIX.spans(_SUFFIX.prefix(prints), at, at + run) ^ hosts[owner[at]].view(np.uint64)).view(np.int64)


def _flags(blocks: list[tuple[bool, str]]) -> str:
    return "".join("1" if m else "0" for m, _ in blocks)


def _outside(texts: list[str], flags: list[str]) -> np.ndarray:
    """Of each token whether it stands outside articles."""
    some = [(f, t.split("\n")) for t, f in zip(texts, flags) if t]
    return np.repeat(np.array([c == "0" for f, _ in some for c in f], bool), np.array([b.count(" ") + 1 for _, bs in some for b in bs], np.int64))


def _streams(batches):
    """(host, content, text, flags): the different contents of a task."""
    schema = pa.schema([("host", pa.int64()), ("content", pa.int64()), ("text", pa.string()), ("flags", pa.string())])
    seen: set = set()
    for whole in batches:
        for batch in in_slices(whole, "html", _SLICE):
            pages = [scan(html or "") for html in batch.column("html").to_pylist()]
            texts, hosts = ["\n".join(t for _, t in blocks) for blocks in pages], batch.column("host").to_numpy()
            prints, counts = _prints(texts)
            ends = np.cumsum(counts)
            content = mix(_PAGE.spans(_PAGE.prefix(prints), ends - counts, ends) ^ hosts.view(np.uint64)).view(np.int64)
            out = []
            for k in np.flatnonzero(counts).tolist():
                if (c := int(content[k])) not in seen:
                    seen.add(c)
                    out.append((int(hosts[k]), c, texts[k], _flags(pages[k])))
            if len(seen) > 200_000:
                seen.clear()
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _hits(run, shared):
    """(host, content, print) of the asked runs (all of them where none are named) in every page."""

    def go(batches):
        asked = shared and shared.value
        for whole in batches:
            for batch in in_slices(whole, "html", _SLICE):
                texts = ["\n".join(t for _, t in scan(html or "")) for html in batch.column("html").to_pylist()]
                hosts = batch.column("host").to_numpy()
                prints, counts = _prints(texts)
                ends = np.cumsum(counts)
                content = mix(_PAGE.spans(_PAGE.prefix(prints), ends - counts, ends) ^ hosts.view(np.uint64)).view(np.int64)
                owner = np.repeat(np.arange(len(texts)), counts)
                at, names = _runs(prints, owner, hosts, run)
                if asked is not None and len(asked):
                    hit = asked[np.minimum(np.searchsorted(asked, names), len(asked) - 1)] == names
                    at, names = at[hit], names[hit]
                rows = np.unique(np.column_stack((hosts[owner[at]], content[owner[at]], names)), axis=0) if len(at) else np.zeros((0, 3), np.int64)
                yield pa.record_batch([pa.array(rows[:, k]) for k in range(3)], names=["host", "content", "print"])

    return go


def _exact(pages: DataFrame, sizes: DataFrame, counted: DataFrame, run: int) -> DataFrame:
    """(print, exact): contents of the runs of large hosts whose shards can't settle them alone.

    A run on more than half of a host's contents is on more than half of a shard's, in one shard at least; and one that a shard has once outside articles
    may be on contents of other shards. Both kinds are counted again over all contents of their hosts.
    """
    n_sizes = sizes.count()
    large = counted.where("print is not null").join(checked_broadcast(sizes.select("host"), n_sizes), "host", "left_semi")
    doubtful = save(large.groupBy("print").agg(F.sum("n").alias("n"), F.max(F.col("major").cast("int")).alias("major")).where("major = 1 or n = 1").select("print"), "op6-doubtful")
    n = doubtful.count() if n_sizes else 0
    asked = pages.join(checked_broadcast(sizes.select("host"), n_sizes), "host", "left_semi").select("host", "html")
    if not n:
        return doubtful.select("print", F.lit(0).cast("long").alias("exact")).limit(0)
    few = n <= BROADCAST_ROWS
    shared = pages.sparkSession.sparkContext.broadcast(doubtful.orderBy("print").toArrow().column("print").to_numpy()) if few else None
    hits = asked.mapInArrow(_hits(run, shared), "host long, content long, print long")
    if not few:
        hits = hits.join(doubtful, "print", "left_semi")
    return hits.distinct().groupBy("print").agg(F.count("*").alias("exact"))


_COUNTED = "host long, print long, n long, major boolean"


def _shard_runs(host: int, shards: int, contents: list[tuple[str, str]], run: int) -> pa.RecordBatch:
    """Counts of a shard's repeated runs (and of unique ones outside articles, if other shards may have them), and a row with its number of contents."""
    texts, flags = zip(*contents)
    prints, counts = _prints(list(texts))
    n = len(contents)
    owner = np.repeat(np.arange(n), counts)
    kinds, ids = np.unique(prints, return_inverse=True)
    place = np.arange(len(ids)) + owner  # a token of its own ends each stream
    stream = np.zeros(len(ids) + n, np.int64)
    stream[place] = ids
    stream[np.cumsum(counts + 1) - 1] = len(kinds) + np.arange(n)
    order, common = suffix_array(stream)
    token = np.full(len(stream), -1)
    token[place] = np.arange(len(ids))
    at, names = _runs(prints, owner, np.full(n, host), run)
    name = np.zeros(len(ids), np.int64)
    name[at] = names
    starts = np.zeros(len(ids) + 1, bool)  # the last place stands for the ends
    starts[at] = True
    reach = np.concatenate(([0], np.cumsum(_outside(list(texts), list(flags)))))
    out = np.zeros(len(ids) + 1, bool)
    out[at] = reach[at + run] > reach[at]
    here = token[order]
    group = np.cumsum(common < run) - 1
    here, group = here[starts[here]], group[starts[here]]
    if len(here):
        group = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
        met = np.unique(group * n + owner[here]) // n  # each group once for each of its contents
        many = np.bincount(met)
        first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        outside = np.bincount(group, weights=out[here]) > 0
        major = 2 * many > n
        keep = outside & (many >= (1 if shards > 1 else 2)) | major & (many >= (1 if shards > 1 else MOST_LEAST))
        name, many, major = name[here[first[keep]]], many[keep], major[keep]
    else:
        name, many, major = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    rows = len(name) + 1
    return pa.record_batch([pa.array(np.full(rows, host)), pa.array([*name.tolist(), None], pa.int64()), pa.array(np.append(many, n)), pa.array(np.append(major, False))], names=["host", "print", "n", "major"])


def _shards(run):
    """Over streams sorted by (host, shard)."""

    def go(batches):
        key, held = None, {}
        for batch in batches:
            for host, shard, shards, content, text, flags in zip(*(batch.column(c).to_pylist() for c in ("host", "shard", "shards", "content", "text", "flags"))):
                if key != (host, shard, shards):
                    if held:
                        yield _shard_runs(key[0], key[2], list(held.values()), run)
                    key, held = (host, shard, shards), {}
                held[content] = (text, flags)
        if held:
            yield _shard_runs(key[0], key[2], list(held.values()), run)

    return go


_TEXT = "page_id long, url string, text string"


def _covered(at: np.ndarray, hit: np.ndarray, n: int, run: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + run, -1)
    return np.cumsum(edge)[:n] > 0


def _cleaned(batch: pa.RecordBatch, gone: np.ndarray, most: np.ndarray, run: int) -> pa.RecordBatch:
    """Texts of pages without repeated runs; gone and most are sorted prints."""
    pages = [scan(html or "") for html in batch.column("html").to_pylist()]
    texts = ["\n".join(t for _, t in blocks) for blocks in pages]
    if len(gone):
        prints, counts = _prints(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        at, names = _runs(prints, owner, batch.column("host").to_numpy(), run)
        hit = gone[np.minimum(np.searchsorted(gone, names), len(gone) - 1)] == names
        drop = np.where(_outside(texts, [_flags(blocks) for blocks in pages]), _covered(at, hit, len(owner), run), _covered(at, hit & np.isin(names, most), len(owner), run))
        ends = np.cumsum(counts)
        for k in np.unique(owner[drop]).tolist():
            left, place, kept = drop[ends[k] - counts[k] : ends[k]], 0, []
            for block in texts[k].split("\n"):
                words = block.split(" ")
                stay = [w for w, d in zip(words, left[place : place + len(words)].tolist()) if not d]
                place += len(words)
                if stay:
                    kept.append(" ".join(stay))
            texts[k] = "\n".join(kept)
    return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _uncovered(run, shared):
    def go(batches):
        gone, most = shared.value
        for whole in batches:
            for batch in in_slices(whole, "html", _SLICE):
                yield _cleaned(batch, gone, most, run)

    return go


def _uncovered_dealt(run):
    """Over rows sorted by (host, shard, print): first a shard's runs that go, then its pages (without a print)."""

    def go(batches):
        key, held, arrays = None, [], None
        for whole in batches:
            for batch in in_slices(whole, "html", _SLICE):
                host, shard, page = batch.column("host").to_numpy(), batch.column("shard").to_numpy(), batch.column("print").is_null().to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((host[1:] != host[:-1]) | (shard[1:] != shard[:-1]) | (page[1:] != page[:-1])) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part = batch.slice(a, b - a)
                    if key != (host[a], shard[a]):
                        key, held, arrays = (host[a], shard[a]), [], None
                    if not page[a]:
                        held.append((part.column("print").to_numpy(), part.column("most").to_numpy(zero_copy_only=False).astype(bool)))
                        continue
                    if arrays is None:
                        prints, most = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, bool))
                        arrays, held = (prints, prints[most]), []
                    yield _cleaned(part, *arrays, run)

    return go


def extract_text(pages: DataFrame, run: int = 8) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    spark = pages.sparkSession
    name = F.regexp_replace(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"(?s)^[a-z][a-z0-9+.-]*://|[/?#].*$", "")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(name).alias("host"), "html")
    sizes = pages.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0))) / SHARD_BYTES).alias("shards")).where("shards > 1")
    sizes = save(sizes, "op6-hosts")
    streams = pages.select("host", "html").mapInArrow(_streams, "host long, content long, text string, flags string")
    streams = streams.join(checked_broadcast(sizes, sizes.count()), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    streams = streams.withColumn("shard", F.pmod("content", "shards")).repartition(F.col("host"), F.col("shard")).sortWithinPartitions("host", "shard")
    counted = save(streams.mapInArrow(_shards(run), _COUNTED), "op6-runs", True)
    totals = counted.where("print is null").groupBy("host").agg(F.sum("n").alias("total"))
    runs = counted.where("print is not null").groupBy("print").agg(F.min("host").alias("host"), F.sum("n").alias("many"), F.sum(F.when(F.col("major"), F.col("n")).otherwise(0)).alias("major"))
    runs = runs.join(_exact(pages, sizes, counted, run), "print", "left").select("print", "host", F.coalesce("exact", "many").alias("many"), F.coalesce("exact", "major").alias("major"))
    gone = runs.where("many >= 2").join(totals, "host").select("host", "print", F.expr(f"major >= {MOST_LEAST} and 2 * major > total").alias("most"))
    gone = save(gone, "op6-gone")
    if gone.count() <= BROADCAST_ROWS:
        got = gone.orderBy("print").toArrow()
        prints, most = got.column("print").to_numpy(), got.column("most").to_numpy()
        return pages.mapInArrow(_uncovered(run, spark.sparkContext.broadcast((prints, prints[most.astype(bool)]))), _TEXT)
    # Too many for every task: they go with the shards of their host's pages.
    parts = F.col("shards").cast("int")
    gone = gone.join(sizes, "host", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    dealt = pages.join(checked_broadcast(sizes, sizes.count()), "host", "left").withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.coalesce(parts, F.lit(1))).cast("int"))
    page, no_page = ("page_id", "url", "html"), (F.lit(None).cast(t) for t in ("long", "string", "string"))
    rows = gone.select("host", "shard", "print", "most", *(c.alias(n) for c, n in zip(no_page, page))).union(dealt.select("host", "shard", F.lit(None).cast("long"), F.lit(None).cast("boolean"), *page))
    rows = rows.repartition(F.col("host"), F.col("shard")).sortWithinPartitions("host", "shard", F.col("print").asc_nulls_last())
    return rows.mapInArrow(_uncovered_dealt(run), _TEXT)
