"""Operator 10, benchmark decontamination by a distributed positional inverted index.

1.  Term counts over all training texts, for terms of the test items.
2.  Every run of `width` consecutive words of an item is a window (a shorter item is one window). Its anchors are its
    two rarest terms. The index stores (term, row, position) for anchor terms.
3.  Posting lists are shifted by the anchors' offsets and intersected, rarest first: equal starts are phrase
    candidates, starts up to `slack` words apart are proximity matches.
4.  Phrase candidates are compared with the words of the text.

Only DataFrame functions run here. Lists are joined per (window, row, start block), so a word that fills a long text
makes no pairs beyond its neighbours. Null or empty texts have no words. Null ids come first and repeated ids are
rows of their own, ties by text; windows that several items share count for each of them; a null item id
counts as an empty one. Texts of any length are searched whole. Empty tables give no hits, or an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, lower_ascii, row_keyed, save

#: What stands between words, in lower-cased and in any text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(col, gap=GAP):
    """Words of a text: splitting at the gaps is many times faster here than extracting all matches of a word pattern."""
    return F.array_remove(F.split(lower_ascii(col) if gap == GAP else col, gap), "")


def _windows(items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(wid, phrase, len) of different windows, and (wid, item)."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where("size(words) > 0")
    w = w.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))).alias("at"))
    w = w.select("item", F.slice("words", F.col("at"), width).alias("words")).select("item", F.array_join("words", " ").alias("phrase")).distinct()
    phrases = save(w.select("phrase").distinct().select(F.monotonically_increasing_id().alias("wid"), "phrase", F.size(F.split("phrase", " ")).alias("len")), "op10-windows")
    return phrases, save(w.join(phrases, "phrase").select("wid", "item"), "op10-items")


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, slack: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed texts, phrase matches (row, wid, start, len, item), proximity matches (row, item))."""
    keyed, _ = row_keyed(docs, id_col, text_col)
    phrases, of_item = _windows(items, item_col, item_text, width)
    terms = phrases.select("wid", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = save(terms.select("term").distinct(), "op10-terms")
    n_terms = vocabulary.count()

    def postings(wanted: DataFrame, n: int) -> DataFrame:
        every = keyed.select("row", F.posexplode(_words(F.col("text"))).alias("pos", "term"))
        return every.join(checked_broadcast(wanted, n), "term", "left_semi")

    counts = postings(vocabulary, n_terms).groupBy("term").agg(F.count("*").alias("n"))
    counted = terms.join(vocabulary.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "term")
    rare = counted.groupBy("wid").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "off", "term"))), 1, 2).alias("rare"))
    # A window with a term that no text has cannot occur; it keeps its place for proximity only through its anchors.
    anchors = save(rare.select("wid", F.col("rare")[0].alias("a"), F.get("rare", F.lit(1)).alias("b")).join(phrases.select("wid", "len"), "wid"), "op10-anchors")
    n_windows = anchors.count()
    wanted = save(anchors.select("a.term").union(anchors.where("b is not null").select("b.term")).distinct(), "op10-anchor-terms")
    index = save(postings(wanted, wanted.count()), "op10-index")

    def shifted(side: str) -> DataFrame:
        lists = anchors.where(f"{side} is not null").select("wid", "len", F.col(f"{side}.term").alias("term"), F.col(f"{side}.off").alias("off"), F.col("b").isNull().alias("alone"))
        return index.join(checked_broadcast(lists, n_windows), "term").select("wid", "row", (F.col("pos") - F.col("off")).alias("start"), "len", "alone")

    block = F.floor(F.col("start") / (slack + 1))
    first = shifted("a").withColumn("block", block)
    second = shifted("b").select("wid", "row", F.col("start").alias("start2"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    near = first.where("not alone").join(second, ["wid", "row", "block"]).where(F.abs(F.col("start") - F.col("start2")) <= slack)
    both = save(near.select("wid", "row", "start", "len", (F.col("start") == F.col("start2")).alias("exact")).union(first.where("alone").select("wid", "row", "start", "len", F.lit(True))), "op10-near")

    candidates = both.where("exact and start >= 0")
    by_row = candidates.groupBy("row").agg(F.collect_list(F.struct("start", "wid", "len")).alias("asked"))
    rows = candidates.select("row").distinct()
    texts = keyed.select("row", "text").join(checked_broadcast(rows, rows.count()), "row", "left_semi")
    seen = texts.select("row", _words(F.col("text")).alias("words")).join(by_row, "row")
    said = seen.select("row", F.explode(F.transform("asked", lambda c: F.struct(c["start"].alias("start"), c["wid"].alias("wid"), F.array_join(F.slice(F.col("words"), c["start"] + 1, c["len"]), " ").alias("said")))).alias("c")).select("row", "c.*")
    exact = said.join(checked_broadcast(phrases, n_windows), "wid").where("said = phrase").select("row", "wid", "start", "len")
    matches = save(exact, "op10-matches")
    proximity = both.where("not exact").select("row", "wid").distinct().join(of_item, "wid").select("row", "item").distinct()
    return keyed, matches.join(of_item, "wid"), proximity


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(row, id, n_words, n_hit, n_items, items, n_near): hit words and items per text; n_near counts items met in proximity."""
    keyed, matches, proximity = find_benchmark(docs, items, **options)
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda acc, r: F.struct(
            (acc["hit"] + F.greatest(r["end"] - F.greatest(r["start"], acc["reach"]), F.lit(0).cast("long"))).alias("hit"),
            F.greatest(acc["reach"], r["end"]).alias("reach"),
        ),
    )
    per_row = matches.groupBy("row").agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("len")).cast("long").alias("end"))).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = per_row.select("row", covered["hit"].alias("n_hit"), "items")
    near = proximity.groupBy("row").agg(F.count("*").alias("n_near"))
    out = keyed.select("row", "id", F.size(_words(F.col("text"), _GAP_ANY_CASE)).cast("long").alias("n_words")).join(hits, "row", "left").join(near, "row", "left")
    return out.select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
