"""Benchmark passages in a corpus, by a positional inverted index.

The index has one posting (term, key, pos) for every corpus word that some test item contains; key
numbers the rows of the corpus.  It is written once, every file sorted by term, so that a look-up of
few terms skips most row groups.  Terms of no item can't take part in a match and get no posting.

Phrases: each distinct window of `width` item words is looked up by its rarest term.  A posting of
that term at `pos`, whose place in the item is `at`, puts the item on the diagonal pos - at.  The
lists of the other terms, moved by their places, are intersected with that: item place i must have its
term at diagonal + i.  Runs of at least `width` places on one diagonal are the exact matches.

Proximity: the same start from the rarest term, but the other terms of the window may lie anywhere
within `reach` words of it.  Lists meet in cells of `reach` positions.

DataFrame functions only.  All that is grouped belongs to one row of the corpus and one item.  Tables of the
size of the test set are sent to every task if their counted rows are few, and are shuffled beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.stored import sent_if_few, stored
from cliplab.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def item_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null for null."""
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class PositionalIndex:
    """Postings (term, key, pos) of a corpus; `rows` has (key, doc_id, n_words) of every row of it."""

    postings: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class TestItems:
    """Distinct word sequences of test items.

    sequences: (seq, n, terms), terms as numbers; names: (seq, item_id), one row per item of at least
    one word; vocabulary: (word, term).
    """

    sequences: DataFrame
    names: DataFrame
    vocabulary: DataFrame


def read_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> TestItems:
    """Number the words and the distinct sequences of a test set.  Items without words play no part."""
    spelled = items.select(F.col(id_col).alias("item_id"), item_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    distinct = cut_lineage(spelled.select("words").distinct().withColumn("seq", F.monotonically_increasing_id()))
    names = cut_lineage(spelled.join(distinct, "words").select("seq", "item_id").distinct())
    placed = distinct.select("seq", F.posexplode("words").alias("at", "word"))
    vocabulary = cut_lineage(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    numbered = placed.join(sent_if_few(vocabulary, chars=F.length("word")), "word")
    terms = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    sequences = cut_lineage(numbered.groupBy("seq").agg(terms.alias("terms")).withColumn("n", F.size("terms")))
    return TestItems(sequences, names, vocabulary)


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Write the postings of a vocabulary (word, term) in whole texts, in one pass over the corpus.

    Every row of `docs` has its own key, so null and repeated ids do no harm.  The first word of a row
    (or nothing, for a null or word-less text) also carries doc_id and n_words.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), item_words(F.col(text_col)).alias("words"))
    keyed = texts.withColumn("key", F.monotonically_increasing_id())
    n_words = F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).cast("long")
    spread = keyed.select("key", "doc_id", n_words.alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    head = F.coalesce("pos", F.lit(0)) == 0
    found = spread.join(sent_if_few(vocabulary, chars=F.length("word")), "word", "left").filter(F.col("term").isNotNull() | head)
    rows = found.select("term", "key", "pos", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_words")).alias("n_words"))
    written = stored(rows.sortWithinPartitions("term", "key", "pos"), "positional-index")
    return PositionalIndex(
        written.filter("term IS NOT NULL").select("term", "key", "pos"),
        written.filter("n_words IS NOT NULL").select("key", "doc_id", "n_words"),
    )


def _windows(items: TestItems, width: int) -> DataFrame:
    """(seq, start, window): all windows of `width` terms; a shorter sequence is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))
    places = items.sequences.select("seq", "terms", F.explode(starts).alias("start"))
    return places.select("seq", "start", F.slice("terms", F.col("start") + 1, F.lit(width)).alias("window"))


def _anchors(index: PositionalIndex, windows: DataFrame) -> DataFrame:
    """(seq, start, window, rare, at): one row per distinct window, with its rarest term and that term's place in the item.

    Windows with a term of no posting can't occur and are left out.
    """
    counts = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    first = windows.groupBy("window").agg(F.min(F.struct("seq", "start")).alias("first")).select("first.*", "window")
    terms = first.select("seq", "start", F.posexplode("window").alias("i", "term")).join(sent_if_few(cut_lineage(counts)), "term", "left")
    rarest = terms.groupBy("seq", "start").agg(
        F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "term", "i")).alias("rarest")
    )
    kept = first.join(rarest, ["seq", "start"]).filter("rarest.postings > 0")
    return kept.select("seq", "start", "window", F.col("rarest.term").alias("rare"), (F.col("start") + F.col("rarest.i")).alias("at"))


def phrase_runs(index: PositionalIndex, items: TestItems, width: int = 10) -> DataFrame:
    """(key, seq, doc_start, item_start, n): stretches of at least `width` words that a row and a sequence share.

    A sequence of fewer words must occur whole.  Every occurrence of a window lies in a stretch of the
    first sequence that has the window; stretches of other sequences with it may be missing.
    """
    anchored = cut_lineage(_anchors(index, _windows(items, width)))
    # windows that share an anchor are looked up once, over the places that any of them covers
    spans = anchored.groupBy("seq", "at", F.col("rare").alias("term")).agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.size("window")).alias("high")
    )
    lists = spans.join(items.sequences, "seq").select(
        "seq", "at", "term", "low", F.slice("terms", F.col("low") + 1, F.col("high") - F.col("low")).alias("around")
    )
    seeds = index.postings.join(sent_if_few(cut_lineage(lists), chars=F.size("around") * 8), "term")
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    wanted = seeds.select("key", "seq", diagonal, "low", F.posexplode("around").alias("i", "term"))
    wanted = wanted.select("key", "seq", "diagonal", (F.col("low") + F.col("i")).alias("place"), "term")
    wanted = wanted.withColumn("pos", F.col("diagonal") + F.col("place")).filter("pos >= 0").distinct()
    wanted = stored(wanted, "wanted-positions")
    met = _rows_of(index.postings, wanted).join(wanted, ["key", "pos", "term"])
    order = Window.partitionBy("key", "seq", "diagonal").orderBy("place")
    island = met.select("key", "seq", "diagonal", "place", (F.col("place") - F.row_number().over(order)).alias("island"))
    runs = island.groupBy("key", "seq", "diagonal", "island").agg(F.min("place").alias("item_start"), F.count(F.lit(1)).alias("n"))
    least = F.least(F.lit(width), items.sequences["n"])
    long_enough = runs.join(items.sequences.select("seq", least.alias("least")), "seq").filter("n >= least")
    return long_enough.select("key", "seq", (F.col("diagonal") + F.col("item_start")).alias("doc_start"), "item_start", "n")


def _rows_of(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the rows that are wanted; left whole if those are too many to be sent to every task."""
    keys = wanted.select("key").distinct()
    few = sent_if_few(keys)
    return postings if few is keys else postings.join(few, "key", "left_semi")


def proximity_runs(index: PositionalIndex, items: TestItems, width: int = 10, reach: int = 20) -> DataFrame:
    """(key, seq, item_start, pos): places of a window's rarest term with all its other terms within `reach` words, in any order."""
    anchored = cut_lineage(_anchors(index, _windows(items, width)))
    lists = anchored.select("seq", "start", F.col("rare").alias("term"), F.array_distinct("window").alias("terms"))
    seeds = index.postings.join(sent_if_few(cut_lineage(lists), chars=F.size("terms") * 8), "term")
    cell = F.floor(F.col("pos") / reach)
    wanted = seeds.select("key", "seq", "start", "pos", F.size("terms").alias("kinds"), F.explode("terms").alias("term"))
    wanted = wanted.withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1)))
    wanted = stored(wanted, "wanted-cells")
    lists = _rows_of(index.postings, wanted).withColumn("cell", cell).withColumnRenamed("pos", "other")
    near = lists.join(wanted, ["key", "term", "cell"]).filter(F.abs(F.col("other") - F.col("pos")) <= reach)
    kinds = near.select("key", "seq", "start", "pos", "kinds", "term").distinct().groupBy("key", "seq", "start", "pos", "kinds")
    met = kinds.agg(F.count(F.lit(1)).alias("found")).filter("found = kinds")
    return met.select("key", "seq", F.col("start").alias("item_start"), "pos")


def _named(runs: DataFrame, index: PositionalIndex, items: TestItems) -> DataFrame:
    return runs.join(index.rows, "key").join(items.names, "seq").drop("key", "seq", "n_words")


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n): exact matches, counted in words from 0; see `phrase_runs`."""
    test = read_items(items)
    index = build_index(docs, test.vocabulary)
    return _named(phrase_runs(index, test, width), index, test).select("doc_id", "item_id", "doc_start", "item_start", "n")


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, reach: int = 20) -> DataFrame:
    """(doc_id, item_id, item_start, pos): windows whose words stand close together in a row; see `proximity_runs`.

    One item per distinct window: the first that has it.
    """
    test = read_items(items)
    index = build_index(docs, test.vocabulary)
    return _named(proximity_runs(index, test, width, reach), index, test).select("doc_id", "item_id", "item_start", "pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, item_ids, contaminated.

    n_hit counts the words inside any occurrence of a window of `items` (item_id, text); item_ids are the
    items with occurring windows as sorted strings, null ids left out.  Null, empty and word-less texts have no
    words and are never hit; rows that repeat an id or a text are judged each; an empty table on either
    side gives no hits.  Other columns of either table are not looked at.
    """
    test = read_items(items)
    index = build_index(docs, test.vocabulary)
    runs = cut_lineage(phrase_runs(index, test, width))
    place = F.explode(F.sequence(F.col("doc_start"), F.col("doc_start") + F.col("n").cast("int") - 1))
    hits = runs.select("key", place.alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))

    windows = cut_lineage(_windows(test, width))
    start = F.explode(F.sequence(F.col("item_start"), F.greatest(F.col("item_start"), F.col("item_start") + F.col("n").cast("int") - width)))
    occurring = runs.select("key", "seq", start.alias("start")).join(sent_if_few(windows, chars=F.size("window") * 8), ["seq", "start"])
    owners = windows.select("window", F.col("seq").alias("owner")).distinct()
    owned = occurring.select("key", "window").distinct().join(owners, "window").select("key", F.col("owner").alias("seq")).distinct()
    told = owned.join(test.names, "seq").select("key", F.col("item_id").cast("string").alias("item_id")).distinct()
    lists = told.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = cut_lineage(hits.join(lists, "key"))
    judged = index.rows.join(sent_if_few(both, chars=F.length(F.array_join("item_ids", ","))), "key", "left")
    return judged.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
