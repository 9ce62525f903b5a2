"""Operator 3, benchmark decontamination by templates. Native: DataFrame functions only.

Numbers, units and names become typed placeholders that keep their value beside them; windows of canonical words are
hash-joined with those of the benchmark and compared word by word. The values that the placeholders of one aligned
run hold must follow a function: a value of the item always stands for the same value in the document, so
re-parameterised questions are caught and chance meetings of placeholders aren't. Whether a word is a name depends on
its case and neighbour, so windows of plain words (lower case, values kept) go through the same index and join too:
a copy with the same words is met whatever its case, line breaks or place in a sentence.

A document is contaminated by an item if consistent runs cover half of the item's words or SPAN_WORDS of them.
Null or empty texts match nothing; benchmark items of fewer than MIN_ITEM words match nothing, those under WINDOW
words match by windows of their own length; repeated rows count once; rows without doc_id aren't judged. Empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .quality import _BLANKS, _let

WINDOW, MIN_ITEM, SPAN_WORDS = 8, 4, 13
#: Windows of a document are sought by runs of this many words at a stride with which each window holds one.
ANCHOR = 5
MIN_COVERAGE = 0.5
#: Plain words (not placeholders) that a window of the benchmark must have to be met with other values.
MIN_PLAIN = 3
#: Documents with a run in common (some 50 bytes each) up to which their ids are broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Windows of the benchmark (some 300 bytes each) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 300_000
_UNITS = "km|cm|mm|kg|mg|ml|lb|lbs|oz|mi|ft|mph|kmh|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|grams?|liters?|litres?|pounds?|dollars?|euros?|cents?|usd|eur|percent|degrees?"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…—–¿¡"


def canonical(text: Column) -> Column:
    """Words in lower case without punctuation; a placeholder word is \\x01kind\\x02value."""

    def marked(text: Column) -> Column:
        # a capitalised word after a lower-case one
        named = F.regexp_replace(text, r"(\p{Lu}(?<=\p{Ll}[,;]? \p{Lu})[\p{L}'-]+)", "\x01name\x02$1")
        counted = lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?i)(?<=\d)( ?)({_UNITS})\b", "$1\x01unit\x02$2"), r"(\d+(?:[.,:/]\d+)*)", "\x01num\x02$1")
        return _let(named, lambda x: F.when(text.rlike(r"\d"), counted(x)).otherwise(x))

    # a line break is a blank to the look-behind
    blank = lambda x: F.when(x.rlike(rf"[{_BLANKS}]|  "), F.regexp_replace(x, rf"[ {_BLANKS}]+", " ")).otherwise(x)
    return _split(_let(_let(_unmarked(text), blank), marked))


def plain(text: Column) -> Column:
    """The same words as canonical(text), without placeholders."""
    return _split(_unmarked(text))


def unmarked_words(words: Column) -> Column:
    """plain(text) from canonical(text): each word without its marks."""
    return F.transform(words, lambda x: F.when(F.contains(x, F.lit("\x02")), F.regexp_replace(x, "\x01[a-z]+\x02", "")).otherwise(x))


def _unmarked(text: Column) -> Column:
    return F.when(text.contains("\x01") | text.contains("\x02"), F.translate(text, "\x01\x02", "  ")).otherwise(text)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.translate(text, _BLANKS + _PUNCTUATION, " " * len(_BLANKS))), " +"), "")


def _kind(word: Column) -> Column:
    return F.substring_index(word, "\x02", 1)


def _windows(words: Column, size: int) -> Column:
    """An array of h, place, words for all windows of size words."""

    def hashed(w: Column) -> Column:
        kinds = F.transform(w, lambda x: F.xxhash64(_kind(x)))
        return _let(kinds, lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(F.xxhash64(*[F.get(k, i + j) for j in range(size)]).alias("h"), i.alias("place"), F.slice(w, i + 1, size).alias("words"))))

    empty = F.array().cast("array<struct<h:bigint,place:int,words:array<string>>>")
    return _let(words, lambda w: F.when(F.size(w) < size, empty).otherwise(hashed(w)))


def _runs(words: Column, sizes: list[int]) -> Column:
    """Hashes of runs of words such that every window of one of the sizes holds a run."""

    def hashed(k: Column, size: int) -> Column:
        n = min(size, ANCHOR)
        places = F.sequence(F.lit(0), F.size(k) - n, F.lit(size - n + 1))
        return F.when(F.size(k) < size, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(F.lit(size), *[F.get(k, i + j) for j in range(n)])))

    kinds = F.transform(words, lambda x: F.xxhash64(_kind(x)))
    return _let(kinds, lambda k: F.concat(*[hashed(k, size) for size in sizes or [WINDOW]]))


def template_index(benchmark: DataFrame, text: str = "text") -> tuple[DataFrame, list[int]]:
    """h, size, plain, item_id, item_place, item_words, item_size of the benchmark's windows, with placeholders and plain
    ones; the window sizes in use."""
    own = F.col(text)
    items = benchmark.filter(own.isNotNull()).select("item_id", canonical(own).alias("w"), plain(own).alias("v")).withColumn("n", F.size("w")).filter(F.col("n") >= MIN_ITEM)
    items = staged(items.dropDuplicates(["item_id", "w"]), "items")
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(WINDOW))).distinct().collect())  # at most WINDOW numbers
    found = None
    for size in sizes or [WINDOW]:
        mine = items.filter(F.least("n", F.lit(WINDOW)) == size).withColumn("size", F.lit(size))
        for words in ("w", "v"):
            part = mine.select("item_id", F.col("n").alias("item_size"), "size", F.lit(words == "v").alias("plain"), F.inline(_windows(F.col(words), size)))
            found = part if found is None else found.union(part)
    unmarked = F.size(F.filter("words", lambda x: ~F.contains(x, F.lit("\x02"))))
    found = found.filter(F.col("plain") | (unmarked >= MIN_PLAIN))
    return staged(found.select("h", "size", "plain", "item_id", F.col("place").alias("item_place"), F.col("words").alias("item_words"), "item_size"), "templates"), sizes


def template_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, covered, coverage, exact for each pair whose runs cover anything. covered counts the words in
    windows with placeholders and, where these aren't enough, those in plain windows too."""
    index, sizes = template_index(benchmark)
    small = index.count() <= BROADCAST_WINDOWS
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    words = texts.select("doc_id", canonical(F.col("text")).alias("w")).withColumn("v", unmarked_words(F.col("w")))
    runs = words.select("doc_id", F.explode(F.array_union(_runs(F.col("w"), sizes), _runs(F.col("v"), sizes))).alias("run"))
    known = None
    for size in sizes or [WINDOW]:
        n = min(size, ANCHOR)
        mine = index.filter(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - n)), lambda i: F.slice("item_words", i + 1, n))).alias("r"))
        mine = mine.select(F.xxhash64(F.lit(size), *[F.xxhash64(_kind(F.get("r", k))) for k in range(n)]).alias("run"))
        known = mine if known is None else known.union(mine)
    known = known.distinct()
    met = staged(runs.join(F.broadcast(known) if small else known, "run", "left_semi").select("doc_id").distinct(), "met")
    met = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
    index = F.broadcast(index) if small else index
    canon = texts.join(met, "doc_id", "left_semi").select("doc_id", canonical(F.col("text")).alias("w")).withColumn("v", unmarked_words(F.col("w")))
    both = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(words == "v").alias("plain"), F.col(words).alias("k")) for size in sizes or [WINDOW] for words in ("w", "v")])
    canon = canon.select("doc_id", F.inline(both))
    hits = None
    for size in sizes or [WINDOW]:
        mine = canon.filter(F.col("size") == size).select("doc_id", "plain", F.inline(_windows(F.col("k"), size))).withColumn("size", F.lit(size))
        hits = mine if hits is None else hits.union(mine)
    same = F.transform("words", _kind) == F.transform("item_words", _kind)
    slots = F.filter(F.zip_with("item_words", "words", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: F.contains(p["a"], F.lit("\x02")))
    hits = hits.join(index, ["h", "size", "plain"]).filter(same)
    hits = hits.select("doc_id", "item_id", "item_size", "size", "plain", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), slots.alias("slots"))
    # runs: windows of one item at one shift. In a run whose values don't follow a function, plain windows count only
    # where no window with placeholders was met
    hits = hits.withColumns({"t": F.when(~F.col("plain"), F.col("item_place")), "v": F.when(F.col("plain"), F.col("item_place"))})
    runs = hits.groupBy("doc_id", "item_id", "item_size", "size", "shift").agg(F.collect_set("t").alias("t"), F.collect_set("v").alias("v"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    exact = ~F.col("ok") | F.forall("slots", lambda p: p["a"] == p["b"])
    runs = runs.withColumn("ok", consistent).withColumns({"t": F.when(F.col("ok"), F.col("t")).otherwise(F.slice("t", 1, 0)), "v": F.when(F.col("ok"), F.array_union("t", "v")).otherwise(F.array_except("v", "t"))})
    places = {x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in ("t", "v")}
    pairs = runs.filter(F.size("v") > 0).groupBy("doc_id", "item_id", "item_size", "size").agg(*places.values(), F.bool_and(exact).alias("exact"))
    gaps = "aggregate(transform({0}, (x, i) -> least(size, coalesce(get({0}, i + 1) - x, size))), 0, (a, x) -> a + x)"
    pairs = pairs.withColumns({x: F.expr(gaps.format(x)).cast("long") for x in places})
    covered = F.when(_enough(F.col("t"), F.col("t") / F.col("item_size")), F.col("t")).otherwise(F.col("v"))
    return pairs.withColumn("covered", covered).select("doc_id", "item_id", "covered", (F.col("covered") / F.col("item_size")).alias("coverage"), "exact")


def _enough(covered: Column, coverage: Column) -> Column:
    return (coverage >= MIN_COVERAGE) | (covered >= SPAN_WORDS)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """A row for each contaminated document: doc_id, n_items, item_id (best covered), covered, coverage, exact, item_ids."""
    pairs = template_matches(docs, benchmark, text).filter(_enough(F.col("covered"), F.col("coverage")))
    best = F.max_by(F.struct("item_id", "covered", "coverage", "exact"), F.struct(F.col("coverage"), -F.col("item_id")))
    out = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), best.alias("best"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return out.select("doc_id", "n_items", "best.*", "item_ids")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    bad = staged(contaminated(docs, benchmark, text).select("doc_id"), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
