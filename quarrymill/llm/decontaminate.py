"""Benchmark decontamination by templates: numbers, units and names become typed placeholders.

Windows of template words are hash-joined with those of the benchmark; windows that are mostly
placeholders take no part. The matches of one text near one diagonal (place in the text less
place in the item) are an occurrence. It counts if the slots agree: each value of the item stands
for one value in the text throughout. So a question asked again with other numbers is found, and a
chance mixture isn't. A second way takes every word as it is, in lower case, for texts whose case
tells nothing. All on DataFrame functions.

What becomes a placeholder: words that begin with a digit, with or without a currency sign, and
number words; units after a number; capitalised words. Digit groups are one number ("1,200") and
runs of numbers or of names one placeholder, so a slot's values may differ in their count of words.
A capitalised word that opens a sentence may be a name or not: it is a placeholder whose value
is bound to nothing. Words in capitals are words.

Only texts that hold some of the words, up to three together, that every match must hold are read so closely.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, few_broadcast, whole

WINDOW, LITERALS, COVERAGE = 8, 5, 0.5
#: Words put in or left out within an item, all in all to either side, that its occurrence may have.
SPREAD = 3
#: Windows of the benchmark that may be broadcast, 40 bytes each or so; more are joined by shuffling.
BROADCAST_WINDOWS = 500_000
#: Words and runs of words that texts are looked over for; beyond so many every text is read closely.
ANCHORS = 100_000
UNITS = ["%", "cm", "days", "dollars", "euros", "feet", "ft", "g", "h", "hours", "inches", "kg", "km", "l", "lb", "m", "meters", "metres", "miles", "min", "minutes", "ml", "mm", "months", "percent", "pounds", "s", "seconds", "weeks", "years", "€", "$"]
NUMBER_WORDS = ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "dozen"]
NUMBER, UNIT, NAME, OPEN = "<number>", "<unit>", "<name>", "<open>"
WAYS = ["template", "literal"]


def bare(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".!?")))


def words_of(text: Column) -> Column:
    """Words as they stand, with the mark that ends a sentence; a comma between a digit and three digits is left out."""
    for _ in range(2):
        text = F.regexp_replace(text, "([0-9]),([0-9]{3})", "$1$2")
    return F.filter(F.split(text, r"[^\p{L}\p{N}.!?%€$]+"), lambda w: F.length(F.rtrim(w, F.lit(".!?"))) > 0)


def kinds_of(words: Column, low: Column) -> Column:
    """For each word the kind of placeholder, or null; ``low`` has the words in lower case without marks."""
    # The cheap tests come first, as nearly every word passes them.
    first = lambda w: F.substring(w, 1, 1)
    digit = lambda w: (w >= "0") & (w < ":") | ((w >= "€") & (w < "₭") | (w >= "$") & (w < "%")) & w.rlike("^[€$][0-9]")
    numeric = lambda w, l: digit(w) | l.isin(NUMBER_WORDS)

    def one(w: Column, i: Column) -> Column:
        before, mine = F.when(i > 0, F.try_element_at(words, i)), F.try_element_at(low, i + 1)
        named = (first(w) != F.lower(first(w))) & w.rlike(r"^\p{Lu}") & (w.rlike(r"\p{Ll}") | (F.length(mine) == 1))
        opens = before.isNull() | before.rlike("[.!?]$")
        follows = mine.isin(UNITS) & F.coalesce(numeric(before, F.when(i > 0, F.try_element_at(low, i))), F.lit(False))
        return F.when(numeric(w, mine), NUMBER).when((i > 0) & follows, UNIT).when(named, F.when((i == 0) | opens, OPEN).otherwise(NAME))

    return F.transform(words, one)


def read(texts: DataFrame, key: str, way: str) -> DataFrame:
    """(key, t, v): the template words of each text and, for placeholders, kind and value."""
    split = texts.select(key, words_of(F.col("_text")).alias("_w")).filter(F.size("_w") > 0)
    split = split.select(key, "_w", F.transform("_w", bare).alias("_l"))
    if way == "literal":
        return split.select(key, F.col("_l").alias("t"), F.array_repeat(F.lit(None).cast("string"), F.size("_l")).alias("v"))
    split = split.select(key, "_l", kinds_of(F.col("_w"), F.col("_l")).alias("_k"))

    def goes_on(kind: Column, i: Column) -> Column:
        """Whether the word at i belongs to the placeholder before it."""
        before = F.when(i > 0, F.try_element_at(F.col("_k"), i))
        return kind.isNotNull() & F.coalesce((kind == NUMBER) & (before == NUMBER) | (kind == NAME) & before.isin(NAME, OPEN), F.lit(False))

    both = F.arrays_zip(F.col("_l").alias("l"), F.col("_k").alias("k"))
    split = split.select(key, F.filter(both, lambda x, i: ~goes_on(x["k"], i)).alias("_x"))
    return split.select(key, F.transform("_x", lambda x: F.when(x["k"].isNull(), x["l"]).when(x["k"] == OPEN, NAME).otherwise(x["k"])).alias("t"), F.transform("_x", lambda x: F.concat(x["k"], x["l"])).alias("v"))


def windows(texts: DataFrame, key: str, way: str, sizes: list[int] | None = None) -> DataFrame:
    """(key, size, at, hash, slots): each window of template words of each of the ``sizes``; ``slots`` joins the values.

    Without ``sizes``, for benchmark items: each has windows of WINDOW words, or one of all its words; ``words`` has them.
    """
    made = read(texts, key, way).select(key, "t", "v", F.size("t").alias("n"), F.transform("t", lambda t: F.xxhash64(t)).alias("h"), F.forall("v", lambda v: v.isNull()).alias("plain"))

    def each(size: Column) -> Column:
        starts = F.when(F.col("n") >= size, F.sequence(F.lit(1), F.col("n") - size + 1)).otherwise(F.array().cast("array<int>"))
        slots = lambda i: F.when(F.col("plain"), F.lit("")).otherwise(F.array_join(F.slice("v", i, size), "\u0001"))
        return F.transform(starts, lambda i: F.struct(size.cast("int").alias("size"), i.alias("at"), F.xxhash64(F.slice("h", i, size)).alias("hash"), slots(i).alias("slots")))

    if sizes is None:
        found = made.select(key, "t", F.inline(each(F.least(F.lit(WINDOW), F.col("n")))))
        return found.select(key, "size", "at", "hash", "slots", F.expr("slice(t, at, size)").alias("words"))
    return made.select(key, F.inline(reduce(F.concat, [each(F.lit(s)) for s in sizes])))


def filled(slots: str) -> Column:
    return F.when(F.col(slots) == "", 0).otherwise(F.size(F.split(slots, "\u0001")))


def items_windows(benchmark: DataFrame, way: str, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows that are looked for. If placeholders leave an item none, all its windows are."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("_text")).filter("item_id is not null and _text is not null").distinct()
    made = windows(items, "item_id", way).filter(F.col("size") - filled("slots") >= F.least(F.lit(LITERALS), F.col("size")))
    return cut(made.select("item_id", F.col("at").alias("item_at"), "size", "hash", F.col("slots").alias("item_slots"), "words"))


def anchors(theirs: DataFrame) -> dict[int, list[int]] | None:
    """By length, hashes of one, two or three words that stand together in a window: for each the longest there is, and of these the one that fewest items hold.

    None where a window has no word of letters alone, or for too many.
    """
    plain = lambda w: w.rlike(r"^\p{L}+$") & ~w.rlike("[σς]")
    at = lambda i: F.try_element_at(F.col("words"), i)
    good = lambda i: F.coalesce(plain(at(i)), F.lit(False))

    def run(i: Column) -> Column:
        two = F.when(good(i + 1), at(i + 1)).otherwise("")
        return F.struct(at(i).alias("a"), two.alias("b"), F.when((two != "") & good(i + 2), at(i + 2)).otherwise("").alias("c"))

    runs = F.transform(F.filter(F.sequence(F.lit(1), F.size("words")), good), run)
    chosen = theirs.select("item_id", "item_at", runs.alias("p"))
    if not chosen.filter(F.size("p") == 0).isEmpty():
        return None
    each = chosen.select("item_id", "item_at", F.inline("p")).withColumn("n", F.lit(1) + (F.col("b") != "").cast("int") + (F.col("c") != "").cast("int"))
    held = each.groupBy("a", "b", "c").agg(F.count_distinct("item_id").alias("held"))
    told = each.join(held, ["a", "b", "c"]).select("item_id", "item_at", F.struct((-F.col("n")).alias("n"), "held", (-F.length("a")).alias("l"), "a", "b", "c").alias("o"))
    best = told.groupBy("item_id", "item_at").agg(F.min("o").alias("o")).select((-F.col("o.n")).alias("n"), F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.col("o.c").alias("c"))
    hashed = F.when(F.col("n") == 1, F.xxhash64("a")).when(F.col("n") == 2, F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c"))
    found = best.select("n", hashed.alias("h")).distinct().limit(ANCHORS + 1).collect()
    return {n: sorted(r["h"] for r in found if r["n"] == n) for n in (1, 2, 3)} if len(found) <= ANCHORS else None


def anchored(texts: DataFrame, key: str, found: dict[int, list[int]]) -> DataFrame:
    """The keys of the texts that hold an anchor; their words are runs of letters in lower case.

    Each place of a text is a row with the words that follow, so that all of it is compiled; nothing but the keys found is shuffled.
    """
    words = texts.select(key, F.split(F.lower("_text"), r"[^\p{L}]+").alias("_1"))
    onward = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    words = words.select(key, "_1", onward(F.col("_1")).alias("_2"))
    words = words.select(key, "_1", "_2", onward(F.col("_2")).alias("_3"))
    places = words.select(key, F.inline(F.arrays_zip("_1", "_2", "_3")))
    held = F.lit(False)
    for n, hashes in found.items():
        if hashes:
            held = held | F.xxhash64(*[f"_{k + 1}" for k in range(n)]).isin(hashes)
    return places.filter(held).select(key).distinct()


def occurrences(texts: DataFrame, theirs: DataFrame, way: str, spread: int = SPREAD, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows): the items whose best occurrence has at least ``coverage`` of their windows with agreeing slots.

    An occurrence is the windows met on one diagonal, or on up to ``spread`` diagonals to either side of one, as words put in or left out shift what follows.
    """
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect())
    totals = theirs.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    few = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sought = theirs.drop("words")
    mine = windows(texts, "doc_id", way, sizes or [WINDOW])
    met = mine.join(F.broadcast(sought) if few else sought, ["size", "hash"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "slots", "item_slots").distinct()
    offsets = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(wide).alias("wide")) for o, wide in [(0, False), *[(o, True) for o in range(-spread, spread + 1)]]])
    met = met.select("doc_id", "item_id", "diagonal", "item_at", "slots", "item_slots", F.inline(offsets)).withColumn("diagonal", F.col("diagonal") + F.col("o"))
    none = F.array().cast("array<struct<theirs:string,mine:string>>")
    pairs = F.arrays_zip(F.split("item_slots", "\u0001").alias("theirs"), F.split("slots", "\u0001").alias("mine"))
    tied = F.filter(pairs, lambda p: ~p["theirs"].startswith(OPEN) & ~p["mine"].startswith(OPEN))
    occurrence = met.groupBy("doc_id", "item_id", "diagonal", "wide").agg(F.count_distinct("item_at").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("item_slots") == "", none).otherwise(tied)))).alias("values"))
    agree = F.size(F.array_distinct(F.transform("values", lambda v: v["theirs"]))) == F.size("values")
    best = occurrence.filter(agree).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))
    joined = best.join(F.broadcast(totals) if few else totals, "item_id")
    return joined.filter(F.col("n_windows") >= F.col("item_windows") * coverage).select("doc_id", "item_id", "n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ways: list[str] = WAYS) -> DataFrame:
    """(doc_id, item_id, template_windows, literal_windows): the items that a text holds, with the windows of the best occurrence by either way, 0 if that way doesn't find it.

    Items shorter than a window are matched whole. Null and empty texts and items match nothing; rows without an id are passed over; repeated rows count once.
    """
    theirs = {way: items_windows(benchmark, way, item_col, item_text_col) for way in ways}
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).filter("doc_id is not null")
    found = [anchors(t) for t in theirs.values()]
    if all(f is not None for f in found):
        near = cut(anchored(texts, "doc_id", {n: sorted({h for f in found for h in f[n]}) for n in (1, 2, 3)}))
        texts = cut(texts.join(few_broadcast(near), "doc_id", "left_semi"))
    each = [occurrences(texts, t, way).select("doc_id", "item_id", F.lit(way).alias("way"), "n_windows") for way, t in theirs.items()]
    said = reduce(DataFrame.unionByName, each).groupBy("doc_id", "item_id")
    return said.agg(*[F.max(F.when(F.col("way") == way, F.col("n_windows")).otherwise(F.lit(0).cast("long"))).alias(f"{way}_windows") for way in WAYS])
