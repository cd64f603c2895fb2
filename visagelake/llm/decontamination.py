"""Benchmark decontamination by template windows.

Words become a template: numbers, units after a number and capitalised names inside a sentence turn into typed
placeholders, runs of names or of numbers into one, everything else is lower-cased. Two kinds of windows are hashed and
joined with those of the benchmark: windows of the template, and short windows of the lower-cased words themselves, which
find verbatim copies in any case, items that are mostly placeholders, and, by the words between the placeholders, items
whose names are not written with capitals. The hits of one kind in a document and an item are chained over nearby
offsets, so that inserted or left out words do not cut an item in two, and give its coverage; then the words behind the
placeholders must correspond one to one, so that a question with other numbers or names is caught and a chance likeness
of templates is not. Built from DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables

NUMBER, NAME, UNIT = "\x02num", "\x02name", "\x02unit"
RAW_TOKENS = r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*"
TOKENS = RAW_TOKENS + r"|[.!?:;|\n%$€£]"
STOPS = tuple(".!?:;|\n")
SIGNS = tuple("%$€£")
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz lb lbs pound pounds ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degree degrees dollar dollars euro euros cent cents "
    "kmh mph hz khz mhz ghz w kw kwh v volt volts a amp amps j joule joules n newton newtons pa bar k kb mb gb tb"
).split()


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once a row, not wherever use() names it inside of a lambda."""
    return F.transform(F.array(value), use)[0]


def typed(tokens: Column, word: Column, at: Column) -> tuple[Column, Column]:
    """(kind, goes on) of a word among the tokens of a text: a placeholder or the word in lower case, null for marks; and
    whether it goes on with a run of names or numbers. Small letters, the common case, are told first."""
    low = F.lower(word)
    before, earlier = F.get(tokens, at - 1), F.get(tokens, at - 2)
    digit = lambda w: (w >= "0") & (w < ":")
    mark = lambda w: w.isin(*STOPS, *SIGNS)
    capital = lambda w: (F.char_length(w) > 1) & (F.lower(w) != w) & (F.substring(w, 2, 1 << 20) == F.substring(F.lower(w), 2, 1 << 20))
    name = capital(word) & before.isNotNull() & ~mark(before)
    small_letters = F.when(digit(word), F.lit(NUMBER)).when(mark(word), F.lit(None)).when(F.coalesce(digit(before), F.lit(False)) & low.isin(*UNITS), F.lit(UNIT)).otherwise(low)
    kind = F.when(word == low, small_letters).when(name, F.lit(NAME)).otherwise(low)
    goes_on = F.when(word == low, digit(word) & digit(before)).otherwise(name & capital(before) & earlier.isNotNull() & ~mark(earlier))
    return kind, F.coalesce(goes_on, F.lit(False))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def raw_words(text: Column) -> Column:
    """Words and numbers in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RAW_TOKENS), F.lit(0))


def template(text: Column) -> Column:
    """The template: kinds of the words, a run as one."""

    def one(tokens: Column, word: Column, at: Column) -> Column:
        kind, goes_on = typed(tokens, word, at)
        return F.when(~goes_on, kind)

    return let(tokens_of(text), lambda tokens: F.filter(F.transform(tokens, lambda w, i: one(tokens, w, i)), lambda k: k.isNotNull()))


def described(df: DataFrame, text: Column) -> DataFrame:
    """df with `raw` (words), `kinds` (their kinds), `canon` (the template) and `slots` (the words behind it, all those of a
    run)."""

    def one(tokens: Column, word: Column, at: Column) -> Column:
        kind, goes_on = typed(tokens, word, at)
        return F.struct(kind.alias("kind"), F.lower(word).alias("word"), goes_on.alias("on"))

    all_words = let(tokens_of(text), lambda tokens: F.filter(F.transform(tokens, lambda w, i: one(tokens, w, i)), lambda p: p["kind"].isNotNull()))
    named = df.withColumn("pairs", all_words)
    written = F.array_join(F.transform("pairs", lambda p: F.concat(F.when(p["on"], F.lit(" ")).otherwise(F.lit("\x03")), p["word"])), "")
    slots = F.filter(F.split(written, "\x03"), lambda w: w != "")
    columns = {"raw": F.col("pairs")["word"], "kinds": F.col("pairs")["kind"], "canon": F.filter("pairs", lambda p: ~p["on"])["kind"], "slots": slots}
    return named.withColumns(columns).drop("pairs")


def windows(words: Column, kind: str, length: int) -> Column:
    """Hashes of all windows of a kind and length, in order; none for shorter texts."""
    starts = lambda h: F.slice(h, 1, F.greatest(F.size(h) - length + 1, F.lit(0)))
    hashed = lambda h, first, i: F.xxhash64(F.lit(f"{kind}{length}"), first, *(F.get(h, i + k) for k in range(1, length)))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts(h), lambda first, i: hashed(h, first, i)))


def is_slot(kind: Column) -> Column:
    return kind.startswith("\x02")


def literals(kinds: Column, at: Column, length: int) -> Column:
    """Words of a window that are no placeholders."""
    return F.size(F.filter(F.slice(kinds, at + 1, length), lambda w: ~is_slot(w)))


#: Kinds of windows with the words of a window of the second; positions of a band.
KINDS, SHORT, BAND = ("canon", "raw"), 4, 64


def sought_windows(items: DataFrame, length: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Windows (item, version, kind, n, item_at, hash) of items, and the kinds and lengths that there are.

    A template window of a longer item needs three plain words of eight. An item of one window at most is sought as a whole if it
    has three plain words, and without its first word, which may be a name, if three are left.
    """
    size = F.size("canon")
    least = {"canon": F.least(size, F.lit(length)), "raw": F.least(F.size("raw"), F.lit(min(SHORT, length)))}
    lengths = [F.struct(F.lit(k).alias("kind"), least[k].alias("n")) for k in KINDS] + [F.struct(F.lit("canon").alias("kind"), F.when((size <= length) & (size > SHORT), size - 1).alias("n"))]
    found = items.select(F.explode(F.array(*lengths)).alias("f")).where("f.n is not null").distinct()
    kinds = sorted((r.f.kind, r.f.n) for r in found.collect())  # length + SHORT rows at most
    out = items.select("item", "version", F.lit(0).alias("item_at"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("kind"), F.lit(0).alias("n")).limit(0)
    for kind, n in kinds:
        plain = literals(F.col("canon"), F.col("item_at"), n)
        whole, headless = (size == n) & (plain >= 3), (size == n + 1) & (size <= length) & (F.col("item_at") == 1) & (plain >= 3)
        good = F.lit(True) if kind == "raw" else F.when(size <= length, whole | headless).otherwise(8 * plain >= 3 * length)
        one = items.where((least[kind] == n) | (F.lit(kind == "canon") & (size <= length) & (size == n + 1)))
        one = one.select("item", "version", "canon", F.posexplode(windows(F.col(kind), kind, n)).alias("item_at", "hash"), F.lit(kind).alias("kind"), F.lit(n).alias("n"))
        out = out.unionByName(one.where(good).drop("canon"))
    return out.distinct(), kinds


def seen_windows(texts: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(doc, text_hash, sizes, pos, hash) of all windows of texts, each text cut up once; see place()."""
    cut = F.concat(*(windows(F.col(kind), kind, n) for kind, n in kinds)) if kinds else F.array().cast("array<bigint>")
    sized = texts.select("doc", "text_hash", F.size("canon").alias("n_canon"), F.size("raw").alias("n_raw"), cut.alias("cut"))  # exploded rows carry no arrays
    # outer, as the other form puts a filter on the array's size below, which cuts up every text once more
    return sized.select("doc", "text_hash", "n_canon", "n_raw", F.posexplode_outer("cut").alias("pos", "hash"))


def place(kinds: list[tuple[str, int]]) -> Column:
    """Position of a hit in its document: that of its window among all, without the kinds and lengths before its own."""
    before, out = F.lit(0), F.lit(None).cast("int")
    for kind, n in kinds:
        out = F.when((F.col("kind") == kind) & (F.col("n") == n), F.col("pos") - before).otherwise(out)
        before = before + F.greatest(F.col(f"n_{kind}") - (n - 1), F.lit(0))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 8,
    coverage: float = 0.5,
    broadcast_rows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold benchmark items, with the items.

    Returns (id_col, item_col, covered, n_words, n_slots, verbatim), one row per pair: words of the item covered by
    matching windows, its words (of its template, where that matches best), its placeholders among them, and whether those
    hold the item's own words. An item shorter than a window is sought as one window of its length, and its numbers
    only against as many numbers. Windows with too few plain words, see sought_windows(), are sought with the item's
    own words only, not with other numbers or names.
    Where the template matches more of an item than anything else and its slots contradict each other, the pair is none. An item
    without words, a null or empty text, and null ids never match. Repeated documents or items give one row per pair of
    ids (of equal ids with different texts, and of several copies in one text, the best match). Texts of any length are cut
    up whole; what is kept of one text and item is bounded by the item's length and BAND. Only ids and texts are read, so
    other columns cannot clash.
    """
    items = described(
        benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t")).distinct(), F.col("t")
    ).withColumn("version", F.xxhash64("t")).drop("t").where(F.size("canon") > 0)
    items = tables.save(items, "items")
    sought, kinds = sought_windows(items, length)
    sought = tables.save(sought, "windows")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).withColumn("text_hash", F.xxhash64("t"))
    cut = texts.select("doc", "text_hash", raw_words(F.col("t")).alias("raw"), template(F.col("t")).alias("canon"))
    seen = seen_windows(cut, kinds)
    hits = seen.join(tables.small(sought, broadcast_rows), "hash").withColumn("shift", place(kinds) - F.col("item_at"))
    bands = F.array_distinct(F.array(*(F.struct(F.lit(side).alias("side"), F.floor((F.col("shift") + side * BAND // 2) / BAND).alias("band")) for side in (0, 1))))
    banded = hits.select("doc", "text_hash", "item", "version", "kind", "n", "item_at", "shift", F.explode(bands).alias("b"))
    pairs = banded.groupBy("doc", "text_hash", "item", "version", "kind", "b").agg(F.array_sort(F.collect_set(F.struct("item_at", "n", "shift"))).alias("hits"))
    pairs = pairs.drop("b").distinct()  # most lie in one band of either side
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["item_at"], h["item_at"] + h["n"] - 1))))
    names = {"canon": "i_canon", "raw": "i_raw", "kinds": "i_kinds", "slots": "i_slots"}
    enough = lambda covered, all_: F.size(covered) >= coverage * F.size(all_)
    literal = F.filter(F.sequence(F.lit(0), F.size("i_raw") - 1), lambda w: ~is_slot(F.get(F.col("i_kinds"), w)))
    between = enough(F.array_intersect("words", literal), literal) & (2 * F.size(F.array_intersect("words", literal)) >= length)
    likely = pairs.withColumn("words", covered).join(tables.small(items.withColumnsRenamed(names), broadcast_rows // 20), ["item", "version"])
    likely = likely.where(F.when(F.col("kind") == "canon", enough("words", F.col("i_canon"))).otherwise((enough("words", F.col("i_raw")) & (F.size("words") >= F.least(F.size("i_raw"), F.lit(length)))) | between))
    likely = likely.withColumn("n_words", F.when(F.col("kind") == "canon", F.size("i_canon")).otherwise(F.size("i_raw")))
    likely = tables.save(likely, "likely")
    again = texts.join(tables.small(likely.select("doc").distinct(), broadcast_rows), "doc", "left_semi")
    own = described(again, F.col("t")).select("doc", "text_hash", "raw", "slots").distinct()
    both = own.join(likely, ["doc", "text_hash"])
    votes = lambda shift: F.size(F.filter("hits", lambda g: g["shift"] == shift))
    ranked = F.reverse(F.array_sort(F.transform(F.array_distinct(F.col("hits")["shift"]), lambda s: F.struct(votes(s).alias("v"), s.alias("s")))))["s"]
    both = both.withColumn("shifts", ranked)
    covers = lambda s, w: F.exists("hits", lambda h: (h["shift"] == s) & (h["item_at"] <= w) & (w < h["item_at"] + h["n"]))
    shift_of = lambda w: F.when(F.size("shifts") == 1, F.get("shifts", F.lit(0))).otherwise(F.get(F.filter("shifts", lambda s: covers(s, w)), F.lit(0)))
    told = lambda w, item, doc, shift: F.struct(F.get(item, w).alias("a"), F.get(doc, w + shift).alias("b"))
    in_template = F.filter("words", lambda w: is_slot(F.get(F.col("i_canon"), w)))
    near = lambda w: F.array_contains("words", w) | F.array_contains("words", w - 1)  # noqa: E731  a placeholder in a window or right after one
    in_words = F.filter(F.sequence(F.lit(0), F.size("i_raw") - 1), lambda w: is_slot(F.get(F.col("i_kinds"), w)) & near(w))
    matched = F.when(F.col("kind") == "canon", F.transform(in_template, lambda w: told(w, F.col("i_slots"), F.col("slots"), shift_of(w)))).otherwise(
        F.transform(in_words, lambda w: told(w, F.col("i_raw"), F.col("raw"), F.coalesce(shift_of(w), shift_of(w - 1))))
    )
    both = both.select("doc", "item", "kind", "words", "n_words", F.size(matched).alias("n_slots"), F.array_distinct(matched).alias("matched"), (F.size("i_canon") <= length).alias("one_window"))
    digit = lambda w: F.coalesce(F.substring(w, 1, 1).between("0", "9"), F.lit(False))
    numbers = F.forall("matched", lambda m: ~digit(m["a"]) | (digit(m["b"]) & (F.size(F.split(m["a"], " ")) == F.size(F.split(m["b"], " ")))))
    one_to_one = (F.size(F.array_distinct(F.col("matched")["a"])) == F.size("matched")) & (F.size(F.array_distinct(F.col("matched")["b"])) == F.size("matched"))
    verbatim = F.forall("matched", lambda m: F.coalesce(m["a"] == m["b"], F.lit(False))) & (F.size("words") >= coverage * F.col("n_words"))
    best_of = F.struct((F.size("words") / F.col("n_words")).alias("share"), verbatim.alias("verbatim"), F.size("words").alias("covered"), F.col("n_words"), F.col("n_slots"))
    both = both.withColumn("agrees", one_to_one & (~F.col("one_window") | numbers))
    against = F.coalesce(F.max(F.when(~F.col("agrees") & (F.col("kind") == "canon"), F.size("words") / F.col("n_words"))), F.lit(0.0)).alias("against")
    found = both.groupBy("doc", "item").agg(F.max(F.when(F.col("agrees"), best_of)).alias("b"), against).where("b is not null and b.share >= against")
    return found.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.covered", "b.n_words", "b.n_slots", "b.verbatim"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 200_000, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id contaminated() returns; all columns stay, rows with a null id stay."""
    found = tables.save(contaminated(docs, benchmark, id_col=id_col, broadcast_rows=broadcast_rows, **options).select(id_col).distinct(), "leaks")
    return docs.join(tables.small(found, broadcast_rows), id_col, "left_anti").select(docs.columns)
