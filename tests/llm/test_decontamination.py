import random
import re

import pytest

from visagelake.llm import decontamination as d

ITEM = "Anna walks 12 km to school every day, then Peter gives her 5 apples and she walks home again with 3 friends."
ROWS = [
    (1, "Some words before. " + ITEM + " Some words after."),
    (2, "Carla walks 20 km to school every day, then Hugo gives her 7 apples and she walks home again with 4 friends."),
    (3, "Nothing of the kind is found in this text, however long it may be, and nobody walks anywhere at all."),
    (4, None), (5, ""), (None, ITEM), (1, "Some words before. " + ITEM + " Some words after."),
    (6, "word " * 30000 + ITEM), (7, "Short exact item text"), (8, "short items"),
    (9, ITEM.upper()),
]
ITEMS = [(100, ITEM), (101, None), (102, ""), (103, "short exact item text"), (104, "..."), (None, ITEM), (100, ITEM)]


def test_reparameterised(spark):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in ROWS], "doc_id long, text string, item_id string, hash int")
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, canon int")
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(docs, items).collect()}
    assert {(1, 100), (2, 100), (6, 100), (7, 103)} <= set(got)
    assert not {i for i, _ in got} & {3, 4, 5, 8}
    assert got[1, 100].verbatim and got[1, 100].covered == got[1, 100].n_words and not got[2, 100].verbatim and got[2, 100].n_slots >= 4
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect() if r.doc_id != 9)[:4] == [(False, 3), (False, 4), (False, 5), (False, 8)]
    assert left.where("doc_id is null").count() == 1


def test_slots_must_agree(spark):
    item = "He counted 5 red birds, then again 5 red birds, and wrote 5 red birds in the large book on his desk."
    good, bad = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    docs = spark.createDataFrame([(1, good), (2, bad), (3, item)], "doc_id long, text string")
    got = {r.doc_id for r in d.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1, 3}


def test_marks_and_capitals_hide_nothing(spark):
    item = "The old boat lay at a quiet shore. Nobody had seen a sail there since the long and stormy winter of that year."
    docs = spark.createDataFrame([(1, "X! " + item.upper().replace(" ", "!! ")), (2, item.replace(" ", "%%% ")), (3, item.replace(" ", "$$$ ").lower())], "doc_id long, text string")
    got = {r.doc_id: r for r in d.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got.keys() == {1, 2, 3} and all(r.covered == r.n_words for r in got.values())


def test_verbatim_copies_without_literal_words_or_capitals(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2?"), (2, "Compute 125 - 37 + 48 - 9."), (3, "Der Hund von Frau Meier sah im Garten einen Vogel und der Vogel sah den Hund von Herrn Braun."), (4, "Seven grey birds sat there.")]
    rows = [(i, f"Some words before: {t} Some words after.") for i, t in items]
    rows += [(10 + i, f"some words before {t.upper()} and after") for i, t in items] + [(20 + i, f"some words before {t.lower()} and after") for i, t in items]
    rows += [(34, "they said Seven grey birds sat there"), (40, "What is 11 + 5 * 3 - 4 / 9? Compute 12 - 3 + 4 - 8."), (41, "12 7 3 4")]
    found = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert got.keys() == {(k + i, i) for k in (0, 10, 20) for i, _ in items} | {(34, 4)}
    assert all(r.verbatim and r.covered == r.n_words for r in found)


def test_shuffled_join_gives_the_same(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, d.contaminated(docs, items).collect())) == sorted(map(tuple, d.contaminated(docs, items, broadcast_rows=0).collect()))


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    squeeze = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    whole = {(x.doc_id, i.item_id) for i in items.collect() for x in docs.collect() if f" {squeeze(i.text)} " in f" {squeeze(x.text)} "}
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(docs, items).collect()}
    assert whole and whole <= set(got)
    assert all(r.covered >= r.n_words / 2 for r in got.values())
    assert len(set(got) - whole) <= 2


def test_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminated(docs, items.limit(0)).collect() == []
    assert d.contaminated(docs.limit(0), items).collect() == []


FRAMES = [
    "On Monday {a} bought {x} kg of rice and gave {y} of the bags to {b}, who sold them again. How many bags did {a} keep, if {b} paid {z} euros for each of them?",
    "A train leaves the town at {x} and drives {y} miles to the coast, where {a} waits for {b}. After {z} minutes {b} comes out of the station and greets {a} with a smile.",
    "The teacher asked {a} to share {x} pencils with {b} and with {y} other children. Each child then lost {z} pencils on the way home, so how many were left with {a}?",
    "In the garden of {a} there are {x} trees, and every tree bears {y} apples. If {b} picks {z} of them each day, how long does it take until the trees are bare?",
    "When {a} was {x} years old, the house of {b} had {y} rooms with {z} windows each, and the two of them cleaned every window before the winter came.",
]
NAMES = "Anna Peter Carla Hugo Mary-Ann Ruth Oscar Ida Walter Nora Felix Greta Simon Edith Martin Clara".split()
SURNAMES = "Miller Baker Fisher Carter Hunter Mason Porter Weaver".split()


def filled(rng, frame, longest=1):
    names = [" ".join([n, *rng.sample(SURNAMES, rng.randint(0, longest - 1))]) for n in rng.sample(NAMES, 2)]
    x, y, z = rng.sample(range(3, 900), 3)
    return frame.format(a=names[0], b=names[1], x=x, y=y, z=z)


@pytest.mark.parametrize("how", ["plain", "long names", "inserted", "lower case", "upper case", "left out"])
def test_recall_on_reparameterised_questions(spark, how):
    """Other names of one to three words, other numbers, two inserted words, other case: nine in ten at least are found."""
    rng = random.Random(how)
    items = [(k, filled(rng, frame)) for k, frame in enumerate(FRAMES)]
    rows = []
    for i in range(100):
        text = filled(rng, FRAMES[i % 5], 3 if how in ("long names", "lower case") else 1)
        words = text.split()
        if how == "inserted":
            words.insert(rng.randint(1, len(words) - 1), rng.choice(["very gladly", "of course", "so then"]))
        if how == "left out":
            del words[rng.randint(1, len(words) - 2)]
        text = " ".join(words)
        text = text.lower() if how == "lower case" else text.upper() if how == "upper case" else text
        rows.append((i, f"Something stands before it, as ever. {text} And something after it."))
    for i, text in enumerate(("They walked along the river and spoke of the weather, of the harvest and of old friends.", "The train to the coast leaves at noon, and nobody waits at the station.", "Every child lost a pencil, so the teacher bought new ones and shared them out.")):
        rows.append((1000 + i, text))
    found = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i % 5) in found for i in range(100)) >= 90
    assert not {i for i, _ in found if i >= 1000} and not {(i, k) for i, k in found if k != i % 5}


def test_runs_are_compared_whole(spark):
    items = [(1, "They met Anna Bell Carl Dora Emil at the gate of the old town hall."), (2, "The row of numbers was 1 2 3 4 5 and nothing else stood on the board.")]
    rows = [(1, items[0][1]), (2, items[1][1]), (3, items[0][1].replace("Emil", "Fritz")), (4, items[1][1].replace("4 5", "4 9"))]
    found = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.verbatim for r in found} == {(1, 1): True, (2, 2): True, (3, 1): False, (4, 2): False}


SHORT_FRAMES = [
    "Compute {x} - {y} + {z}.", "Is {x} larger than {y}?", "{a} has {x} apples and {b} has {y}.", "How many legs do {x} spiders have?", "What is {x} percent of {y}?",
    "If {a} is {x} and {b} is {y}, who is older?", "A box of {x} kg costs {y} euros.", "Divide {x} sweets among {y} children and {z} guests.",
]


def test_recall_on_short_questions(spark):
    """Short frames with other numbers and names: nine in ten at least where three words are plain, and no text of ordinary
    words. The first frame has one plain word and is sought with its own numbers only."""
    rng = random.Random(5)
    items = [(k, filled(rng, frame)) for k, frame in enumerate(SHORT_FRAMES)]
    rows = [(i, f"Something stands before it, as ever. {filled(rng, SHORT_FRAMES[i % 8])} And something after it.") for i in range(160)]
    clean = ["We compute 7 and go on.", "He is larger than she is.", "The train has 12 coaches and the bus has none.", "A box of tea costs 4 euros.", "How many legs do they have?", "What is left of it?", "Peter is 5 and lives in the house of Anna."]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    found = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hit = [sum((i, k) in found for i in range(k, 160, 8)) for k in range(8)]
    assert hit[0] == 0 and sum(hit[1:]) >= 126, hit
    assert not {(i, k) for i, k in found if i >= 1000 or k != i % 8}
