import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from visagelake.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    spans = {}
    for i in range(len(words) - 4):
        spans.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in spans.values() if len(at) > 1 for i in at for k in range(5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        doubled += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)


ODD = [None, "", " ", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\nx\n\n\n x\nx", "é ü #*", "w " * 30000, "y\u001cz \x1f", "one two\r\nthree\r\n", "a b c d e f a b c d e f g h i j k l m n o p q r s t u v w x y z"]


def test_base_equals_plain(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "some words", None, None, 1)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows += [(r.doc_id + 100, r.text, r.lang, r.source, 1) for r in docs.collect()]
    out = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_per_group(spark):
    rng = random.Random(2)
    words = ["ale", "bird", "coast", "dune", "elder", "fjord", "gale", "harbour", "iris", "juniper", "kelp", "lagoon"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    rows = [(i, text(rng.randint(40, 300)), "en", "s0" if i % 3 else "s1") for i in range(600)]
    rows += [(1000 + i, re.sub(r" ", "%%% ", text(100)), "en", "s0") for i in range(60)]
    rows += [(2000 + i, text(100), "xx", "tiny") for i in range(5)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert sum(got[i].kept for i in range(600)) >= 594
    assert not any(got[1000 + i].kept for i in range(60))
    assert all(got[2000 + i].kept and got[2000 + i].distance is None for i in range(5))
    again = {r.doc_id: r.kept for r in rules.judge(docs.repartition(7)).collect()}
    assert again == {i: r.kept for i, r in got.items()}


def test_small_groups_are_judged_by_a_pool(spark):
    rng = random.Random(3)
    words = ["ale", "bird", "coast", "dune", "elder", "fjord", "gale", "harbour", "iris", "juniper", "kelp", "lagoon"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    junk = lambda: text(100).replace(" ", "%%% ")
    rows = [(i, text(rng.randint(40, 300)), "en", f"s{i % 20}") for i in range(300)]
    rows += [(1000, junk(), "en", "rare"), (1001, junk(), None, "s3"), (1002, junk(), "xx", None), (1003, junk(), None, None)]
    rows += [(2000, text(100), "en", "rare"), (2001, text(100), None, "s3"), (2002, text(100), "xx", None), (2003, "short", "yy", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = rules.judge(docs).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) == len(got)
    assert all(r.distance is None and r.pooled_distance is not None for r in out)
    assert sum(got[i].kept for i in range(300)) >= 297 and all(got[i].kept for i in (2000, 2001, 2002))
    assert not any(got[i].kept for i in (1000, 1001, 1002, 1003, 2003))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rules.judge(docs).collect() == []


def exact_estimate(x, share, least):
    """The subset of least determinant among all of them."""
    found = []
    for some in itertools.combinations(range(len(x)), round(share * len(x))):
        near = x[list(some)]
        cov = rules.scatter(near.mean(axis=0), near.T @ near / len(near), share, least)
        found.append((np.linalg.slogdet(cov)[1], near.mean(axis=0), cov))
    return min(found, key=lambda f: f[0])


def test_estimates_equal_the_exact_minimum(spark):
    draw = np.random.default_rng(5)
    least = np.full(6, 1e-6)
    data = {}
    for g in ("a", "b", "c"):
        x = draw.normal(size=(16, 6)) @ draw.normal(size=(6, 6))
        x[draw.choice(16, 4, replace=False)] += 30 * draw.normal(size=6)
        data[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in data.items() for v in x], ["group", *rules.VECTOR])
    got = {r.group: r for r in rules.estimate(rows, 0.75, 20, least).collect()}
    for g, x in data.items():
        _, mean, cov = exact_estimate(x, 0.75, least)
        assert np.allclose(got[g].centre, mean) and np.allclose(np.array(got[g].inverse).reshape(6, 6), np.linalg.inv(cov), rtol=1e-4)


def test_the_covariance_decides(spark):
    """Rows that are ordinary in every statistic and odd only in how two of them go together."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(900, 6))
    x[:, 1] = 2 * x[:, 0] + 0.1 * x[:, 1]
    odd = draw.normal(size=(30, 6)) * 0.3
    odd[:, 0], odd[:, 1] = 1.0, -2.0
    rows = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(np.vstack([x, odd]))], ["id", "group", *rules.VECTOR])
    model = rules.estimate(rows.drop("id"), 0.75, 20, np.full(6, 1e-9))
    far = rows.join(model, "group").where(rules.distance(F.col("centre"), F.col("inverse")) > F.col("cutoff"))
    got = {r.id for r in far.collect()}
    assert set(range(900, 930)) <= got and len(got) <= 33
    assert (np.abs(odd) < 3 * np.abs(x).std(axis=0)).all()


def test_cutoff_nears_chi_squared():
    assert abs(rules.cutoff(1e7, 0.75) / 27.856 - 1) < 0.02 and abs(rules.consistency(0.75) - 1.362) < 1e-3
    assert rules.cutoff(100, 0.75) > rules.cutoff(1000, 0.75) > 27.8


def test_masses_of_copies_do_not_shrink_the_scatter(spark):
    rng = random.Random(8)
    words = ["ale", "bird", "coast", "dune", "elder", "fjord", "gale", "harbour", "iris", "juniper", "kelp", "lagoon"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    copy = text(90)
    rows = [(i, text(rng.randint(40, 300)), "en", "s") for i in range(100)] + [(1000 + i, copy, "en", "s") for i in range(900)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(100)) >= 98 and all(got[1000 + i] for i in range(900))
