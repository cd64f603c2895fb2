"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

A candidate is a maximal run of 16 or more encoding characters that holds a letter; '=' ends it, and belongs to it only
as padding after which no encoding character follows, so that of NAME=VALUE both sides are candidates. Its encoding
(hexadecimal, base 32 or base 64) is inferred from its letters, and three tests ask how random it looks in that encoding:
chi-squared uniformity of the alphabet, runs of capitals, small letters and digits, and serial correlation; Fisher's method
joins them.

The hypothesis that is put to the test is that a token is ordinary. How random ordinary tokens look is counted over the
whole corpus, per encoding and length class: the words of every text, written together as names are and cut into
tokens of every length class, go through the same battery (words of standard modules' documentation are counted in, so that small corpora have
a measure too). A candidate's p-value is the share of ordinary tokens that look as random as it does, and the
Benjamini-Hochberg rule per encoding and length class keeps the expected share of ordinary tokens among the reported
ones at `fdr`. Short tokens are reported only where they stand out from the ordinary ones of their length.
"""

import argparse
import doctest
import json
import logging
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visagelake.operators import tables
from visagelake.llm._arrow import slices

# The base patterns, with group 2 of the first of 8, the others of 16 and 32 characters at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?")
ENCODINGS = {
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTH_CLASSES = (16, 20, 24, 32, 40, 56, 80, 128, 256)
#: Texts whose words are counted as ordinary besides those of the corpus.
STANDARD = " ".join(m.__doc__ or "" for m in (argparse, doctest, json, logging, re))
#: Bytes of text handled together.
TOGETHER = 1_000_000
#: Letters of tokens that go through the battery together.
LETTERS = 100_000
#: Lines of letters are counted in parts of so many: tokens of no length class lie across two.
PART = 4 * math.lcm(*LENGTH_CLASSES)
#: How far from random a token looks, -ln of the joined p-value, is kept in steps, for a histogram of bounded size.
STEPS, MOST = 20, 1000
#: Step from which a token is told from random ones at the level 0.01.
TOLD = int(-STEPS * math.log(0.01))

SPAN = "array<struct<kind: string, start: bigint, end: bigint, step: int>>"
FOUND = "array<struct<family: string, start: bigint, end: bigint, step: int>>"
NULL = "array<struct<family: string, step: int, n: bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Spans of the fixed patterns with their values, by start, then kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span(), m[0][4:]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def letter_class(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2


CLASS_OF = {name: np.array([letter_class(c) for c in letters]) for name, letters in ENCODINGS.items()}
#: Place of every byte in an encoding's alphabet, -1 for none.
PLACE_OF = {name: np.full(256, -1, dtype=np.int8) for name in ENCODINGS}
for _name, _letters in ENCODINGS.items():
    PLACE_OF[_name][np.frombuffer(_letters.encode(), dtype=np.uint8)] = np.arange(len(_letters))
WHOLE = re.compile(r"[A-Za-z]")


def body_of(token: str) -> str:
    return token.rstrip("=").replace("-", "+").replace("_", "/")


def infer_encoding(token: str) -> str | None:
    """The smallest encoding with all letters of a token; None without a letter."""
    body = body_of(token)
    if not WHOLE.search(body):
        return None
    return next((name for name, letters in ENCODINGS.items() if set(body) <= set(letters)), None)


def length_class(n: int) -> int:
    return max(k for k in LENGTH_CLASSES if k <= n)


#: Bounds and steps a unit of the table of normal tails; linear in between, within 1e-8.
TAIL_FROM, TAIL_TO, TAIL_STEPS = -10, 40, 5000


@cache
def tails() -> np.ndarray:
    z = np.arange(TAIL_FROM * TAIL_STEPS, TAIL_TO * TAIL_STEPS + 2) / TAIL_STEPS
    return np.array([-math.log(max(0.5 * math.erfc(v / math.sqrt(2)), 1e-300)) for v in z.tolist()])


def log_tail(z: np.ndarray) -> np.ndarray:
    """-ln of the chance that a normal variable exceeds z."""
    table = tails()
    at = (np.clip(z, TAIL_FROM, TAIL_TO) - TAIL_FROM) * TAIL_STEPS
    low = at.astype(np.int32)
    return table[low] + (at - low) * (table[low + 1] - table[low])


@cache
def bins_of(encoding: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of an alphabet for tokens of a length, each within one class of letters, and the expected counts; four a bin where it can be."""
    kinds, size = CLASS_OF[encoding], len(ENCODINGS[encoding])
    bins, expected = np.zeros(size, dtype=np.int64), []
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        for part in np.array_split(own, max(1, min(len(own), round(n * len(own) / size / 4)))):
            bins[part] = len(expected)
            expected.append(n * len(part) / size)
    return bins, np.array(expected)


def squares_of(places: np.ndarray, encoding: str) -> np.ndarray:
    """Chi-squared of tokens of one length (rows of places in the alphabet) against a uniform alphabet."""
    rows, n = places.shape
    most = max(1, LETTERS // n)
    if rows > most:
        return np.concatenate([squares_of(places[at : at + most], encoding) for at in range(0, rows, most)])
    bins, expected = bins_of(encoding, n)
    own = bins[places] + np.arange(rows)[:, None] * len(expected)
    counts = np.bincount(own.ravel(), minlength=rows * len(expected)).reshape(rows, -1).astype(float)
    return (counts * counts) @ (1 / expected) - n


def joined_steps(squares: np.ndarray, changes: np.ndarray, products: np.ndarray, encoding: str, n: int) -> np.ndarray:
    """Steps of -ln of the joined p-value of tokens of n letters, by their chi-squared, their changes between classes of letters,
    and the sum of products of neighbouring places, each counted from the middle of the alphabet."""
    size, kinds = len(ENCODINGS[encoding]), CLASS_OF[encoding]
    free = len(bins_of(encoding, n)[1]) - 1
    spread = 2 / (9 * free)
    uniform = log_tail((np.cbrt(np.maximum(squares, 1e-12) / free) - 1 + spread) / math.sqrt(spread))  # Wilson and Hilferty
    part = np.bincount(kinds, minlength=3) / size
    change, twice = 1 - (part**2).sum(), (part * (1 - part) ** 2).sum()
    wide = math.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (twice - change * change))
    runs = log_tail(((n - 1) * change - changes - 0.5) / wide)  # ordinary tokens change less often
    serial = np.abs(products) / math.sqrt(n - 1) / ((size * size - 1) / 12)
    half = uniform + runs + np.maximum(log_tail(serial) - math.log(2), 0)
    joined = half - np.log1p(half + half * half / 2)
    return np.minimum(MOST, STEPS * joined).astype(np.int64)


def battery(places: np.ndarray, encoding: str) -> np.ndarray:
    """Steps of tokens of one length (rows of places in the alphabet): large for ordinary ones."""
    rows, n = places.shape
    most = max(1, LETTERS // n)
    if rows > most:
        return np.concatenate([battery(places[at : at + most], encoding) for at in range(0, rows, most)])
    found = CLASS_OF[encoding][places]
    changes = (found[:, 1:] != found[:, :-1]).sum(axis=1)
    centred = places - (len(ENCODINGS[encoding]) - 1) / 2
    return joined_steps(squares_of(places, encoding), changes, (centred[:, 1:] * centred[:, :-1]).sum(axis=1), encoding, n)


def steps_of(tokens: list[tuple[str, str]]) -> list[int]:
    """Steps of tokens (encoding, body), those of one encoding and length together."""
    together = defaultdict(list)
    for i, (encoding, body) in enumerate(tokens):
        together[encoding, len(body)].append(i)
    out = [0] * len(tokens)
    for (encoding, n), which in together.items():
        raw = np.frombuffer("".join(tokens[i][1] for i in which).encode(), dtype=np.uint8).reshape(len(which), n)
        for i, step in zip(which, battery(PLACE_OF[encoding][raw], encoding).tolist(), strict=True):
            out[i] = step
    return out


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int]]:
    """Candidate tokens outside the base spans: encoding, start, end."""
    found = []
    for m in (part for run in RUN.finditer(text) for part in CANDIDATE.finditer(text, *run.span())):
        if m.end() - m.start() < LENGTH_CLASSES[0] or len(body_of(m[0])) < LENGTH_CLASSES[0] or any(s < m.end() and m.start() < e for _, s, e, _ in taken):
            continue
        if (encoding := infer_encoding(m[0])) is not None:
            found.append((encoding, m.start(), m.end()))
    return found


def ordinary(text: str) -> dict[str, np.ndarray]:
    """Lines of letters that ordinary tokens are cut from, of a whole text by encoding, as places in the alphabet: the words
    written together, with capitals in front and numbers here and there, for base 64; the letters that an encoding has, for the others."""
    raw = np.frombuffer(RUN.sub(" ", text).encode("utf-8", "replace"), dtype=np.uint8)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    kept = letter | ((raw >= 48) & (raw <= 57))
    first = letter & ~np.concatenate(([False], letter[:-1]))
    names = np.where(first, raw & 0xDF, raw)[kept]
    if zlib.crc32(raw) & 1:
        for k, digit in enumerate(f"20{zlib.crc32(raw) % 100:02d}"):
            names[20 + k :: 24] = ord(digit)
    small, large = np.where(letter, raw | 32, raw), np.where(letter, raw & 0xDF, raw)
    lines = {name: PLACE_OF[name][line] for name, line in (("base64", names), ("hex_lower", small), ("hex_upper", large), ("base32", large))}
    return {name: line[line >= 0] for name, line in lines.items()}


FAMILIES = [(encoding, length) for encoding in ENCODINGS for length in LENGTH_CLASSES]


def line_counts(lines: list[np.ndarray], encoding: str, length: int, sums: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many tokens of a length have each step, every line being cut from its start; tokens without a letter don't count."""
    line, letters, changes, products = sums
    sizes = np.array([len(x) for x in lines])
    n = sizes // length
    starts = np.repeat(np.cumsum(sizes) - sizes - length * (np.cumsum(n) - n), n) + length * np.arange(n.sum())
    starts = starts[letters[starts + length] > letters[starts]]
    if not len(starts):
        return np.zeros(MOST + 1, dtype=np.int64)
    ends = starts + length - 1
    places = np.lib.stride_tricks.sliding_window_view(line, length)[starts]
    steps = joined_steps(squares_of(places, encoding), changes[ends] - changes[starts], (products[ends] - products[starts]) / 4, encoding, length)
    return np.bincount(steps, minlength=MOST + 1)


def null_counts(texts: list[str]) -> np.ndarray:
    """How many ordinary tokens of the texts have each step: a row for each of FAMILIES. The lines of every text are cut
    into tokens of every length class."""
    out = np.zeros((len(FAMILIES), MOST + 1), dtype=np.int64)
    waiting, held = {name: [] for name in ENCODINGS}, dict.fromkeys(ENCODINGS, 0)

    def count(encoding: str) -> None:
        lines, waiting[encoding], held[encoding] = waiting[encoding], [], 0
        line = np.concatenate(lines)
        kind, twice = CLASS_OF[encoding][line], 2 * line.astype(np.int64) - (len(ENCODINGS[encoding]) - 1)
        upto = lambda values: np.concatenate(([0], np.cumsum(values)))
        sums = line, upto(kind < 2), upto(kind[1:] != kind[:-1]), upto(twice[1:] * twice[:-1])
        for row, (name, length) in enumerate(FAMILIES):
            if name == encoding:
                out[row] += line_counts(lines, encoding, length, sums)

    for text in texts:
        for encoding, whole in ordinary(text).items():
            for line in (whole[at : at + PART] for at in range(0, len(whole), PART)):
                if len(line) >= LENGTH_CLASSES[0]:
                    waiting[encoding].append(line)
                    held[encoding] += len(line)
                    if held[encoding] >= LETTERS:
                        count(encoding)
    for encoding in ENCODINGS:
        if waiting[encoding]:
            count(encoding)
    return out


def count_rows(counts: np.ndarray) -> list[tuple[str, int, int]]:
    """Rows (family, step, n) of null_counts()."""
    return [("{}:{}".format(*FAMILIES[row]), int(step), int(counts[row, step])) for row, step in np.argwhere(counts)]


def standard_counts() -> list[tuple[str, int, int]]:
    """Rows (family, step, n) of the ordinary tokens of STANDARD, at every length."""
    return count_rows(null_counts([STANDARD]))


BASE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("step", pa.int32())]))
FOUND_TYPE = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("step", pa.int32())]))
NULL_TYPE = pa.list_(pa.struct([("family", pa.string()), ("step", pa.int32()), ("n", pa.int64())]))


def scanned_columns(texts: list[str]) -> list[pa.Array]:
    """Columns base and found of texts."""
    spans = [base_spans(t) for t in texts]
    more = [candidates(t, s) for t, s in zip(texts, spans, strict=True)]
    values = [(infer_encoding(v), body_of(v)) for s in spans for *_, v in s]
    known = [i for i, (encoding, body) in enumerate(values) if encoding is not None and len(body) >= 8]
    base_steps = dict(zip(known, steps_of([values[i] for i in known]), strict=True))
    steps = iter(steps_of([(encoding, body_of(t[s:e])) for t, found in zip(texts, more, strict=True) for encoding, s, e in found]))
    count = iter(range(len(values)))
    base = [[{"kind": k, "start": a, "end": e, "step": base_steps.get(next(count))} for k, a, e, _ in s] for s in spans]
    found = [
        [{"family": f"{encoding}:{length_class(len(body_of(t[s:e])))}", "start": s, "end": e, "step": next(steps)} for encoding, s, e in some]
        for t, some in zip(texts, more, strict=True)
    ]
    return [pa.array(base, BASE_TYPE), pa.array(found, FOUND_TYPE)]


def scan(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with base spans, candidates with their steps, and counts of ordinary tokens (columns __base, __found and
    __null) of whole texts; a null text counts as an empty one. The ordinary tokens of all texts of a task are counted in its last row."""
    names = ["__base", "__found", "__null"]
    where = docs.columns.index(text_col)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, last, counts = [], None, np.zeros((len(FAMILIES), MOST + 1), dtype=np.int64)
        for batch in (part for whole in found for part in slices(whole, where, TOGETHER)):
            if last is not None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[]] * last.num_rows, NULL_TYPE)], names=[*last.schema.names, *names])
            texts = [t or "" for t in batch.column(where).to_pylist()]
            columns, last = [*batch.columns, *scanned_columns(texts)], batch
            counts += null_counts(texts)
        if last is not None:
            null = [{"family": f, "step": step, "n": n} for f, step, n in count_rows(counts)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[]] * (last.num_rows - 1) + [null], NULL_TYPE)], names=[*last.schema.names, *names])

    from_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(batches, f"{from_schema}, __base {SPAN}, __found {FOUND}, __null {NULL}")


def most_steps(scanned: DataFrame, fdr: float) -> dict[str, int]:
    """Per family, the largest step at which a candidate is still reported.

    The histograms have a row for each family and step at most (36 families, 1001 steps); what comes to the driver
    is a row for each family.
    """
    spark = scanned.sparkSession
    candidates_ = scanned.select(F.explode("__found").alias("f")).groupBy("f.family", "f.step").agg(F.count("*").alias("k"))
    null = scanned.select(F.explode("__null").alias("f")).groupBy("f.family", "f.step").agg(F.sum("f.n").alias("n"))
    null = null.unionByName(spark.createDataFrame(standard_counts(), "family string, step int, n long"))
    both = candidates_.withColumn("n", F.lit(0).cast("long")).unionByName(null.withColumn("k", F.lit(0).cast("long"))).groupBy("family", "step").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    family = Window.partitionBy("family")
    upto = family.orderBy("step")
    ranked = both.select("family", "step", F.col("k").alias("own"), *(F.sum(c).over(w).alias(a) for c, w, a in (("k", upto, "k"), ("k", family, "m"), ("n", upto, "n"), ("n", family, "all"))))
    p = (1 + F.col("n")) / (1 + F.col("all"))
    reported = ranked.where((F.col("own") > 0) & (p <= fdr * F.col("k") / F.col("m")))
    return {r.family: r.step for r in reported.groupBy("family").agg(F.max("step").alias("step")).collect()}


def all_spans(steps: dict[str, int]) -> F.Column:
    """Base spans and the candidates that are reported, by start, then kind."""
    most = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]) if steps else F.create_map().cast("map<string,int>")
    kept = F.filter("__found", lambda f: f["step"] <= F.coalesce(F.try_element_at(most, f["family"]), F.lit(-1)))
    plain = lambda kind: lambda f: F.struct(kind(f).alias("kind"), f["start"].alias("start"), f["end"].alias("end"))
    order = F.array(*map(F.lit, KINDS))

    def by_start(a: F.Column, b: F.Column) -> F.Column:
        rank = lambda s: s["start"] * len(KINDS) + F.array_position(order, s["kind"])
        return (rank(a) - rank(b)).cast("int")

    return F.array_sort(F.concat(F.transform("__base", plain(lambda f: f["kind"])), F.transform(kept, plain(lambda _: F.lit("random")))), by_start)


def find_secrets(docs: DataFrame, fdr: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of whole texts.

    Returns (id_col, spans array<struct<kind, start, end>>, n_base_ordinary), one row per input row; spans by start, then kind
    (assign, access, hex, random), positions in code points, ends exclusive. n_base_ordinary counts the spans of fixed
    patterns whose value the battery tells from a random one; they stay. A null or empty text has no spans, a null id
    stays null, repeated rows are scanned again (and count again among the candidates), other columns are not carried.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = tables.save(scan(source, "text").drop("text"), "secrets")
    told = F.size(F.filter("__base", lambda b: F.coalesce(b["step"] >= TOLD, F.lit(False)))).cast("long")
    return scanned.select(F.col("id").alias(id_col), all_spans(most_steps(scanned, fdr)).alias("spans"), told.alias("n_base_ordinary"))


def redact(docs: DataFrame, fdr: float = 0.1, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret span of the text replaced by a mark, and the length column set anew.

    Keeps all rows and columns, repeated rows too, whatever their names. Overlapping spans are replaced as one; a null text
    stays null. One pass scans and keeps the rows with what it found; only rows with spans are cut.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    scanned = tables.save(scan(inner, names[docs.columns.index(text_col)]), "secrets")
    marked = scanned.withColumn("__base", all_spans(most_steps(scanned, fdr))).drop("__found", "__null")
    where = docs.columns.index(text_col)

    def cut(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, where, TOGETHER)):
            columns = list(batch.columns[:-1])
            texts = [cut(t, s) for t, s in zip(columns[where].to_pylist(), batch.columns[-1].to_pylist(), strict=True)]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = marked.where(F.size("__base") == 0).drop("__base").unionByName(marked.where(F.size("__base") > 0).mapInArrow(batches, inner.schema)).toDF(*docs.columns)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of find_secrets()."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col(id_col),
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of("random").alias("n_random"),
        "n_base_ordinary",
    )
