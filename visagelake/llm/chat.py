"""Chat formatting by quotation linking.

Lines that begin with quote marks are parsed into nested levels. Quoted passages (runs of one level, their lines,
sentences and overlapping windows of words) are normalised, hashed and joined with the passages that messages wrote
themselves; a message answers the one that it quotes most on the first level, or, where that finds none, on the next
level that finds one. In its own conversation every passage counts, and a short one that nobody wrote as a whole links to the
message that has it inside a line; another conversation is answered only by passages of FAR_WORDS words or more, each the
less the more conversations wrote it. A message belongs to the thread of the one it
answers, else to its own conversation; the first message of a thread and the depth are found by pointer doubling over the
quoting messages only. Sorted by thread, conversation and turn, every message comes after the one it answers. Quotes
are left out of the texts.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables
from visagelake.llm._arrow import slices

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
SAYS = re.compile(r"\s*(?:On\b.{0,200}|.{1,80}?)\s(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
WINDOW = 5
#: Words of quoted passages that are too short for a window, sought inside lines of their own conversation.
SHORT = range(2, WINDOW)
#: Least words of a passage that links to another conversation.
FAR_WORDS = 5
TOGETHER = 2_000_000  # bytes of text handled together
#: Quoted hashes up to which own passages are narrowed by a broadcast; more are joined by shuffle.
BROADCAST_HASHES = 200_000
PASSAGE = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))


def normal(text: str) -> str:
    """Letters and digits of a passage in lower case, single spaces between words."""
    return " ".join(re.findall(r"\w+", text.lower()))


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, content) of every line; level 0 is the message's own."""
    out = []
    for line in text.split("\n"):
        found = MARKS.fullmatch(line.rstrip("\r"))
        out.append((found[1].count(">"), found[2]) if found else (0, line))
    return out


def pieces(text: str) -> list[str]:
    """A text's sentences and its windows of words, all normalised; lines may break anywhere."""
    words = normal(text).split()
    return [normal(x) for x in SENTENCE_END.split(text)] + [" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def passages(own: str) -> list[tuple[int, int, int]]:
    """Passages (0, hash, words) that a message offers: its own text, paragraphs, lines, sentences and windows."""
    paragraphs = re.split(r"\n\s*\n", own)
    parts = [normal(x) for x in (own, *paragraphs, *own.split("\n"))]
    written = dict.fromkeys([*parts, *pieces(own), *(normal(x) for paragraph in paragraphs for x in SENTENCE_END.split(paragraph))])
    return [(0, hashed(p), len(p.split())) for p in written if p]


def short_windows(own: str) -> list[int]:
    """Hashes of the windows of so few words that a message offers to its own conversation."""
    words = normal(own).split()
    return [hashed(x) for x in dict.fromkeys(" ".join(words[i : i + n]) for n in SHORT for i in range(len(words) - n + 1))]


def split_quotes(text: str) -> tuple[str, list[tuple[int, int, int]], int]:
    """Own text, quoted passages (level, hash, words) of a message, and how many of them are whole runs or lines."""
    lines = levels(text)
    lines = [x for i, x in enumerate(lines) if not (x[0] == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and SAYS.fullmatch(x[1]))]
    if not any(level for level, _ in lines):
        return text, [], 0
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(x for level, x in lines if level == 0)).strip()
    quoted: dict[tuple[int, str], None] = {}
    more: dict[tuple[int, str], None] = {}
    run: list[str] = []
    for i, (level, content) in enumerate(lines):
        if level:
            run.append(content)
            quoted[level, normal(content)] = None
            if i + 1 == len(lines) or lines[i + 1][0] != level:
                quoted[level, normal("\n".join(run))] = None
                more |= dict.fromkeys((level, x) for x in pieces("\n".join(run)))
                run = []
    return own, [(k, hashed(p), len(p.split())) for k, p in quoted | more if p], sum(p != "" for _, p in quoted)


def parse(text: str) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Own text, quoted passages and own passages (level, hash, words) of a message."""
    own, quoted, _ = split_quotes(text)
    return own, quoted, passages(own)


def link(messages: DataFrame, order: str | None = None) -> DataFrame:
    """Messages without quotes, with what they answer and the thread they belong to.

    Returns (conv_id, turn, role, text, n_quotes, reply_conv, reply_turn, depth, thread_id), one row per input row; other
    columns are not carried, conversations and turns keep their types (numbers or text). A message answers the earliest
    writer of the passages it quotes most words of, first in its own conversation, else in any; deeper levels count only
    where no shallower one finds a writer; of equal ones the latest message is answered. thread_id is the conversation of
    the thread's first message, depth the number of answers from there. n_quotes counts quoted runs and lines. A quoted
    run or line of two to four words that no earlier message of its conversation wrote as a whole counts for the earliest that
    has these words in a row; a single word counts as a whole passage only. Only earlier messages count: in a conversation by
    turn, between conversations by the column that order names (a time, say), then conversation and turn; a null there is the
    earliest. Without order, ids decide by their value, text ids as text. A null or empty text has no passages and stays, as an empty one;
    texts of any length are read whole, a few megabytes at a time; messages with a null conversation or turn are neither
    linked nor answered; of rows with one conversation and turn, each writes for all and all share their reply.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 4, TOGETHER)):
            parsed = [split_quotes(t or "") for t in batch.column(4).to_pylist()]
            told = pa.array([[dict(zip(("level", "hash", "words"), p, strict=True)) for p in x[1]] for x in parsed], PASSAGE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[0] for x in parsed], pa.string()), told, pa.array([x[2] for x in parsed], pa.int64())], names=["conv", "turn", "place", "role", "text", "quoted", "n_quotes"])

    def offered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 3, TOGETHER)):
            hashes = [[h for _, h, _ in passages(t)] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["conv", "turn", "place", "hashes"])

    def inner(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 2, TOGETHER)):
            hashes = [short_windows(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hashes, pa.list_(pa.int64()))], names=["conv", "turn", "hashes"])

    source = messages.select(F.col("conv_id").alias("conv"), "turn", (F.col(order) if order else F.lit(None).cast("int")).alias("place"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ids = f"conv {source.schema['conv'].dataType.simpleString()}, turn {source.schema['turn'].dataType.simpleString()}"
    placed = f"{ids}, place {source.schema['place'].dataType.simpleString()}"
    passage = "array<struct<level: int, hash: bigint, words: int>>"
    parsed = tables.save(source.mapInArrow(batches, f"{placed}, role string, text string, quoted {passage}, n_quotes bigint"), "messages")
    keyed = parsed.where("conv is not null and turn is not null")
    quotes = keyed.select("conv", "turn", "place", F.explode("quoted").alias("q")).select("conv", "turn", "place", "q.level", "q.hash", "q.words").distinct()
    sought = tables.small(tables.save(quotes.select("hash").distinct(), "sought"), BROADCAST_HASHES)
    written = keyed.select("conv", "turn", "place", "text").mapInArrow(offered, f"{placed}, hashes array<bigint>").select("conv", "turn", "place", F.explode("hashes").alias("hash")).join(sought, "hash", "left_semi")
    inside = written.groupBy("hash", "conv").agg(F.min("turn").alias("inside"), F.min(F.struct("place", "turn")).alias("begun"))
    first = inside.groupBy("hash").agg(F.min(F.struct("begun.place", "conv", "begun.turn")).alias("first"), F.count("*").alias("writers"))
    short = quotes.where(F.col("words").between(SHORT[0], SHORT[-1]))
    quoting = tables.small(tables.save(short.select("conv").distinct(), "quoting"), BROADCAST_HASHES)
    windows = keyed.select("conv", "turn", "text").join(quoting, "conv", "left_semi").mapInArrow(inner, f"{ids}, hashes array<bigint>")
    held = windows.select("conv", "turn", F.explode("hashes").alias("hash")).join(sought, "hash", "left_semi")
    parts = held.groupBy("hash", "conv").agg(F.min("turn").alias("part"))
    met = quotes.join(first, "hash", "left").join(inside.drop("begun"), ["hash", "conv"], "left").join(parts, ["hash", "conv"], "left")
    near = F.when(F.col("inside") < F.col("turn"), F.struct("conv", F.col("inside").alias("turn"))).when(F.col("part") < F.col("turn"), F.struct("conv", F.col("part").alias("turn")))
    far = F.when((F.col("first") < F.struct("place", "conv", "turn")) & (F.col("words") >= FAR_WORDS), F.struct("first.conv", "first.turn"))
    weight = F.when(near.isNotNull(), F.col("words").cast("double")).otherwise(F.col("words") / F.col("writers"))
    votes = met.withColumns({"to": F.coalesce(near, far), "weight": weight}).where("to is not null").groupBy("conv", "turn", "level", "to").agg(F.sum("weight").alias("weight"))
    answers = votes.groupBy("conv", "turn").agg(F.max_by("to", F.struct(-F.col("level"), F.round("weight", 6), "to")).alias("to"))
    answers = tables.save(answers.select(F.struct("conv", "turn").alias("node"), "to"), "answers")
    climbing = answers.select("node", "to", F.col("to").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open"))
    while not climbing.where("open").isEmpty():
        above = climbing.select(F.col("node").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"), F.col("open").alias("on"))
        joined = climbing.join(above, "root", "left")
        climbing = tables.save(joined.select("node", "to", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("on", F.lit(False)).alias("open")), "threads")
    linked = parsed.withColumn("node", F.struct("conv", "turn")).join(climbing, "node", "left")
    return linked.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "text",
        "n_quotes",
        F.col("to.conv").alias("reply_conv"),
        F.col("to.turn").alias("reply_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("root.conv", "conv").alias("thread_id"),
    )


def conversations(linked: DataFrame) -> DataFrame:
    """Messages of link() in the order of threads, in each every message after the one it answers: a sort over ranges, so
    that a long thread spans several tasks."""
    return linked.orderBy("thread_id", "conv_id", "turn", "role", "text")
