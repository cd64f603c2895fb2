"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into text blocks with their containers. A classifier gives every block a cost for either label: the log
odds of its own text, learnt from the blocks of a bounded sample of pages that stand in containers of a plain meaning,
and the evidence of its containers. The costs become capacities to the two terminals; neighbouring blocks, and blocks
of one container, get smoothness edges that get weaker with the distance in the tree. The minimum cut, found by
maximum flow, separates content from boilerplate, so that a short line inside an article and a sentence inside a notice go
with what surrounds them. Pages are independent rows, so the work is one pass over Arrow batches without a shuffle.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.llm._arrow import slices

TAG = re.compile(r"</?([A-Za-z][^\s/><\"']*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Za-z]+")
TOGETHER = 4_000_000  # bytes of html handled together

RAW = frozenset("script style textarea title noscript iframe svg annotation annotation-xml template select object canvas audio video head".split())
#: Of those, elements of markup, not of plain characters: one that is not closed ends where the next block begins or a container ends.
LOOSE = frozenset("svg annotation annotation-xml template select object canvas audio video".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr figure fieldset menu dialog details blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address figcaption caption summary legend option button label".split())

BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - {'option', 'button', 'label', 'legend'}))})(?=[\s/>])", re.IGNORECASE)

#: Evidence that containers of a plain meaning pass to their blocks (log odds, content is positive).
TAG_EVIDENCE = {"nav": -2.5, "footer": -2.5, "aside": -2.5, "menu": -2.5, "dialog": -2.5, "fieldset": -1.2, "form": -1.2}
CONTENT, NAMED, PARTLY, HEADER, HEADER_INSIDE, LEAST = 1.2, -2.5, -0.3, -1.5, -0.6, -5.0
#: Names (class, id, role) of boilerplate and of content, and the words that may stand beside them in such a name.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent notice gdpr popup modal newsletter subscribe "
    "subscription share sharing social related recommended sidebar navigation navbar nav menu breadcrumb breadcrumbs pagination footer comment comments "
    "disqus reply replies respond login signup toolbar contentinfo complementary copyright".split()
)
CONTENT_NAMES = frozenset("article content post entry story text body main".split())
HELPERS = frozenset(
    "box bar block list section wrap wrapper container area links link buttons button top bottom left right main site page form item items inner outer widget group row col "
    "content text header title global primary secondary first last mobile desktop holder region panel".split()
)
#: Words that speak of a page's machinery.
BOILERPLATE_WORDS = frozenset(
    "subscribe newsletter cookie cookies login logout signup advertisement sponsored copyright reply replies comment comments share tweet privacy terms unsubscribe "
    "register permalink breadcrumb sitemap menu ago posted upvote".split()
)
#: Weights of features() before anything is learnt, and how many blocks they count for.
PRIOR, PRIOR_BLOCKS, TEXT_MOST = np.array([-1.1, 2.6, -3.0, 0.7, -2.4, -1.5]), 50.0, 3.0
#: Capacities: next block (an eighth for every step of distance in the tree), block of the same container; longest distance that counts.
SMOOTH_NEXT, SMOOTH_SAME, DISTANCE_MOST = 1.2, 0.6, 6


def named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether a container's names tell of boilerplate in whole or in part, or of content: of a name in whole, every
    word is a word for boilerplate or a helper."""
    whole = partly = content = False
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
            some = sum(w in BOILERPLATE_NAMES for w in words)
            if some and all(w in BOILERPLATE_NAMES or w in HELPERS for w in words):
                whole = True
            elif some:
                partly = True
            elif words and all(w in CONTENT_NAMES or w in HELPERS for w in words) and any(w in CONTENT_NAMES for w in words):
                content = True
    return whole, partly, content


def container_evidence(tag: str, attributes: str, inside: float) -> float:
    """Evidence that a container passes to its blocks, given that of the container around it. An article in a form is an
    article; one in a sidebar is not."""
    found = inside
    if tag in ("article", "main"):
        found = CONTENT if inside > -2.0 else inside
    elif tag == "header":
        found = inside + HEADER_INSIDE if inside > 0 else min(inside, HEADER)
    elif tag in TAG_EVIDENCE:
        found = min(inside, 0.0, TAG_EVIDENCE[tag])
    if attributes and tag not in ("html", "body"):
        whole, partly, content = named(attributes)
        if whole and tag not in ("main", "article"):
            found = min(found, 0.0) + NAMED
        elif partly:
            found += PARTLY
        elif content and found > -1.0 and tag not in TAG_EVIDENCE:
            found = max(found, CONTENT / 2)
    return max(found, LEAST)


class Block:
    """Text, container (number), evidence of the containers, characters in links."""

    __slots__ = ("text", "container", "around", "linked")

    def __init__(self, text: str, container: int, around: float, linked: int):
        self.text, self.container, self.around, self.linked = text, container, around, linked


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of comments (no name) and tags, in one pass: a tag whose quotes never
    close ends at the first '>', and so do all tags after it, so that no part of a page is searched again and again."""
    at, loose = 0, False
    unclosed: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        if follows in ("!", "?"):
            opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, start)), ("<!", ">"))
            end = page.find(closing, start + len(opening))
            at = end + len(closing) if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        found = TAG.match(page, start)
        if not found:
            at = start + 1
            continue
        name, closing, place, end = found[1].lower(), follows == "/", found.end(), -1
        while not loose:
            mark = QUOTE_OR_END.search(page, place)
            if mark and mark[0] == ">":
                end = mark.start()
                break
            place = page.find(mark[0], mark.end()) + 1 if mark else 0
            if not place:
                loose = True
        if end < 0 and (end := page.find(">", found.end())) < 0:
            return
        attributes = page[found.end() : end]
        at = end + 1
        if name in RAW and not closing and not attributes.endswith("/"):
            again = rf"|<{name}(?=[\s>])" if name in ("select", "canvas", "audio", "video") else ""  # these hold none of their kind
            ended = None if name in unclosed else re.compile(rf"</{name}\s*>{again}", re.IGNORECASE).search(page, at)
            if ended and ended[0][1] == "/":
                at = ended.end()
            else:
                if not ended:
                    unclosed.add(name)
                if name in LOOSE:
                    ended = BLOCK_TAG.search(page, at)
                if name != "head":
                    at = ended.start() if ended else len(page)
        yield start, at, name, closing, attributes


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the parent of every container."""
    out: list[Block] = []
    parents = [0]
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]
    opened: Counter[str] = Counter()
    parts, linked, in_link, at = [], 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][2], linked))
        parts, linked = [], 0

    for start, end, name, closing, attributes in markup(page):
        if start > at:
            parts.append(page[at:start])
            linked += len(parts[-1].strip()) if in_link else 0
        at = end
        if name in RAW:
            continue
        if name in BLOCKS:
            close()
            if name in CONTAINERS:
                if not closing:
                    parents.append(stack[-1][1])
                    stack.append((name, len(parents) - 1, container_evidence(name, attributes, stack[-1][2])))
                    opened[name] += 1
                elif opened[name]:
                    while True:
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
            if not closing:
                in_link = False
        elif name == "a":
            in_link = not closing
        elif name in ("br", "hr", "img", "input"):
            parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
        linked += len(parts[-1].strip()) if in_link else 0
    close()
    return out, parents


def features(b: Block) -> list[float]:
    """What a block's own text tells: constant, length, links, end of a sentence, machinery, copyright."""
    n = len(b.text)
    low = b.text[:400].lower() if n < 400 else ""
    words = WORDS.findall(low)
    machinery = sum(w in BOILERPLATE_WORDS for w in words) / max(len(words), 1)
    return [
        1.0,
        min(2.0, 0.5 * math.log1p(n / 20)),
        min(1.0, b.linked / n),
        float(b.text[-1] in ".!?…。:;\"”'’)"),
        min(1.0, 4 * machinery),
        float(n < 200 and ("©" in b.text or "copyright" in low)),
    ]


def learnt(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier with PRIOR as its prior; Newton's steps, halved where they overshoot, half of all
    weight to either label."""
    w = PRIOR.copy()
    if not 0 < labels.sum() < len(labels):
        return w
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    loss = lambda v: float(weight @ (np.logaddexp(0, rows @ v) - labels * (rows @ v)) + PRIOR_BLOCKS / 2 * ((v - PRIOR) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (labels - p)) - PRIOR_BLOCKS * (w - PRIOR)
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + PRIOR_BLOCKS * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def edges_of(blocks: list[Block], parents: list[int]) -> list[tuple[int, int, float]]:
    """Neighbouring blocks, less the farther apart they stand in the tree, and blocks of one container with others between."""

    def distance(a: int, b: int) -> int:
        steps = 0
        while a != b and steps < DISTANCE_MOST:  # a container's number is larger than its parent's
            a, b = (parents[a], b) if a > b else (a, parents[b])
            steps += 1
        return steps

    at = [b.container for b in blocks]
    edges = [(i, i + 1, SMOOTH_NEXT / 8 ** distance(at[i], at[i + 1])) for i in range(len(at) - 1)]
    last: dict[int, int] = {}
    for i, container in enumerate(at):
        if last.get(container, i - 1) != i - 1:
            edges.append((last[container], i, SMOOTH_SAME))  # a list or table stands between
        elif i > 1 and at[i - 2] == container:
            edges.append((i - 2, i, SMOOTH_SAME))
        last[container] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the content side of the minimum cut.

    A positive score is the capacity from the content terminal, a negative one that to the other. Maximum flow by
    level graphs and blocking flows; blocks that residual capacity reaches from the content terminal are content.
    """
    n = len(scores)
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    heads, room, at = [], [], [[] for _ in range(n)]
    for u, v, c in edges:
        at[u].append(len(heads))
        heads.append(v)
        room.append(c)
        at[v].append(len(heads))
        heads.append(u)
        room.append(c)
    while True:
        level, queue, reached = [-1] * n, [i for i in range(n) if supply[i] > 1e-12], False
        for i in queue:
            level[i] = 0
        for u in queue:
            reached = reached or demand[u] > 1e-12
            for e in at[u]:
                if room[e] > 1e-12 and level[heads[e]] < 0:
                    level[heads[e]] = level[u] + 1
                    queue.append(heads[e])
        if not reached:
            return [x >= 0 for x in level]
        used = [0] * n
        for root in range(n):
            while supply[root] > 1e-12:
                path, u = [], root
                while demand[u] <= 1e-12:
                    while used[u] < len(at[u]) and not (room[e := at[u][used[u]]] > 1e-12 and level[heads[e]] == level[u] + 1):
                        used[u] += 1
                    if used[u] < len(at[u]):
                        path.append(at[u][used[u]])
                        u = heads[path[-1]]
                    elif path:
                        u = heads[path.pop() ^ 1]
                        used[u] += 1
                    else:
                        u = -1
                        break
                if u < 0:
                    break
                flow = min([supply[root], demand[u], *(room[e] for e in path)])
                supply[root] -= flow
                demand[u] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def costs(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Log odds of content of every block: its text's, bounded, and its containers'."""
    if not blocks:
        return []
    own = np.clip(np.array([features(b) for b in blocks]) @ weights, -TEXT_MOST, TEXT_MOST)
    return [float(s) + b.around for s, b in zip(own, blocks, strict=True)]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Main text of one page; empty for a null or empty page, or one without content."""
    blocks, parents = blocks_of(page or "")
    content = minimum_cut(costs(blocks, weights), edges_of(blocks, parents))
    return " ".join(b.text for b, kept in zip(blocks, content, strict=True) if kept)


def train(pages: DataFrame, html_col: str = "html", sample: int = 500, page_blocks: int = 200) -> np.ndarray:
    """Weights learnt from sample pages, drawn by a hash of their html, and page_blocks blocks of each at most.

    Blocks in an article or main text are content, blocks with strong evidence against them boilerplate; others are
    not learnt from. Without blocks of either kind, PRIOR.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 0, TOGETHER)):
            rows, labels = [], []
            for page in batch.column(0).to_pylist():
                told = [b for b in blocks_of(page)[0] if b.around >= CONTENT or b.around <= -2.0][:page_blocks]
                rows += [features(b) for b in told]
                labels += [int(b.around > 0) for b in told]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["row", "label"])

    source = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    source = source.withColumn("h", F.xxhash64("html"))
    most = source.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes alone are sorted
    drawn = source.where(F.col("h") <= F.lit(most).cast("long")).groupBy("h").agg(F.first("html").alias("html")).select("html")
    found = sorted((tuple(r.row), r.label) for r in drawn.mapInArrow(batches, "row array<double>, label int").collect())  # sample x page_blocks rows at most
    return learnt(np.array([r for r, _ in found]).reshape(len(found), len(PRIOR)), np.array([label for _, label in found], dtype=float))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), **options) -> DataFrame:
    """Main text of every page.

    Returns the columns in keep (which may be null), text string and n_chars long (code points), one row per input
    row, in whole; equal pages get equal texts. Other columns are not carried, so none can clash. A null, empty or unreadable page has an empty
    text; of broken markup what can be read counts, in time proportional to its length.
    """
    weights = train(pages, html_col, **options)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 0, TOGETHER)):
            texts = [main_text(p, weights) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    names = [f"k{i}" for i in range(len(keep))]
    source = pages.select(F.col(html_col).cast("string").alias("html"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    made = source.mapInArrow(batches, f"{kinds}, text string, n_chars bigint")
    return made.withColumnsRenamed(dict(zip(names, keep, strict=True)))
