"""HTML extraction by a site style tree.

All pages of a host are merged into one tree of branches (containers by tag, classes, id
and role along their path below the body, numbers and hashes in these being one), and so are the
pages of all hosts, for what a small host can't tell by itself. A branch has

* presentation importance: the entropy (base: its pages) of the sequences of child tags it shows;
* content importance: 1 less the mean entropy of its features, where a feature that m of the
  branch's n pages hold has the entropy log m / log n. Features are the branch's own text blocks
  (not those of branches below it), parted at marks that join bits of boilerplate in a line;
* composite importance: (1 - D^l) presentation + D^l content for l different presentations.

A small sample overstates importance, so a branch counts as little as the host's tree or the tree
of all hosts makes it. Branches of less than MIN_PAGES pages count 1. On a page, a branch's own text
goes if its importance, as a share of the page's most important text, is below THRESHOLD. Declarations
(article and main; nav, footer, aside, forms, and containers whose class, id or role says so) weigh the
share by a prior, which decides between branches about as important as the content: readers'
comments differ from page to page as articles do. On a host whose declared articles are copies
of each other, the tree of all hosts judges them. Scripts, styles, the head and form controls never give text.
An article among comments or in a list of related ones is not the content.

Blocks are texts between block-level tags: character references are decoded, white space turns
into one space, and blocks are joined in page order by a line feed.

Nulls: a null html has no text; a null or odd url is of the host "". Empty pages give the empty
text. Broken markup (unclosed tags, a page cut short) is read to its end; very long and very deep pages
are read whole, in time linear in their length. Repeated rows are each a page of the site. An empty table
gives no rows. Extra columns are not read.

Features are summed in each batch and task before they are sent. Only branches below KNOWN go to
the pages: as a broadcast, if they are at most BRANCH_LIMIT (counted), else in one stream with the
pages of their host, sorted so that a host's branches come first; a host with more than a
partition's share of pages is dealt to several tasks.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DAMPING, THRESHOLD = 0.98, 0.8
#: Pages a branch needs before its entropies count; importance from which a branch needs no mention.
MIN_PAGES, KNOWN = 8, 0.95
#: Branches below KNOWN that may be broadcast (some 3 MB).
BRANCH_LIMIT = 50_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
SKIPPED = RAW | frozenset("head svg math object button select option datalist canvas audio video map".split())
CONTAINERS = frozenset("body article main section nav header footer aside form div ul ol dl menu table figure fieldset details dialog center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption blockquote pre address hr summary legend html hgroup".split())
#: A start tag closes an open element of its group, up to the nearest of the group's bounds.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, (frozenset({"p"}), frozenset({"button", "td", "th", "table", "caption"}))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: What pages declare as content, and as anything else: tags, and words of class, id and role.
CONTENT_TAGS, CONTENT_WORDS = frozenset({"article", "main"}), frozenset("article main story entry post".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog header".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer footer "
    "form header login masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related remark remarks replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: What stands under these is about another page, unless a page declares nothing else (main is the content anywhere).
OTHERS_TAGS, OTHERS_WORDS = frozenset("nav footer aside".split()), frozenset("comment comments related remark remarks replies reply respond".split())
#: Weights of declarations: within declared content, in declared noise or outside of declared content, otherwise.
CONTENT_PRIOR, NOISE_PRIOR, PLAIN_PRIOR = 1.25, 0.75, 1.0

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Marks between the bits of a line of boilerplate.
_JOINT = re.compile(r"\s*[·•|»«–—©]\s*")
#: Numbers and hashes in ids and classes, which tell one page's element from another's.
_NUMBER = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")


class Node:
    __slots__ = ("tag", "label", "words", "items", "path")

    def __init__(self, tag: str, label: str, words: frozenset[str], path: int):
        self.tag, self.label, self.words, self.path = tag, label, words, path
        self.items: list[Node | str] = []


class _Open:
    """The open elements. The places of each tag are kept, so that no step walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.containers = [root], {root.tag: [0]}, [0]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in CONTAINERS:
            self.containers.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()


def parse(text: str) -> Node:
    """The tree of a page; text items are raw (references not yet decoded)."""
    root = Node("html", "html", frozenset(), 0)
    stack, at = _Open(root), 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if text[m.start()] != "<" or at - m.start() == 1:
                stack.nodes[-1].items.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            place = stack.last((tag,))
            # An inline end tag does not close a container.
            if place and (tag in CONTAINERS or tag in ("body", "html", "table") or place > stack.containers[-1]):
                stack.close(place)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in ("html", "body") and stack.places.get(tag):
            continue
        if rule := CLOSES.get(tag):
            place = stack.last(rule[0])
            if place > max(stack.last(rule[1]), stack.containers[-1]):
                stack.close(place)
        parent, words, label = stack.nodes[-1], frozenset(), tag
        if tag in CONTAINERS and (attributes := m[3] or m[6]):
            names = sorted({f"{a.lower()}={w}" for a, *v in _ATTRIBUTE.findall(attributes) for w in "".join(v).lower().split()})
            if names:
                label = tag + "." + ".".join(sorted({_NUMBER.sub("0", n) for n in names}))
                words = frozenset(w for n in names for w in _WORD.findall(n.partition("=")[2]))
        node = Node(tag, label, words, xxhash.xxh3_64_intdigest(label, seed=parent.path & 0xFFFFFFFF) if tag in CONTAINERS and tag != "body" else parent.path)
        parent.items.append(node)
        if tag not in VOID:
            stack.push(node)
    return root


def declared(node: Node) -> str:
    """'content', 'noise' or ''."""
    if node.tag in CONTENT_TAGS or "role=main" in node.label:
        return "content"
    if node.tag in NOISE_TAGS or node.words & NOISE_WORDS:
        return "noise"
    return "content" if node.words & CONTENT_WORDS and node.tag != "body" else ""


@dataclass
class Page:
    """A page in one walk: its containers in page order, each with its parent's place, and its
    blocks as (place of the nearest container, text, whether it is in an h1 heading)."""

    containers: list[tuple[Node, int]] = field(default_factory=list)
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)


def read(root: Node) -> Page:
    page, now = Page([(root, -1)]), []
    headings, at = 0, 0

    def close() -> None:
        if now and (t := " ".join(htmllib.unescape("".join(now)).split())):
            page.blocks.append((at, t, headings > 0))
        now.clear()

    todo: list = list(reversed(root.items))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif isinstance(x, tuple):  # the end of a block element
            close()
            at, headings = x
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in SKIPPED:
            continue
        else:
            if x.tag in BLOCKS:
                close()
                todo.append((at, headings))
                if x.tag in CONTAINERS:
                    page.containers.append((x, at))
                    at = len(page.containers) - 1
                headings += x.tag == "h1"
            todo.extend(reversed(x.items))
    close()
    return page


def features(text: str) -> list[str]:
    return [t for t in _JOINT.split(text) if t]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, branch, pages, presentations, presentation, content, importance; a null host stands for all hosts."""
    shared.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                page = read(parse(html.as_py() or ""))
                held = {(page.containers[at][0].path, 1, xxhash.xxh3_64_intdigest(f)) for at, t, _ in page.blocks for f in features(t)}
                styles: dict[int, list[str]] = {}
                for x, _ in page.containers:
                    tags = [i.tag for i in x.items if not isinstance(i, str) and i.tag in BLOCKS]
                    styles.setdefault(x.path, []).append(" ".join(t for k, t in enumerate(tags) if not k or tags[k - 1] != t))
                held.update((path, 0, xxhash.xxh3_64_intdigest("/".join(s))) for path, s in styles.items())
                seen.update((host, *h) for h in held)
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in rows], pa.string()),
                    *(pa.array([_signed(k[i]) for k, _ in rows], pa.int64()) for i in (1, 2, 3)),
                    pa.array([n for _, n in rows], pa.int64()),
                ],
                names=["host", "branch", "kind", "feature", "n"],
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, branch long, kind long, feature long, n long")
    own = rows.groupBy("host", "branch", "kind", "feature").agg(F.sum("n").alias("n"))
    every = own.groupBy("branch", "kind", "feature").agg(F.sum("n").alias("n"))
    return _importance(own, ["host", "branch"]).unionByName(_importance(every, ["branch"]).withColumn("host", F.lit(None).cast("string")))


def _importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The entropies from the pages n that show each presentation (kind 0) or hold each feature (kind 1)."""
    style, text = F.col("kind") == 0, F.col("kind") == 1
    parts = counts.groupBy(*keys).agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.lit(1))).alias("presentations"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("_s"),
        F.avg(F.when(text, F.log("n"))).alias("_c"),
    )
    log_pages = F.log(F.col("pages").cast("double"))
    alone = F.col("pages") <= 1
    parts = parts.withColumns(
        {
            "presentation": F.when(alone, F.lit(1.0)).otherwise((log_pages - F.col("_s") / F.col("pages")) / log_pages),
            "content": F.when(alone | F.col("_c").isNull(), F.lit(1.0)).otherwise(1 - F.col("_c") / log_pages),
        }
    )
    weight = F.pow(F.lit(DAMPING), F.col("presentations"))
    importance = (1 - weight) * F.col("presentation") + weight * F.col("content")
    return parts.select(*keys, "pages", "presentations", "presentation", "content", importance.alias("importance"))


def extract(pages: DataFrame, branch_limit: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    limit = BRANCH_LIMIT if branch_limit is None else branch_limit
    tree = shared.materialise(style_tree(pages), "branches")
    low = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < KNOWN)).select("host", "branch", "importance")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = low.limit(limit + 1).collect()
    if len(found) <= limit:
        return _with_broadcast(rows, found)
    return _with_stream(rows, tree, low)


def _schema(rows: DataFrame):
    return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema


def _texts(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
    )


def _with_broadcast(rows: DataFrame, found: list) -> DataFrame:
    known: dict[str | None, dict[int, float]] = {}
    for r in found:
        known.setdefault(r["host"], {})[r["branch"]] = r["importance"]
    held = rows.sparkSession.sparkContext.broadcast(known)  # BRANCH_LIMIT entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value.get(None, {})
        for b in batches:
            out = []
            for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                out.append("\n".join(main_text(parse(html.as_py() or ""), held.value.get(host, {}), every)))
            yield _texts(b, out)

    return rows.mapInArrow(run, _schema(rows))


def _with_stream(rows: DataFrame, tree: DataFrame, low: DataFrame) -> DataFrame:
    """Branches and pages of a host in one sorted stream: branches first, and only one host's are held."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = low.where("host IS NULL").select(F.col("branch").alias("_b"), F.col("importance").alias("every"))
    own = low.where("host IS NOT NULL").select(F.col("host").alias("_h"), F.col("branch").alias("_o"), F.col("importance").alias("own"))
    hosts = tree.where("host IS NOT NULL").select("host", "branch")
    known = hosts.join(every, F.col("branch") == F.col("_b"), "left").join(own, (F.col("host") == F.col("_h")) & (F.col("branch") == F.col("_o")), "left")
    known = known.where("every IS NOT NULL OR own IS NOT NULL").select("host", "branch", "own", "every")
    # A host is dealt to as many tasks as it has partitions' shares of the pages.
    total = max(1, rows.count())
    salts = F.ceil(F.count("*") * F.lit(parts) / F.lit(total)).cast("int")
    large = F.broadcast(rows.groupBy("host").agg(salts.alias("salts")).where("salts > 1"))  # fewer than `parts`
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("salts")), F.lit(0)).cast("int")
    salted = rows.join(large, "host", "left").select("host", salt.alias("salt"), F.lit(1).alias("kind"), "page_id", "url", "html")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    marks = known.join(large, "host", "left").select("host", each.alias("salt"), F.lit(0).alias("kind"), "branch", "own", "every")
    both = salted.unionByName(marks, allowMissingColumns=True).repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, every = None, {}, {}
        for b in batches:
            out, at = [], []
            columns = [b.column(c).to_pylist() for c in ("host", "kind", "branch", "own", "every")]
            for k, (host, kind, branch, o, e) in enumerate(zip(*columns, strict=True)):
                if host != now:
                    now, own, every = host, {}, {}
                if kind:
                    out.append("\n".join(main_text(parse(b.column("html")[k].as_py() or ""), own, every)))
                    at.append(k)
                else:
                    own |= {branch: o} if o is not None else {}
                    every |= {branch: e} if e is not None else {}
            if at:
                yield _texts(b.take(pa.array(at)), out)

    return both.mapInArrow(run, _schema(rows))


def main_text(root: Node, own: dict[int, float], every: dict[int, float] | None = None) -> list[str]:
    """The blocks that stay: importances of branches in the host's tree and in that of all hosts; others count 1."""
    page = read(root)
    every = own if every is None else every
    found, leads = _contents(page)
    context: list[str] = []
    for k, (x, up) in enumerate(page.containers):
        above = context[up] if up >= 0 else "outside" if found else "plain"
        if k in found:
            context.append("content")
        elif k in leads:
            context.append("outside")
        elif declared(x) == "noise" and not (x.tag == "header" and above == "content"):
            context.append("noise")  # an article's own header holds its title
        else:
            context.append(above)
    with_text = {at for at, _, _ in page.blocks}
    sides = {k: [t.get(_signed(page.containers[k][0].path), 1.0) for t in (own, every)] for k in with_text}
    value = {k: min(v) for k, v in sides.items()}
    inside = [k for k in with_text if context[k] == "content"]
    if max((value[k] for k in inside), default=1.0) < THRESHOLD:  # all its text is repeated: other hosts tell
        value |= {k: max(sides[k]) for k in inside}
    top = max(value.values(), default=0.0)
    prior = {"content": CONTENT_PRIOR, "noise": NOISE_PRIOR, "outside": NOISE_PRIOR, "plain": PLAIN_PRIOR}
    stays = {k: (v / top if top > 0 else 1.0) * prior[context[k]] >= THRESHOLD for k, v in value.items()}
    titled = any(h and context[at] == "content" for at, _, h in page.blocks)
    # A heading around an article without one is its title.
    title = set() if titled or not found else {at for at in with_text if at in leads or page.containers[at][0].tag in ("html", "body")}
    return [t for at, t, h in page.blocks if stays[at] or h and at in title]


def _contents(page: Page) -> tuple[set[int], set[int]]:
    """Places of the declared content, and of the containers around it."""
    under: list[bool] = []
    content: list[int] = []
    for k, (x, up) in enumerate(page.containers):
        others = x.tag in OTHERS_TAGS or bool(x.words & OTHERS_WORDS) and x.tag != "body"
        kind = declared(x) if k and x.tag != "body" else ""
        under.append(up >= 0 and (under[up] or others and kind != "content"))
        if kind == "content":
            content.append(k)
    own = {k for k in content if not under[k] or page.containers[k][0].tag == "main" or "role=main" in page.containers[k][0].label}
    found, leads = own or set(content), set()
    for k in range(len(page.containers) - 1, 0, -1):
        if k in found or k in leads:
            leads.add(page.containers[k][1])
    return found, leads - found
