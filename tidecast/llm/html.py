"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of branches: an element's path of tags
and classes, and its place among equal siblings where it has no class. For each
branch the pages give a presentation importance, the entropy of the sequences of
children seen there, and a content importance, high where the branch's words
differ from page to page and low where they repeat. The tree of all hosts merged
into one site stands in for a host's own evidence where that is thin, and what a
tag or class declares counts as a few pages more. Branches of low importance are
removed from every page of the host, inside a declared article too.

Three roles are settled by what is declared: a declared article is kept, whatever
its copies on the host, and reader comments and forms, which differ from page to
page as articles do, are removed.

All words of a branch count: every shingle of a short text is a feature, and of a
long one every run of shingles, cut where the words say so. Only counts by (host, branches, feature) are
shuffled, once and by feature, so a host with a third of all pages is spread over
all tasks. Equal pages of a host count as one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecast.llm.common import Scratch, fresh, map_arrow, small, table, without

#: A branch is kept from this importance on; inside a kept one, a branch is removed below this content importance.
LOW, REPEATED = 0.7, 0.35
#: Weight of what a branch says beside how its children are laid out.
CONTENT_SHARE = 0.8
#: Pages that the tree of all hosts counts for beside a host's own, and pages that a declared role counts for beside both.
ALL_HOSTS, DECLARED = 20.0, 4.0
#: Importance that goes with a role: the article, none, none on a page that declares its article elsewhere, menus and the like.
ROLES = {"main": 0.9, "open": 0.75, "outside": 0.4, "noise": 0.2}
#: A text counts for the element that holds it and for so many elements above; what lies higher is judged by what is below it.
REACH = 2
#: Features of a branch on a page: all its shingles of so many words; those of a text of more than LONG in runs that begin at words of RUN letters.
WORDS, LONG, RUN = 3, 24, 7
#: Counts that a task sums up before it passes them on.
HELD_COUNTS = 100_000
#: Pages of which a task counts the features.
PART_PAGES = 4096

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("nav footer aside header menu button select dialog head object audio video canvas".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget notice notices cookie cookies consent alert popup modal newsletter subscribe signup login share sharing social form search pagination pager toolbar copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
#: Words that may stand beside those of a role in a class name joined by hyphens.
PLAIN_WORDS = frozenset("site page main top bottom left right global primary secondary box block bar area list item items section wrapper container slot unit buttons links inner".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("article section div main aside nav header footer table ul ol dl body html form blockquote td th".split())
#: Elements told apart by their place where they have no class.
PLACED = frozenset("div section span td".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>|</{t}\s[^>]*>|\Z", re.I) for t in RAW}


class Node:
    __slots__ = ("parent", "tag", "path", "noise", "main", "hard", "kids", "places", "state", "role")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.parent, self.tag = parent, tag
        name = tag
        self.noise = tag in NOISE_TAGS
        self.hard = tag == "form" or parent is not None and parent.hard
        self.main = tag in ("article", "main")
        comment = False
        if "=" in attrs:
            for key, value in _ATTR.findall(attrs):
                value = value.strip("\"'")
                key = key.lower()
                if key in ("class", "id"):
                    said = [_role(w.lower()) for w in value.split()]
                    comment |= "comment" in said
                    self.noise |= "noise" in said and tag not in ("html", "body")
                    if key == "class" and value.split():
                        name = f"{tag}.{'.'.join(sorted(value.split()))}"
                elif key == "role":
                    self.noise |= value.lower() in NOISE_ROLES
                    self.main |= value.lower() == "main"
                    self.hard |= value.lower() == "form"
                elif value.lower() == "articlebody":
                    self.main = True
        if comment:
            self.main, self.hard = False, True
        elif tag == "article" and parent is not None and not _in_comments(parent):
            # a form or menu that was never closed does not take the article with it
            self.noise = self.hard = False
        if self.hard and parent is not None and _in_comments(parent):
            self.main = False
        if name == tag and tag in PLACED and parent is not None:
            parent.places[tag] = parent.places.get(tag, 0) + 1
            name = f"{tag}:{parent.places[tag]}"
        self.path = xxhash.xxh3_64_intdigest(name, parent.path if parent else 0) >> 1
        self.kids: list[str] = []
        self.places: dict[str, int] = {}
        self.state = "comment" if comment or parent is not None and _in_comments(parent) else ""


def _in_comments(node: Node) -> bool:
    return node.state == "comment"


def _role(word: str) -> str:
    """``noise`` or ``comment`` for a class name that is such a word, or is made of them and plain ones by hyphens or underscores."""
    some = re.split("[-_]", word)
    if not all(w in NOISE_WORDS or w in COMMENT_WORDS or w in PLAIN_WORDS for w in some):
        return ""
    return "comment" if any(w in COMMENT_WORDS for w in some) else "noise" if any(w in NOISE_WORDS for w in some) else ""


class _TagEnds:
    """Where tags end, in one pass over the page: a quote that is never closed is passed over once."""

    def __init__(self, page: str):
        self.page, self.quotes, self.open = page, True, {}
        self.last = page.rfind(">")

    def after(self, at: int) -> int:
        """The place behind the ``>`` of the tag whose name ends at ``at``; -1 without one."""
        i = at
        if at > self.last:
            return -1
        while self.quotes:
            m = _MARK.search(self.page, i)
            if m is None:
                self.quotes = False  # no tag behind this place ends outside quotes either
                break
            if m[1] is None:
                return m.end()
            close = -1 if self.open.get(m[1]) else self.page.find(m[1], m.end())
            if close < 0:
                self.open[m[1]] = True
                i = m.end()
            else:
                i = close + 1
        return self.page.find(">", at) + 1


def parse(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Blocks of text with the element that they stand in, and all elements, in page order."""
    root = Node("html", "", None)
    stack, nodes = [root], [root]
    open_ = Counter({"html": 1})
    blocks: list[tuple[str, Node]] = []
    buffer: list[str] = []
    own: list[Node] = []
    ends, last_data = _TagEnds(page), page.rfind("]]>")

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                blocks.append((text, own[0]))
            buffer.clear()
            own.clear()

    def say(text: str):
        if not own and text.strip():
            own.append(stack[-1])
        if own or buffer:
            buffer.append(text)

    def cut(i: int):
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4) + 3
            if at < 3:
                break
            continue
        if lt < last_data and page.startswith("<![CDATA[", lt):
            at = page.find("]]>", lt) + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1 or n
            continue
        closing = page[lt + 1 : lt + 2] == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m and page.startswith(">", m.end()):
            to = m.end() + 1
        else:
            to = ends.after(m.end()) if m else -1
        if to < 0:  # no tag: the sign itself
            say("<")
            at = lt + 1
            continue
        tag, attrs, at = m[0].lower(), page[m.end() : to - 1], to
        if closing:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > (tag == "html") else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end does not close blocks
            continue
        if tag in RAW:
            at = _RAW_END[tag].search(page, at).end()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag == "body":
            flush()
            for i in range(len(stack) - 1, 0, -1) if open_["head"] > 0 else ():
                if stack[i].tag == "head":
                    cut(i)
        if tag in ("html", "body") and open_[tag] > 0:
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1) if open_["p"] > 0 else ():
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in CLOSES and any(open_[t] > 0 for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    cut(i)
                elif stack[i].tag in SCOPES and stack[i].tag not in ("td", "th"):
                    break
        parent = stack[-1]
        parent.kids.append(tag)
        if tag in VOID:
            continue
        node = Node(tag, attrs.rstrip("/"), parent)
        nodes.append(node)
        stack.append(node)
        open_[tag] += 1
    flush()
    return blocks, nodes


def smoothed(known: tuple[float, float] | None, role: str) -> float:
    """(pages, importance) joined with what goes with the role."""
    pages, value = known or (0.0, 0.0)
    return (pages * value + DECLARED * ROLES[role]) / (pages + DECLARED)


def main_text(page: str, tree: dict[int, tuple[float, float, float]] | None = None) -> str:
    """The page's blocks of high importance, joined by empty lines. ``tree`` has pages, importance and content importance of the host's branches.

    An element of high importance keeps all below it but what repeats, unless
    something below it is of low importance: then each element stands for
    itself, outside of a declared article.
    """
    tree = tree or {}
    blocks, nodes = parse(page)
    declared = any(node.main for node in nodes)
    weight: dict[int, float] = {}
    inside: dict[int, bool] = {}
    for node in nodes:  # parents come first
        main = inside[id(node)] = node.main or node.parent is not None and inside[id(node.parent)]
        known = tree.get(node.path)
        node.role = "noise" if node.noise else "main" if main else "outside" if declared else "open"
        weight[id(node)] = 0.0 if node.hard or node.state == "comment" else 1.0 if node.main else smoothed(known[:2] if known else None, node.role)
    mixed: set[int] = set()  # elements with text of low importance below them
    spoken = {id(node) for _, node in blocks}
    for node in reversed(nodes):
        if node.parent is not None and id(node) in spoken:
            spoken.add(id(node.parent))
            if weight[id(node)] < LOW or id(node) in mixed:
                mixed.add(id(node.parent))
    for node in nodes:
        above, main, role = node.parent, inside[id(node)], node.role
        known = tree.get(node.path)
        said = (known[0], known[2]) if known else None
        heading = node.tag == "header" and main and above is not None and above.state in ("keep", "own")
        if node.hard or node.state == "comment":
            node.state = "drop"
        elif above is not None and above.state == "drop" and not node.main:
            node.state = "drop"
        elif heading or above is not None and above.state == "header" and not node.noise and not (node.tag[:1] == "h" and node.tag[1:].isdigit()):
            node.state = "header"  # of an article's header the headings stay
        elif above is not None and (above.state in ("keep", "header") or above.state == "own" and main) and not node.noise and not node.main:
            node.state = ("own" if id(node) in mixed else "keep") if smoothed(said, role) >= REPEATED else "drop"
        elif weight[id(node)] >= LOW:
            node.state = "own" if id(node) in mixed else "keep"
        else:
            node.state = "drop" if node.noise else ""
    return "\n\n".join([text for text, node in blocks if node.state in ("keep", "own")])


def features(text: str) -> list[int]:
    """Hashes of all the text's shingles: one by one, or of a long text in runs, so that each shingle is in one of them.

    A run begins at a word of a certain length, wherever the words stand, so what two long texts share they share in runs too.
    """
    words = text.split()
    if len(words) <= WORDS:
        return [xxhash.xxh32_intdigest(text)]
    last = len(words) - WORDS + 1
    if last <= LONG:
        return [xxhash.xxh32_intdigest(" ".join(words[i : i + WORDS])) for i in range(last)]
    starts = [0, *[i for i in range(1, last) if len(words[i]) == RUN], last]
    return [xxhash.xxh32_intdigest(" ".join(words[i : j + WORDS - 1])) for i, j in zip(starts, starts[1:])]


def page_features(page: str) -> Iterator[tuple[int, tuple[int, ...], list[int]]]:
    """(kind, branches, features) of a page: each of the features is one of every branch. Kind 0 the sequence of children, 1 what it says, 2 that it is there.

    Features of kinds 0 and 2 differ from branch to branch.
    """
    blocks, nodes = parse(page)
    where: dict[int, tuple[int, ...]] = {}
    spoken: set[int] = set()
    for text, node in blocks:
        chain = []
        for _ in range(REACH + 1):
            spoken.add(id(node))
            chain.append(node.path)
            node = node.parent
            if node is None:
                break
        own = tuple(chain)
        for f in features(text):
            if where.setdefault(f, own) != own:
                where[f] = tuple(sorted({*where[f], *own}))
    said: dict[tuple[int, ...], list[int]] = {}
    for f, branches in where.items():
        said.setdefault(branches, []).append(f)
    for branches, some in said.items():
        yield 1, branches, some
    laid: dict[int, set[int]] = {}
    for node in nodes:
        if id(node) in spoken:
            laid.setdefault(node.path, set()).add(xxhash.xxh3_64_intdigest(",".join(node.kids), node.path) >> 1)
    for path, some in laid.items():
        yield 0, (path,), list(some)
        yield 2, (path,), [path]


def page_counts(page: str) -> set[tuple[int, int, int]]:
    """(branch, kind, feature) of a page, one by one."""
    return {(branch, kind, f) for kind, branches, some in page_features(page) for branch in branches for f in some}


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def branch_features(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, kind, branches, feature, n): pages of the host with a feature in just these branches, summed by task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict = defaultdict(Counter)

        def summed() -> pa.RecordBatch:
            hosts, kinds, branches = zip(*counts) if counts else ((), (), ())
            long = pa.list_(pa.int64())
            cols = [pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(branches, long), pa.array([list(c) for c in counts.values()], long)]
            cols.append(pa.array([[float(n) for n in c.values()] for c in counts.values()], pa.list_(pa.float64())))
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, ["host", "kind", "branches", "feature", "n"])

        held = 0
        for batch in batches:
            for host, page, share in zip(*[c.to_pylist() for c in batch.columns]):
                for kind, branches, some in page_features(page or ""):
                    own = counts[host, kind, branches]
                    held -= len(own)
                    if share == 1:
                        own.update(some)
                    else:
                        for f in some:
                            own[f] += share
                    held += len(own)
                if held > HELD_COUNTS:
                    yield summed()
                    held = 0
        yield summed()

    rows = pages.select(_host(url).alias("host"), F.col(html).alias("html"))
    key = F.xxhash64("html", F.length("html"))
    copies = rows.groupBy("host", key.alias("key")).agg(F.count("*").alias("copies")).where("copies > 1").toDF("h", "key", "copies")
    shared = rows.join(small(copies, "h"), (rows.host == F.col("h")) & (key == F.col("key")), "left")
    got = map_arrow(shared.select("host", "html", (1.0 / F.coalesce("copies", F.lit(1))).alias("share")), run, "host string, kind int, branches array<long>, feature array<long>, n array<double>")
    return got.select("host", "kind", "branches", F.inline(F.arrays_zip("feature", "n")))


def branch_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, branch, kind, feature, n): on how many different pages of the host a branch has a feature."""
    got = branch_features(pages, url, html).select("host", F.explode("branches").alias("branch"), "kind", "feature", "n")
    return got.groupBy("host", "branch", "kind", "feature").agg(F.sum("n").alias("n"))


def branch_sums(rows: DataFrame, parts: int) -> DataFrame:
    """What both trees need of (host, kind, branches, feature, n): by host and branch the sums of n and of n times the log of the feature's count, on the host and (``all_x``) on all hosts.

    Rows meet by feature, once, in ``parts`` partitions. Those alone with their
    feature, most of them, go on as they are, and only others by single branches.
    """
    met = rows.repartition(parts, "feature").withColumn("met", F.count("*").over(Window.partitionBy("feature")))
    one = met.select("host", "kind", "feature", "n", F.explode(F.when(F.col("met") == 1, F.array("branches")).otherwise(F.transform("branches", lambda b: F.array(b)))).alias("branches"))
    everywhere = Window.partitionBy("feature", "kind", "branches").orderBy("host")
    host, every = everywhere.rangeBetween(Window.currentRow, Window.currentRow), everywhere.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumns({"own": F.sum("n").over(host), "all": F.sum("n").over(every)})
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what))
    x = lambda c: F.when(F.col(c) > 1, F.col("n") * F.log(c)).otherwise(0.0)
    sums = {"pages": of(2, F.col("n"))}
    for kind, name in ((0, "style"), (1, "text")):
        sums |= {f"{name}s": of(kind, F.col("n")), f"{name}_x": of(kind, x("own")), f"{name}_all_x": of(kind, x("all"))}
    by_set = one.groupBy("host", "branches").agg(*[c.alias(k) for k, c in sums.items()])
    return by_set.select("host", F.explode("branches").alias("branch"), *sums).groupBy("host", "branch").agg(*[F.sum(k).alias(k) for k in sums])


def _importance(sums: DataFrame, keys: list[str], of: str = "") -> DataFrame:
    scale = F.log(F.greatest("pages", F.lit(2.0)))
    presentation = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("styles") - F.col(f"style{of}_x") / F.col("styles")) / scale))
    content = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col(f"text{of}_x") / F.col("texts") / scale))
    tree = sums.select(*keys, "pages", presentation.alias("presentation"), content.alias("content"))
    return tree.withColumn("importance", (1 - CONTENT_SHARE) * F.col("presentation") + CONTENT_SHARE * F.col("content"))


def tree_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, presentation, content, importance) of every branch that holds text: by host and branch, or by branch for all hosts merged."""
    if "host" in keys:
        return _importance(sums, keys)
    return _importance(sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("host", *keys)]), keys, "_all")


def style_tree(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``tree_of_sums`` for the result of ``branch_counts``."""
    rows = counts.withColumn("branches", F.array("branch"))
    return tree_of_sums(branch_sums(rows, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), keys)


def evidence(pages: DataFrame, url: str = "url", html: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """(host, branch, pages, importance, content): a host's own figures joined with those of all hosts merged, and how many pages both are worth.

    One page tells nothing of what repeats, so a tree counts for its pages less one.
    """
    keep = (scratch or Scratch(pages.sparkSession)).keep
    sums = keep(branch_sums(branch_features(pages, url, html), pages.count() // PART_PAGES + 1))
    everywhere = tree_of_sums(sums, ["branch"])
    everywhere = keep(everywhere.select("branch", F.least(F.greatest(F.col("pages") - 1.0, F.lit(0.0)), F.lit(ALL_HOSTS)).alias("m"), F.col("importance").alias("all_importance"), F.col("content").alias("all_content")))
    both = tree_of_sums(sums, ["host", "branch"]).withColumn("w", F.greatest(F.col("pages") - 1.0, F.lit(0.0))).join(everywhere, "branch")
    mean = lambda c: F.try_divide(F.col("w") * F.col(c) + F.col("m") * F.col(f"all_{c}"), F.col("w") + F.col("m")).alias(c)
    return keep(both.select("host", "branch", (F.col("w") + F.col("m")).alias("pages"), mean("importance"), mean("content")).where("pages > 1e-6"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``main_text`` and ``n_chars`` (its code points) to every page.

    A null or empty page has an empty text. Pages without url or host form one
    site of their own. Pages of any length and depth are read whole, in time in
    proportion to their length. Repeated rows get equal results and count as
    pages of their site; branches at the very bounds are kept. Input columns
    named like an output are replaced, all others pass through, whatever their
    names; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    tree = evidence(pages, url, html, scratch)
    by_host = tree.groupBy("host").agg(F.collect_list(F.struct("branch", "pages", "importance", "content")).alias("tree"))
    by_host = scratch.result(by_host)
    base = without(pages, *[c for c in ("main_text", "n_chars") if c not in (url, html)])
    site, own = fresh(base, "site"), fresh(base, "tree")
    by_host = small(by_host.toDF(site, own), site, own)
    names = [f.name for f in base.schema.fields]
    rows = base.join(by_host, _host(url) == by_host[site], "left").select(*[base[f"`{n}`"] for n in names], by_host[own])
    schema = StructType([*base.schema.fields, *StructType.fromDDL("main_text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, branches = None, {}
        for batch in batches:
            texts = []
            trees = batch.column(len(names))
            for i, page in enumerate(batch.column(names.index(html)).to_pylist()):
                part = trees[i].values
                if last is None or part is None or not part.equals(last):
                    last = part
                    cols = [] if part is None else [c.to_pylist() for c in part.flatten()]
                    branches = {b: tuple(v) for b, *v in zip(*cols)}
                texts.append(main_text(page or "", branches))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "main_text", "n_chars"])

    return map_arrow(rows, run, schema)


def op4_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")
