"""Main text of web pages by consensus host paths.

Scan 1 parses each page into blocks of text under container paths (tag and
class names from the body down, digits generalised).  Every container is scored
by the text below it that is not linked and not in a menu, advert, form or the
like; from the deepest container that holds most of that score the page climbs
while the parent adds text that is not linked (a heading or lead beside the body,
a second section), and votes for where it ends.
Spark counts the votes per host and path (combined before the shuffle, so a
host with a third of all pages is a few rows per task).  Scan 2 extracts each
page again under its host's winning path, or the next best one the page has, so
a page whose own scores mislead follows its host; a page that has none of them
follows its own vote.  Under its host's path a page still climbs to text of its
own that lies directly in the parent or in the same article.

A form, or a container that a class word marks as noise, is left out only if it
does not hold most of the page's unlinked text (``kinds`` below).  Reader comments
are left out whatever their length: a container or list one of whose names has a
comment word among its words and none that speaks about comments (has-, no-, -closed).

Edge rows: null and empty pages give an empty text; a null url is a host of its
own; repeated rows give a row each; an empty table gives none; unclosed tags,
comments and scripts run to their parent's end or the page's; further columns
are not read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ship_package, sized_broadcast
from .blocks import cut

# Share of a page's score that the container must hold from which it climbs.
HOLDS = 0.8
# Ranked paths kept per host; a page without any of them uses its own vote.
RANKS = 5
# Host rows that are broadcast to the second scan; more are joined by shuffle.
HOSTS_BROADCAST_ROWS = 100_000

# Fixed lists of HTML element names.
RAW = "script|style|noscript|template|textarea|svg|iframe|select|button|object|canvas"
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "th", "center",
              "nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "figure", "details"}
SKIPPED = {"nav", "footer", "aside", "menu", "dialog", "head", "fieldset"}
BREAKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote",
                       "hr", "address", "figcaption", "caption", "summary", "thead", "tfoot", "title", "option", "legend"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
KEPT_WHOLE = {"html", "body", "main", "article"}

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>\"'<]*+(?:\"[^\"<]*\"[^>\"'<]*+|'[^'<]*'[^>\"'<]*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
# Behind the last ``>`` of a page no tag ends: only what runs to the end of the page is left to find.
TAIL = re.compile(r"<!--.*|<[!?/].*", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_COMMENTS = "comments?|commentlist|replies|respond|disqus"
_NOISE = ("ads?|adverts?|advertisement|banner|sidebar|menu|navbar|nav|navigation|breadcrumbs?|footer|cookies?|"
          "notice|consent|popup|modal|newsletter|subscribe|signup|promo|sponsor(?:ed)?|related|share|sharing|social|"
          f"{_COMMENTS}|widget|pagination|pager|toolbar|login|search|complementary|contentinfo")
_HEADER = "header|masthead"
NOISE = re.compile(rf"(?:^|[\s_-])(?:{_NOISE})(?:$|[\s_-])")
HEADER = re.compile(rf"(?:^|[\s_-])(?:{_HEADER})(?:$|[\s_-])")
# A name that starts with such a word says what the container is, one that holds it later may say what stands beside it.
NAMED = re.compile(rf"(?:^|\s)(?:{_NOISE}|{_HEADER})(?:$|[\s_-])")
COMMENT_WORD = re.compile(_COMMENTS)
# Words of a name by which a container says something about its comments, instead of being them.
ABOUT = {"has", "with", "no", "without", "hide", "show", "open", "opened", "closed", "enabled", "disabled", "allowed", "on", "off", "count"}
LISTS = {"ul", "ol", "dl"}
LAYOUT = re.compile(r"(?:^|[\s_-])(?:content|post|article|entry|main|story|page|body|text)(?:$|[\s_-])")
# Kinds of containers: kept; left out by tag; as comments; by a name that says so; by a form tag or a word in a name.
PLAIN, TAGGED, COMMENT, NOISY, MAYBE = range(5)
SPACE = re.compile(r"\s+")


def names_of(attributes: str) -> tuple[list[str], list[str]]:
    """The values of class, id and role, and the class names with digits generalised."""
    classes, names = [], []
    if "=" in attributes:
        for k, a, b, c in NAMES.findall(attributes):
            value = (a or b or c).lower()
            names.append(value)
            if k.lower() == "class":
                classes = sorted({re.sub(r"\d+", "#", x).replace(">", "#") for x in value.split()})
    return names, classes


def is_comments(names: list[str]) -> bool:
    """Whether a name is that of reader comments: one of its words is a comment word and none says otherwise."""
    for name in " ".join(names).split():
        words = re.split(r"[_-]+", name)
        if any(COMMENT_WORD.fullmatch(w) for w in words) and not ABOUT.intersection(words):
            return True
    return False


def tags(source: str):
    """The tokens of a page in order; each ``<`` is looked at once."""
    last, at = source.rfind(">"), source.find("<")
    while at >= 0:
        m = (TOKEN if at <= last else TAIL).match(source, at)
        if m:
            yield m
        at = source.find("<", m.end() if m else at + 1)


class Page:
    """The blocks of a page: (node, text, linked characters, kept, prose).

    ``kinds`` has a kind per container and ``above`` the container around it.
    Containers of one path are one node: ``steps`` has the node's last step and
    ``parents`` the node above, 0 being the page itself.
    """

    def __init__(self, source: str):
        self.held: list[tuple[int, str, int, int, bool]] = []  # node, text, linked, container, prose
        self.kinds, self.above = [PLAIN], [0]
        self.steps, self.parents, self.children = [""], [0], {}
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, node, container, in article
        self.places: dict[str, list[int]] = {}  # tag -> places in the stack
        self.text: list[str] = []
        self.linked = self.links = self.lists = 0
        self.tag = ""
        at = 0
        for m in tags(source):
            if m.start() > at:
                self.add(source[at:m.start()])
            at = m.end()
            if m.re is TAIL:
                continue
            if name := (m[3] or m[6]):
                name, closing = name.lower(), m[2] or m[5]
                if name == "a":
                    self.links = 0 if closing else 1
                elif name == "br":
                    self.text.append(" ")
                elif name in BREAKS:
                    self.flush()
                    if closing:
                        self.close(name)
                    else:
                        self.tag = name
                        attributes = m[4] or m[7] or ""
                        # A list is a container where it is one of comments, and within such a list.
                        if name in CONTAINERS or name in LISTS and (self.lists or is_comments(names_of(attributes)[0])):
                            self.open(name, attributes)
            elif m[1] is None:
                continue
        if at < len(source):
            self.add(source[at:])
        self.flush()
        self.blocks = self.judged()
        self.measure()

    def add(self, raw: str) -> None:
        t = entities.unescape(raw) if "&" in raw else raw
        self.text.append(t)
        if self.links:
            self.linked += len(t)

    def flush(self) -> None:
        if self.text:
            t = SPACE.sub(" ", "".join(self.text)).strip()
            if t:
                _, node, container, _ = self.stack[-1]
                self.held.append((node, t, self.linked, container, self.tag not in CONTAINERS and self.tag != "li"))
            self.text = []
        self.linked = 0

    def node(self, parent: int, step: str) -> int:
        found = self.children.get((parent, step))
        if found is None:
            found = self.children[parent, step] = len(self.steps)
            self.steps.append(step)
            self.parents.append(parent)
        return found

    def open(self, tag: str, attributes: str) -> None:
        _, node, container, inside = self.stack[-1]
        names, classes = names_of(attributes)
        kind = TAGGED if tag in SKIPPED or tag == "header" and not inside else MAYBE if tag == "form" else PLAIN
        if kind != TAGGED and tag not in KEPT_WHOLE and names:
            name = " ".join(names)
            if is_comments(names):
                kind = COMMENT
            elif NOISE.search(name) or not inside and HEADER.search(name):
                kind = MAYBE if LAYOUT.search(name) or not NAMED.search(name) else NOISY
        self.kinds.append(kind)
        self.above.append(container)
        node = 0 if tag in ("html", "head") else self.node(node, ".".join([tag, *classes]))
        self.lists += tag in LISTS
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, len(self.kinds) - 1, inside or tag in ("article", "main")))

    def close(self, tag: str) -> None:
        self.tag = ""
        if self.places.get(tag):
            for gone, *_ in reversed(self.stack[self.places[tag][-1]:]):
                self.places[gone].pop()
                self.lists -= gone in LISTS
                self.stack.pop()

    def scores(self, without: set[int]) -> list[float]:
        """Unlinked text below every container, but what lies in one of ``without``."""
        out, left_out = [0.0] * len(self.kinds), self.left_out(without)
        for _, t, linked, container, prose in self.held:
            if not left_out[container]:
                out[container] += max(0, len(t) - 2 * linked) * (1.0 if prose else 0.5)
        for i in range(len(out) - 1, 0, -1):
            out[self.above[i]] += out[i]
        return out

    def left_out(self, without: set[int]) -> list[bool]:
        out = [False] * len(self.kinds)
        for i in range(1, len(out)):
            out[i] = out[self.above[i]] or i in without
        return out

    def judged(self) -> list[tuple[int, str, int, bool, bool]]:
        """The blocks, kept or not.

        Containers left out by a tag, as comments or by a name that says so are
        no part of the measure for others: of the rest, a form or a container
        with a noise word in its name must hold most to stay.  A container whose
        name says it is noise (but comments) must hold ``HOLDS`` of all but the
        tagged ones and comments.  Where that leaves nothing, names do not count.
        """
        of = {k: {i for i, kind in enumerate(self.kinds) if kind == k} for k in range(1, 5)}
        if len(self.held) and any(of.values()):
            gone = of[TAGGED] | of[COMMENT]
            if of[NOISY]:
                score = self.scores(gone)
                gone |= {i for i in of[NOISY] if score[i] < HOLDS * score[0] or not score[i]}
            if of[MAYBE]:
                score = self.scores(gone)
                gone |= {i for i in of[MAYBE] if 2 * score[i] <= score[0]}
            left_out = self.left_out(gone)
            if all(left_out[c] for *_, c, _ in self.held):
                left_out = self.left_out(of[TAGGED])  # a name that covers the whole page means nothing
        else:
            left_out = [False] * len(self.kinds)
        return [(p, t, linked, not left_out[c], prose) for p, t, linked, c, prose in self.held]

    def measure(self) -> None:
        """Per node: how many kept blocks with more text than links lie in it directly (``own``) and below it
        (``total``), their score, whether it lies in an article, and the range of nodes below."""
        n = len(self.steps)
        self.own, self.total, self.score = [0] * n, [0] * n, [0.0] * n
        for node, t, linked, kept, prose in self.blocks:
            if kept:
                self.own[node] += len(t) > 2 * linked
                self.score[node] += max(0, len(t) - 2 * linked) * (1.0 if prose else 0.5)
        self.total = list(self.own)
        sizes = [1] * n
        for i in range(n - 1, 0, -1):
            above = self.parents[i]
            self.total[above] += self.total[i]
            self.score[above] += self.score[i]
            sizes[above] += sizes[i]
        # Preorder numbers: the nodes below one are a range.
        self.first, self.depth, self.article = [0] * n, [0] * n, [False] * n
        free = [1] * n
        for i in range(1, n):
            above = self.parents[i]
            self.first[i] = self.first[above] + free[above]
            free[above] += sizes[i]
            self.depth[i] = self.depth[above] + 1
            self.article[i] = self.article[above] or self.steps[i].split(".")[0] in ("article", "main")
        self.sizes = sizes

    def below(self, node: int, container: int) -> bool:
        return 0 <= self.first[node] - self.first[container] < self.sizes[container]

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.steps[node])
            node = self.parents[node]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int | None:
        """The node of a path, if the page has it."""
        node = 0
        for step in path.split(">") if path else ():
            node = self.children.get((node, step))
            if node is None:
                return None
        return node

    def vote(self) -> int:
        """The node around all unlinked text, from the deepest that holds most of the page's score."""
        whole = self.score[0]
        good = [i for i in range(1, len(self.steps)) if self.score[i] >= HOLDS * whole and whole > 0]
        return self.climbed(max(good, key=lambda i: (self.depth[i], -i), default=0), siblings=True)

    def climbed(self, node: int, siblings: bool) -> int:
        """``node``, or the nearest one above it that leaves no unlinked text out.

        Text in other children of a container counts with ``siblings``, or
        within an article; text directly in it always counts.
        """
        best = node
        while node:
            inner, node = node, self.parents[node]
            if self.own[node] or (siblings or self.article[node]) and self.total[node] > self.total[inner]:
                best = node
        return best

    def under(self, node: int) -> list[str]:
        return [t for at, t, _, kept, _ in self.blocks if kept and self.below(at, node)]


def parse(source: str | None) -> Page:
    return Page(source or "")


def main_text(source: str | None, ranked: list[str]) -> str:
    """Text under the first of the ranked paths that the page has, else under its own vote."""
    page = parse(source)
    for path in ranked:
        node = page.find(path)
        if node is not None and page.under(node):
            return "\n\n".join(page.under(page.climbed(node, siblings=False)))
    return "\n\n".join(page.under(page.vote()))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    ship_package(pages.sparkSession)
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def votes(batches):
        for batch in batches:
            pages_read = (parse(h.as_py()) for h in batch.column("html"))
            got = [page.path(page.vote()) for page in pages_read]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(got, pa.string())], ["host", "path"])

    counted = (held.select("host", "html").mapInArrow(votes, "host string, path string").where("path <> ''")
               .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = (counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= RANKS)
              .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("ranked"))
              .select("host", F.col("ranked.path").alias("ranked")))

    def extract(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), r.as_py() or []) for h, r in zip(batch.column("html"), batch.column("ranked"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = held.join(sized_broadcast(cut(ranked), HOSTS_BROADCAST_ROWS), "host", "left")
    return joined.select("page_id", "url", "html", "ranked").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
