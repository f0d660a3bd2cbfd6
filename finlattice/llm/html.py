"""Main text of web pages by a site style tree.

Every page is parsed once, in linear time, into its boxes (elements that start a line of their own) and text blocks.
A box is known by its style path (tag, class and id of itself and all boxes around it, hashed step by step),
and pages of one host are merged along these paths into the site's tree.  Pages with the same texts are one body.
Each node of the tree is judged over all bodies of the site: its presentation by the entropy of the styles in it, its texts by the
larger of their entropy and of the mean of 1 - ln(bodies that hold a text), both as a share of ln(bodies of the site).  So a
text of one body is important however rare its node is, and so are many different texts that near copies share; a few
texts that the site's pages choose from are not.  Importance is summed up the tree, so that a branch has that of all it
holds.  Branches of low importance in which no node's texts are important are cut from every page of the host, and so is a
single text that most bodies of the site repeat.  What the tree leaves goes by its name where that says that it is no article (nav,
footer, class ad and so on), as words of a page's own in such places cannot be told by entropy.

Defined results: a null or empty page has an empty text; a null url is one site of its own; null ids
are returned as null; repeated rows give repeated results (and are one body of their site); pages nested
however deeply, unclosed tags, quotes and comments are read as far as they go; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, keep

# HTML's element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow mfrac msup msub q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img td th".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that another of their kind closes, and what keeps it from doing so.
_CLOSED_BY_OWN = {"p": "article section div main body table li blockquote".split(), "li": ["ul", "ol", "menu"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["tr", "table"], "th": ["tr", "table"], "option": ["select"]}
_STOPS = {stop: [tag for tag, stops in _CLOSED_BY_OWN.items() if stop in stops] for stop in {s for stops in _CLOSED_BY_OWN.values() for s in stops}}
# Elements, roles and words in class or id that mark what is no article; words that pages also use of their layout are left to the tree.
_NOT_ARTICLE = frozenset("head nav aside footer form button dialog menu select label fieldset template noscript svg object canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead "
    "footer cookie cookies consent gdpr banner popup modal newsletter subscribe subscription signup login comment comments disqus respond reply replies "
    "recommended recommendations widget toolbar pagination pager skip alert alerts disclaimer announcement toast overlay teaser toc".split()
)
# Words of these that articles also use of their own parts, such as a lead or a list of sections.
_OF_ARTICLES = frozenset("teaser toc announcement disclaimer widget overlay skip".split())
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
_IN_TAG = re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"\d+")
_HOST = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class StyleTreeSettings:
    prior: float = 2.0  # bodies without the texts in question, added to each site
    presentation: float = 0.1  # weight of a node's presentation beside one text
    least_importance: float = 0.45  # of a branch
    most_share: float = 0.5  # of a site's bodies that may hold the same text


def _long(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def tags(page: str):
    """(text before, tag, closing, attributes) of each tag in turn; comments and the like are left out, and the last tag is None.

    A quote that nothing closes ends at the tag's end; each kind of quote is looked for in vain once only.
    """
    at, text_from, n = 0, 0, len(page)
    texts: list[str] = []
    missing: dict[str, int] = {}  # position from which on a closing quote or comment is known to be missing
    while at < n:
        found = _MARKUP.search(page, at)
        if found is None:
            break
        if found.start() > text_from:
            texts.append(page[text_from : found.start()])
        if found[3]:
            end = page.find("-->", found.end())
            at = text_from = n if end < 0 else end + 3
            continue
        end = found.end()
        while True:
            mark = _IN_TAG.search(page, end)
            if mark is None:
                end = after = n
                break
            if mark[0] == ">":
                end, after = mark.start(), mark.end()
                break
            quote = mark[0][-1]
            close = page.find(quote, mark.end()) if mark.end() < missing.get(quote, n + 1) else -1
            if close < 0:
                missing[quote] = min(mark.end(), missing.get(quote, n))
            end = mark.end() if close < 0 else close + 1
        at = text_from = after
        if found[2]:
            yield "".join(texts), found[2].lower(), bool(found[1]), page[found.end() : end]
            texts.clear()
            if not found[1] and (tag := found[2].lower()) in _RAW:
                ends = _ENDS[tag].search(page, at)
                at = text_from = ends.end() if ends else n
    texts.append(page[text_from:])
    yield "".join(texts), None, False, ""


class _Open:
    """An open element: box is the number of the box that its text belongs to, base where that box stands, near where the elements stand that an own kind would close."""

    __slots__ = ("tag", "box", "base", "bad", "inside", "mark", "near", "inline")

    def __init__(self, tag: str, box: int, base: int, bad: bool, inside: int, mark: int, near: dict[str, int]):
        self.tag, self.box, self.base, self.bad, self.inside, self.mark, self.near = tag, box, base, bad, inside, mark, near
        self.inline: dict[str, int] = {}  # open inline elements of a box


class Page:
    """Boxes (path, parent, look) and blocks (box, text or None if a name says it is no article, content hash) of a page."""

    def __init__(self, page: str):
        self.paths, self.parents, self.looks = [0], [-1], [0]
        self.found: list[tuple[int, str, bool, int, int]] = []  # box, text, named, inside, mark
        self.mark_of = [-1]  # the mark around each mark
        self.stack = [_Open("", 0, 0, False, 0, 0, {})]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        for before, tag, closing, attributes in tags(page):
            if before:
                self.text.append(before)
            if tag is None:
                break
            if closing:
                self._end(tag)
            elif tag not in _RAW:
                self._start(tag, attributes)
        self._flush()
        self._judge()

    def _flush(self) -> None:
        if self.text:
            top = self.stack[-1]
            words = unescape("".join(self.text)).split()
            if words:
                self.found.append((top.box, " ".join(words), top.bad, top.inside, top.mark))
            self.text.clear()

    def _pop_to(self, k: int) -> None:
        for o in self.stack[k:]:
            self.open[o.tag] -= 1
        del self.stack[k:]

    def _end(self, tag: str) -> None:
        if tag in _VOID:
            return
        if not self.open.get(tag):
            if tag == "p":
                self._flush()
            return
        stack = self.stack
        if tag in _INLINE and tag not in ("td", "th"):
            inline = stack[stack[-1].base].inline
            if not inline.get(tag):
                return  # open outside of this box only
            inline[tag] -= 1
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            if (stack[k].bad, stack[k].mark) != (stack[k - 1].bad, stack[k - 1].mark):
                self._flush()
            self.open[tag] -= 1
            del stack[k]
            return
        k = len(stack) - 1
        inline = True
        while stack[k].tag != tag:
            inline &= stack[k].tag in _INLINE
            k -= 1
        if not inline or tag not in _INLINE:
            self._flush()
        self._pop_to(k)

    def _start(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in ("br", "td", "th", "img"):
            self.text.append(" ")
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            box = stack[-1].box
            self.looks[box] = (self.looks[box] * 31 + xxhash.xxh3_64_intdigest(tag)) & _MASK
            return
        if tag not in _INLINE:
            self._flush()
        for kind in ("p",) if tag in _CLOSES_P else (tag,) if tag in _CLOSED_BY_OWN else ():
            if (k := stack[-1].near.get(kind, 0)) > 0:
                if tag in ("td", "th"):
                    self.text.append(" ")
                self._pop_to(k)
        if tag == "body":
            self._pop_to(1)
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        top = stack[-1]
        role = named.get("role", "")
        names = f"{named.get('class', '')} {named.get('id', '')}"
        words = set(_SPLIT.split(names))
        bad = top.bad or tag in _NOT_ARTICLE or role in _ROLES or (top.inside < 2 and tag == "header")
        # an article is marked by a whole name only (a card's `teaser`, not `comments-open`), body and main by none
        marked = not bad and tag not in ("body", "main") and bool((set(names.split()) if tag == "article" else words) & (_WORDS if top.inside < 2 else _WORDS - _OF_ARTICLES))
        marked |= not bad and tag not in ("body", "main", "article") and top.inside < 2 and "header" in words
        mark = top.mark
        if marked:
            self.mark_of.append(mark)
            mark = len(self.mark_of) - 1
        inside = top.inside
        if not bad and (tag == "article" or role == "article"):
            inside = 3 if inside in (1, 3) else 2
        elif not bad and (tag == "main" or role == "main"):
            inside = max(inside, 1)
        style = tag + "".join(f".{w}" for w in named.get("class", "").split()) + (f"#{named['id']}" if named.get("id") else "")
        style = xxhash.xxh3_64_intdigest(_NUMBER.sub("0", style))
        box = top.box
        self.looks[box] = (self.looks[box] * 31 + style) & _MASK
        if tag in _INLINE:
            if (bad, mark) != (top.bad, top.mark):
                self._flush()
            base = top.base
            if tag not in ("td", "th"):
                inline = stack[base].inline
                inline[tag] = inline.get(tag, 0) + 1
        else:
            base = len(stack)
            self.paths.append(xxhash.xxh3_64_intdigest(self.paths[box].to_bytes(8, "little") + style.to_bytes(8, "little")))
            self.parents.append(box)
            self.looks.append(0)
            box = len(self.paths) - 1
        near = top.near
        if tag in _STOPS or tag in _CLOSED_BY_OWN:
            near = near | dict.fromkeys(_STOPS.get(tag, ()), 0)
            if tag in _CLOSED_BY_OWN:
                near[tag] = len(stack)
        stack.append(_Open(tag, box, base, bad, inside, mark, near))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _judge(self) -> None:
        """A box of most of a page's text is marked for nothing, unless an article or main is outside of it."""
        total = in_main = 0
        chars, main = [0] * len(self.mark_of), [0] * len(self.mark_of)
        for _, text, named, inside, mark in self.found:
            if not named:
                total += len(text)
                in_main += len(text) * (inside > 0)
                chars[mark] += len(text)
                main[mark] += len(text) * (inside > 0)
        for k in range(len(self.mark_of) - 1, 0, -1):
            chars[self.mark_of[k]] += chars[k]
            main[self.mark_of[k]] += main[k]
        good = [True] * len(self.mark_of)
        for k in range(1, len(good)):
            good[k] = good[self.mark_of[k]] and 2 * chars[k] > total and main[k] == in_main
        self.blocks = [(box, None if named or not good[mark] else text, _long(text)) for box, text, named, _, mark in self.found]


def blocks(page: str) -> list[str]:
    """The texts of a page that no name says to be no article, in page order."""
    return [text for _, text, _ in Page(page).blocks if text is not None]


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("site", pa.int64()), ("paths", _LONGS), ("parents", _INTS), ("looks", _LONGS), ("boxes", _INTS), ("contents", _LONGS), ("texts", pa.list_(pa.string()))])


def parse(pages: DataFrame) -> DataFrame:
    """row, page_id, url, site; paths, parents and looks of the boxes that hold text; boxes, contents (hashes) and texts of the blocks."""

    def of_page(html: str) -> tuple:
        page = Page(html)
        wanted = bytearray(len(page.paths))
        for box, _, _ in page.blocks:
            while box >= 0 and not wanted[box]:
                wanted[box] = 1
                box = page.parents[box]
        number, n = [-1] * (len(wanted) + 1), 0
        for k, yes in enumerate(wanted):
            if yes:
                number[k], n = n, n + 1
        kept = [k for k, yes in enumerate(wanted) if yes]
        signed = lambda values: [values[k] - (1 << 63) for k in kept]
        return (
            signed(page.paths), [number[page.parents[k]] for k in kept], signed(page.looks),
            [number[b] for b, _, _ in page.blocks], [c for _, _, c in page.blocks], [t for _, t, _ in page.blocks],
        )

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                host = _HOST.match(url or "")
                rows.append((page_id, url, _long((host[1] if host else url or "").lower()), *of_page(page or "")))
                size += len(page or "")
                if size > 4 << 20:
                    yield _batch(rows, _PARSED)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _PARSED)

    slim = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    kind = "page_id long, url string, site long, paths array<long>, parents array<int>, looks array<long>, boxes array<int>, contents array<long>, texts array<string>"
    return slim.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _share(sum_n_ln_n, n, bodies):
    """Entropy of counts with sum n, as a share of ln(bodies); 1 at most."""
    return F.least(F.lit(1.0), (F.ln(n) - sum_n_ln_n / n) / F.ln(bodies))


def importance(parsed: DataFrame, settings: StyleTreeSettings) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The site style trees: (site, node, importance, most) of each node, most being the highest importance of texts in its
    branch; (site, key) of single texts on most bodies of a site, key being node xor content; and the kept tables that these are read from.

    Counts are summed in each task before they are shuffled, and a node's entropy is put together from its
    sums, so a site with a third of all pages is no single group.
    """
    body = F.xxhash64(F.sort_array(F.array_distinct("contents")))
    first = F.min(F.struct("contents", "paths", "parents", "looks", "boxes"))
    bodies = keep(parsed.groupBy("site", body.alias("body")).agg(first.alias("b")).select("site", "b.*"), "bodies")
    up = F.when(F.col("z.parents") >= 0, F.get("paths", F.col("z.parents")))
    node = bodies.select("site", "paths", F.explode(F.arrays_zip("paths", "parents", "looks")).alias("z")).select("site", F.col("z.paths").alias("node"), up.alias("up"), F.col("z.looks").alias("look"))
    looks = node.groupBy("site", "node", "look").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("up"))
    n_ln_n = F.sum(F.col("n") * F.ln("n"))
    looks = looks.groupBy("site", "node").agg(F.sum("n").alias("m"), n_ln_n.alias("l"), F.max("up").alias("up"))
    at = F.arrays_zip(F.transform("boxes", lambda b: F.get("paths", b)).alias("node"), F.col("contents").alias("content"))
    text = bodies.select("site", F.explode(F.array_distinct(at)).alias("z")).select("site", "z.node", "z.content")
    texts = keep(text.groupBy("site", "node", "content").agg(F.count(F.lit(1)).alias("n")), "contents")
    pages = bodies.groupBy("site").agg((F.count(F.lit(1)) + settings.prior).alias("bodies"))  # a row per site
    counted = texts.join(pages, "site")
    rare = F.avg(1 - F.ln("n") / F.ln("bodies"))
    contents = counted.groupBy("site", "node").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), n_ln_n.alias("c"), rare.alias("rare"))
    tree = looks.join(pages, "site").join(contents, ["site", "node"], "left")
    own = F.when(F.col("k") > 0, F.greatest("rare", _share(F.col("c"), F.col("w"), F.col("bodies"))))
    look = F.when(F.col("m") == 1, 1.0).otherwise(_share(F.col("l"), F.col("m"), F.col("bodies")))
    tree = tree.select(
        "site", "node", "up", (F.coalesce(own * F.col("k"), F.lit(0.0)) + settings.presentation * look).alias("s"), (F.coalesce("k", F.lit(0)) + settings.presentation).alias("t"), F.coalesce(own, F.lit(0.0)).alias("most")
    )
    tree = _sum_up(keep(tree, "tree"))
    repeated = counted.where(F.col("n") > settings.most_share * F.col("bodies"))
    keys = repeated.select("site", F.col("node").bitwiseXOR(F.col("content")).alias("key")).distinct()
    return tree.select("site", "node", (F.col("s") / F.col("t")).alias("importance"), "most"), keys, [bodies, texts, tree]


def _sum_up(tree: DataFrame) -> DataFrame:
    """Sums of s and t and the highest most over each node's branch: every round looks twice as far down, so a depth of d takes log2(d) rounds."""
    while not tree.where("up is not null").isEmpty():
        below = tree.where("up is not null").groupBy("site", F.col("up").alias("node")).agg(F.sum("s").alias("s2"), F.sum("t").alias("t2"), F.max("most").alias("most2"))
        summed = tree.join(below, ["site", "node"], "left")
        above = tree.where("up is not null").select("site", F.col("node").alias("up"), F.col("up").alias("next"))
        zero = F.lit(0.0)
        new = summed.join(above, ["site", "up"], "left").select(
            "site", "node", F.col("next").alias("up"), (F.col("s") + F.coalesce("s2", zero)).alias("s"), (F.col("t") + F.coalesce("t2", zero)).alias("t"), F.greatest("most", "most2").alias("most")
        )
        new = keep(new, "tree")
        drop(tree)
        tree = new
    return tree


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_removed", pa.int64()), ("n_named", pa.int64()), ("n_tree", pa.int64())])


def _prune(batches):
    """Each page without the boxes that are cut, or stand in one that is, and without texts that are cut."""
    for batch in batches:
        rows = []
        columns = ("page_id", "url", "paths", "parents", "boxes", "contents", "texts", "cut")
        for page_id, url, paths, parents, boxes, contents, texts, cut in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            cut, gone = set(cut or ()), []
            for path, parent in zip(paths, parents, strict=True):
                gone.append(path in cut or (parent >= 0 and gone[parent]))
            stay = [t for t, b, c in zip(texts, boxes, contents, strict=True) if not gone[b] and paths[b] ^ c not in cut]
            text = "\n".join(t for t in stay if t is not None)
            n_named = texts.count(None)
            rows.append((page_id, url, text, len(text), len(texts) - n_named - len(stay) + stay.count(None), n_named, len(texts) - len(stay)))
        if rows:
            yield _batch(rows, _RESULT)


def extract(pages: DataFrame, settings: StyleTreeSettings = StyleTreeSettings(), most_broadcast: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars, n_removed (blocks cut by the style tree alone), n_named (blocks of a telling name), n_tree (all that the tree cuts) per page."""
    parsed = keep(parse(pages), "parsed")
    tree, repeated, read = importance(parsed, settings)
    dull = (F.col("importance") < settings.least_importance) & (F.col("most") < settings.least_importance)
    noise = keep(tree.where(dull).select("site", F.col("node").alias("key")).unionAll(repeated), "noise").groupBy("site").agg(F.collect_set("key").alias("noise"))
    drop(*read)
    if noise.select(F.coalesce(F.sum(F.size("noise")), F.lit(0))).first()[0] <= most_broadcast:
        noise = F.broadcast(noise)  # else Spark joins by shuffle
    keys = F.zip_with(F.transform("boxes", lambda b: F.get("paths", b)), "contents", lambda a, b: a.bitwiseXOR(b))
    cut = F.when(F.col("noise").isNotNull(), F.array_intersect("noise", F.concat("paths", keys)))
    joined = parsed.join(noise, "site", "left").select("page_id", "url", "paths", "parents", "boxes", "contents", "texts", cut.alias("cut"))
    return joined.mapInArrow(_prune, "page_id long, url string, text string, n_chars long, n_removed long, n_named long, n_tree long")
