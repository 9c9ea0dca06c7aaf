"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page is read as a stream of tags and texts.  Streams of one host are aligned one after another into a wrapper, a regular expression without unions: sub-expressions
in sequence, each once, optional or repeated, and texts that are constant or slots.  A tag that stands again beside an equal one makes a repeated group; a
mismatch is resolved by skipping ahead to the tag that fits, and what is skipped, on either side, becomes optional; texts that differ become slots.  A
sequence that grows past ``WIDE`` items is one repeated group of optional items.  Wrappers of parts of a host align with each other the same way, so tasks infer
them from their own pages and a few rounds of small groups merge them; no task reads all pages of a host.

The wrapper says where a host keeps its article: in ``article`` elements, else in the element named for content that has most of the slot text, else in the innermost
element that has most of it; there texts that all pages share and blocks of links are left out.  A page is aligned with its host's wrapper and gives the texts
of those places.  Menus, headers, footers, sidebars, notices, adverts, forms and comments are known by tag, role and name, and are left out wherever they stand.

* Null or empty html gives an empty text; a null url, or one without a host, belongs to the host ``""``.  A page on which the host's places do not
  occur (also an only page) is its own wrapper.
* Very long pages are read whole; elements nested deeper than ``DEEP`` (frames: twice that) count as part of the one above.  Repeated rows give equal texts.
* An empty table gives an empty one.  Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import written
from tablewarden.llm.words import small_batches

DEEP, WIDE, FAN = 100, 64, 64         # nesting, items of a sequence, wrappers merged in one group
HOSTS = 2_000                         # hosts whose wrappers a task holds at once
BROADCAST = 32 << 20                  # bytes of wrappers that are sent to all tasks; more are joined

_QUOTED = r"""(?:"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,20000}+"|'[^']{0,20000}+'|[^>"'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)({_QUOTED})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes template xmp svg math canvas object select button datalist audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
                   "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog search".split())
#: Tags that end an open element of one of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
#: What keeps an implied end from reaching further out.
LIMITS = frozenset("ul ol dl table td th div section article main body html aside nav header footer form".split())
#: Words in names and roles of elements that hold no article text.
FRAME = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense alert banner breadcrumb breadcrumbs colophon complementary consent contentinfo cookie cookies "
                  "copyright dialog disclaimer footer form gdpr header headline-bar login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
                  "popup promo promos promotion recommended related search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar "
                  "widget widgets".split())
TALK = frozenset("comment comments commentary commentlist discussion disqus feedback replies reply respond responses".split())
CONTENT = frozenset("article content entry main post story text articlebody body".split())
BLANK = frozenset(("header", "footer"))


class Node:
    """A sub-expression: of a wrapper, or of one page (then ``runs`` lists its texts).

    ``seen``: groups of the parent that have it, ``times``: how often it stands there; ``text``: digest of its own text, None where texts differ (a slot);
    ``chars`` and ``links``: characters of its own texts and of those inside links; ``any_order``: its items are one repeated group.
    """

    __slots__ = ("sign", "seen", "times", "text", "chars", "links", "any_order", "items", "runs", "main")

    def __init__(self, sign: str):
        self.sign, self.seen, self.times, self.text, self.chars, self.links, self.any_order, self.items, self.runs, self.main = sign, 1, 1, 0, 0, 0, False, [], [], False

    @property
    def tag(self) -> str:
        return self.sign.split(" ", 1)[0]

    @property
    def kind(self) -> str:
        """``""``, or why it holds no article text: ``outside`` by tag, ``frame`` or ``talk`` by name."""
        return _kind(self.sign)

    def plain(self) -> list:
        return [self.sign, self.seen, self.times, self.text, self.chars, self.links, int(self.any_order), [k.plain() for k in self.items]]

    @staticmethod
    def of(plain: list) -> "Node":
        node = Node(plain[0])
        node.seen, node.times, node.text, node.chars, node.links, order, items = plain[1:]
        node.any_order, node.items = bool(order), [Node.of(k) for k in items]
        return node


_KINDS: dict[str, str] = {}


def _kind(sign: str) -> str:
    if sign not in _KINDS:
        if len(_KINDS) > 100_000:
            _KINDS.clear()
        tag, _, names = sign.partition(" ")
        words = set(names.split())
        _KINDS[sign] = "outside" if tag in OUTSIDE else "" if tag in ("html", "body", "main") else "talk" if words & TALK else "frame" if words & FRAME or tag in BLANK else ""
    return _KINDS[sign]


def _sign(tag: str, attributes: str) -> str:
    """Tag and the words of class, id, role and itemprop, without digits."""
    if "=" not in attributes:
        return tag
    words = [p.lower() for found in _ATTRIBUTE.findall(attributes) for p in _NAME_PART.findall(found[1] or found[2] or found[3])]
    return " ".join([tag, *dict.fromkeys(words)][:12])


def _alike(a: Node, b: Node) -> bool:
    """Whether two expressions can be one: equal signs, and for elements without a name also like content."""
    if a.sign != b.sign:
        return False
    if " " in a.sign or a.tag not in ("div", "section", "td", "center") or not (a.items or b.items):
        return True
    left, right = {k.sign for k in a.items}, {k.sign for k in b.items}
    return 3 * len(left & right) >= len(left | right)


def _joined(a: Node, b: Node, beside: bool) -> None:
    """Align ``b`` with ``a``, which becomes the expression of both; ``beside``: they stand in one sequence, so the group repeats."""
    a.seen += 0 if beside else b.seen
    a.times += b.times
    if a.text != b.text:
        a.text = None
    a.chars += b.chars
    a.links += b.links
    a.runs += b.runs
    a.any_order |= b.any_order
    _aligned(a, b.items)


def _aligned(a: Node, items: list[Node]) -> None:
    mine = a.items
    if not a.any_order and len(mine) == len(items) and all(_alike(x, y) for x, y in zip(mine, items)):
        for x, y in zip(mine, items):
            _joined(x, y, False)
        return
    i = 0
    for y in items:
        start = 0 if a.any_order else i
        j = next((j for j in range(start, len(mine)) if _alike(mine[j], y)), None)
        if j is None:                                   # only in b: optional
            mine.insert(i, y)
            i += 1
        else:                                           # what lies between is only in a: optional
            _joined(mine[j], y, False)
            i = j + 1
    if len(mine) > WIDE:
        a.any_order, a.items = True, _grouped(mine)


def _grouped(items: list[Node]) -> list[Node]:
    """One item for each sign; if these are still too many, one for each tag."""
    for key in (lambda k: k.sign, lambda k: k.tag + (" " + k.kind if k.kind in TALK | FRAME else "")):
        found: dict[str, Node] = {}
        for k in items:
            if key(k) in found:
                _joined(found[key(k)], k, False)
            else:
                k.sign = key(k)
                found[key(k)] = k
        items = list(found.values())
        if len(items) <= WIDE:
            break
    return items


def parsed(page: str) -> tuple[Node, list[tuple[int, str]]]:
    """A page's expression, and its texts (number of the block, text) in page order."""
    root = Node("")
    stack, texts, block, link, at, n = [root], [], 0, False, 0, len(page)
    own: dict[int, list[str]] = {}

    def closed() -> None:
        node = stack.pop()
        said = own.pop(id(node), None)
        if said:
            node.text = int.from_bytes(hashlib.blake2b(" ".join(" ".join(said).split()).encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big") or 1
        before = stack[-1].items
        if before and _alike(before[-1], node):
            _joined(before[-1], node, True)
        else:
            before.append(node)
            if len(before) > WIDE:
                stack[-1].any_order, stack[-1].items = True, _grouped(before)

    def end(names, limits) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].sign.split(" ", 1)[0]
            if tag in names:
                while len(stack) > k:
                    closed()
                return True
            if tag in limits:
                return False
        return False

    while at < n:
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            said = token[0]
            if said[0] == "<" and len(said) > 1:
                continue                                # a comment or declaration
            texts.append((block, said))
            node = stack[-1]
            node.runs.append(len(texts) - 1)
            size = len(said.strip())
            if size:
                node.chars += size
                node.links += size if link else 0
                own.setdefault(id(node), []).append(said)
            continue
        tag = tag.lower()
        if token[1] or token[4]:
            if tag in BLOCKS:
                block, link = block + 1, False
                end((tag,), LIMITS if tag == "p" or tag in CLOSES else ())
            elif tag == "a":
                link = False
            else:
                end((tag,), BLOCKS)
            continue
        attributes = token[3] or token[6] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else (n if tag in ("script", "style", "textarea") else at)
            continue
        if tag == "br":
            texts.append((block, " "))
            stack[-1].runs.append(len(texts) - 1)
            continue
        if tag in BLOCKS:
            block += 1
            end(("p",), LIMITS)
            if tag in CLOSES:
                end(CLOSES[tag], LIMITS - set(CLOSES[tag]))
            link = False
        elif tag == "a":
            link = True
        if tag in VOID:
            continue
        sign = _sign(tag, attributes)
        if (tag in BLOCKS or _kind(sign)) and not attributes.endswith("/") and len(stack) <= (2 * DEEP if _kind(sign) else DEEP):
            stack.append(Node(sign))
    while len(stack) > 1:
        closed()
    return root, texts


def _freed(node: Node) -> bool:
    """Whether an article or main element lies inside; an element around one is no frame, whatever it is called."""
    inside = [_freed(k) for k in node.items]
    found = any(inside) or (node.tag in ("article", "main") and node.kind == "")
    if any(inside) and node.kind == "frame" and node.tag not in BLANK:
        node.sign = node.tag
    return found


def _mass(node: Node, pages: int, sizes: dict) -> int:
    """Characters outside links of the slots below; of an only page, of all texts."""
    own = 0 if node.kind and node.kind != "" else (node.chars - node.links if node.text is None or pages < 2 else 0)
    below = sum(_mass(k, pages, sizes) for k in node.items)
    sizes[id(node)] = 0 if node.kind else own + below
    return sizes[id(node)]


def _walk(node: Node):
    """The expressions outside frames, from the outside in."""
    if not node.kind:
        yield node
        for k in node.items:
            yield from _walk(k)


def choose(root: Node, pages: int) -> None:
    """Mark the places of the article as ``main`` and frame what stands in them without belonging there."""
    _freed(root)
    sizes: dict[int, int] = {}
    _mass(root, pages, sizes)
    nodes = list(_walk(root))
    articles = [k for k in nodes if k.tag == "article"]
    most = max((sizes[id(k)] for k in articles), default=0)
    if articles:
        for k in articles:
            k.main = 5 * sizes[id(k)] >= most
        return
    named = [k for k in nodes if sizes[id(k)] and (k.tag == "main" or set(k.sign.split()[1:]) & CONTENT)]
    place = max(named, key=lambda k: sizes[id(k)]) if named else root
    while True:                                          # inwards, as long as one element has most of the text
        inner = [k for k in place.items if not k.kind and (10 * sizes[id(k)] >= (7 if named else 6) * sizes[id(place)]) and k.tag in LIMITS]
        if not inner or not sizes[id(place)]:
            break
        place = inner[0]
    place.main = True
    for k in list(_walk(place)):
        if k is not place:
            chars, links = _linked(k)
            constant = pages > 2 and k.text and k.seen >= pages
            if (2 * links > chars and k.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt")) or (constant and not k.items and k.tag[0] != "h"):
                k.sign = f"{k.sign} skip"
                k.main = None


def _linked(node: Node) -> tuple[int, int]:
    below = [_linked(k) for k in node.items]
    return node.chars + sum(x[0] for x in below), node.links + sum(x[1] for x in below)


def _taken(place: Node | None, node: Node, inside: bool, runs: list[int]) -> bool:
    """Collect the texts of a page's expression that the wrapper's places take; whether one of them stands on the page."""
    if node.kind and not (inside and node.tag == "header"):
        return False
    if place is not None and place.main is None:
        return False
    found = place is not None and place.main
    inside = inside or bool(found)
    heading = node.tag == "header" and inside
    if inside and not heading:
        runs += node.runs
    i, items = 0, place.items if place is not None else []
    for k in node.items:
        if heading and k.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
            continue
        same = lambda x: x.sign == k.sign or x.sign == f"{k.sign} skip"
        j = next((j for j in range(0 if place is not None and place.any_order else i, len(items)) if same(items[j])), None)
        if j is None:
            j = next((j for j in range(len(items)) if same(items[j])), None)
        else:
            i = j if items[j].times > items[j].seen else j + 1
        found |= _taken(items[j] if j is not None else None, k, inside, runs)
    return found


def main_text(page: str | None, wrapper: Node | None) -> str:
    """The blocks of a page that its host's wrapper takes, one a line, white space made one space, character references decoded."""
    if not page:
        return ""
    root, texts = parsed(page)
    _freed(root)
    runs: list[int] = []
    if wrapper is None or not _taken(wrapper, root, False, runs):
        runs = []
        choose(root, 1)
        _taken(root, root, False, runs)
    blocks: dict[int, list[str]] = {}
    for r in sorted(runs):
        blocks.setdefault(texts[r][0], []).append(texts[r][1])
    lines = (" ".join(html.unescape("".join(said)).split()) for said in blocks.values())
    return "\n".join(line for line in lines if line)


def host_of(url: Column) -> Column:
    """The host of a url: after ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; ``""`` without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit("")))


def _stored(root: Node, pages: int) -> bytes:
    return json.dumps([pages, root.plain()], separators=(",", ":")).encode()


def _read(stored: bytes) -> tuple[int, Node]:
    pages, plain = json.loads(stored)
    return pages, Node.of(plain)


def _inferred(batches):
    """Wrappers (host, wrapper) of a task's pages."""
    import pyarrow as pa

    held: dict[str, list] = {}

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array([_stored(*v) for v in held.values()], type=pa.binary())], names=["host", "wrapper"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"]):
            text = page.as_py()
            if not text:
                continue
            root = parsed(text)[0]
            _unlisted(root)
            if host in held:
                _joined(held[host][0], root, False)
                held[host][1] += 1
            else:
                held[host] = [root, 1]
            if len(held) >= HOSTS:
                yield rows()
    if held:
        yield rows()


def _unlisted(node: Node) -> None:
    node.runs = []
    for k in node.items:
        _unlisted(k)


def _merged(table):
    """The wrappers of one group of one host as one."""
    import pyarrow as pa

    whole, count = None, 0
    for stored in sorted(x.as_py() for x in table["wrapper"]):
        pages, root = _read(stored)
        count += pages
        if whole is None:
            whole = root
        else:
            _joined(whole, root, False)
    return pa.table({"host": table["host"].slice(0, 1), "wrapper": pa.array([_stored(whole, count)], type=pa.binary())})


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (bytes) of all pages (host, html): tasks align their own pages, groups of at most ``FAN`` wrappers of a host are merged in rounds."""
    small_batches(pages.sparkSession)
    found = written(pages.select("host", "html").mapInArrow(_inferred, "host string, wrapper binary"), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        parts = -(-most // FAN)
        dealt = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(max(1, parts * 2 if parts > 1 else 1))))
        found = written(dealt.groupBy("host", "part").applyInArrow(_merged, "host string, wrapper binary"), "wrappers")
        if parts <= 1:
            return found


def _extracted(keys: list[str], wrappers):
    import pyarrow as pa

    def run(batches):
        sent = wrappers.value if wrappers is not None else {}
        read: dict[str, Node] = {}

        def wrapper(host, stored):
            if host not in read:
                if len(read) > HOSTS:
                    read.clear()
                if stored is None:
                    return None
                pages, root = _read(stored)
                choose(root, pages)
                read[host] = root
            return read[host]

        for batch in batches:
            given = batch["wrapper"] if wrappers is None else None
            texts = []
            for i, host in enumerate(batch["host"].to_pylist()):
                stored = given[i].as_py() if given is not None and host not in read else sent.get(host)
                texts.append(main_text(batch["html"][i].as_py(), wrapper(host, stored)))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(texts, type=pa.string())], names=[*keys, "text"])

    return run


def extract(pages: DataFrame, keys: list[str], url: str = "url", page: str = "html", limit: int = BROADCAST) -> DataFrame:
    """``keys`` and ``text`` (the main text) of every row.

    Wrappers of up to ``limit`` bytes together are sent to all tasks; more are joined to the pages by host, pages of one host dealt over several tasks.
    """
    kinds = dict(pages.dtypes)
    read = pages.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)], host_of(F.col(f"`{url}`").cast("string")).alias("host"), F.col(f"`{page}`").cast("string").alias("html"))
    wrappers = infer(read)
    names = [f"_{i}" for i in range(len(keys))]
    schema = ", ".join([*(f"_{i} {kinds[k]}" for i, k in enumerate(keys)), "text string"])
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= limit:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in wrappers.collect()})
        out = read.mapInArrow(_extracted(names, sent), schema)
    else:
        salts = F.array(*[F.lit(k) for k in range(32)])
        joined = read.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(32)).cast("int")).join(wrappers.withColumn("_salt", F.explode(salts)), ["host", "_salt"], "left")
        out = joined.drop("_salt").mapInArrow(_extracted(names, None), schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "text")
