"""Main text of web pages by wrappers inferred from same-host pages.

A wrapper is a union-free regular expression over a host's token streams, written as a tree: the
parts of an element are a sequence of elements and text slots, each of which may be optional or
repeated. Pages are aligned with it one after another: parts that only one side has become optional,
runs of equal parts become one repeated part (or a repeated group of up to three), and a text that
differs becomes a slot. Aligning two wrappers works like aligning a page.

The order of alignment is fixed by the pages alone, so another partitioning gives the same wrappers: pages of
equal shape are taken together first (their slots' counts add up), shapes are dealt to buckets by their
digests, about ``FAN`` to a bucket, and aligned in the order of digests; the buckets' wrappers are
aligned again, ``FAN`` at a time, until a host has one. Tasks read the sorted rows as a stream and hold
one wrapper, whatever a host's size.

Each slot counts its characters. The main part of a host is its article or main element with the
most varying slot text, or without one the innermost part, not repeated, that holds most of the varying
text. Each page's text is then read from the parts at that place, without menus, headers, footers, side bars,
notices, adverts, forms, scripts, styles and comments, and, where no article element marks the main part,
without texts that never vary over the host's pages. Those are counted by host, place and digest over
all pages, outside the wrapper, whose width is bounded by taking parts together, never by leaving any out.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, partitions, pick, read, staged

#: Shapes, or wrappers, that are aligned in one bucket.
FAN = 64
#: Beyond so many parts in sequence equal ones are merged, then ones of equal tags, then all.
WIDTH = 64
#: Shapes that a task holds before it passes them on.
SHAPES = 2000
#: Places and templates of up to so many characters in all are broadcast.
BROADCAST = 16_000_000
#: Elements nested deeper are read as parts of the one above them; their texts stay in place.
DEEP = 100
#: A text that never varied belongs to the template if so many pages showed it.
CONSTANT_PAGES = 3

_apart_from_text = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)", re.IGNORECASE)
_attrs = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>")
#: Elements whose content is no markup, and how each ends; all but ``xmp`` are left out.
RAW = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "svg", "xmp")}
_named = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_hint = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
_digits = re.compile(r"[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics annotation".split())
#: Elements that never hold main text.
APART = frozenset("nav header footer aside form script style noscript template button select option input head title menu dialog iframe svg".split())
#: Elements that hold the page or its main part, whatever their class, id or role says.
PAGE = frozenset("html body article main".split())
#: Names of a class, id or role that mark such parts, alone or with words of ``PLACE`` only.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header footer comment comments disqus reply replies respond related share sharing social widget pagination pager toolbar search complementary contentinfo".split()
)
#: What may stand beside such a name; any other word makes it another thing's name or a state of the page.
PLACE = frozenset(
    "site main page post posts entry article articles blog top bottom left right primary secondary global local sub mobile user wp js the google "
    "wrapper wrap container box block list section area bar panel item items inner outer content region slot unit button buttons link links signup stories".split()
)
#: An element holds most of another one's text from this share on.
MOST = 0.7
#: Start tags that end an open element of the same set in the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body article section main div table ul ol dl td th blockquote aside nav header footer form figure".split())


def tokens(page: str):
    """(text, None, None, None) or (None, "/" or "", tag, attributes) of each token of a page, in time linear in it.

    A tag ends at the first ``>`` outside quotes. Where a quote stays open up to the end of the page, tags that
    start before it end at the first ``>`` at all, so no stretch is read for a tag more than a few times. Comments, and raw elements with their contents, are left out.
    """
    at, size, last, torn = 0, len(page), page.rfind(">"), -1
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield page[at:start], None, None, None
        if start > last:  # no tag ends any more
            if not page.startswith(("<!", "<?"), start) and start < size:
                follows = min((x for x in (page.find("<!", start), page.find("<?", start)) if x >= 0), default=size)
                yield page[start:follows], None, None, None
            return
        m = _apart_from_text.match(page, start)
        if not m:
            yield "<", None, None, None
            at = start + 1
        elif not m["tag"]:
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0].upper(), ">")
            end = page.find(stop, m.end())
            at = size if end < 0 else end + len(stop)
        else:
            whole = None
            if start > torn:
                whole = _attrs.match(page, m.end())
                if not whole:  # a quote that never closes: it is the last of its kind
                    rest = re.sub(r"\"[^\"]*+\"|'[^']*+'", lambda q: " " * len(q[0]), page[m.end() :])
                    torn = m.end() + min(x for x in (rest.find('"'), rest.find("'"), len(rest)) if x >= 0)
            end = whole.end() if whole else page.find(">", m.end()) + 1
            tag, at = m["tag"].lower(), end
            if not m["end"] and tag in RAW:
                close = RAW[tag].search(page, end)
                if tag == "xmp":
                    yield None, "", tag, ""
                    yield page[end : close.start() if close else size], None, None, None
                    yield None, "/", tag, ""
                at = close.end() if close else size
                continue
            yield None, m["end"], tag, page[m.end() : end - 1]


def tree(page: str | None) -> list:
    """The page as [key, parts]; a text part is a string. Unclosed and crossed tags are repaired.

    Below ``DEEP`` an element has no parts of its own: they follow it in its parent, and an empty part
    of its name marks its end. Only a part that is left out (a menu in an article) still gets its own.
    Places of open elements are kept by tag, so no tag searches the stack.
    """
    root: list = ["", []]
    stack, tags = [root], [""]
    places: dict[str, list[int]] = {}
    scopes: list[int] = [0]

    def close(at: int) -> None:
        for k in range(len(tags) - 1, at - 1, -1):
            if stack[k] is stack[k - 1]:
                stack[k][1].append([tags[k], []])
            places[tags[k]].pop()
            if scopes[-1] == k:
                scopes.pop()
        del tags[at:], stack[at:]

    for text, end, tag, attrs in tokens(page or ""):
        if text is not None:
            if text:
                stack[-1][1].append(text)
            continue
        if end:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        ends = CLOSES.get(tag, ()) if tag not in ENDS_P else ("p",)
        at = max((places[t][-1] for t in ends if places.get(t)), default=0)
        if at and at >= scopes[-1]:
            close(at)
        names = sorted({w for a in _named.findall(attrs) for w in (a[1] or a[2] or a[3]).lower().split()}) if attrs else []
        node: list = [" ".join([tag, *names]), []]
        stack[-1][1].append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(stack[-1] if len(stack) > DEEP and (apart(stack[-1][0]) or not apart(node[0])) else node)
            places.setdefault(tag, []).append(len(tags))
            if tag in SCOPE:
                scopes.append(len(tags))
            tags.append(tag)
    return root


def marks(name: str) -> bool:
    """Whether a class, id or role names a part that is left out: ``sidebar-left``, ``site-footer`` and ``commentlist`` do, ``has-sidebar``, ``share-price`` and ``comments-open`` do not."""
    words = [w for w in _hint.findall(name) if w not in PLACE]
    return bool(words) and all(w in APART_WORDS or any(w[:i] in APART_WORDS and w[i:] in PLACE for i in range(2, len(w))) for w in words)


@lru_cache(4096)
def apart(key: str) -> bool:
    tag, *names = key.split(" ")
    return tag in APART or (tag not in PAGE and any(map(marks, names)))


# A wrapper part is [key, repeated, optional, characters, digest of a constant text or None, parts, pages that showed it, at least]; the key of a text slot is "#".
# Numbers in keys are taken as equal. "div *" stands for a div of any class, id or role, "*" for any element.


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(4096)
def plain(key: str) -> str:
    return _digits.sub("0", key)


def part_of(node) -> list | None:
    if isinstance(node, str):
        text = _space.sub(" ", node).strip()
        return ["#", 0, 0, len(text), digest(text), [], 1] if text else None
    return [plain(node[0]), 0, 0, 0, None, narrowed(folded([p for p in map(part_of, node[1]) if p])), 1]


def shape_of(part: list) -> int:
    """A digest of what a wrapper is without its counts and texts, not negative."""

    def walk(p: list) -> str:
        return f"{p[0]}|{p[1]}{p[2]}({','.join(map(walk, p[5]))})"

    return digest(walk(part)) >> 1 & (1 << 62) - 1


def merged(parts: list) -> list:
    """``parts`` with those of equal keys taken together, in the order of the first ones."""
    first: dict[str, list] = {}
    for p in parts:
        first[p[0]] = aligned_part(first[p[0]], p, max) if p[0] in first else p
    return list(first.values())


def widened(parts: list, by_tag: bool) -> list:
    return [p if p[0] == "#" else [f"{p[0].split(' ', 1)[0]} *" if by_tag and p[0] != "*" else "*", *p[1:]] for p in parts]


def narrowed(parts: list) -> list:
    """``parts``, with equal ones taken together if there are more than ``WIDTH``, then those of equal tags, then all elements."""
    if len(parts) <= WIDTH:
        return parts
    out = merged(parts)
    if len(out) > WIDTH:
        out = merged(widened(out, True))
    return out if len(out) <= WIDTH else merged(widened(out, False))


def folded(parts: list) -> list:
    """Runs of equal parts, or of equal groups of two or three, as one repeated part."""
    out: list = []
    for part in parts:
        out.append(part)
        for period in (1, 2, 3):
            if period == 1:
                if len(out) > 1 and out[-1][0] == out[-2][0] and out[-1][0] != "#":
                    one = out.pop()
                    out[-1] = aligned_part(out[-1], one, max)
                    out[-1][1] = 1
                    break
            elif len(out) >= 2 * period and [p[0] for p in out[-period:]] == [p[0] for p in out[-2 * period : -period]] and len({p[0] for p in out[-period:]}) == period:
                new = out[-period:]
                del out[-period:]
                old = out[-period:]
                out[-period:] = [[one[0], 1, *one[2:]] for one in (aligned_part(a, b, max) for a, b in zip(old, new, strict=True))]
                break
    return out


def aligned_part(a: list, b: list, pages=int.__add__) -> list:
    """``pages`` adds the page counts of different pages; ``max`` is for parts that the same pages may have shown."""
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], a[4] if a[4] == b[4] else None, aligned(a[5], b[5], pages), pages(a[6], b[6])]


def aligned(a: list, b: list, pages=int.__add__) -> list:
    """One sequence of parts that both sequences match: common parts in order, the rest optional."""
    if [p[0] for p in a] == [p[0] for p in b]:
        return [aligned_part(x, y, pages) for x, y in zip(a, b, strict=True)]
    if any(p[0] == "*" for p in (*a, *b)):
        a, b = merged(widened(a, False)), merged(widened(b, False))
    elif any(p[0].endswith(" *") for p in (*a, *b)):
        a, b = merged(widened(a, True)), merged(widened(b, True))
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(aligned_part(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([*a[i][:2], 1, *a[i][3:]])
            i += 1
        else:
            out.append([*b[j][:2], 1, *b[j][3:]])
            j += 1
    return narrowed(folded(out))  # orders that keep changing would make it ever longer


def main_place(wrapper: list, pages: int) -> dict:
    """{"path": keys down to the main part, "marked": whether an element marks it, "kept": paths that are not left out}.

    An element that only its class, id or role sets apart is kept if it holds most of the page's varying text.
    """
    kept: set[str] = set()

    def out(part: list, path: str) -> bool:
        return apart(part[0]) and path not in kept

    def varying(part: list) -> int:
        return 0 if part[4] is not None and min(pages, part[6]) >= CONSTANT_PAGES else part[3]

    def all_held(part: list) -> int:
        return varying(part) if part[0] == "#" else 0 if part[0].split(" ", 1)[0] in APART else sum(map(all_held, part[5]))

    def held(part: list, path: str) -> int:
        return varying(part) if part[0] == "#" else 0 if out(part, path) else sum(held(p, below(path, p[0])) for p in part[5])

    def size_of(part: list, path: str) -> int:
        return part[3] if part[0] == "#" else 0 if out(part, path) else sum(size_of(p, below(path, p[0])) for p in part[5])

    def look(part: list, path: list[str], at: str, marked: list) -> None:
        if path and out(part, at):
            return
        if part[0].split(" ")[0] in ("article", "main") or "main" in part[0].split(" ")[1:]:
            marked.append(((sum(held(p, below(at, p[0])) for p in part[5]), sum(size_of(p, below(at, p[0])) for p in part[5])), path))
            return
        for p in part[5]:
            if p[0] != "#":
                look(p, [*path, p[0]], below(at, p[0]), marked)

    marked: list[tuple[tuple[int, int], list[str]]] = []
    look(wrapper, [], "", marked)
    whole, at, path = all_held(wrapper), wrapper, ""
    while whole and (inner := max((p for p in at[5] if p[0] != "#"), key=all_held, default=None)) and all_held(inner) >= MOST * whole:
        at, path = inner, below(path, inner[0])
        if apart(inner[0]):
            kept.add(path)
    if kept and not any(n[1] for n, _ in marked):
        marked.clear()
        look(wrapper, [], "", marked)
    if marked:
        return {"path": max(marked, key=lambda x: x[0])[1], "marked": True, "kept": sorted(kept)}
    at, keys, path = wrapper, [], ""
    while True:
        inner = max((p for p in at[5] if p[0] != "#"), key=lambda p: held(p, below(path, p[0])), default=None)
        if inner is None or inner[1] or held(inner, below(path, inner[0])) < MOST * max(1, held(at, path)):
            break
        at, keys, path = inner, [*keys, inner[0]], below(path, inner[0])
    return {"path": keys, "marked": False, "kept": sorted(kept)}


def below(path: str, key: str) -> str:
    return f"{path}>{key}"


def nodes_at(root: list, path: list[str]) -> list[list]:
    def fits(key: str, name: str) -> bool:
        return key == "*" or plain(name) == key or (key.endswith(" *") and name.split(" ", 1)[0] == key[:-2])

    found = [root]
    for key in path:
        found = [p for n in found for p in n[1] if not isinstance(p, str) and fits(key, p[0])]
    return found


def slotted(root: list):
    """(parts, place in them, slots) of each text: the digests of three descriptions of where it stands.

    They are the path of keys, with numbers taken as equal; that and the neighbours of the last
    element; and the path of tags.
    """

    def walk(node: list, path: str, tags: str, beside: str):
        slots = None
        parts = node[1]
        keys = [None if isinstance(p, str) else plain(p[0]) for p in parts]
        after: list = [""] * len(parts)  # the next other key of each element
        run, following = "", ""
        for i in range(len(parts) - 1, -1, -1):
            if keys[i] is not None:
                if keys[i] != run:
                    run, following = keys[i], run
                after[i] = following
        run, before = "", ""
        for i, p in enumerate(parts):
            if isinstance(p, str):
                if p.strip():
                    slots = slots or (digest(path), digest(f"{path}\n{beside}"), digest(f"\n{tags}"))
                    yield parts, i, slots
                continue
            if keys[i] != run:
                run, before = keys[i], run
            tag = p[0].split(" ", 1)[0]
            if tag not in APART:
                yield from walk(p, below(path, keys[i]), below(tags, tag), f"{before}\n{after[i]}")

    return walk(root, "", "", "")


def entries(text: str, slots: tuple[int, ...]) -> list[int]:
    text = _space.sub(" ", text).strip()
    return [digest(f"{slot}\n{text}") for slot in slots]


def text_of(node: list, path: str = "", kept: frozenset[str] = frozenset()) -> str:
    """Text of a part: references decoded, white space in a block as one space, blocks joined by one."""
    blocks: list[list[str]] = [[]]

    def walk(n: list, path: str) -> None:
        for p in n[1]:
            if isinstance(p, str):
                blocks[-1].append(p)
            elif not apart(p[0]) or (kept and below(path, plain(p[0])) in kept):
                inline = p[0].split(" ", 1)[0] in INLINE
                if not inline:
                    blocks.append([])
                walk(p, below(path, plain(p[0])))
                if not inline:
                    blocks.append([])

    walk(node, path)
    return " ".join(t for b in blocks if (t := _space.sub(" ", htmllib.unescape("".join(b))).strip()))


def main_text(page: str | None, place: dict | None, template: frozenset[int] = frozenset()) -> str:
    root = tree(page)

    def at(place: dict) -> str:
        path, kept = "".join(f">{key}" for key in place["path"]), frozenset(place["kept"])
        return " ".join(t for n in nodes_at(root, place["path"]) if (t := text_of(n, path, kept)))

    if place is not None:
        if template:
            for parts, i, slots in slotted(root):
                if not template.isdisjoint(entries(parts[i], slots)):
                    parts[i] = ""
        if text := at(place):
            return text
        if template:
            root = tree(page)
    return at(main_place(part_of(root), 1))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper): the wrapper of each host's pages as JSON; the same for any partitioning of ``pages``."""
    rows = pick(pages, url=url_col, html=html_col).select(host_of(F.col("url")).alias("host"), "html")
    kind = "host string, bucket long, shape long, pages long, wrapper string"

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["host", "bucket", "shape", "pages", "wrapper"])

    def shapes(batches):
        held: dict[tuple[str, int], list] = {}

        def passed_on():
            yield batch_of([(host, 0, shape, n, json.dumps(part)) for (host, shape), (n, part) in held.items()])
            held.clear()

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                part = part_of(tree(page.as_py()))
                key = host, shape_of(part)
                held[key] = [held[key][0] + 1, aligned_part(held[key][1], part)] if key in held else [1, part]
                if len(held) >= SHAPES:
                    yield from passed_on()
        if held:
            yield from passed_on()

    def align(batches):
        """Rows come sorted by host, bucket and shape; one row leaves for each host and bucket."""
        group, shape, pages, whole, same, out = None, None, 0, None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "shape", "pages", "wrapper")), strict=True):
                part = json.loads(row[4])
                if row[:2] != group:
                    if group is not None:
                        whole = same if whole is None else aligned_part(whole, same)
                        out.append((*group, group[1], pages, json.dumps(whole)))
                    group, shape, pages, whole, same = row[:2], row[2], 0, None, part
                elif row[2] == shape:
                    same = aligned_part(same, part)
                else:
                    whole = same if whole is None else aligned_part(whole, same)
                    shape, same = row[2], part
                pages += row[3]
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        if group is not None:
            whole = same if whole is None else aligned_part(whole, same)
            yield batch_of([*out, (*group, group[1], pages, json.dumps(whole))])

    def round_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        spread = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions("host", "bucket", "shape")
        return spread.select("host", "bucket", "shape", "pages", "wrapper").mapInArrow(align, kind)

    partial = staged(rows.mapInArrow(shapes, kind), "page-shapes")
    counted = partial.select("host", "shape").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    bits = staged(counted.select("host", "n", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / FAN))).cast("int").alias("bits")), "page-hosts")
    left = bits.agg(F.max("bits")).first()[0] or 0
    # equal shapes first, one row of each, so that a bucket holds as many rows as shapes
    now = round_of(partial.withColumn("bucket", F.col("shape")), ["host", "shape"])
    now = lookup(now, bits, ["host"], "n").withColumn("bucket", F.expr("shiftright(shape, 62 - bits)"))
    step = FAN.bit_length() - 1
    while True:
        now = round_of(now, ["host", "bucket"])
        if left <= 0:
            return now.select("host", "pages", "wrapper")
        left -= step
        now = lookup(staged(now, "page-wrappers"), bits, ["host"], "n").withColumn("bucket", F.expr(f"shiftright(bucket, least({step}, greatest(0, bits)))"))
        bits = bits.withColumn("bits", F.col("bits") - step)


def places_of(found: DataFrame) -> DataFrame:
    """(host, pages, place, marked): where each host's main text stands, by its wrapper, and whether an element marks it."""

    def place(batches):
        for batch in batches:
            found = [main_place(json.loads(w), n) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(map(json.dumps, found), pa.string()), pa.array([f["marked"] for f in found], pa.bool_())], ["host", "pages", "place", "marked"])

    return found.mapInArrow(place, "host string, pages long, place string, marked boolean")


def templates(rows: DataFrame) -> DataFrame:
    """(host, template): digests of the texts that stood in a slot on each of its pages, ``CONSTANT_PAGES`` at least; rows have host and html."""

    def count(batches):
        held: Counter = Counter()

        def flushed():
            hosts, slots, texts = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(slots, pa.int64()), pa.array(texts, pa.int64()), pa.array(held.values(), pa.int64())], ["host", "slot", "entry", "n"])
            held.clear()

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                seen: set = set()
                for parts, i, slots in slotted(tree(page.as_py())):
                    for slot, entry in zip(slots, entries(parts[i], slots), strict=True):
                        seen |= {(host, slot, None), (host, slot, entry)}
                held.update(seen)
                if len(held) > 100_000:
                    yield from flushed()
        if held:
            yield from flushed()

    counted = rows.select("host", "html").mapInArrow(count, "host string, slot long, entry long, n long").groupBy("host", "slot", "entry").agg(F.sum("n").alias("n"))
    counted = staged(counted.where(F.col("n") >= CONSTANT_PAGES), "constant")
    pages = counted.where("entry IS NULL").select("host", "slot", "n")
    return counted.where("entry IS NOT NULL").join(pages, ["host", "slot", "n"]).groupBy("host").agg(F.collect_set("entry").alias("template"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null html counts as empty and gives an empty text; pages without a host in their url share the
    host ''. Repeated rows are extracted alike, and null or repeated ids do not matter. An empty table gives no
    rows. Extra columns, whatever their names, are not read. A page on which the host's place is missing or
    empty is read by a wrapper of its own. Reruns and other partitionings give the same texts.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    places = staged(places_of(wrappers(pages, url_col=url_col, html_col=html_col)), "places")
    unmarked = places.where("NOT marked").select("host", "pages")
    if unmarked.isEmpty():
        places = places.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        found = templates(lookup(rows, unmarked, ["host"], "pages"))
        places = staged(places.join(found, "host", "left").withColumn("template", F.when(~F.col("marked"), F.col("template"))), "placed")
    places = places.select("host", "pages", "place", "template")
    size = places.agg(F.sum(F.length("host") + F.length("place") + 8 * F.greatest(F.lit(0), F.size(F.coalesce("template", F.array().cast("array<long>")))))).first()[0] or 0
    placed = rows.join(F.broadcast(places.drop("pages")), "host") if size <= BROADCAST else lookup(rows, places, ["host"], "pages")
    placed = placed.select("page_id", "url", "html", "place", "template")

    def texts(batches):
        places: dict = {}
        for batch in batches:
            found = []
            for page, where, template in zip(batch.column("html"), batch.column("place").to_pylist(), batch.column("template"), strict=True):
                if where not in places:
                    places[where] = where and json.loads(where)
                found.append(main_text(page.as_py(), places[where], frozenset(template.as_py() or ())))
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return placed.mapInArrow(texts, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
