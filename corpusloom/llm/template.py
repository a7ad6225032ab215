"""Main text of web pages by equivalence-class template deduction over the pages of a host.

A page is a sequence of tokens: tags, and runs of text, each told apart by the path of elements around it. Tokens of
a host whose occurrence vectors (how often on each page) are equal form an equivalence class (Arasu and
Garcia-Molina, "Extracting structured data from web pages", 2003). Vectors are compared through sums of per-page
hashes, so that a host's pages are only ever counted, never brought together. Classes that occur on at least half of
the host's pages make up its template: the class whose tokens every such page has once is the outer frame, and classes
with more occurrences nest in its slots, between neighbouring frame tokens, as repeated records. The frame is valid on
a page if its tokens keep their order there.

The template says where the main text is. Of the frame's elements it is the innermost that holds KEEP of the text
outside links; elements with more text in links are menus. An article, or the main part, is preferred if it holds at
least TIE. What lies in the chosen element's slots and records is the main text. If it has a telling name, all of it;
else less the texts that the template repeats, and less records that are mostly links. Names also tell what no
occurrence can: menus, headers, footers, sidebars, notices, adverts, forms and reader comments inside the chosen
element differ from page to page as articles do. Scripts, styles and comments in the markup are never text.

On a host without a template, or a page on which the frame isn't valid, names decide alone; a page with neither article
nor main part gives what is left outside the boilerplate, less what the template repeats.

Defined results: a null or blank html, and a page without main text, give an empty text; a null or malformed url puts
the page on the host without a name; pages with equal page_id are separate pages; tags that never end are text, and
unclosed elements end with the page, in time proportional to its length; other columns are ignored; no rows: no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter as Counts
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import materialise, maybe_broadcast

LEAST_PAGES = 2
SUPPORT = 0.5
#: Shares of the frame's text outside links: of an unnamed main element, and of a named one.
KEEP, TIE = 0.8, 0.1
#: Elements of a path; deeper ones stand behind a hash of it.
DEEP = 64
#: Templates may have so many bytes in all to be broadcast; beyond, they are joined by a shuffle.
TEMPLATE_BYTES = 32 << 20
#: How elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav header footer aside form menu dialog script style noscript template title head button select textarea iframe svg canvas object audio video figure-ad".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|foot|masthead|side-?bar|aside|widget\w*|cookie\w*|consent|notices?|alert|pop-?up|modal|newsletter|subscri\w*|sign-?up|login|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|more-stories|tags|pagination|pager|legal|copyright|disclaimer|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
_OPENS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ENDS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_SPECIAL = re.compile(r"[>\"']")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w=-])", re.IGNORECASE)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Token:
    """A tag or a run of text; key tells it apart on its host. main: article, main or nothing, around it or its own.

    Of an element's opening tag: after, the place of the first token behind the element, and the characters of its text
    outside links and in them.
    """

    __slots__ = ("after", "boilerplate", "chars", "key", "kind", "linked", "main", "text")

    def __init__(self, key: str, text: str | None, boilerplate: bool, main: str, kind: str = "") -> None:
        self.key, self.text, self.boilerplate, self.main, self.kind = key, text, boilerplate, main, kind
        self.after = self.chars = self.linked = 0


class Tags:
    """Where tags end: behind the next > outside quotes. Regular expressions find it until one fails, which may take
    them to the end of the page; then all ends are worked out at once, from the last to the first."""

    def __init__(self, html: str) -> None:
        self.html, self.at, self.ends = html, None, None

    def end(self, start: int) -> int:
        """Behind the tag whose attributes start here; -1 if it never ends."""
        if self.at is None:
            m = _ENDS.match(self.html, start)
            if m:
                return m.end()
            self.at = [m.start() for m in _SPECIAL.finditer(self.html)]
            self.ends, nearest = [-1] * (len(self.at) + 1), {}
            for k in range(len(self.at) - 1, -1, -1):
                c = self.html[self.at[k]]
                self.ends[k] = self.at[k] + 1 if c == ">" else self.ends[nearest[c] + 1] if c in nearest else -1
                nearest[c] = k
        return self.ends[bisect_left(self.at, start)]


def _is_boilerplate(name: str, attributes: str) -> bool:
    if name in SKIPPED:
        return True
    for kind, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if hidden or kind.lower() == "role" and value.lower() in ROLES:
            return True
        if kind.lower() in ("class", "id") and name not in ("article", "main", "body", "html") and BOILERPLATE.search(value):
            return True
    return False


def tokens(html: str) -> list[Token]:
    """The tokens of a page. Blocks are closed by tags that aren't inline; a text token is a whole block."""
    out: list[Token] = []
    #: Of each open element: name, whether it is boilerplate, main, path, its opening token, text before it.
    stack: list[tuple[str, bool, str, str, Token, int, int]] = []
    is_open: Counts[str] = Counts()
    path, boilerplate, main = "", False, ""
    block: list[str] = []
    links = chars = linked = in_block = 0
    tags, done, at, last = Tags(html), 0, 0, html.rfind(">")

    def flush() -> None:
        nonlocal chars, linked, in_block
        joined = " ".join(unescape("".join(block)).split())
        block.clear()
        if joined:
            out.append(Token(f"{path}|{joined}", joined, boilerplate, main))
            own = min(in_block, len(joined))
            chars, linked = chars + len(joined) - own, linked + own
        in_block = 0

    def close() -> str:
        nonlocal path, boilerplate, main
        name, _, _, _, token, had, had_linked = stack.pop()
        is_open[name] -= 1
        token.after, token.chars, token.linked = len(out), chars - had, linked - had_linked
        boilerplate, main, path = stack[-1][1:4] if stack else (False, "", "")
        return name

    def take(upto: int) -> None:
        nonlocal in_block
        if upto > done:
            block.append(html[done:upto])
            if links:
                in_block += upto - done

    while at <= last and (at := html.find("<", at)) >= 0:
        m = _OPENS.match(html, at)
        if not m:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), at):
                end = html.find(">", at) + 1
            else:
                end = 0
            if not end:
                at += 1
                continue
            take(at)
            done = at = end
            continue
        end = tags.end(m.end())
        if end < 0:
            at += 1
            continue
        take(at)
        closing, name, attributes = m[1] == "/", m[2].lower(), html[m.end() : end - 1]
        done = at = end
        if name in RAW and not closing:
            ends = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(html, at)
            done = at = ends.end() if ends else len(html)
            continue
        if name == "br":
            block.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE and (closing and not is_open[name] or not closing and not _is_boilerplate(name, attributes)):
            # An inline element leaves path and block as they are.
            continue
        if closing and name != "p" and not is_open[name]:
            continue
        flush()
        if closing:
            if is_open[name]:
                while close() != name:
                    pass
                out.append(Token(f"{path}</{name}>", None, boilerplate, main))
            continue
        if stack and (name in CLOSES_P and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
            close()
        kind = name if name in ("article", "main") else "main" if _MAIN.search(attributes) else ""
        token = Token(f"{path}<{name}>", None, boilerplate, main, kind)
        out.append(token)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            if name not in INLINE and name != "p":
                depth = path.count("/")
                path = f"{path}/{name}" if path and depth < DEEP else f"#{_hash(path)}/{name}" if path else name
            boilerplate = boilerplate or _is_boilerplate(name, attributes)
            main = "article" if "article" in (kind, main) else kind or main
            stack.append((name, boilerplate, main, path, token, chars, linked))
            is_open[name] += 1
    take(len(html))
    flush()
    while stack:
        close()
    return out


def _hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


COUNTED = {"host": "string", "token": "long", "is_text": "boolean", "kind": "int", "pages": "long", "times": "long", "low": "long", "high": "long", "place": "long", "chars": "long", "linked": "long"}
KINDS = {"": 0, "main": 1, "article": 2}


class Counter:
    """mapInArrow function: (page_id, url, html) to rows of COUNTED, summed by batch.

    low and high are the halves of the vector's fingerprint: sums over pages of a hash of page and count. chars and
    linked are the text in an element outside links and in them; kind is of opening tags.
    """

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, bool, int], list] = {}
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, counts = host_of(url), {}
                for place, t in enumerate(tokens(html or "")):
                    c = counts.setdefault((_hash(t.key), t.text is not None, KINDS[t.kind]), [0, place, 0, 0])
                    c[0] += 1
                    c[2] += t.chars
                    c[3] += t.linked
                content = xxhash.xxh64_intdigest(html or "")
                for key, (n, place, chars, linked) in counts.items():
                    mark = xxhash.xxh64_intdigest(f"{page} {content} {n}")
                    s = sums.setdefault((host, *key), [0] * 7)
                    for k, v in enumerate((1, n, mark & 0xFFFFFFFF, mark >> 32, place, chars, linked)):
                        s[k] += v
            rows = [(*k, *v) for k, v in sums.items()]
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(COUNTED.values())], names=list(COUNTED))


def classes(pages: DataFrame) -> DataFrame:
    """The template tokens of each host, with low and high to tell their class, most (its pages) and members.

    Only tokens, not pages, are shuffled; what is left is as much as pages have in common.
    """
    named = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    counted = named.mapInArrow(Counter(), ", ".join(f"{k} {v}" for k, v in COUNTED.items()))
    summed = counted.groupBy("host", "token", "is_text", "kind").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "low", "high", "place", "chars", "linked")])
    # Every page has tokens: the most frequent one's pages are the host's.
    common = materialise(summed.filter(F.col("pages") >= LEAST_PAGES), "tokens")
    most = common.groupBy("host").agg(F.max("pages").alias("most"))
    frequent = common.join(maybe_broadcast(materialise(most, "hosts")), "host").filter(F.col("pages") >= SUPPORT * F.col("most"))
    # Counts meet before a window would bring a class together.
    sizes = frequent.groupBy("host", "low", "high").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    return frequent.join(sizes, ["host", "low", "high"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, frame, texts, main, named, menus): the frame's tag tokens in order, the text tokens that the template
    repeats, the token that opens the main element and whether its name tells, and those of records that are mostly
    links."""
    found = materialise(classes(pages), "classes")
    tag = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "kind", (F.col("chars") / F.col("pages")).alias("chars"), (F.col("linked") / F.col("pages")).alias("linked"))
    once = found.filter("not is_text and times = pages").groupBy("host", "low", "high").agg(F.max("pages").alias("pages"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(tag)).alias("tags"))
    frames = once.groupBy("host").agg(F.max_by("tags", F.struct("pages", "n", "low", "high")).alias("tags"))
    whole = F.array_max(F.transform("tags", lambda x: x["chars"]))
    holds = lambda share: F.filter("tags", lambda x: (x["chars"] > 0) & (x["chars"] >= x["linked"]) & (x["chars"] >= share * whole))
    of_kind = lambda k: F.get(F.filter(holds(TIE), lambda x: x["kind"] == k), F.lit(0))["token"]
    telling = F.coalesce(of_kind(KINDS["article"]), of_kind(KINDS["main"]))
    main = F.coalesce(telling, F.try_element_at(holds(KEEP), F.lit(-1))["token"])
    frames = frames.select("host", F.col("tags.token").alias("frame"), main.alias("main"), telling.isNotNull().alias("named"))
    listed = lambda rule, name: found.filter(rule).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias(name))
    out = frames.join(listed("is_text", "texts"), "host", "full").join(listed("not is_text and times > pages and linked > chars", "menus"), "host", "full")
    none = F.array().cast("array<bigint>")
    return out.select("host", F.coalesce("frame", none).alias("frame"), F.coalesce("texts", none).alias("texts"), "main", F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("menus", none).alias("menus"))


def in_order(found: list[int], frame: list[int]) -> bool:
    """Whether the frame's tokens that a page has come in the frame's order, each once."""
    place = {t: k for k, t in enumerate(frame)}
    seen = [place[t] for t in found if t in place]
    return all(a < b for a, b in zip(seen, seen[1:], strict=False))


def extract(html: str, frame: list[int], texts: set[int], main: int | None = None, named: bool = False, menus: set[int] = frozenset()) -> list[str]:
    """The blocks of the main text: what the slots and records inside the chosen element hold."""
    every = tokens(html)
    hashes = [_hash(t.key) for t in every]
    valid = bool(frame) and in_order([h for t, h in zip(every, hashes, strict=True) if t.text is None], frame)
    begin, after = 0, len(every)
    if valid and main in hashes:
        begin = hashes.index(main)
        after = every[begin].after
        if named:
            return [t.text for t in every[begin:after] if t.text is not None and not t.boilerplate]
    own = range(begin, after)
    kept = [k for k in own if every[k].text is not None and not every[k].boilerplate]
    for part in ("article", "main"):
        if any(every[k].main == part or every[k].kind == part for k in own):
            return [every[k].text for k in kept if every[k].main == part and (part == "article" or not valid or hashes[k] not in texts)]
    if valid:
        # What records of links hold; they nest, so that the furthest end so far tells.
        end, menu = 0, set()
        for k in own:
            if hashes[k] in menus:
                end = max(end, every[k].after)
            if k < end:
                menu.add(k)
        kept = [k for k in kept if k not in menu and hashes[k] not in texts]
    return [every[k].text for k in kept]


class Extractor:
    """mapInArrow function: (page_id, url, html, and a template's columns) to (page_id, url, text, n_chars)."""

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = ["\n\n".join(extract(h or "", f or [], set(t or []), m, bool(n), set(l or []))) for h, f, t, m, n, l in zip(*(part.column(k).to_pylist() for k in range(2, 8)), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


class Hosts:
    """mapInArrow function: puts the host beside (page_id, url, html)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Templates are broadcast if they are small, else joined by host."""
    found = materialise(templates(pages), "templates")
    size = found.agg(F.coalesce(F.sum(64 + F.octet_length("host") + 8 * (F.size("frame") + F.size("texts") + F.size("menus"))), F.lit(0))).first()[0]
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    with_host = T.StructType([*plain.schema.fields, T.StructField("host", T.StringType())])
    joined = plain.mapInArrow(Hosts(), with_host).join(F.broadcast(found) if size <= TEMPLATE_BYTES else found, "host", "left")
    schema = T.StructType([*plain.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.select("page_id", "url", "html", "frame", "texts", "main", "named", "menus").mapInArrow(Extractor(), schema)
