"""HTML main text by equivalence classes of tokens over the pages of a host.

A page is read as tokens: opening and closing tags, told apart by their path, and runs of text outside articles. Tokens
of one host that occur equally often on every page (one occurrence vector) are an equivalence class. A class is valid
on a page where its tokens come in one order and no other class is cut by it; valid classes nest into the template of
the host. What lies between template tokens are slots. Slots under menus, forms, notices and the like are left out, the
others are the text. Vectors are sums of hashes, so no task ever holds the pages of a host.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .url_filter import url_host

MIN_PAGES = 8  # hosts with fewer pages are deduced together
SUPPORT = 0.5  # share of the pages a template token is on
BROADCAST_BYTES = 32_000_000  # of templates; beyond it they are joined

# How HTML reads its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span "
    "strike strong sub sup svg time tt u var wbr area audio button canvas embed iframe input link meta noscript object param picture script select source "
    "style template textarea track video".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

# What is not main text: by element, by role, by word of class or id.
CONTAINERS = frozenset(("article", "main"))
LEFT_OUT = frozenset("head nav form script style noscript template iframe object svg button select textarea dialog menu canvas audio video".split())
ALWAYS_OUT = frozenset(("aside",))
OUTSIDE_ARTICLES = frozenset(("header",))
ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
WORDS_OUT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
                      "cookie cookies consent gdpr notice banner popup modal newsletter subscribe footer".split())  # fmt: skip
WORDS_ALWAYS_OUT = frozenset("sidebar comment comments disqus replies respond".split())
WORDS_OUTSIDE_ARTICLES = frozenset("header masthead".split())

FREE, CONTENT, OUT, SHUT = range(4)  # SHUT: not even an article inside is main text

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile("[^a-z0-9]+")
_WHITE = re.compile(r"[ \t-\r]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SIGN = 1 << 63


def _hash(*parts: object) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) ^ _SIGN) - _SIGN


@lru_cache(maxsize=16_384)
def _element(name: str, attributes: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """(label of a tag, words of class and id, roles)."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in reversed(_ATTRIBUTE.findall(attributes))}
    classes = " ".join(sorted(found.get("class", "").split()))
    words = frozenset(w for w in _NAME.split(f"{found.get('class', '')} {found.get('id', '')}") if w)
    return f"{name}.{classes}" if classes else name, words, frozenset(found.get("role", "").split())


@lru_cache(maxsize=16_384)
def _region(above: int, inside: bool, name: str, words: frozenset[str], roles: frozenset[str]) -> int:
    """The region of an element below a region; ``inside``: in an article."""
    if above == SHUT or name in ALWAYS_OUT:
        return SHUT
    if name in ("html", "body"):
        return above
    if name not in CONTAINERS and words & WORDS_ALWAYS_OUT:
        return SHUT
    if name in CONTAINERS or "main" in roles:
        return CONTENT
    if name in LEFT_OUT or roles & ROLES_OUT or words & WORDS_OUT or name == "footer":
        return OUT
    if not inside and (name in OUTSIDE_ARTICLES or words & WORDS_OUTSIDE_ARTICLES):
        return OUT
    return above


@lru_cache(maxsize=65_536)
def _step(path: int, label: str) -> int:
    return _hash(path, label) & ~1  # even, odd for texts


def events(page: str) -> Iterator[tuple[int, str | None, int, bool, bool]]:
    """(token, text or None, region, ends a block, in a link) of each tag and each run of text, in page order.

    Runs outside regions that may hold text, and white space, have the token 0.
    """
    # name, path, region, in an article, in a link
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, FREE, False, False)]
    opened: dict[str, int] = {}
    at = 0
    size = len(page)

    def text(run: str):
        _, path, region, _, link = stack[-1]
        if region > CONTENT:
            return 0, "", region, False, link
        token = _hash(path, _WHITE.sub(" ", run).strip(" ")) | 1 if region == FREE and not run.isspace() else 0
        return token, html.unescape(run) if "&" in run else run, region, False, link

    def shut(names: tuple[str, ...], inline: bool = False, until: tuple[str, ...] = ()) -> int | None:
        """Close the innermost open element of a name, and what is open in it; its path, or None if there is none."""
        for name in names:
            if opened.get(name):
                break
        else:
            return None
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0]
            if name in names:
                path = stack[i][1]
                for gone in stack[i:]:
                    opened[gone[0]] -= 1
                del stack[i:]
                return path
            if name in until or (inline and name not in INLINE):
                return None
        return None

    while at < size:
        found = _TOKEN.search(page, at)
        start = size if found is None else found.start()
        if start > at:
            yield text(page[at:start])
        if found is None:
            return
        at = found.end()
        if found[1] is None:  # a comment or declaration
            continue
        name = found[1].lower()
        block = name not in INLINE
        if page[start + 1] == "/":
            path = shut((name,), inline=not block)
            if path is not None:
                yield _step(path, "/"), None, stack[-1][2], block, False
            elif name == "p":
                yield 0, None, stack[-1][2], True, False
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            stack.pop()
            opened["head"] -= 1
        if name in VOID:
            _, above_path, above, _, link = stack[-1]
            yield _step(above_path, name), (" " if name == "br" else None), above, block, link
            continue
        if block:
            shut(("p",), inline=True)
        if name in CLOSES:
            shut(CLOSES[name][0], until=CLOSES[name][1])
        _, above_path, above, inside, link = stack[-1]
        label, words, roles = _element(name, found[2])
        path = _step(above_path, label)
        region = _region(above, inside, name, words, roles)
        yield path, None, above, block, False
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = size if end is None else end.start()
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, path, region, inside or (region == CONTENT and name in CONTAINERS), link or name == "a"))


def vector_rows(page: str) -> dict[int, tuple[int, int]]:
    """token: (occurrences, where it comes first) of the tags of a page and of its texts outside articles."""
    counts: Counter[int] = Counter()
    first: dict[int, int] = {}
    for no, (token, *_) in enumerate(events(page)):
        if token:
            counts[token] += 1
            first.setdefault(token, no)
    return {t: (n, first[t]) for t, n in counts.items()}


def valid_tokens(order: list[int], classes: dict[int, tuple[int, int]]) -> set[int]:
    """The template tokens of one page: those of classes that are in order and cut no class taken before.

    ``order`` has the tokens of the page, ``classes`` maps template tokens to (class, place in its order).
    """
    places: dict[int, list[int]] = {}
    for no, token in enumerate(order):
        if token in classes:
            places.setdefault(classes[token][0], []).append(no)
    length = Counter(c for c, _ in classes.values())
    owner: dict[int, int] = {}
    taken: set[int] = set()
    # Larger classes first, so that smaller ones nest in their gaps.
    for c, own in sorted(places.items(), key=lambda x: (-length[x[0]], x[1][0])):
        n = length[c]
        ranks = [classes[order[no]][1] for no in own]
        if len(ranks) % n or any(r != i % n for i, r in enumerate(ranks)):
            continue
        spans = [(own[i], own[i + n - 1]) for i in range(0, len(own), n)]
        if any(_cuts(a, z, places, length, taken) for a, z in spans):
            continue
        taken.add(c)
        owner.update(dict.fromkeys(own, c))
    return {t for t, (c, _) in classes.items() if c in taken}


def _cuts(a: int, z: int, places: dict[int, list[int]], length: Counter[int], taken: set[int]) -> bool:
    """Whether a span holds a part of a round of a class taken before; it may hold none or whole rounds."""
    for c in taken:
        first, end = bisect(places[c], a), bisect(places[c], z)
        if first < end and (first % length[c] or end % length[c]):
            return True
    return False


def main_text(page: str, classes: dict[int, tuple[int, int]]) -> tuple[str, int]:
    """(text, slots that hold it) of one page under the template of its host."""
    found = list(events(page))
    template = valid_tokens([e[0] for e in found], classes)
    blocks: dict[int, list[str]] = {CONTENT: [], FREE: []}
    slots: dict[int, set[int]] = {CONTENT: set(), FREE: set()}
    open_text: list[str] = []
    region_of, all_links, slot, contained = OUT, True, 0, False

    def close() -> None:
        nonlocal all_links
        block = _WHITE.sub(" ", "".join(open_text)).strip(" ")
        if block and region_of in blocks and not (region_of == FREE and all_links):
            blocks[region_of].append(block)
            slots[region_of].add(slot)
        open_text.clear()
        all_links = True

    for no, (token, text, region, ends, link) in enumerate(found):
        contained = contained or region == CONTENT
        if ends:
            close()
        if token in template:
            slot = no
            if text is None or region == FREE:
                continue
        if text and region in blocks:
            if region != region_of:
                close()
                region_of = region
            open_text.append(text)
            all_links = all_links and (link or text.isspace())
    close()
    kept = CONTENT if contained else FREE
    return "\n".join(blocks[kept]), len(slots[kept])


def page_host() -> Column:
    return url_host(F.col("url"))


_COUNTS = "host string, token bigint, low bigint, high bigint, pages bigint, occurrences bigint, place bigint"


HELD = 200_000  # sums a task holds before it passes them on


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and host: sums over pages of a hash of (page, occurrences) for every token."""
    sums: dict[tuple[str, int], list[int]] = {}

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(5)]
        keys = [pa.array([h for h, _ in sums], pa.string()), pa.array([t for _, t in sums], pa.int64())]
        return pa.RecordBatch.from_arrays(keys + columns, names=["host", "token", "low", "high", "pages", "occurrences", "place"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            key = _hash(page)
            for token, (n, first) in vector_rows(page).items():
                h = _hash(key, n)
                s = sums.setdefault((host, token), [0, 0, 0, 0, 0])
                for i, x in enumerate((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, 1, n, first)):
                    s[i] += x
            if len(sums) > HELD:
                yield passed_on()
                sums.clear()
    yield passed_on()


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, tokens): per host the template tokens with their class and their place in it; host null for the small ones.

    A class has two tokens or more, each on at least ``support`` of the pages. Hosts with fewer than ``min_pages``
    pages share the template of host null. Texts are template only where a host has ``min_pages`` pages and half of
    them differ, so that copies of one page are not taken for a template.
    """
    read = pages.select(page_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = read.groupBy("host", F.xxhash64("html").alias("kind")).agg(F.count("*").alias("n"))
    hosts = stored(kinds.groupBy("host").agg(F.sum("n").alias("host_pages"), F.count("*").alias("kinds")))
    hosts = hosts.withColumn("small", (F.col("kinds") < min_pages) | (2 * F.col("kinds") < F.col("host_pages")))
    sums = ["low", "high", "pages", "occurrences", "place"]
    counted = stored(read.mapInArrow(_count, _COUNTS).groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in sums]))
    marked = counted.join(hosts, "host").where(~F.col("small") | (F.col("token") % 2 == 0)).withColumn("host", F.when(~F.col("small"), F.col("host")))
    owners = hosts.groupBy(F.when(~F.col("small"), F.col("host")).alias("owner")).agg(F.sum("host_pages").alias("all_pages"))
    tokens = marked.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in sums])
    often = tokens.join(owners, F.col("host").eqNullSafe(F.col("owner"))).where(F.col("pages") >= F.col("all_pages") * support)
    member = F.struct(F.floor(F.col("place") * 1000 / F.col("pages")).alias("at"), "token")
    classes = often.groupBy("host", "low", "high", "pages", "occurrences").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    numbered = F.transform("members", lambda m, i: F.struct(m["token"].alias("token"), F.xxhash64("low", "high").alias("class"), i.alias("place")))
    return classes.groupBy("host").agg(F.flatten(F.collect_list(numbered)).alias("tokens"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars, host, n_slots of every row of ``pages``.

    Main text is what stands in articles (or main), without what is left out there; on a page without either, what
    stands in slots of the template, without blocks that are links only. Texts in articles are never template, so
    an article that every page of a host repeats stays. Character references are decoded once, white space
    (\\x20, \\x09-\\x0D) in a block becomes one space, blocks are joined by a line feed. Null and empty pages have an
    empty text; a null url is the empty host. Rows are independent: repeated rows and ids give as many rows.
    """
    template = stored(templates(pages, min_pages, support))
    read = pages.select("page_id", "url", page_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    size = template.agg(F.sum(F.size("tokens") * 24)).first()[0] or 0
    # One row: tokens that half of the small hosts' pages have.
    others = {t["token"]: (t["class"], t["place"]) for r in template.where("host IS NULL").collect() for t in r["tokens"]}
    own = template.where("host IS NOT NULL").select(F.col("host").alias("of"), "tokens")
    if size <= BROADCAST_BYTES:
        own = F.broadcast(own)
    chosen = read.join(own, F.col("host") == F.col("of"), "left").drop("of")
    page_id = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, tuple[int, int]]] = {}
        for batch in batches:
            out = []
            hosts, tokens = batch.column("host").to_pylist(), batch.column("tokens")
            for i, page in enumerate(batch.column("html").to_pylist()):
                if hosts[i] not in known:
                    if len(known) > 1000:
                        known.clear()
                    mine = tokens[i].as_py()
                    known[hosts[i]] = others if mine is None else {t["token"]: (t["class"], t["place"]) for t in mine}
                out.append(main_text(page, known[hosts[i]]))
            texts = [t for t, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("host"), pa.array([n for _, n in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "host", "n_slots"],
            )

    return chosen.mapInArrow(extract, f"page_id {page_id}, url string, text string, n_chars bigint, host string, n_slots bigint")
