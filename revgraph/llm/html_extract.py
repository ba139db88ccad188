"""Main text of web pages: markup, a host's suffix array of repeated token runs, and the runs that stay.

A page is read into blocks of text: scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and
comments are recognised by element, role, class or id; the rest is article text where the page marks an article or
main element, and undecided where it marks none. Inside an article a header is the article's own, and class names mark
containers only, not paragraphs.

The blocks of a host's pages are token streams. Their suffixes are sorted, each cut to RUN tokens as longer common
prefixes decide nothing more, and those that agree with a neighbour in RUN tokens are the repeated runs. Suffixes
without a partner are left out beforehand without loss: every suffix has an anchor, the least hash among the GRAM-token
strings in its first RUN tokens, equal suffixes have equal anchors, and anchors that one block alone holds fall away.
Equal pages of a host are one content, and equal blocks of a host one block with the contents that hold it.

A content's base is how many contents hold its rarest text: the level under which CORE of its runs lie. Editions of one
article have their number as base, so every content counts as 1 / base articles. A run is boilerplate when the contents
that hold it count as three articles, or two on hosts of few articles: notices repeated among different texts go,
from undecided blocks and from marked articles alike, and republished articles stay. Page frame blocks are evidence
only. In a marked article blocks shorter than RUN tokens are not judged, as they are headings more often than notices;
an undecided block shorter than that is judged as a whole.

Null html counts as empty and gives an empty text; pages without a host (null or empty url) are compared with none;
repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import ENTRY, arrow_schema, cut, discard, gathered, mixed, pieces_of, release_memory, shared_keys, sliding_min, stored, tidy, word_hashes

RUN, GRAM = 8, 4
#: Share of a content's runs up to its base.
CORE = 0.2
#: Articles that make a run boilerplate, and that do on hosts of no more articles than NEED.
NEED, NEED_FEW = 3, 2
#: Ids up to which a list is broadcast; beyond, it joins by a shuffle.
BROADCAST_IDS = 1_000_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s>/]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>", re.S)
#: A tag that the end of the page cuts through.
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements of HTML by their meaning.
RAW = frozenset("script style title textarea noscript template xmp iframe noembed noframes".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select datalist svg object audio video canvas map head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input picture source math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mtable mtr mtd semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Class names and ids of what a page holds beside its article: menus, headers, footers, sidebars, notices, adverts, comments.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar header footer masthead cookie cookies consent gdpr notice notices popup modal newsletter comment comments disqus share sharing social related promo promotion".split()
)
#: Elements of running text: within an article class names do not drop them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figure figcaption address details summary".split())
#: A closing end tag is optional for these.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())


def dropped(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page frame by its name or attributes; inside: within an article."""
    if inside and name == "header":
        return False
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main") or inside and name in TEXT:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and not NAMES.isdisjoint(_SPLIT.split(value)) or key == "role" and value in ROLES:
            return True
    return False


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of every block in page order; zone 2 in the article, 1 undecided, 0 page frame."""
    out: list[tuple[int, str]] = []
    part: list[str] = []
    main = 0  # open article and main elements
    frame, depth = "", 0  # the element that drops what it holds, and how many of its name are open
    at, end = 0, len(html)

    def flush() -> None:
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                out.append((0 if frame else 2 if main else 1, text))

    while at < end:
        found = _TAG.search(html, at)
        if not found:
            part.append(_CUT_TAG.sub("", html[at:]))
            break
        if found.start() > at:
            part.append(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s>/])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if name in INLINE and not (frame and name == frame):
            if name == "br":
                part.append(" ")
            elif not closing and not frame and name not in VOID and attributes and dropped(name, attributes, main > 0):
                flush()
                frame, depth = name, 1
            continue
        flush()
        if frame:
            if name == frame:
                depth += -1 if closing else 1 if name not in OPEN_ENDED else 0
                if depth <= 0:
                    frame = ""
                elif not closing and name in OPEN_ENDED and not dropped(name, attributes, main > 0):
                    frame = ""
            elif frame in OPEN_ENDED and (closing or name in MAIN):
                frame = ""
            if frame or closing and name not in MAIN:
                if name in MAIN and closing:
                    main = max(0, main - 1)
                    frame = ""
                continue
        if name in MAIN:
            main = max(0, main - 1) if closing else main + 1
        if not closing and name not in VOID and not attributes.endswith("/") and dropped(name, attributes, main > 0):
            frame, depth = name, 1
    flush()
    return out


def host_of(url: str | None) -> str:
    return "" if url is None else re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.lower()).split("/")[0].split("?")[0].split("#")[0]


def judged(parts: list[tuple[int, str]]) -> int:
    """The zone whose blocks are the page's text: the article's, or undecided ones where there is no article."""
    return 2 if any(zone == 2 for zone, _ in parts) else 1


def block_id(host: str, own: bool, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{int(own)}{text}") - (1 << 63)


def judged_blocks(host: str, parts: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """id: (text, runs) of the blocks that count; 0 runs: page frame, which is evidence only."""
    kept, out = judged(parts), {}
    for zone, text in parts:
        n, own = text.count(" ") + 1, zone == kept
        if n >= RUN or own and kept < 2:
            out[block_id(host, own, text)] = text, max(1, n - RUN + 1) if own else 0
    return out


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, start, end) of the tokens of texts that are joined by line ends."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    line = data == 10
    gap = np.flatnonzero((data == 32) | line)
    starts = np.concatenate([[0], gap + 1])
    return np.concatenate([[0], np.cumsum(line[gap])]), starts, np.append(gap, len(data))


def anchored(texts: list[str], hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, token, anchor) of every suffix of RUN tokens or more; hosts: a hash for each text's host."""
    block, starts, ends = tokens_of(texts)
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    n = len(block) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = word_hashes(data, starts, ends)
    factors = mixed(np.arange(1, GRAM + 1, dtype=np.uint64))
    grams = np.zeros(len(word) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams += word[k : k + len(grams)] * factors[k]
    least = sliding_min(mixed(grams + hosts[block[: len(grams)]]), RUN - GRAM + 1)
    at = np.flatnonzero(block[:n] == block[RUN - 1 :])
    first = np.searchsorted(block, np.arange(len(texts)))
    return block[at], at - first[block[at]], least[at]


def _pages(batches, columns: list[str]):
    """For every page that has a host: key, host, blocks, and the other columns."""
    for t in gathered(batches, 4 << 20, 2000):
        for key, url, html, *rest in zip(*(t.column(c).to_pylist() for c in ["page_key", "url", "html", *columns]), strict=True):
            host = host_of(url)
            if host:
                yield key, host, blocks(html), *rest


def _batches(rows, ddl: str, size: int):
    schema, held = arrow_schema(ddl), []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()
    held = None
    release_memory()


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host)


def contents(read: DataFrame) -> DataFrame:
    """page_key, host, content, total (runs), and the ids and runs of the blocks, of every page that has a host."""
    ddl = "page_key long, host long, content long, total int, blocks array<long>, sizes array<int>"

    def run(batches):
        for key, host, parts in _pages(batches, []):
            found = judged_blocks(host, parts)
            content = xxhash.xxh64_intdigest("\n".join([host, *(f"{zone}{text}" for zone, text in parts)])) - (1 << 63)
            sizes = [n for _, n in found.values()]
            yield key, _host_hash(host) - (1 << 63), content, sum(sizes), list(found), sizes

    return read.mapInArrow(lambda batches: _batches(run(batches), ddl, 4000), ddl)


def _anchors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a batch of pages, each once for a block, so that two blocks of one page share them too."""
    ids, texts, owner, hosts = [], [], [], []
    for key, url, html, skip in zip(*(t.column(c).to_pylist() for c in ("page_key", "url", "html", "skip")), strict=True):
        host = host_of(url)
        if host:
            left = [text for i, (text, _) in judged_blocks(host, blocks(html)).items() if i not in (skip or ()) and text.count(" ") >= RUN - 1]
            owner += [len(ids)] * len(left)
            hosts += [_host_hash(host)] * len(left)
            texts += left
            ids.append(key)
    block, _, anchor = anchored(texts, np.array(hosts, np.uint64)) if texts else (np.zeros(0, np.int64), None, np.zeros(0, np.uint64))
    order = np.lexsort((anchor, block))
    block, anchor = block[order], anchor[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])
    meta = np.zeros(len(ids), ENTRY)
    meta["id"], meta["n"] = ids, np.bincount(np.array(owner, np.int64)[block[new]], minlength=len(ids))
    return meta, anchor[new]


def _suffixes(count: int):
    """host, suffix (cut to RUN tokens), block, token, size of the suffixes whose anchors other pages hold."""
    ddl = "host long, suffix string, block long, token int, size int"

    def run(batches):
        for _, host, parts, skip, held in _pages(batches, ["skip", "held"]):
            some = {i: x for i, x in judged_blocks(host, parts).items() if i not in (skip or ()) and x[0].count(" ") >= RUN - 1}
            if not some:
                continue
            ids, texts = list(some), [text for text, _ in some.values()]
            words = [x.split(" ") for x in texts]
            block, token, anchor = anchored(texts, np.full(len(texts), _host_hash(host), np.uint64))
            hit = np.isin(pieces_of(anchor, count), np.array(held, np.int64))
            for b, k in zip(block[hit].tolist(), token[hit].tolist(), strict=True):
                yield _host_hash(host) - (1 << 63), " ".join(words[b][k : k + RUN]), ids[b], k, some[ids[b]][1]

    return lambda batches: _batches(run(batches), ddl, 20_000), ddl


def _common(batches):
    """run, block, token, size of the sorted suffixes that agree with a neighbour, or may with one of another task."""
    schema = arrow_schema("run long, block long, token int, size int")

    def picked(t: pa.Table, keep: np.ndarray) -> pa.RecordBatch:
        t = t.filter(pa.array(keep)).combine_chunks()
        runs = [xxhash.xxh64_intdigest(f"{h} {s}") - (1 << 63) for h, s in zip(t.column("host").to_pylist(), t.column("suffix").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), *(pa.concat_arrays(t.column(c).chunks or [pa.array([], schema.field(c).type)]) for c in ("block", "token", "size"))], schema=schema)

    tail, agrees = None, True  # the last suffix so far, and whether the one before agrees with it
    for t in gathered(batches, 2 << 20, 50_000):
        if tail is not None:
            t = pa.concat_tables([tail, t]).combine_chunks()
        n = t.num_rows
        same = np.full(n, agrees)
        if n > 1:
            host, suffix = (pa.concat_arrays(t.column(c).chunks) for c in ("host", "suffix"))
            same[1:] = pc.and_(pc.equal(host[1:], host[:-1]), pc.equal(suffix[1:], suffix[:-1])).to_numpy(zero_copy_only=False)
        yield picked(t.slice(0, n - 1), same[:-1] | same[1:])
        tail, agrees = t.slice(n - 1), bool(same[-1])
    if tail is not None:
        yield picked(tail, np.ones(1, bool))


def _few(rows: DataFrame, size=None):
    """Broadcast a cut list when its counted size allows, else leave the join to a shuffle."""
    n = rows.count() if size is None else rows.agg(F.coalesce(F.sum(F.size(size)), F.lit(0))).first()[0]
    return F.broadcast(rows) if n <= BROADCAST_IDS else rows


def level(levels, total, start):
    """The least level under which CORE of the total lies; levels: sorted structs of h and n; start: (level, n) of the rest."""
    found = F.aggregate(levels, F.struct(start[1].cast("double").alias("seen"), F.when(start[1] >= CORE * total, start[0]).cast("double").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= CORE * total, x["h"].cast("double"))).alias("at")))
    return F.coalesce(found["at"], start[0].cast("double"))


def boilerplate(read: DataFrame) -> DataFrame:
    """page_key, covered (structs of a block's id and the tokens at which boilerplate runs begin; null: the whole block)."""
    spark = read.sparkSession
    known = stored(contents(read), "contents")
    low = known.groupBy("content").agg(F.min("page_key").alias("page_key"), F.max("page_key").alias("high")).where("page_key <> high").select("content", F.col("page_key").alias("kept"))
    spare = cut(known.select("content", "page_key").join(low, "content").where("page_key <> kept").select("page_key"))
    one = known.join(_few(spare), "page_key", "left_anti")
    if known.groupBy("page_key").count().where("count > 1").head(1):  # rows repeated in full
        one = one.dropDuplicates(["content"])
    held_by = one.select("page_key", "content", "host", F.explode(F.arrays_zip("blocks", "sizes")).alias("x")).select("page_key", "content", "host", F.col("x.blocks").alias("block"), F.col("x.sizes").alias("size"))
    several = cut(held_by.groupBy("block").agg(F.count("*").alias("pages"), F.min("page_key").alias("first"), F.max("size").alias("size")).where("pages > 1"))
    skip = cut(held_by.select("page_key", "block").join(_few(several.select("block", "first")), "block").where("page_key <> first").groupBy("page_key").agg(F.collect_list("block").alias("skip")))
    read = read.join(_few(spare), "page_key", "left_anti").join(_few(skip, "skip"), "page_key", "left")
    count = max(1, known.agg(F.sum("total")).first()[0] or 0) // 3  # about a third of the suffixes are the first of their anchor
    shared = shared_keys(read.select("page_key", "url", "html", "skip"), _anchors, count)
    asked = cut(shared.groupBy(F.col("id").alias("page_key")).agg(F.collect_set("piece").alias("held")))
    tidy(spark, wait=True)  # the routed anchors
    step, ddl = _suffixes(count)
    suffixes = stored(read.join(_few(asked, "held"), "page_key").select("page_key", "url", "html", "skip", "held").mapInArrow(step, ddl), "suffixes")
    order = ["host", "suffix", "block", "token"]
    runs = stored(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_common, "run long, block long, token int, size int"), "runs")
    discard(suffixes)
    tidy(spark, wait=True)  # the sorted suffixes
    # levels: how many contents hold each run, and each block's and content's rarest text
    pages = several.select("block", "pages")
    pairs = runs.groupBy("run", "block").agg(F.size(F.collect_set("token")).alias("n"), F.max("size").alias("size")).join(pages, "block", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    pairs = cut(pairs)
    tidy(spark, wait=True)
    held = pairs.groupBy("run").agg(F.sum("pages").alias("h"), F.count("*").alias("blocks")).where("blocks > 1").select("run", "h")
    pairs = cut(pairs.join(held, "run"))
    del held
    tidy(spark, wait=True)
    rarest = pairs.where("size > 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("levels"), F.sum("n").alias("shared"), F.max("size").alias("size"), F.max("pages").alias("pages"))
    rarest = rarest.select("block", level(F.col("levels"), F.col("size"), (F.col("pages"), F.col("size") - F.col("shared"))).alias("h"))
    special = cut(several.select("block", F.col("pages").cast("double").alias("pages")).join(rarest, "block", "full").select("block", F.coalesce("h", "pages").alias("h")).unionByName(pairs.where("size = 0").select("block", F.lit(1.0).alias("h"))).groupBy("block").agg(F.max("h").alias("h")))
    held_by = cut(held_by.drop("page_key").join(_few(special), "block"))
    base = held_by.where("size > 0").groupBy("content").agg(F.sort_array(F.collect_list(F.struct("h", F.col("size").alias("n")))).alias("levels"), F.sum("size").alias("some"))
    base = base.join(one.select("content", "total"), "content").select("content", level(F.col("levels"), F.col("total"), (F.lit(1), F.col("total") - F.col("some"))).alias("base")).where("base > 1")
    base = cut(base)
    few_hosts = one.select("content", "host").join(_few(base), "content", "left").groupBy("host").agg(F.sum(1 / F.coalesce("base", F.lit(1.0))).alias("articles")).where(F.col("articles") < NEED + 0.5).select("host", F.lit(NEED_FEW).alias("need"))
    weighed = held_by.join(_few(base), "content", "left").join(_few(cut(few_hosts)), "host", "left").select("content", "block", "size", (1 / F.coalesce("base", F.lit(1.0))).alias("w"), (F.coalesce("need", F.lit(NEED)) - 1e-6).alias("need"))
    weighed = cut(weighed)
    weights = cut(weighed.groupBy("block").agg(F.sum("w").alias("w"), F.max("need").alias("need"), F.max("size").alias("size")))
    maybe = pairs.select("run", "block").join(weights, "block").groupBy("run").agg(F.sum("w").alias("w"), F.max("need").alias("need")).where("w >= need").select("run")
    maybe = cut(pairs.select("run", "block").join(maybe, "run", "left_semi"))
    del pairs, rarest, special, held_by, base, few_hosts
    tidy(spark, wait=True)
    gone = maybe.join(weighed, "block").groupBy("run", "content").agg(F.max("w").alias("w"), F.max("need").alias("need")).groupBy("run").agg(F.sum("w").alias("w"), F.max("need").alias("need")).where("w >= need").select("run")
    parts = runs.where("size > 0").join(gone, "run", "left_semi").groupBy("block").agg(F.collect_set("token").alias("tokens"))
    cover = weights.where("size > 0 and w >= need").select("block", F.lit(True).alias("whole")).join(parts, "block", "full").select("block", F.when(F.col("whole").isNull(), F.col("tokens")).alias("tokens"))
    cover = cut(cover)
    out = cut(known.select("page_key", F.explode("blocks").alias("block")).join(_few(cover), "block").groupBy("page_key").agg(F.collect_list(F.struct("block", "tokens")).alias("covered")))
    discard(known, runs)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    covered = boilerplate(read)
    joined = read.join(_few(covered, "covered"), "page_key", "left").select("page_id", "url", "html", "covered")
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def texts(batches):
        for t in gathered(batches, 4 << 20, 2000):
            made = [main_text(host_of(url), blocks(html), {x["block"]: x["tokens"] for x in c or ()}) for url, html, c in zip(*(t.column(k).to_pylist() for k in ("url", "html", "covered")), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("page_id").combine_chunks(), t.column("url").combine_chunks(), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], schema=schema)

    return joined.mapInArrow(texts, ddl)


def main_text(host: str, parts: list[tuple[int, str]], covered: dict[int, list[int] | None]) -> str:
    """The article's blocks, or without an article the undecided ones, less what boilerplate runs cover."""
    kept, out = judged(parts), []
    for zone, text in parts:
        if zone == kept:
            at = block_id(host, True, text) if covered else 0
            if at in covered:
                if covered[at] is None:
                    continue
                gone = {k + i for k in covered[at] for i in range(RUN)}
                text = " ".join([w for k, w in enumerate(text.split(" ")) if k not in gone])
            if text:
                out.append(text)
    return "\n".join(out)
