"""Main text of web pages by a site style tree.

Pages of a host are merged into one style tree: nodes are paths of block elements (tag and class
names, which only tell nodes apart) below ``body``. What HTML itself defines as no prose (scripts,
forms, navigation, footers, headers of pages, asides; ARIA roles and comment microdata that say the
same) is not in the tree. All else is judged by two importances of a node:

* **Entropy.** A node's content is the word pairs of its text, each once a page. A pair that stands on n of the node's m pages has
  the entropy ``log n / log(m + PRIOR)``: 0 if one page alone has it, near 1 if all have. Content
  importance is 1 less the mean entropy, so a template repeats although a word in it differs.
  Presentation importance is the same for the sequence of a node's children. The higher counts; a
  node below ``LEAST`` is removed from every page, with its text. Both are taken over the pages of
  the host and over those of all hosts with the same path; the lower judges.
* **Share.** What part of a page's text a branch holds (a container with the prose right below it),
  as a mean over the host's pages that have the branch, with ``PRIOR`` pages that hold what that
  path holds on all hosts, itself with ``PRIOR`` pages that hold what its tags hold. On each page, branches outside ``article`` and
  ``main`` whose mean is less than ``SMALL`` of the page's largest one are removed: an advert beside
  a story, even where a host has too few pages to see it repeat.

* **Series.** Comments of readers differ on every page, so what repeats is their form alone: a node with
  several children alike, ``SERIES`` of them on some pages, that are containers with blocks of text in
  them and no headings. Where that is so on a fair part of a host's pages (``FAIR``, with ``PRIOR`` pages
  as on all hosts) and the node holds less than half of their text in the mean, it is removed from
  every page, inside ``article`` and ``main`` too. A story that is made so holds most of its page.

Small hosts are judged by the same formulas: ``PRIOR`` keeps a node that two or three pages share,
and lets the trees of all hosts decide. Pages of a host count once if their text is the same, so
copies do not tell what pages share; for nodes inside ``article`` or ``main`` pages count once if all
they have in there is the same.

A page is a row or two of hashes, of which copies are merged before and after they are dealt by host
and page. Word pairs are counted before they are shuffled and go as sorted numbers, packed, a row a
host, node and 256th of all pairs; these are dealt by node and 256th, where all hosts' meet, so a host
with most pages is no group of rows anywhere, and only sums a host and node are left. Judged nodes, one row a host, are joined to pages by
host: broadcast by Spark where they are small, else in a join that splits hosts with many pages.

Text: character references are decoded; white space inside a block becomes one space; blocks are
joined in page order by one space. Null html is empty. A null url is a host of its own. Pages may
repeat and be of any length: markup is read once from left to right. Broken markup is read as
browsers do, as far as this needs: a block ends an open paragraph, unknown end tags are ignored, what
is open at the end is closed, a tag without end is text. An empty table gives an empty result;
columns beyond page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.llm import scratch
from tallyring.llm.text import SPACED, Words, sequences

LEAST, SMALL, PRIOR = 0.5, 0.15, 8
SERIES, FAIR = 3, 0.3

_QUOTED = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|role|itemprop|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Class names that tell a page or an item by its number (post-123): the number is no style.
_OWN_ID = re.compile(r"^((?:[a-z]+-)*(?:post|postid|pageid|page-id|node|nid|entry|article|story|product|topic|thread|item|id|attachment|attachmentid|author|user|category|term|tag)[-_]?)\d+$")

#: Fixed values of HTML: elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that end a block of text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that are no prose whatever they hold, and roles and microdata that say the same of any.
NO_PROSE = frozenset("nav footer aside form script style head noscript iframe template button select textarea svg menu dialog input object canvas audio video title".split())
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
NO_PROSE_ITEMS = frozenset("comment usercomments".split())
#: Elements whose prose is a branch of its own.
CONTAINER = frozenset("html body div section article main center".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div main nav ol section table td th ul dl form header footer".split())
KEEP = frozenset(("article", "main"))
#: Elements that comments are made of, and those that begin a section.
ITEM = frozenset("div section article li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _number(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    """An open element: number of its path, of its branch, and of the branch's tags alone. ``size`` is the
    text below it so far, ``said`` that right in it, ``items`` how many children alike it has by path."""

    __slots__ = ("branch", "drop", "heading", "items", "keep", "key", "said", "size", "tag", "tags")

    def __init__(self, tag: str, key: int, branch: int, tags: int, drop: bool, keep: bool) -> None:
        self.tag, self.key, self.branch, self.tags, self.drop, self.keep = tag, key, branch, tags, drop, keep
        self.size, self.said, self.heading = 0, 0, tag in HEADING
        self.items: dict[int, int] | None = None

    def take(self, child: Node) -> None:
        """A child that ends."""
        self.size += child.size
        self.heading = self.heading or child.heading
        if child.key == self.key:  # inline: its text is that of the block around
            self.said += child.said
        elif child.tag in ITEM and child.size and not child.said and not child.heading:
            if self.items is None:
                self.items = {}
            self.items[child.key] = self.items.get(child.key, 0) + 1


def _no_prose(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is no prose by what it says it is; and its class names for the tree."""
    said, label = False, ""
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, kind = next((v for v in values if v), "").lower(), kind.lower()
        if kind == "class":
            label = ".".join(sorted({_OWN_ID.sub(r"\1#", x) for x in value.split()}))
        elif kind == "role":
            said = said or bool(NO_PROSE_ROLES.intersection(value.split()))
        else:
            said = said or bool(NO_PROSE_ITEMS.intersection(x.rpartition("/")[2] for x in value.split()))
    if tag in NO_PROSE or (tag == "header" and not inside):
        return True, label
    return said and tag not in ("html", "body", "article", "main"), label


def marks(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """Text, then what follows it: name of a tag (None for comments and the like), whether it is an
    end tag, its attributes. Every character is looked at a few times at most."""
    at, text_from, n = 0, 0, len(page)
    never = {'"': False, "'": False, ">": False, "]]>": False}  # what does not come any more
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[text_from:at], None, False, ""
            text_from = at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at) and not never["]]>"]:
            end = page.find("]]>", at)
            if end >= 0:
                yield page[text_from:at] + html.escape(page[at + 9 : end]), None, False, ""
                text_from = at = end + 3
                continue
            never["]]>"] = True
        odd = page[at + 1 : at + 2] in ("!", "?")
        m = None if odd else _NAME.match(page, at + 1)
        if (not odd and m is None) or never[">"]:
            at += 1
            continue
        begin = pos = at + 2 if odd else m.end()
        end = page.find(">", pos)
        while end >= 0 and not odd and (q := _QUOTED.search(page, pos, end)):
            close = -1 if never[q[1]] else page.find(q[1], q.end())
            if close < 0:
                never[q[1]] = True
                break
            pos = close + 1
            if end < pos:
                end = page.find(">", pos)
        if end < 0:
            never[">"] = page.find(">", begin) < 0
            end = -1 if never[">"] else page.find(">", begin)
            if end < 0:
                at += 1
                continue
        yield page[text_from:at], None if odd else m[2].lower(), bool(m and m[1]), "" if odd else page[begin:end]
        text_from = at = end + 1
        if m and not m[1] and m[2].lower() in RAW:
            close = re.compile(rf"</{re.escape(m[2])}\s*>", re.I).search(page, at)
            text_from = at = close.end() if close else n
    yield page[text_from:], None, False, ""


def blocks(page: str, series: frozenset = frozenset(), ended: list | None = None) -> Iterator[tuple[Node, str, Node]]:
    """Text blocks of a page that HTML does not call no prose, in order: the element (for its path
    and branch), the text, and the element around. Without what stands in nodes of ``series``;
    ``ended`` takes nodes with items, when they end: path, text below, and most items alike."""
    stack = [Node("html", 0, 0, 0, False, False)]
    open_tags: Counter = Counter(("html",))
    text: list[str] = []

    def flush() -> tuple | None:
        if not text:
            return None
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        top = stack[-1]
        if not said or top.drop:
            return None
        top.size += len(said)
        top.said += len(said)
        return top, said, stack[max(0, len(stack) - 2)]

    def close(to: int) -> None:
        while len(stack) > max(1, to):
            node = stack.pop()
            open_tags[node.tag] -= 1
            stack[-1].take(node)
            if ended is not None and node.items is not None:
                ended.append((node.key, node.size, max(node.items.values())))

    for before, tag, is_end, attributes in marks(page):
        if before:
            text.append(before)
        if tag is None:
            continue
        breaks = tag in BLOCK or tag in NO_PROSE
        if is_end:
            if not open_tags[tag] or tag == "html":
                if breaks and (b := flush()):
                    yield b
                continue
            if (breaks or stack[-1].drop) and (b := flush()):
                yield b
            i = len(stack) - 1
            while stack[i].tag != tag and (breaks or stack[i].tag not in SCOPE):
                i -= 1
            if stack[i].tag == tag:
                close(i)
            continue
        if breaks:
            if b := flush():
                yield b
            if tag in BLOCK and tag != "br":
                for ends, stops in ((("p",), SCOPE), (CLOSED_BY.get(tag, ()), SCOPE)):
                    if any(open_tags[e] for e in ends):
                        i = len(stack) - 1
                        while i and stack[i].tag not in ends and stack[i].tag not in stops:
                            i -= 1
                        if i and stack[i].tag in ends:
                            close(i)
        if tag in VOID or tag in RAW or (attributes.rstrip().endswith("/") and tag not in BLOCK):
            continue
        parent = stack[-1]
        dropped, label = _no_prose(tag, attributes, parent.keep)
        if not breaks:
            if dropped and (b := flush()):
                yield b
            stack.append(Node(tag, parent.key, parent.branch, parent.tags, parent.drop or dropped, parent.keep))
        else:
            key = _number(parent.key, tag, label)
            own = tag in CONTAINER
            stack.append(Node(tag, key, key if own else parent.branch, _number(parent.tags, tag) if own else parent.tags, parent.drop or dropped or key in series, parent.keep or tag in KEEP))
        open_tags[tag] += 1
    if b := flush():
        yield b
    close(1)


def host(url: Column) -> Column:
    """Lower-cased host of a url, without user and port; null and relative urls have none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Kinds of rows of the tree: word pairs, children, presence of a node, share of a branch, and of a
#: node with items (feature 1 where it has SERIES of them).
PAIR, CHILDREN, PRESENT, SHARE, ITEMS = range(5)
#: Sums over the word pairs of a node: on a host, and on all hosts.
OWN, ALL = 5, 6
#: Pairs counted together in a task, at least.
MANY = 1 << 20


def _pack(x: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits, each less the one before, byte by byte: high bytes are mostly 0 or alike."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes | memoryview) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _pairs(texts: list[str], groups: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each group of texts all distinct word pairs; a text of one word has that for a pair."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), SPACED)
    hashes = w.hash
    within = w.doc[1:] == w.doc[:-1]
    alone = np.flatnonzero(w.count == 1)
    # 32 bits tell the pairs of one node apart: where so many stand in it that some fall together, the
    # logarithm of how often they stand is still small beside that of the pages
    pairs = np.concatenate([sequences(hashes, 2)[within], hashes[w.first[alone]]]).astype(np.uint32)
    group = np.asarray(groups, dtype=np.int64)[np.concatenate([w.doc[1:][within], alone])]
    order = np.lexsort((pairs, group))
    pairs, group = pairs[order], group[order]
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (group[1:] != group[:-1])
    pairs, group = pairs[new], group[new]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(group)], strict=True):
        yield int(group[lo]), pairs[lo:hi]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Hosts and pages, some hundreds of kilobytes at a time."""
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
        lo = size = 0
        for hi, page in enumerate(pages, 1):
            size += len(page or "")
            if size > 1 << 19 or hi == len(pages):
                yield hosts[lo:hi], pages[lo:hi]
                lo, size = hi, 0


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a page and one for what it has inside article or main: word pairs of each node, its
    children, and shares of branches. ``page`` is the digest of the text (of that inside only, in the
    second), which copies share."""
    listed = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("kind", pa.int32()), ("share", pa.float64())]))
    for names, pages in _parts(batches):
        hosts, digests, rows = [], [], []
        texts: list[str] = []
        groups: list[int] = []
        whose: list[tuple[int, int]] = []  # row and node of every group of texts
        for name, page in zip(names, pages, strict=True):
            left = hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16, person=b"inside")
            # by whether a node lies inside article or main; each part is a copy for itself
            own: tuple[dict[int, list[str]], ...] = {}, {}
            below: tuple[dict[int, list[int]], ...] = {}, {}
            held: dict[tuple[int, int], int] = {}
            ended: list[tuple[int, int, int]] = []
            for node, said, parent in blocks(page or "", ended=ended):
                own[node.keep].setdefault(node.key, []).append(said)
                if parent.key != node.key:
                    below[parent.keep].setdefault(parent.key, []).append(node.key)
                held[node.branch, node.tags] = held.get((node.branch, node.tags), 0) + len(said)
                for part in left[: 1 + node.keep]:
                    part.update(f"{node.key}\n{said}\n".encode("utf-8", "surrogatepass"))
            total = sum(held.values())
            for k in (0, 1) if own[1] else (0,):
                for node, said in own[k].items():
                    groups += [len(whose)] * len(said)
                    texts += said
                    whose.append((len(rows), node))
                out = [(n, _number(*xs), CHILDREN, 0.0) for n, xs in below[k].items()] + [(n, 0, PRESENT, 0.0) for n in {*own[k], *below[k]}]
                if k == 0:
                    out += [(n, tags, SHARE, size / total) for (n, tags), size in held.items()]
                    largest = {}
                    for n, size, alike in ended:
                        before = largest.get(n, (0, 0))
                        largest[n] = (before[0] + size, max(before[1], alike))
                    out += [(n, int(alike >= SERIES), ITEMS, size / total) for n, (size, alike) in largest.items()]
                hosts.append(name)
                digests.append(left[k].digest())
                rows.append(out)
        nodes_: list[list[int]] = [[] for _ in rows]
        found: list[list[np.ndarray]] = [[] for _ in rows]
        for group, pairs in _pairs(texts, groups):
            row, node_ = whose[group]
            nodes_[row].append(node_)
            found[row].append(pairs)
        packed = [np.array(n, dtype="<i8").tobytes() for n in nodes_], [np.array(list(map(len, x)), dtype="<i4").tobytes() for x in found], [_pack(np.concatenate(x)) if x else b"" for x in found]
        at = np.cumsum([0, *map(len, rows)])
        node, feature, kind, share = zip(*(x for out in rows for x in out), strict=True) if at[-1] else ((), (), (), ())
        flat = pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(feature, pa.int64()), pa.array(kind, pa.int32()), pa.array(share, pa.float64())], fields=list(listed.value_type))
        held_ = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), held_, *[pa.array(x, pa.binary()) for x in packed]], names=["host", "page", "held", "nodes", "sizes", "pairs"])


def _importance(counted: DataFrame, by: list[str], pairs: int) -> DataFrame:
    """Importance of nodes from how often each feature stands (n pages), and the sums of ``pairs``."""
    kind = lambda k: F.col("kind") == k
    total = lambda k, x: F.coalesce(F.sum(F.when(kind(k), x)), F.lit(0.0))
    n = F.col("n").cast("double")
    sums = counted.groupBy(*by, "node").agg(total(PRESENT, F.col("n")).alias("pages"), total(pairs, n).alias("n0"), total(pairs, F.col("share")).alias("h0"), total(CHILDREN, n).alias("n1"), total(CHILDREN, F.col("n") * F.log("n")).alias("h1"))
    entropy = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"h{k}") / F.col(f"n{k}") / F.log(F.col("pages") + PRIOR))
    return sums.select(*by, "node", "pages", "n0", (1 - F.least(entropy(0), entropy(1))).alias("importance"))


_HELD = "array<struct<node:long,feature:long,kind:int,share:double>>"


_COUNTED = "host string, node long, kind int, feature long, n long, share double"
_RUNS = ("host", "node", "kind", "feature", "n", "share")


def _batch(host: pa.Array, **columns) -> pa.RecordBatch:
    kinds = {"node": pa.int64(), "kind": pa.int32(), "feature": pa.int64(), "n": pa.int64(), "share": pa.float64(), "pairs": pa.binary(), "counts": pa.binary()}
    arrays = [host, *[columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(len(host), k) for c, k in kinds.items()]]
    return pa.RecordBatch.from_arrays(arrays, names=["host", *kinds])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of pages, summed by task, and pairs counted by host and node: a row for each 256th (``feature``)
    of all numbers, with the numbers and, where some stand on several pages, the counts packed."""
    kept: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
    others: list[pa.Table] = []
    many = 0

    def flush() -> Iterator[pa.RecordBatch]:
        summed = pa.concat_tables(others).group_by(["host", "node", "kind", "feature"]).aggregate([("share", "count"), ("share", "sum")])
        others.clear()
        for b in summed.combine_chunks().to_batches(10_000):
            yield _batch(b.column("host"), **{c: b.column(c) for c in ("node", "kind", "feature")}, n=b.column("share_count"), share=b.column("share_sum"))
        if not kept:
            return
        names = list(dict.fromkeys(k[0] for k in kept))
        number = {n: i for i, n in enumerate(names)}
        host_ = np.concatenate([np.full(len(k[3]), number[k[0]], dtype=np.int32) for k in kept])
        node = np.concatenate([np.repeat(k[1], k[2]) for k in kept])
        pairs = np.concatenate([k[3] for k in kept])
        kept.clear()
        nodes, code = np.unique(node, return_inverse=True)
        key = (host_.astype(np.int64) * len(nodes) + code).astype(np.uint64) << np.uint64(32) | pairs
        key, n = np.unique(key, return_counts=True)
        n = n.astype(np.uint32)
        pairs, of = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
        at = _starts(key >> np.uint64(24))
        bounds = list(zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True))
        packed = [_pack(pairs[a:b]) for a, b in bounds]
        counts = [n[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() if (n[a:b] > 1).any() else None for a, b in bounds]
        hosts = pa.array(names, pa.string()).take(pa.array(of[at] // len(nodes)))
        for lo in range(0, len(at), 10_000):
            own = slice(lo, lo + 10_000)
            yield _batch(hosts[own], node=nodes[of[at[own]] % len(nodes)], kind=np.full(len(at[own]), PAIR), feature=(pairs[at[own]] >> np.uint32(24)).astype(np.int64), pairs=packed[own], counts=counts[own])

    for batch in batches:
        held = batch.column("held")
        rows, flat = pc.list_parent_indices(held), pc.list_flatten(held)
        names_ = ("node", "feature", "kind", "share")
        others.append(pa.table([batch.column("host").take(rows), *[pc.struct_field(flat, c) for c in names_]], names=["host", *names_]))
        many += len(flat)
        for name, nodes, sizes, pairs in zip(*[batch.column(c).to_pylist() for c in ("host", "nodes", "sizes", "pairs")], strict=True):
            if pairs:
                kept.append((name, np.frombuffer(nodes, dtype="<i8"), np.frombuffer(sizes, dtype="<i4"), _unpack(pairs)))
                many += len(pairs) // 4
        if many >= 4 * MANY:
            yield from flush()
            many = 0
    if others:
        yield from flush()


def _sums(each: bool):
    """Of rows in order of kind, node and feature: how often each pair stands on a host, or only the sums of n
    and of n log n (``share``) of a node on a host (``OWN``) and on all hosts (``ALL``). All else as it is."""

    def count(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = list(dict.fromkeys(r[0] for r in rows))
        number = {n: i for i, n in enumerate(names)}
        found = [_unpack(r[2]) for r in rows]
        size = [len(f) for f in found]
        host_ = np.repeat(np.array([number[r[0]] for r in rows], dtype=np.int64), size)
        nodes, code = np.unique(np.array([r[1] for r in rows], dtype=np.int64), return_inverse=True)
        pair = np.repeat(code.astype(np.uint64), size) << np.uint64(32) | np.concatenate(found)
        n = np.concatenate([np.ones(k, dtype=np.int64) if r[3] is None else np.ascontiguousarray(np.frombuffer(r[3], dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for r, k in zip(rows, size, strict=True)])
        order = np.lexsort((host_, pair))
        pair, host_, n = pair[order], host_[order], n[order]
        at = _starts(pair, host_)
        n = np.add.reduceat(n, at)
        pair, host_ = pair[at], host_[at]
        node = (pair >> np.uint64(32)).astype(np.int64)
        of = pa.array(names, pa.string())
        if each:
            yield _batch(of.take(pa.array(host_)), node=nodes[node], kind=np.full(len(n), PAIR), feature=(pair & np.uint64(0xFFFFFFFF)).astype(np.int64), n=n, share=np.zeros(len(n)))
            return
        own, place = np.unique(node * len(names) + host_, return_inverse=True)
        yield _batch(of.take(pa.array(own % len(names))), node=nodes[own // len(names)], kind=np.full(len(own), OWN), feature=np.zeros(len(own), dtype=np.int64), n=np.bincount(place, n).astype(np.int64), share=np.bincount(place, n * np.log(n)))
        at = _starts(pair)
        n = np.add.reduceat(n, at)
        node = node[at]
        all_ = np.unique(node)
        yield _batch(pa.nulls(len(all_), pa.string()), node=nodes[all_], kind=np.full(len(all_), ALL), feature=np.zeros(len(all_), dtype=np.int64), n=np.bincount(node, n)[all_].astype(np.int64), share=np.bincount(node, n * np.log(n))[all_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        many, last = 0, None
        for batch in batches:
            is_pair = pc.equal(batch.column("kind"), PAIR)
            rest = batch.filter(pc.invert(is_pair))
            if rest.num_rows:
                yield rest.select(list(_RUNS))
            rows = batch.filter(is_pair)
            for name, node, feature, pairs, counts in zip(*[rows.column(c).to_pylist() for c in ("host", "node", "feature", "pairs", "counts")], strict=True):
                if many >= MANY and (node, feature) != last:
                    yield from (b.select(list(_RUNS)) for b in count(kept))
                    kept, many = [], 0
                kept.append((name, node, pairs, counts))
                many, last = many + len(pairs) // 4, (node, feature)
        if kept:
            yield from (b.select(list(_RUNS)) for b in count(kept))

    return run


def features(pages: DataFrame, each: bool = True) -> DataFrame:
    """On how many pages of a host (n) each feature of a node stands, and the sum of shares. If not
    ``each``, only the sums over a node's word pairs, ``OWN`` and ``ALL`` (without host), with n log n in ``share``."""
    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_contents, f"host string, page binary, held {_HELD}, nodes binary, sizes binary, pairs binary")
    merged = rows.groupBy("host", "page").agg(*[F.min(c).alias(c) for c in ("held", "nodes", "sizes", "pairs")])
    packed = merged.mapInArrow(_counted, f"{_COUNTED}, pairs binary, counts binary")
    dealt = packed.repartition("node", "feature").sortWithinPartitions("kind", "node", "feature")
    return dealt.mapInArrow(_sums(each), _COUNTED).groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))


def style_tree(counted: DataFrame) -> DataFrame:
    """host, node, importance, share (null for nodes that are no branch) and series (whether it is one) of
    every node, from its :func:`features` with sums of pairs."""
    everywhere = counted.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    own = _importance(counted.where(F.col("kind") != ALL), ["host"], OWN).where("n0 > 0")
    all_hosts = _importance(everywhere, [], ALL).select("node", F.col("importance").alias("elsewhere"))
    branches = counted.where(F.col("kind") == SHARE)
    # a branch's share leans on that of its path on all hosts, and this on that of its tags
    of_path = branches.groupBy("node", F.col("feature").alias("tags")).agg(F.sum("share").alias("all"), F.sum("n").alias("of"))
    of_tags = of_path.groupBy("tags").agg((F.sum("all") / F.sum("of")).alias("usual"))
    usual = of_path.join(of_tags, "tags").select("node", ((F.col("all") + PRIOR * F.col("usual")) / (F.col("of") + PRIOR)).alias("usual"))
    shares = branches.join(usual, "node").select("host", "node", ((F.col("share") + PRIOR * F.col("usual")) / (F.col("n") + PRIOR)).alias("mean"))
    judged = own.join(all_hosts, "node").select("host", "node", F.least("importance", "elsewhere").alias("importance"))
    items = counted.where(F.col("kind") == ITEMS).groupBy("host", "node").agg(F.sum("n").alias("of"), F.sum(F.col("n") * F.col("feature")).alias("many"), F.sum("share").alias("text"))
    all_items = items.groupBy("node").agg((F.sum("many") / (F.sum("of") + PRIOR)).alias("usual"))
    fair = (F.col("many") + PRIOR * F.col("usual")) / (F.col("of") + PRIOR) >= FAIR
    series = items.join(all_items, "node").where(fair & (2 * F.col("text") < F.col("of"))).select("host", "node", F.lit(True).alias("series"))
    told = judged.join(shares, ["host", "node"], "full").join(series, ["host", "node"], "full")
    return told.select("host", "node", "importance", F.col("mean").alias("share"), F.coalesce("series", F.lit(False)).alias("series"))


def kept_text(page: str, low: frozenset, share: dict[int, float], series: frozenset = frozenset()) -> str:
    """Text of a page without series, nodes of low importance and, outside article and main, branches
    whose usual share is small beside that of the largest on the page."""
    found = [(node, said) for node, said, _ in blocks(page, series)]
    found = [(node, said) for node, said in found if node.key not in low]
    most = max((share.get(node.branch, 1.0) for node, _ in found), default=0.0)
    return " ".join(said for node, said in found if node.keep or share.get(node.branch, 1.0) >= SMALL * most)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, last, judged = [], math.nan, (frozenset(), {}, frozenset())
        for name, page, nodes in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("judged"), strict=True):
            if name != last:
                nodes = nodes.as_py() or []
                judged = frozenset(x["node"] for x in nodes if x["low"]), {x["node"]: x["share"] for x in nodes if x["share"] is not None}, frozenset(x["node"] for x in nodes if x["series"])
                last = name
            texts.append(kept_text(page or "", *judged))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    counted = scratch.table(features(pages, each=False), "tree")
    tree = style_tree(counted)
    low = F.coalesce(F.col("importance") < LEAST, F.lit(False))
    by_host = tree.groupBy("host").agg(F.collect_list(F.struct("node", low.alias("low"), "share", "series")).alias("judged"))
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    # written first, its size is known before pages are dealt: they stay where they are if it is small
    judged = scratch.table(by_host, "judged")
    scratch.drop(counted)
    joined = named.join(judged, "host", "left").select("page_id", "url", "html", "host", "judged")
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
