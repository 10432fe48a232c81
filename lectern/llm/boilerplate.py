"""Main content of web pages (problem 5).

Method: union-free regular expressions, inferred by aligning the token streams
of a host one after the other. A page is a stream of line tokens: a line with
its numbers, months and the host's own name turned into slots. The first page
of a host is its template; every further page is aligned with it along the
longest common order of their tokens. What matches is a constant of the
template; what only one side has is an optional group there; what mismatches
on both sides is a text slot, which the template keeps as a place and not as
text; a token that comes again within a page is a repeated group. A menu is a
repeated group of items that recur in other menus, a side box a constant
followed by a repeated group of text slots (its links).

A node is part of the wrapper if it aligns in ``support`` pages of its host
that are no copies of each other. Headings and list items, which align too,
carry marks of their text (numbers, hash signs, bullets) somewhere in the
corpus; furniture never does. Hosts whose own pages are too few are backed by
the tokens that stand in a share of all pages of the corpus.

Streams are hashes, not texts. A large host falls into parts of about
``TOGETHER`` pages by a hash of the id, each aligned by one task, and the counts
of their nodes are added: a group of copies counts once a part, which is less
than the support whatever the number of parts.

Defined results: null, empty and blank texts have no lines. A page whose url
names no host belongs to the host of its institution, and where that is null as
well to one of its own. Rows of other extensions than html are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage
from .confusables import ordinary
from .mojibake import EAST, SINGLE, _any_island, _from_bytes, _islands, _to_bytes

LEAST, SHARE = 5, 6e-4
#: So many minwise values tell pages apart; lines longer than HEAVY weigh no more than lines of that length.
VIEWS, HEAVY = 4, 200
#: Pages of a host that one task aligns. A part holds more than 1 / SHARE pages, so that copies in all parts stay below the support.
TOGETHER = 4000
#: Tables by host are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 200_000
_VIEW = np.array([[0x9E3779B97F4A7C15 * v % (1 << 64)] for v in range(1, VIEWS + 1)], dtype=np.uint64)
MARKED_SHARE = 0.06
#: A constant mostly followed by lines in its paragraph, this share of them marked as links, is the head of a box.
LINKED = 0.2
#: Longer lines are compared as they stand, with their numbers.
LONG = 400
MARK = re.compile(r"\s*(?:#{1,6}\s+|[-*•–·›»]\s+|\d+(?:\.\d+)*[.)]\s+|Q:\s+)+")
ITEMS = re.compile(r"\s*[|·>»›/]\s*|\t+| {2,}")
CRUMB = re.compile(r"\s+[>›»/]\s+")
DIGITS = re.compile(r"\d+(?:[ .,:/-]\d+)*")
#: Month names of the languages of the corpus that write them out.
MONTHS = re.compile(
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|janeiro|fevereiro|março|maio|junho|julho|setembro|outubro|novembro|dezembro)\b"
)
#: What joins the name of a site to a title.
JOINS = r"\s+[|–—·»-]\s+|\s*::\s*|:\s+|：|｜"
OWNER = re.compile(r"(.{0,12}© 0 )([^.]+?)(\. .*|)$")
PARTS = frozenset("|·>»›/")
SENTENCE_END = re.compile(r"[.!?。！？]\s*$")


def _hash(text: str) -> int:
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def _mended(text: str) -> str:
    """A text with what a wrong encoding or look-alikes did to it undone where that is plain, for comparing."""
    if text.isascii():
        return text
    if _any_island().search(text):
        for _ in range(2):
            for codec in SINGLE:
                text = _islands(codec).sub(lambda m, codec=codec: _from_bytes(_to_bytes(m.group(), codec), "utf-8") or m.group(), text)
    return ordinary(text)


class Page:
    """The line tokens of one page."""

    __slots__ = ("at", "lines", "keys", "bases", "marked", "para", "titles")

    def __init__(self, text: str, title: str | None, names: list[str] | None):
        self.at, self.lines, self.keys, self.bases, self.marked, self.para = [], [], [], [], [], []
        names = sorted((n for n in names or [] if n), key=len, reverse=True)
        para, blank = -1, True
        mended = _mended(text)
        raw = text.split("\n")
        lines = mended.split("\n")
        if len(lines) != len(raw):
            lines = raw
        for no, line in enumerate(lines):
            line = line.strip(" \t\r\f")
            if not raw[no].strip(" \t\r\f"):
                blank = True
                continue
            para += blank
            blank = False
            m = MARK.match(line)
            self.at.append(no)
            self.lines.append(line)
            self.keys.append(mask(line, names))
            self.bases.append(mask(line[m.end() :], names) if m else self.keys[-1])
            self.marked.append(bool(m))
            self.para.append(para)
        title = _mended(title or "")
        self.titles = {mask(x, names) for x in [title, *re.split(JOINS, title)] if x}


def mask(line: str, names: list[str]) -> str:
    for n in names:
        if n in line:
            line = line.replace(n, "\x01")
    if len(line) > LONG:
        return line
    line = DIGITS.sub("0", line)
    if "0" not in line:
        return line
    return _slotted(MONTHS.sub("M", line))


def _slotted(line: str) -> str:
    """A name not known from titles as a slot: after a year of copyright, or before the rest of an address."""
    m = OWNER.match(line)
    if m and len(line) < 120:
        return m.group(1) + "\x01" + m.group(3)
    head, comma, rest = line.partition(", ")
    return "\x01, " + rest if comma and len(line) < 120 and "0" in rest and "0" not in head and not SENTENCE_END.search(line) else line


def menu(line: str) -> list[str]:
    """The items of a line, if it has several."""
    items = [x for x in ITEMS.split(line.strip("|·>»›/ \t")) if x]
    if len(items) < 2 and " " in line and EAST.search(line) and len(line) < 200 and not SENTENCE_END.search(line):
        items = line.split()
    return items if len(items) > 1 else []


def _is_item(x: str) -> bool:
    return len(x) <= 40 and x.count(" ") < 5 and "0" not in x and not SENTENCE_END.search(x)


def hosts(df: DataFrame, url_col: str = "url", owner_col: str | None = "institution_id") -> DataFrame:
    host = F.nullif(F.lower(F.regexp_extract(url_col, "^[A-Za-z]+://([^/?#]+)", 1)), F.lit(""))
    owner = F.concat(F.lit("\x01"), F.col(owner_col).cast("string")) if owner_col in df.columns else F.lit(None).cast("string")
    return df.withColumn("host_", F.coalesce(host, owner, F.lit("")))


def site_names(df: DataFrame, title_col: str = "title") -> DataFrame:
    """The names of each host: the ends of its titles that stand beside at least two different other parts, and beside a twentieth of its titles.

    A title has two ends, so that a host has no more than 40 names.
    """
    parts = F.filter(F.split(F.col(title_col), JOINS), lambda x: F.length(x) > 2)
    rows = df.where(F.size(parts) > 1).select("host_", F.trim(F.element_at(parts, 1)).alias("a"), F.trim(F.element_at(parts, -1)).alias("b")).distinct()
    of = rows.groupBy("host_").agg(F.count(F.lit(1)).alias("of"))
    ends = rows.select("host_", F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))).alias("x")).select("host_", "x.*")
    ends = ends.distinct().groupBy("host_", "name").agg(F.count(F.lit(1)).alias("n"))
    return ends.join(of, "host_").where("n >= 2 and n >= 0.05 * of").groupBy("host_").agg(F.collect_list("name").alias("names_"))


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table with a hint to broadcast it where its rows are few, and whether they are."""
    few = df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(df) if few else df), few


def _pages(df: DataFrame, id_col: str, text_col: str, url_col: str, title_col: str) -> DataFrame:
    by_host = hosts(df, url_col)
    names, _ = _small(stage(site_names(by_host, title_col), "line-names"))
    rows = by_host.where(F.length(text_col) > 0).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(title_col).alias("title_"), "host_")
    return rows.join(names, "host_", "left").select("id_", "text_", "title_", "names_", F.xxhash64("host_").alias("host"))


LINES = ["key", "name", "weight", "marked", "begins", "head", "words"]
ITEMS_OF = ["item_key", "item_of", "item_head", "item_words"]
STREAM = "host bigint, salt bigint, " + ", ".join(f"{c} array<bigint>" for c in LINES + ITEMS_OF)


def line_streams(pages: DataFrame) -> DataFrame:
    """Every page as the hashes of its line tokens, a row a page.

    By line: ``key`` (of a marked line its text without the mark), ``name`` (the
    line as it stands), ``weight``, ``marked``, ``begins`` (a paragraph), and
    ``head`` and ``words`` to look for it inside a longer line; by item of a
    menu: its key, the key of its menu, head and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[str, tuple[int, int, int]] = {}

        def shape(token: str) -> tuple[int, int, int]:
            known = shapes.get(token)
            if known is None:
                if len(shapes) > 200_000:
                    shapes.clear()
                known = shapes[token] = (_hash(token), *_shape(token))
            return known

        for batch in batches:
            salts, cols = [], [[] for _ in LINES + ITEMS_OF]
            for k, (text, title, names) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                page = Page(text, title, names)
                tokens = [shape(b) for b in page.bases]
                items = []
                for key, marked, token in zip(page.keys, page.marked, tokens):
                    if not marked and len(own := menu(key)) > 2 and all(map(_is_item, own)):
                        items += [(token[0], shape("\x02" + x)[0], *_shape(x)) for x in own]
                para = page.para
                lines = ([t[0] for t in tokens], [_hash(x) for x in page.lines], [min(max(len(x), 1), HEAVY) for x in page.lines], page.marked, [not i or para[i] != para[i - 1] for i in range(len(para))], [t[1] for t in tokens], [t[2] for t in tokens])
                for col, x in zip(cols, (*lines, [x[1] for x in items], [x[0] for x in items], [x[2] for x in items], [x[3] for x in items])):
                    col.append(list(map(int, x)))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), *(pa.array(c, kind) for c in cols)], names=["host", "salt", *LINES, *ITEMS_OF])

    return pages.withColumn("salt", F.xxhash64("id_")).mapInArrow(run, STREAM)


def contexts(name: np.ndarray, key: np.ndarray, weight: np.ndarray, page: np.ndarray, first_line: np.ndarray) -> list[np.ndarray]:
    """By line and view, what tells its page apart: the weighted minwise line of the page that has another token.

    Long lines are likelier to be it, so that copies of a page, slightly changed
    ones too, share it; a line is never its own context, and furniture that is
    the context of its pages in one view is not in another. A page of one token
    only is its own context.
    """
    out = []

    def least(value: np.ndarray) -> np.ndarray:
        """The line of the least value of each page."""
        low = np.minimum.reduceat(value, first_line)
        at = np.flatnonzero(value == low[page])
        return at[np.unique(page[at], return_index=True)[1]]

    for view in _VIEW[:, 0]:
        with np.errstate(over="ignore"):
            x = (name.view(np.uint64) ^ view) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        value = -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight
        first = least(value)
        same = key == key[first][page]
        second = least(np.where(same, np.inf, value))
        second = np.where(key[second] == key[first], first, second)
        out.append(np.where(same, name[second][page], name[first][page]))
    return out


class Template:
    """The nodes of a host's template, grown by aligning one page after the other; nodes of one rank are alternatives in one slot."""

    def __init__(self) -> None:
        self.rank: list[float] = []
        self.key: list[int] = []
        self.pages: list[int] = []
        self.again: list[int] = []
        self.of: dict[int, list[int]] = {}

    def _renumber(self) -> None:
        place = {r: float(k) for k, r in enumerate(sorted(set(self.rank)))}
        self.rank = [place[r] for r in self.rank]

    def add(self, tokens: list[int]) -> None:
        """Align a page: the longest run of its tokens that has the order of the template; the others become nodes between."""
        seen: set[int] = set()
        own = []
        for t in tokens:
            if t in seen:
                # the same token again: a repeated group of the node it is aligned with
                for node in self.of.get(t, ())[:1]:
                    self.again[node] += 1
            else:
                seen.add(t)
                own.append(t)
        # longest increasing run of ranks; of a token with several nodes the later ones are tried first
        tails: list[float] = []
        ends: list[tuple[int, int]] = []
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        for i, t in enumerate(own):
            for node in reversed(self.of.get(t, ())):
                r = self.rank[node]
                at = bisect_left(tails, r)
                back[i, node] = ends[at - 1] if at else None
                if at == len(tails):
                    tails.append(r)
                    ends.append((i, node))
                else:
                    tails[at], ends[at] = r, (i, node)
        path: dict[int, int] = {}
        step = ends[-1] if ends else None
        while step is not None:
            path[step[0]] = step[1]
            step = back[step]
        for node in path.values():
            self.pages[node] += 1
        # what stands between two matches on the page goes between their nodes
        i, n, left = 0, len(own), None
        close = False
        while i < n:
            if i in path:
                left = self.rank[path[i]]
                i += 1
                continue
            j = i
            while j < n and j not in path:
                j += 1
            right = self.rank[path[j]] if j < n else None
            low = left if left is not None else (right if right is not None else 0.0) - (j - i + 1)
            high = right if right is not None else low + (j - i + 1)
            step_ = (high - low) / (j - i + 1)
            for k in range(i, j):
                node = len(self.rank)
                self.rank.append(low + step_ * (k - i + 1))
                self.key.append(own[k])
                self.pages.append(1)
                self.again.append(0)
                nodes = self.of.setdefault(own[k], [])
                nodes.append(node)
                if len(nodes) > 1:
                    nodes.sort(key=self.rank.__getitem__)
            close |= step_ < 1e-6
            i = j
        if close:
            self._renumber()


CTX = [f"ctx_{v}" for v in range(VIEWS)]
COUNTS = ["marked", "plain", "follow", "slot", "aligned", "again", "n_ctx"]
NODES = "host bigint, key bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", place double, head bigint, words bigint, " + ", ".join(f"{c} array<bigint>" for c in CTX)


def align_part(part: pa.Table) -> pa.Table:
    """The nodes of one part of a host: a row a token, with the pages it aligns in and the contexts it stands in."""
    part = part.combine_chunks()
    flat = lambda c: part.column(c).combine_chunks().values.to_numpy().astype(np.int64)
    key, name, weight, marked, begins, head, words = (flat(c) for c in LINES)
    item_key, item_of, item_head, item_words = (flat(c) for c in ITEMS_OF)
    sizes = np.diff(part.column("key").combine_chunks().offsets.to_numpy())
    sizes = sizes[sizes > 0]
    n = len(key)
    if not n:
        return pa.table([pa.array([], t) for t in (pa.int64(),) * 9] + [pa.array([], pa.float64())] + [pa.array([], pa.int64())] * 2 + [pa.array([], pa.list_(pa.int64()))] * VIEWS, names=NODE_COLUMNS)
    page = np.repeat(np.arange(len(sizes)), sizes)
    first_line = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ctx = contexts(name, key, weight.astype(float), page, first_line)
    tokens, code = np.unique(np.concatenate([key, item_key]), return_inverse=True)
    line, item = code[:n], code[n:]
    m = len(tokens)
    plain = marked == 0
    nxt = np.append((page[1:] == page[:-1]) & (begins[1:] == 0), False)
    count = lambda x, where: np.bincount(x[where], minlength=m)
    cols = {"marked": count(line, ~plain), "plain": count(line, plain) + np.bincount(item, minlength=m), "follow": count(line, plain & nxt), "slot": count(line, plain & nxt & np.append(marked[1:] == 1, False))}
    # tokens of at least two pages can align; all others are text slots
    on_pages = np.bincount(np.unique(line[plain] * np.int64(len(sizes)) + page[plain]) // len(sizes), minlength=m)
    aligns = plain & (on_pages[line] > 1)
    template = Template()
    at = np.flatnonzero(aligns)
    for own in np.split(line[at], np.flatnonzero(np.diff(page[at])) + 1):
        template.add(own.tolist())
    node_of, node_pages = np.array(template.key, dtype=np.int64), np.array(template.pages, dtype=np.int64)
    rank, again = np.array(template.rank), np.array(template.again, dtype=np.int64)
    # a node with the page only that brought it has aligned with nothing
    met = np.where(node_pages > 1, node_pages, 0)
    cols["aligned"] = np.bincount(node_of, weights=met, minlength=m).astype(np.int64) + np.bincount(item, minlength=m)
    cols["again"] = np.bincount(node_of, weights=again, minlength=m).astype(np.int64)
    low, high = (rank.min(), rank.max()) if len(rank) else (0.0, 1.0)
    place = np.bincount(node_of, weights=met * (rank - low) / max(high - low, 1e-9), minlength=m) / np.maximum(np.bincount(node_of, weights=met, minlength=m), 1)
    lists, n_ctx = [], []
    for c in ctx:
        of, what = np.concatenate([line[plain], item]), np.concatenate([c[plain], item_of])
        seen, which = np.unique(what, return_inverse=True)
        both = np.unique(of * np.int64(len(seen)) + which)
        per = np.bincount(both // len(seen), minlength=m)
        n_ctx.append(per)
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(seen[both % len(seen)])))
    # one view may be cut down by furniture, and another split by what is changed in copies
    cols["n_ctx"] = np.sort(np.stack(n_ctx), axis=0)[-2]
    shape = np.zeros((2, m), dtype=np.int64)
    for where, h, w in ((line, head, words), (item, item_head, item_words)):
        shape[0, where], shape[1, where] = h, w
    hosts_ = pa.array(np.full(m, part.column("host")[0].as_py()))
    return pa.table([hosts_, pa.array(tokens), *(pa.array(cols[c].astype(np.int64)) for c in COUNTS), pa.array(place), pa.array(shape[0]), pa.array(shape[1]), *lists], names=NODE_COLUMNS)


NODE_COLUMNS = ["host", "key", *COUNTS, "place", "head", "words", *CTX]


def host_nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the templates of all hosts, by part, and the number of pages of each host."""
    streams = stage(line_streams(pages), "line-streams")
    sizes = stage(streams.groupBy("host").agg(F.count(F.lit(1)).alias("of_pages")), "line-hosts")
    parts = _small(sizes.where(F.col("of_pages") > TOGETHER).select("host", F.ceil(F.col("of_pages") / TOGETHER).alias("parts")))[0]
    streams = streams.join(parts, "host", "left").withColumn("part", F.expr("pmod(salt, coalesce(parts, 1))")).drop("parts", "salt")
    return stage(streams.groupBy("host", "part").applyInArrow(align_part, NODES), "line-nodes"), sizes


CONSTANT, HEAD, MENU, SEVERAL, LINK = "constant", "head", "menu", "several", "link"


def _shape(text: str) -> tuple[int, int]:
    """What a token starts with, and its number of words: to look for it inside a longer line."""
    return _hash(text.partition(" ")[0]), text.count(" ") + 1


class Wrappers:
    """Constants and menu items, box heads, and the words constants start with, all by hash."""

    def __init__(self, constants: set[int], heads: set[int], starts: set[int], longest: int):
        self.constants, self.heads, self.starts, self.longest = constants, heads, starts, longest

    def with_own(self, own: list[tuple[int, bool, int, int]]) -> Wrappers:
        """These and the constants of a host: their key, whether they are heads, the word they start with and their number of words."""
        sets = ({k for k, *_ in own}, {k for k, is_head, *_ in own if is_head}, {head for _, _, head, _ in own})
        return Wrappers(*(Either(x, y) for x, y in zip((self.constants, self.heads, self.starts), sets)), max(self.longest, *(words for *_, words in own)))

    def known(self, text: str) -> bool:
        return _hash(text) in self.constants

    def item(self, text: str) -> bool:
        return _hash("\x02" + text) in self.constants or _hash(text) in self.constants

    def is_menu(self, key: str, titles: set[str]) -> bool:
        items = menu(key)
        for k, x in enumerate(items):
            if not self.item(x):
                # a path ends with the page itself
                return k == len(items) - 1 and k > 0 and bool(CRUMB.search(key)) and (k > 1 or x in titles)
        return bool(items)

    def is_made_of(self, key: str, titles: set[str]) -> bool:
        """Whether a line is several pieces of furniture one after the other."""
        words = key.split(" ")
        n = len(words)
        if n < 2 or _hash(words[0]) not in self.starts:
            return False
        reach = {0}
        for i in range(n):
            if i not in reach or _hash(words[i]) not in self.starts:
                continue
            part = ""
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = words[i] if j == i + 1 else f"{part} {words[j - 1]}"
                if self.item(part) or "0" in part and self.known(_slotted(part)):
                    reach.add(j)
            # a menu among them: as long as its items and what parts them go on
            j, good = i, i
            while j < n:
                if words[j] in PARTS:
                    j += 1
                    continue
                for k in range(min(n, j + 5), j, -1):
                    if self.item(x := " ".join(words[j:k])) or k == j + 1 and self.is_menu(x, titles):
                        j = good = k
                        break
                else:
                    break
                if j < n and words[j] not in PARTS:
                    break
            if good > i:
                reach.add(good)
        return n in reach

    def furniture(self, page: Page) -> list[str | None]:
        """For every line token its part in the wrapper, none for content: constant, head, menu, several or link."""
        n = len(page.keys)
        out: list[str | None] = [None] * n
        in_box = False
        for i in range(n):
            key = page.keys[i]
            if i and page.para[i] != page.para[i - 1]:
                in_box = False
            if page.marked[i] and not in_box:
                continue
            if not page.marked[i]:
                h = _hash(key)
                out[i] = HEAD if h in self.heads else CONSTANT if h in self.constants else MENU if self.is_menu(key, page.titles) or self.item(key) else SEVERAL if self.is_made_of(key, page.titles) else None
                if out[i]:
                    # only one box at a time; a constant that is no head ends its links
                    in_box = out[i] == HEAD
                    continue
            if in_box:
                if len(key) < 160 and not SENTENCE_END.search(key):
                    out[i] = LINK
                else:
                    in_box = False
        return out


class Either:
    """Membership in one of two sets, neither copied."""

    def __init__(self, one: set[int], two: set[int]):
        self.one, self.two = one, two

    def __contains__(self, x: int) -> bool:
        return x in self.one or x in self.two


IS_HEAD = f"2 * follow > plain and slot > {LINKED} * follow"
OWN = ["key", "is_head", "head", "words"]


def _sums(what: list[str]) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in what], F.max_by("head", "words").alias("head"), F.max("words").alias("words")]


def infer_wrappers(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> tuple[Wrappers, DataFrame]:
    """What backs all hosts, and the table of every host's own wrapper.

    The table has ``host``, ``groups`` (so many for the pages of the host), a
    token a row, ``is_head``, ``n_ctx`` (different pages), ``again`` (repeats),
    and ``place``. The backing tokens stand in ``share`` of all pages, at least
    ``least`` different ones: no more than lines / (share x pages) of them.
    """
    nodes, sizes = host_nodes(pages)
    n = sizes.agg(F.coalesce(F.sum("of_pages"), F.lit(0))).first()[0]
    support = max(least, share * n)
    # marks count wherever they stand in the corpus
    totals = nodes.groupBy("key").agg(*_sums(["marked", "plain", "follow", "slot"])).where(F.col("plain") >= least)
    totals = stage(totals.where(F.col("marked") <= MARKED_SHARE * (F.col("plain") + F.col("marked"))), "line-tokens")
    views = nodes.join(totals.where(F.col("plain") >= support).select("key"), "key").select("key", F.posexplode(F.array(*CTX)).alias("view", "ctx")).select("key", "view", F.explode("ctx").alias("ctx")).distinct()
    n_ctx = views.groupBy("key", "view").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sort_array(F.collect_list("n"), False)[1].alias("n_ctx"))
    pooled = stage(totals.join(n_ctx.where(F.col("n_ctx") >= support), "key").select("key", F.expr(IS_HEAD).alias("is_head"), "head", "words"), "line-constants")
    constants, heads, starts, longest = set(), set(), set(), 1
    for batch in pooled.toArrow().to_batches():
        k, is_head, head, words = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        constants.update(k.tolist())
        heads.update(k[is_head.astype(bool)].tolist())
        starts.update(head.tolist())
        longest = max(longest, int(words.max(initial=1)))
    own = nodes.where("aligned > 0").groupBy("host", "key").agg(*_sums(["plain", "aligned", "again", "n_ctx"]), (F.sum(F.col("place") * F.col("aligned")) / F.sum("aligned")).alias("place"))
    own = own.where(F.col("n_ctx") >= least).join(_small(sizes)[0], "host").where(F.col("n_ctx") >= share * F.col("of_pages"))
    # what follows a token is counted over all hosts
    own = own.join(totals.select("key", F.expr(IS_HEAD).alias("is_head")), "key")
    own = own.select("host", F.ceil(F.col("of_pages") / TOGETHER).cast("int").alias("groups"), "is_head", "key", "head", "words", "n_ctx", "again", "place", "plain", "of_pages")
    return Wrappers(constants, heads, starts, longest), stage(own, "line-own")


def _beside(pages: DataFrame, own: DataFrame) -> DataFrame:
    """Pages grouped by host and part of it, each group after the wrapper of its host: ``is_page`` tells them apart."""
    groups = own.select("host", "groups").distinct()
    part = F.expr("cast(pmod(xxhash64(id_), coalesce(groups, 1000000)) as int)")
    rows = pages.join(groups, "host", "left").withColumn("part", part).drop("groups").withColumn("is_page", F.lit(True))
    first = own.select("host", "groups", *OWN).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups").withColumn("is_page", F.lit(False))
    both = rows.unionByName(first, allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", "is_page")
    return both.select("id_", "text_", "title_", "names_", "host", "part", "is_page", *OWN)


def furniture_lines(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", url_col: str = "url", title_col: str = "title", extension_col: str | None = "extension") -> DataFrame:
    """A row a line that belongs to the site: the id and ``line_no``, counted from 0 within the text."""
    return _mapped(df, id_col, text_col, url_col, title_col, extension_col, "line_no int", _emit_lines)


def main_content(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", url_col: str = "url", title_col: str = "title", extension_col: str | None = "extension") -> DataFrame:
    """Every page's id with ``body``, its text without furniture, ``main_title``, without the site's name, and ``n_removed`` lines."""
    return _mapped(df, id_col, text_col, url_col, title_col, extension_col, "body string, main_title string, n_removed int", _emit_bodies)


def host_wrappers(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", url_col: str = "url", title_col: str = "title", extension_col: str | None = "extension") -> DataFrame:
    """The inferred template of each host, a row a node: ``host``, ``part``, ``token``, ``n_pages`` with it, ``of_pages``, ``n_repeats``, ``place``.

    ``part`` is constant (on all pages of the host), optional, head (of a box of
    links), or link, the repeated group of text slots after a head, without a
    token. ``n_repeats`` above 0 makes a node a repeated group. ``token`` has
    ``*`` for the slot of the host's name and 0 for numbers. ``place`` goes by
    the order of the template, from 0 at its top to 1 at its end.
    """
    pages, _, own = _inferred(df, id_col, text_col, url_col, title_col, extension_col)
    keys, few = _small(own.select("host", "key").distinct())
    known = df.sparkSession.sparkContext.broadcast({r.key for r in own.select("key").distinct().toLocalIterator()}) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {}
            for text, title, names, host in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                page = Page(text, title, names)
                for key, marked in zip(page.keys, page.marked):
                    if not marked:
                        for token, h in ((key, _hash(key)), *((x, _hash("\x02" + x)) for x in menu(key))):
                            if known is None or h in known.value:
                                seen.setdefault((host, h), token.replace("\x01", "*"))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([k for _, k in seen], pa.int64()), pa.array(list(seen.values()), pa.string())], names=["host", "key", "token"])

    tokens = pages.mapInArrow(run, "host bigint, key bigint, token string").groupBy("host", "key").agg(F.min("token").alias("token"))
    of = hosts(df, url_col).select("host_").distinct().select(F.xxhash64("host_").alias("host"), F.regexp_replace("host_", "^\x01", "").alias("name"))
    part = F.when(F.col("is_head"), HEAD).when(F.col("plain") >= F.col("of_pages"), CONSTANT).otherwise("optional")
    nodes = own.join(tokens, ["host", "key"]).join(of, "host")
    row = lambda part, token: nodes.select(F.col("name").alias("host"), part.alias("part"), token.alias("token"), F.col("plain").alias("n_pages"), "of_pages", F.col("again").alias("n_repeats"), "place", "is_head")
    slots = row(F.lit(LINK), F.lit(None).cast("string")).where("is_head").withColumn("n_repeats", F.col("n_pages"))
    return row(part, F.col("token")).unionByName(slots).drop("is_head")


def _emit_lines(texts, titles, names, wrappers):
    row, no = [], []
    for k, (text, title, own, wrapper) in enumerate(zip(texts, titles, names, wrappers)):
        page = Page(text, title, own)
        for at, gone in zip(page.at, wrapper.furniture(page)):
            if gone:
                row.append(k)
                no.append(at)
    return row, [pa.array(no, pa.int32())], ["line_no"]


def _emit_bodies(texts, titles, names, wrappers):
    bodies, plain, removed = [], [], []
    for text, title, own, wrapper in zip(texts, titles, names, wrappers):
        page = Page(text, title, own)
        gone = {at for at, f in zip(page.at, wrapper.furniture(page)) if f}
        body = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in gone)
        bodies.append(re.sub(r"\n\s*\n\s*\n+", "\n\n", body).strip("\r\n"))
        parts = [x for x in re.split(f"({JOINS})", title) if x] if title else []
        while len(parts) > 2 and parts[-1].strip() in (own or []):
            parts = parts[:-2]
        while len(parts) > 2 and parts[0].strip() in (own or []):
            parts = parts[2:]
        plain.append("".join(parts) if title is not None else None)
        removed.append(len(gone))
    return list(range(len(texts))), [pa.array(bodies, pa.string()), pa.array(plain, pa.string()), pa.array(removed, pa.int32())], ["body", "main_title", "n_removed"]


def _inferred(df: DataFrame, id_col: str, text_col: str, url_col: str, title_col: str, extension_col: str | None) -> tuple[DataFrame, Wrappers, DataFrame]:
    ship(df.sparkSession)
    if extension_col:
        df = df.where(F.lower(F.col(extension_col)) == "html")
    pages = _pages(df, id_col, text_col, url_col, title_col)
    return pages, *infer_wrappers(pages)


def _mapped(df, id_col, text_col, url_col, title_col, extension_col, schema, emit) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    pages, wrappers, own = _inferred(df, id_col, text_col, url_col, title_col, extension_col)
    _, few = _small(own)
    of_host: dict[int, list] = {}
    if few:
        for r in own.select("host", *OWN).toLocalIterator():
            of_host.setdefault(r.host, []).append((r.key, r.is_head, r["head"], r.words))
    sent = df.sparkSession.sparkContext.broadcast((wrappers, of_host))

    def with_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled, of_host = sent.value
        by_host: dict[int, Wrappers] = {}
        for batch in batches:
            by_row = []
            for h in batch.column(4).to_pylist():
                if h not in by_host:
                    by_host[h] = pooled.with_own(of_host[h]) if h in of_host else pooled
                by_row.append(by_host[h])
            row, cols, columns = emit(*(batch.column(i).to_pylist() for i in (1, 2, 3)), by_row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *cols], names=["id_", *columns])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled = sent.value[0]
        at, seen, wrapper = None, [], pooled
        for batch in batches:
            by_row = [pooled] * batch.num_rows
            is_page = batch.column(6).to_pylist()
            where = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            own_rows = list(zip(*(batch.column(i).to_pylist() for i in (7, 8, 9, 10))))
            for k, page in enumerate(is_page):
                if where[k] != at:
                    at, seen, wrapper = where[k], [], pooled
                if not page:
                    seen.append(own_rows[k])
                    wrapper = None
                else:
                    wrapper = by_row[k] = wrapper or pooled.with_own(seen)
            take = pa.array([k for k, page in enumerate(is_page) if page], pa.int64())
            pages_ = batch.take(take)
            row, cols, columns = emit(*(pages_.column(i).to_pylist() for i in (1, 2, 3)), [by_row[k] for k in take.to_pylist()])
            yield pa.RecordBatch.from_arrays([pages_.column(0).take(pa.array(row, pa.int64())), *cols], names=["id_", *columns])

    # the wrappers of hosts go to the pages where they are few, and both go by host where they are many
    rows, run = (pages, with_broadcast) if few else (_beside(pages, own), beside)
    return rows.mapInArrow(run, f"id_ {kind}, {schema}").withColumnRenamed("id_", id_col)
