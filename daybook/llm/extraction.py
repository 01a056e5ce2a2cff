"""Main text of web pages by the templates of their hosts.

Tokens of a page are its tags and runs of text, each with its path (``markup``). Over all pages of
a host, tokens with the same occurrence vector (how often in which page) form an equivalence class;
vectors are compared by their length, their sum and two order-free hash sums, so no vector and no
host is ever held in one place. Classes of two tokens or more that occur in ``LEAST_PAGES`` pages
and in half of the host's pages are candidates. A candidate is valid if its tokens come in one
order in every page, properly nested in the others, and in one place of the template. Valid classes
are the template; what lies between the tokens is its slots.

Slots are told apart over the host: a slot is main text if most of its characters lie in the
article (elements and attribute names tell, see ``markup``). Where a host's template marks no
article, slots that are mostly links are menus, and text of the template itself is not extracted.
In a marked article all text stays, also such as is alike in many pages. A host with too few pages
for a template has its pages judged by their own marks.

White space is what ``str.split`` takes for it. A null or empty page gives empty text; repeated
rows count and come out as often as they occur; a null or odd url belongs to one nameless host.
Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, OrderedDict, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.markup import BLOCK, Token, tokens
from daybook.llm.text import slices, stage

LEAST_PAGES = 3
#: Templates go to all tasks if they have at most this many numbers in all (8 bytes each).
BROADCAST_NUMBERS = 2_000_000
#: Rows that a task adds up before it sends them, and templates that it keeps ready.
HELD_ROWS, HELD_HOSTS = 200_000, 256
#: Bytes of pages in work at a time.
PAGE_BYTES = 1 << 22

TEMPLATE = "marks array<long>, classes array<long>, fixed array<long>, slots array<long>, host_rank int"
_HALF = (1 << 32) - 1


def host(url: Column) -> Column:
    """Lower-case host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _number(*parts: object) -> int:
    return int.from_bytes(blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


class Sums:
    """Rows added up by key within a task, sent when there are many."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], add: Callable) -> None:
        self.schema = pa.schema(list(zip(names, kinds)))
        self.add, self.rows = add, {}

    def put(self, key: tuple, values: tuple) -> None:
        old = self.rows.get(key)
        self.rows[key] = values if old is None else self.add(old, values)

    def full(self) -> bool:
        return len(self.rows) >= HELD_ROWS

    def take(self) -> pa.RecordBatch:
        rows, self.rows = [(*k, *v) for k, v in self.rows.items()], {}
        columns = list(zip(*rows)) if rows else [()] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in slices([batch], "html", PAGE_BYTES):
            yield from part.to_pylist()


def _add_tokens(old: tuple, new: tuple) -> tuple:
    return (*[a + b for a, b in zip(old[:4], new[:4])], max(old[4], new[4]))


def _token_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, occurrences, two hash sums of the vector, rank it opens.

    Token 0 stands for the page itself.
    """
    sums = Sums("host key pages total one two opens".split(), [pa.string(), *[pa.int64()] * 5, pa.int32()], _add_tokens)
    for page in _pages(batches):
        counts, opens = Counter(), {}
        for token in tokens(page["html"]):
            if token.key:
                counts[token.key] += 1
                opens[token.key] = max(opens.get(token.key, 0), token.opens)
        hashes = {n: _number(page["mark"], n) for n in set(counts.values())}
        sums.put((page["host"], 0), (1, 0, 0, 0, 0))
        for key, n in counts.items():
            sums.put((page["host"], key), (1, n, hashes[n] & _HALF, hashes[n] >> 32, opens[key]))
        if sums.full():
            yield sums.take()
    yield sums.take()


def candidates(pages: DataFrame) -> DataFrame:
    """Classes of tokens with equal vectors: host, class, keys, rank that one of them opens."""
    sent = pages.mapInArrow(_token_sums, "host string, key long, pages long, total long, one long, two long, opens int")
    seen = sent.groupBy("host", "key").agg(
        *[F.sum(c).alias(c) for c in ("pages", "total", "one", "two")], F.max("opens").alias("opens")
    )
    seen = stage(seen.where(F.col("pages") >= LEAST_PAGES), "tokens")
    hosts = seen.where("key = 0").select("host", F.col("pages").alias("all_pages"))
    common = seen.where("key <> 0").join(hosts, "host").where("2 * pages >= all_pages")
    vector = F.xxhash64("pages", "total", "one", "two").alias("class")
    classes = common.groupBy("host", vector).agg(F.collect_list("key").alias("keys"), F.max("opens").alias("opens"))
    return stage(classes.where(F.size("keys") > 1), "classes")


def _whole(candidate: DataFrame) -> DataFrame:
    """One row per host with the keys (``marks``) and classes of all candidates."""
    spread = F.flatten(F.transform("found", lambda c: F.array_repeat(c["class"], F.size(c["keys"]))))
    found = F.sort_array(F.collect_list(F.struct("class", "keys"))).alias("found")
    rows = candidate.groupBy("host").agg(found, F.max("opens").cast("int").alias("host_rank"))
    empty = F.array().cast("array<long>")
    return rows.select(
        "host",
        F.flatten(F.col("found.keys")).alias("marks"),
        spread.alias("classes"),
        empty.alias("fixed"),
        empty.alias("slots"),
        "host_rank",
    )


def attach(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with their host's template, if it has one.

    Templates are no longer than two pages each. If all are small they go to every task; else
    pages meet them by host, and the join splits a host that has many.
    """
    size = templates.agg(F.sum(2 * F.size("marks") + F.size("fixed") + F.size("slots"))).first()[0] or 0
    return pages.join(F.broadcast(templates) if size <= BROADCAST_NUMBERS else templates, "host", "left")


class Templates:
    """Templates of the hosts met last, ready for use."""

    def __init__(self) -> None:
        self.ready: OrderedDict[str, tuple] = OrderedDict()

    def of(self, page: dict) -> tuple[dict[int, int], set[int], set[int], int]:
        found = self.ready.get(page["host"])
        if found is None:
            marks = dict(zip(page["marks"] or [], page["classes"] or []))
            found = marks, set(page["fixed"] or []), set(page["slots"] or []), page["host_rank"] or 0
            self.ready[page["host"]] = found
            if len(self.ready) > HELD_HOSTS:
                self.ready.popitem(last=False)
        return found


def check_classes(sequence: list[tuple[int, int]], sizes: Counter) -> dict[int, tuple[bool, int, int]]:
    """For each class in a page's sequence of (class, key): is it well nested, its order, its place."""
    open_classes, done, order, place, bad = [], Counter(), defaultdict(list), {}, set()
    for name, key in sequence:
        size, i = sizes[name], done[name] % sizes[name]
        if i == 0:
            outer = open_classes[-1] if open_classes else 0
            here = _number(outer, done[outer] % sizes[outer] if outer else 0)
            if place.setdefault(name, here) != here:
                bad.add(name)
            open_classes.append(name)
        elif name in open_classes:
            while open_classes[-1] != name:
                bad.add(open_classes.pop())
        else:
            bad.add(name)
        if done[name] < size:
            order[name].append(key)
        elif order[name][i] != key:
            bad.add(name)
        done[name] += 1
        if i == size - 1 and open_classes and open_classes[-1] == name:
            open_classes.pop()
    bad |= {name for name, n in done.items() if n % sizes[name]}
    return {name: (name not in bad, _number(*keys), place[name]) for name, keys in order.items()}


def _add_checks(old: tuple, new: tuple) -> tuple:
    low, high = (min(a, b) for a, b in zip(old[:3], new[:3])), (max(a, b) for a, b in zip(old[3:5], new[3:5]))
    return (*low, *high, *[a + b for a, b in zip(old[5:], new[5:])])


def _checks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and class the checks of all pages, and per host and slot its characters.

    Characters: all, those in the article, and those in links.
    """
    names = "host class slot sound order place order_most place_most chars inside links".split()
    sums = Sums(names, [pa.string(), *[pa.int64()] * 10], _add_checks)
    templates = Templates()
    for page in _pages(batches):
        if page["marks"] is None:
            continue
        marks, _, _, rank = templates.of(page)
        sizes, sequence, slot = Counter(marks.values()), [], 0
        for token in tokens(page["html"]):
            name = marks.get(token.key)
            if name is not None:
                sequence.append((name, token.key))
                slot = token.key
            elif not token.name:
                n = len(token.text)
                inside = n if not token.aside and token.rank >= rank else 0
                sums.put((page["host"], 0, slot), (0, 0, 0, 0, 0, n, inside, n if token.link else 0))
        for name, (sound, order, place) in check_classes(sequence, sizes).items():
            order, place = order >> 1, place >> 1
            sums.put((page["host"], name, 0), (int(sound), order, place, order, place, 0, 0, 0))
        if sums.full():
            yield sums.take()
    yield sums.take()


def templates(pages: DataFrame) -> DataFrame:
    """Template of every host that has one: marks of its slots, fixed tokens, main slots, rank.

    ``pages`` have host, mark (a hash of the row) and html.
    """
    candidate = candidates(pages)
    whole = stage(_whole(candidate), "candidates")
    kinds = "host string, class long, slot long, sound long, order long, place long, order_most long, place_most long"
    sent = attach(pages, whole).mapInArrow(_checks, f"{kinds}, chars long, inside long, links long")
    checks = sent.groupBy("host", "class", "slot").agg(
        *[F.min(c).alias(c) for c in ("sound", "order", "place")],
        *[F.max(c).alias(c) for c in ("order_most", "place_most")],
        *[F.sum(c).alias(c) for c in ("chars", "inside", "links")],
    )
    checks = stage(checks, "checks")
    valid = checks.where("class <> 0 AND sound = 1 AND order = order_most AND place = place_most")
    keys = candidate.join(valid.select("host", "class"), ["host", "class"]).groupBy("host")
    fixed = keys.agg(F.flatten(F.collect_list("keys")).alias("_fixed"))
    main = checks.where("class = 0").join(whole.select("host", "host_rank"), "host")
    main = main.where("2 * inside > chars AND (host_rank > 0 OR 2 * links < chars)")
    slots = main.groupBy("host").agg(F.collect_list("slot").alias("_slots"))
    joined = whole.join(fixed, "host", "left").join(slots, "host", "left")
    empty = F.array().cast("array<long>")
    made = {"fixed": F.coalesce("_fixed", empty), "slots": F.coalesce("_slots", empty)}
    return stage(joined.withColumns(made).drop("_fixed", "_slots"), "templates")


def main_text(found: list[Token], template: tuple[dict[int, int], set[int], set[int], int]) -> str:
    """Text of the main slots of one page."""
    marks, fixed, slots, host_rank = template
    own = max((t.opens for t in found), default=0)
    need = min(own, host_rank) if host_rank else own
    pieces, slot = [], 0
    for token in found:
        slot = token.key if token.key in marks else slot
        if token.name:
            pieces.append(" " if token.name in BLOCK else "")
        elif token.aside:
            pieces.append(" " if token.text.isspace() else "")
        elif need:
            pieces.append(token.text if token.rank >= need else " ")
        elif not marks:
            pieces.append(token.text)
        elif host_rank:
            pieces.append(token.text if slot in slots else " ")
        else:
            pieces.append(token.text if token.key not in fixed and slot in slots else " ")
    return " ".join("".join(pieces).split())


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready = Templates()
    for batch in batches:
        for part in slices([batch], "html", PAGE_BYTES):
            texts = [main_text(list(tokens(page["html"])), ready.of(page)) for page in part.to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Every page's page_id, url and main text."""
    read = pages.select(
        "page_id",
        "url",
        host(F.col("url")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("mark"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    made = templates(read.select("host", "mark", "html"))
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string"
    return attach(read, made).mapInArrow(_extracted, schema)
