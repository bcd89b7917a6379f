"""Operator 5: main text of web pages by consensus host paths.

Every page scores its containers and names the generalised tag-class path of its
main one. Spark counts the votes of a host's pages, and every page is extracted
again from the containers on its host's winning path, or from its own main one
where they are only a part of it; a main container apart from the winning path is
overruled. That is the article's core: titles, leads and
sections around it belong to the text too, but for page furniture, which is links
and blocks that stand around the cores of most of a host's pages.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm import pagetree
from salesmatch.llm.common import text_or_empty, written

#: A page's main container is the deepest with this share of its text.
SHARE = 0.7
#: A block around the core is furniture if it stands beside so many different cores of a host, and more than half of them.
REPEATED = 2
#: Least text of a page's winning containers that overrules a main container apart from them.
OVERRULE = 200
#: Most hosts (below 100 bytes each) and furniture blocks that are broadcast; more are joined.
BROADCAST_HOSTS = 200_000


def host(url):
    """Host of a url column, lower-cased, without ``www.`` and port; empty if there is none."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(name, r"^www\.", "")


def _parsed(html: str):
    root, items = pagetree.parse(html)
    pagetree.measure(root, items)
    return root, items, pagetree.main_container(root, SHARE)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def vote(html: str) -> tuple[str, int, int, list[int]]:
    """Path and text size of the page's main container, hash of its text, and hashes of the blocks around it."""
    root, items, own = _parsed(html)
    inside = pagetree.under(root, {own})
    core, outside = [], set()
    for node, text, _ in pagetree.unmarked(items):
        core.append(text) if node in inside else outside.add(_hash(text))
    return pagetree.path(own), own.size, _hash(" ".join(core)), sorted(outside)


def extract(html: str, winner: str | None = None, furniture=()) -> str:
    """Text of the page's article; ``winner`` is its host's path, ``furniture`` has the hashes of its host's repeated blocks.

    The winning containers are the core unless they are only a part of the page's own main container. If they
    lie apart from it, they overrule it: it is then a long menu, list or discussion beside the article, and goes.
    """
    root, items, own = _parsed(html)
    found = pagetree.unmarked(items)
    nodes, overruled = {own}, set()
    if winner is not None:
        place = pagetree.place_of(winner)
        winning = {n for n in pagetree.all_nodes(root) if n.place == place and n.tag in pagetree.HOLD and not n.away}
        held, mine = pagetree.under(root, winning), pagetree.under(root, nodes)
        if winning and all(node in held for node, _, _ in found if node in mine):
            nodes = winning
        elif sum(n.size for n in winning) >= OVERRULE and not held & mine:
            nodes, overruled = winning, mine
    known = frozenset(furniture or ())
    found = [f for f in found if f[0] not in overruled]
    return " ".join(pagetree.around(root, nodes, found, lambda text: bool(known) and _hash(text) in known))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, and path, size, core and around (``vote``) of each page; pages without text do not vote."""

    def run(batches):
        for b in batches:
            got = list(zip(*(vote(h) for h in b.column(1).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(got, (
                pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))))], ["host", "path", "size", "core", "around"])

    rows = pages.select(host(F.col(url)).alias("host"), text_or_empty(html).alias("html"))
    return rows.mapInArrow(run, "host string, path string, size long, core long, around array<long>").where("size > 0")


def winners(ballots: DataFrame) -> DataFrame:
    """host and the path with most pages (then most text, then first by name)."""
    counted = ballots.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("size"), "path")).alias("winner"))


def furniture(ballots: DataFrame) -> DataFrame:
    """host and the hashes of its furniture: at most twice as many as a page has blocks around its core.

    Copies of a page have the same core and count once, so their leads are none.
    """
    cores = ballots.select("host", "core").distinct().groupBy("host").agg(F.count("*").alias("cores"))
    pairs = ballots.select("host", "core", F.explode("around").alias("block")).distinct()
    often = pairs.groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    return often.join(cores, "host").where(2 * F.col("n") > F.col("cores")).groupBy("host").agg(
        F.collect_list("block").alias("furniture"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text; a null or odd url belongs to the
    nameless host. Repeated rows give one row each; extra columns are ignored.
    """
    ballots = written(votes(pages, url, html), "votes")
    best = written(winners(ballots).join(furniture(ballots), "host", "left"), "winners")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"),
                        text_or_empty(html).alias("html"))
    # The check of the size; hosts are joined with the pages' own shuffle beyond it.
    n = best.agg(F.count("*") + F.coalesce(F.sum(F.size(F.coalesce("furniture", F.array()))), F.lit(0))).first()[0]
    small = n <= broadcast_hosts
    rows = rows.join(F.broadcast(best) if small else best, "host", "left")

    def run(batches):
        for b in batches:
            text = [extract(*row) for row in zip(*(b.column(c).to_pylist() for c in ("html", "winner", "furniture")))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "winner", "furniture").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
