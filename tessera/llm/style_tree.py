"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements
with their classes. For every node the pages' presentations (which children it has)
and contents (the text of its blocks) are counted. A node's presentation importance
is the entropy of its presentations over the pages, to the base of their number; its
content importance is one less the entropy of its blocks over the pages that have
them: a text on every page counts nothing. Both are put together with those of the
nodes below, what lies in an article or main element adds to a node's importance, and
branches of low importance are removed from each page, along with what the markup itself
declares not to be content (menus, headers, footers, asides, notices, adverts, forms,
comments; also articles in an element with such a class, unless the page has no other text).

The counts are one row for each host, node and feature of a batch, summed by Spark, so
a host with a third of all pages is pre-aggregated like any other. A node is judged by the
pages that have it, however few of its host's these are; its importance is smoothed
towards 1 by that of ``SMOOTH`` pages, so a text must be on some pages before it counts as
repeated. Low nodes are broadcast as one array of hashes of host and node in groups of hosts
of about ``MAX_NODES``: usually one group, else the pages are read once for each group (a
host's nodes are in one group, 8 bytes each).

Edge cases: a null or empty page has the empty text; a null url is the host ``""``; a
node of one page has no entropy to go by, so only declared roles count; if removal
would leave nothing of a page, or of an article that is not itself of low importance, they stay;
repeated pages are each extracted; an empty table gives no rows; texts are neither cut nor dropped by size.
Added columns are ``text, n_chars``; input columns of those names are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.dom import WRAPPED, Block, read_page
from tessera.llm.host_reputation import host_of
from tessera.llm.shield import inner, restored, shielded
from tessera.llm.store import stored

MIN_PAGES = 2
#: Pages of full importance that every node has besides its own.
SMOOTH = 2
LEAST = 0.3
#: What a node's importance gains if all of its text lies in an article.
EVIDENCE = 0.15
DAMPING = 0.9
MAX_NODES = 1 << 18
LINKS = 0.6

_STATS = "host string, node bigint, kind int, feature bigint, n bigint, chars bigint, links bigint, mains bigint"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presentations (kind 0) and contents (kind 1) of every node, once for each page, summed over a batch.

    Kind 2 is a node below another: ``feature`` is the one above.
    """
    for batch in batches:
        hosts, htmls = _column(batch, "host").to_pylist(), _column(batch, "html")
        for a in range(0, len(hosts), 256):
            n: Counter = Counter()
            chars: Counter = Counter()
            links: Counter = Counter()
            mains: Counter = Counter()
            for host, html in zip(hosts[a : a + 256], htmls.slice(a, 256).to_pylist()):
                page = read_page(html or "")
                for node, below in page.children.items():
                    n[host, node, 0, _signed(xxhash.xxh64_intdigest(repr(below)))] += 1
                seen = set()
                for b in page.blocks:
                    key = (host, b.path, 1, _signed(xxhash.xxh64_intdigest(b.text)))
                    seen.add(key)
                    chars[key] += len(b.text)
                    links[key] += min(b.link_chars, len(b.text))
                    mains[key] += len(b.text) if b.main else 0
                    seen.update((host, b.path, 2, above) for above in b.chain)
                n.update(seen)
            keys = list(n)
            cols = list(zip(*keys)) or [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({
                "host": pa.array(cols[0], pa.string()), "node": pa.array(cols[1], pa.int64()),
                "kind": pa.array(cols[2], pa.int32()), "feature": pa.array(cols[3], pa.int64()),
                "n": pa.array([n[k] for k in keys], pa.int64()),
                "chars": pa.array([chars[k] for k in keys], pa.int64()),
                "links": pa.array([links[k] for k in keys], pa.int64()),
                "mains": pa.array([mains[k] for k in keys], pa.int64())})


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES, smooth: float = SMOOTH) -> DataFrame:
    """``host, node, pages, presentation, content, importance, link_share`` of every node with text below.

    ``pages`` has ``host, html``. Nodes on fewer than ``min_pages`` pages are left out.
    """
    counted = pages.mapInArrow(_count, _STATS).groupBy("host", "node", "kind", "feature").agg(
        *[F.sum(x).alias(x) for x in ("n", "chars", "links", "mains")])
    counted = stored(counted, "style-counts")
    # c pages of m share a presentation: -sum(c/m log_m(c/m)) = 1 - sum(c ln c) / (m ln m).
    c, log_c = F.col("n"), F.col("n") * F.log("n")
    shown = counted.filter("kind = 0").groupBy("host", "node").agg(
        F.sum(c).alias("pages"), F.sum(log_c).alias("repeated"))
    said = counted.filter("kind = 1").groupBy("host", "node").agg(
        F.sum(c).alias("blocks"), F.sum(log_c).alias("same"),
        *[F.sum(x).alias(x) for x in ("chars", "links", "mains")])
    # What is said in a node counts for the nodes above it as well.
    below = counted.filter("kind = 2").select("host", "node", F.col("feature").alias("above"))
    tree = said.join(below, ["host", "node"]).groupBy("host", F.col("above").alias("node")).agg(
        *[F.sum(x).alias(x) for x in ("blocks", "same", "chars", "links", "mains")])
    m = F.log("pages")
    found = tree.join(shown, ["host", "node"]).filter(F.col("pages") >= max(2, min_pages))
    found = found.withColumns({
        "presentation": F.lit(1.0) - F.col("repeated") / (F.col("pages") * m),
        "content": F.greatest(F.lit(0.0), F.lit(1.0) - F.col("same") / (F.col("blocks") * m)),
        "link_share": F.col("links") / F.greatest(F.col("chars"), F.lit(1)),
    })
    importance = (1 - DAMPING) * F.col("presentation") + DAMPING * F.col("content")
    importance = (F.col("pages") * importance + smooth) / (F.col("pages") + smooth)
    importance = importance + EVIDENCE * F.col("mains") / F.greatest(F.col("chars"), F.lit(1))
    return found.select("host", "node", "pages", "presentation", "content", importance.alias("importance"), "link_share")


def low_nodes(tree: DataFrame, least: float = LEAST, links: float = LINKS) -> DataFrame:
    """``host, node`` of the branches to remove: of low importance, or mostly links of little importance."""
    return tree.filter((F.col("importance") < least)
                       | ((F.col("link_share") > links) & (F.col("importance") < 2 * least))).select("host", "node")


def main_text(blocks: list[Block], low) -> str:
    """The page's blocks that stay, with an empty line between them; ``low(node)`` tells which branches go."""
    stay = [b for b in blocks if not b.noise] or [b for b in blocks if b.noise == WRAPPED]
    important = [b for b in stay if not any(map(low, b.chain))]
    # An article that is not low itself has content: if all of its parts are low, it stays whole.
    article = lambda b: b.chain[: b.main]
    left = {article(b) for b in important}
    whole = {a for a in map(article, stay) if a and a not in left and not any(map(low, a))}
    if whole:
        kept = set(map(id, important))
        important = [b for b in stay if id(b) in kept or article(b) in whole]
    important = important or stay  # all of a page is never noise
    return "\n\n".join(b.text for b in important)


def _node_key(host: str, node: int) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{node} {host}"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(_column(batch, "host").to_pylist(), _column(batch, "node").to_pylist())
        yield pa.RecordBatch.from_pydict({"key": pa.array([_node_key(h, n) for h, n in pairs], pa.int64())})


def _extract(low, carried: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed = low.value
        for batch in batches:
            hosts, htmls = _column(batch, "_host").to_pylist(), _column(batch, "_html")
            for a in range(0, len(hosts), 256):
                texts = []
                for host, html in zip(hosts[a : a + 256], htmls.slice(a, 256).to_pylist()):
                    known: dict[int, bool] = {}

                    def gone(node: int) -> bool:
                        if node not in known:
                            key = _node_key(host, node)
                            i = int(np.searchsorted(removed, key))
                            known[node] = i < len(removed) and int(removed[i]) == key
                        return known[node]

                    texts.append(main_text(read_page(html or "").blocks, gone))
                rows = batch.slice(a, 256)
                out = {c: _column(rows, c) for c in carried}
                out["text"] = pa.array(texts, pa.string())
                out["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_pydict(out)
    return scan


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None,
                 min_pages: int = MIN_PAGES, smooth: float = SMOOTH, least: float = LEAST) -> DataFrame:
    """The columns ``carry`` of ``pages`` (default: all but the html) with ``text`` and ``n_chars``."""
    spark = pages.sparkSession
    wanted = [c for c in pages.columns if c != html] if carry is None else carry
    carried = [c for c in wanted if c not in ("text", "n_chars")]
    rows = pages.select(*shielded(carried), F.coalesce(host_of(F.col(url)), F.lit("")).alias("_host"),
                        F.col(html).alias("_html"))
    tree = style_tree(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html")), min_pages, smooth)
    low = stored(low_nodes(tree, least), "low-nodes")
    groups = max(1, -(-low.count() // MAX_NODES))
    inside = [inner(i) for i in range(len(carried))]
    schema = StructType([rows.schema[c] for c in inside]
                        + [StructField("text", StringType()), StructField("n_chars", LongType())])
    out = None
    for g in range(groups):
        mine = rows if groups == 1 else rows.filter(F.pmod(F.xxhash64("_host"), F.lit(groups)) == g)
        nodes = low if groups == 1 else low.filter(F.pmod(F.xxhash64("host"), F.lit(groups)) == g)
        keys = np.sort(nodes.mapInArrow(_keys, "key bigint").toArrow().column("key").to_numpy())
        part = mine.mapInArrow(_extract(spark.sparkContext.broadcast(keys), inside), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(*restored(carried), "text", "n_chars")
