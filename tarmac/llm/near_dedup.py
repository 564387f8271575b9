"""SimHash near-duplicate groups by multi-index hashing.

Fingerprint: words of the ASCII-lower-cased text, shingles of ``width`` words (a shorter text is one shingle, no
words give fingerprint 0), XXH64 of each shingle; a bit is 1 if it is set in more than half of the hashes.

Search: a fingerprint is cut into ``segments`` equal parts. Two fingerprints at distance <= radius differ by at
most ``radius // segments`` bits in one part at least, so each table value enumerates that small Hamming ball in
its part, fetches the table rows found there, and verifies the complete distance. Table rows hold all
fingerprints that share a part (cut into chunks of at most ``CHUNK``), so a group of near copies is compared as
blocks of numpy words; each block reports a spanning forest of its links, never all pairs. Components are found
by rounds of contraction, in which every node hooks to its least neighbour and edges are renamed.

Cases: null text counts as empty; a null doc_id keeps its row and never names a component; equal texts share a
fingerprint and so a component; an empty table gives an empty result; other input columns are ignored.
Dropping near copies goes by row, not by doc_id: every group keeps exactly one row, so a group whose doc_ids are all
null keeps one, and texts of different groups stay although they share a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_arrays, extended, row_hash, stored, utf8

BITS = 64
CHUNK = 4096  # fingerprints in one compared block side


def fingerprint_of(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(norm, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(norm[a:b], 42) for a, b in
                          zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo:lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 3, *others) -> DataFrame:
    """(doc_id, the ``others`` (named expressions), fp long) of every row; the long holds the 64 bits."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_of(t, width) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield add_arrays(b.select(b.schema.names[:-1]), fp=pa.array(fps.view(np.int64)))

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *others)
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *others, utf8().alias("__text"))
    return src.mapInArrow(run, extended(kept.schema, fp=T.LongType()))


def fp_hex(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int):
    """Index pairs (i, j) of a spanning forest of the links |a_i ^ b_j| <= radius."""
    near = np.empty((len(a), len(b)), bool)
    for lo in range(0, len(a), 512):
        near[lo:lo + 512] = np.bitwise_count(a[lo:lo + 512, None] ^ b[None, :]) <= radius
    out, todo_a, todo_b = [], near.any(axis=1), near.any(axis=0)
    while todo_a.any():
        frontier = np.array([int(np.argmax(todo_a))])
        todo_a[frontier] = False
        while len(frontier):
            grown = []
            for i in frontier.tolist():
                js = np.flatnonzero(near[i] & todo_b)
                if len(js):
                    todo_b[js] = False
                    out.append(np.stack([np.full(len(js), i), js]))
                    grown.append(js)
            if not grown:
                break
            nxt = []
            for j in np.concatenate(grown).tolist():
                rows = np.flatnonzero(near[:, j] & todo_a)
                if len(rows):
                    todo_a[rows] = False
                    out.append(np.stack([rows, np.full(len(rows), j)]))
                    nxt.append(rows)
            frontier = np.concatenate(nxt) if nxt else np.array([], int)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), int)


def _ball(bits: int, radius: int) -> list[int]:
    """Masks with at most ``radius`` ones among ``bits`` bits."""
    masks = [0]
    layer = [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << i, i) for m, last in layer for i in range(last + 1, bits)]
        masks += [m for m, _ in layer]
    return masks


def links(fps: DataFrame, radius: int = 3, segments: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(u, v): a spanning set of the links between distinct fingerprints (column ``fp``) at distance <= radius."""
    width = BITS // segments
    part_mask = (1 << width) - 1
    ball = _ball(width, radius // segments)
    seg = F.explode(F.array([F.struct(F.lit(s).alias("s"),
                                      F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit(part_mask)).alias("v"))
                             for s in range(segments)])).alias("k")
    parts = fps.select("fp", seg).select("fp", "k.s", "k.v")
    full = parts.groupBy("s", "v").count().filter(F.col("count") > chunk)
    pieces = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1))
    cells = (parts.join(full, ["s", "v"], "left")
             .withColumn("cell", F.pmod(F.xxhash64("fp"), pieces))
             .groupBy("s", "v", "cell").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    cells = stored(cells, "mih-cells")
    # Each unordered pair of table values is met once: from the value with the smaller number.
    probes = (cells.select("s", F.col("v").alias("from_v"), F.col("cell").alias("from_cell"),
                           F.col("fps").alias("a"),
                           F.explode(F.array([F.col("v").bitwiseXOR(F.lit(m)) for m in ball])).alias("v"))
              .filter("v >= from_v"))
    met = (probes.join(cells, ["s", "v"])
           .filter("v > from_v OR cell > from_cell OR (cell = from_cell AND size(a) > 1)")
           .select("a", F.col("fps").alias("b")))

    def verify(batches):
        for batch in batches:
            us, vs = [], []
            a_all, b_all = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                a = a_all[r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = b_all[r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(a) == 1 and len(b) == 1:
                    if (int(a[0]) ^ int(b[0])).bit_count() <= radius:
                        us.append(a)
                        vs.append(b)
                    continue
                ij = _forest(a, b, radius)
                us.append(a[ij[0]])
                vs.append(b[ij[1]])
            u = np.concatenate(us) if us else np.array([], np.uint64)
            v = np.concatenate(vs) if vs else np.array([], np.uint64)
            keep = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))],
                                             names=["u", "v"])

    return met.mapInArrow(verify, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is one node per connected component.

    Each round every node hooks to the least of itself and its neighbours; the edges are renamed to the hooks and
    loops go. A node that is no local minimum disappears, so the rounds are logarithmic in practice; each round
    is stored.
    """
    both = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    both = stored(both, "cc-edges")
    roots = None
    while not both.isEmpty():
        sides = both.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")),
                                              F.struct(F.col("v").alias("node"), F.col("u").alias("to")))).alias("x"))
        hook = stored(sides.select("x.*").groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("root")),
                      "cc-hook")
        if roots is None:
            roots = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(step, "root", "left")
                           .select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        left, right = (hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
        both = stored(both.join(left, "u").join(right, "v")
                      .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
                      .filter("u < v").distinct(), "cc-edges")
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return roots


def _rooted(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """``nodes`` (distinct fp) with the root of each one's group."""
    roots = components(links(nodes.select("fp"), radius, segments))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root",
                                                                                      F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents linked at ``radius`` bits or fewer.

    component_id is the least doc_id of the group.
    """
    docs = stored(fingerprints(documents, width), "simhash")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    rooted = _rooted(nodes, radius, segments)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return docs.join(names, "fp").select("doc_id", fp_hex().alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """The documents without near copies: of each group the row with the least doc_id stays (nulls last, then by the
    row's hash; one of repeated rows)."""
    key = row_hash(documents)
    rows = fingerprints(documents, width, key.alias("key"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = stored(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-nodes")
    keep = (_rooted(nodes, radius, segments).groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.key.a").alias("__a"), F.col("first.key.b").alias("__b")))
    keyed = documents.withColumns({"__a": key["a"], "__b": key["b"]})
    repeats = Window.partitionBy("__a", "__b").orderBy("__a")
    return (keyed.join(keep, ["__a", "__b"], "left_semi").withColumn("__rn", F.row_number().over(repeats))
            .filter("__rn = 1").select(*[F.col(f"`{c}`") for c in documents.columns]))
