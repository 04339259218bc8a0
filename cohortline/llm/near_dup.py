"""Near duplicates by chosen paths: a similarity join of shingle sets, and its connected groups.

A document's set holds its distinct five-word shingles (fewer words: the whole
sequence as one; none: empty, linked with nothing). Documents whose sets have a
similarity of 0.75 or more are linked, each link confirmed on the full sets.

Equal sets are one vertex. Several independent trees branch the vertices: a
vertex starts at one minwise token of its set, so two vertices meet with the
probability of their similarity. In a node, vertices are candidates for a link
when half or more of 64 minwise tokens agree (four and a half standard deviations
below the limit). A node gives only the candidates that join what it has not yet
joined, a forest, so its pairs are fewer than its vertices. All forests together
part the vertices into candidate groups, and no link leaves a group.

A node beyond ``NODE_PART`` vertices is first joined in parts. Then, if few of its
vertices are in another group than most, these meet the whole node; else the node
branches, each vertex follows two minwise tokens, and nodes of one group end. A
pair of similarity s that starts in one node stays together with probability
1 - q, q = (1 - s + s * q)^2 at any depth: at 0.75 one tree finds it with
0.75 * 0.889 = 0.667 at least (0.75 if nothing branches), and all eight miss it with
0.00015 at most, if draws were independent; the trees share 64 tokens, each in an
order of its own.

The texts of a candidate group then meet: full sets of all its candidates are
compared, the most alike first, but for those that links have joined already. A
group beyond ``NODE_PART`` vertices or ``PART_SHINGLES`` shingles is linked in parts,
and then what is outside its largest linked part, in blocks of that size, meets all
of it. So a group of thousands of near copies costs a few comparisons per copy, and
no vertex is left out for being in a large node or group. Components are found by
the star algorithm, a fixed few joins per round. Each round is written to the shared
folder.

Defined cases: null text is empty; ``component_id`` is the smallest id of the
group, nulls aside; repeated rows with one id are in one group if their sets are
equal. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.text import SHINGLE, id_and_text, mix, pieces, shingle_sets
from cohortline.session import materialize

TREES, LEVELS = 8, 8
TOKENS = TREES * LEVELS
CHILDREN = 2
MAX_DEPTH = (TOKENS - 1) // CHILDREN
NODE_PART = 4096
PART_SHINGLES = 1 << 20
LEAST_ESTIMATE = 0.5
_odd = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (TOKENS, 2), dtype=np.uint64)
_FACTORS, _SHIFTS = _odd[:, 0] * np.uint64(2) + np.uint64(1), _odd[:, 1]
# a tree starts at a token of its own; then it takes the others, each once, in an order of its own
_ORDERS = [[t * LEVELS, *np.random.Generator(np.random.PCG64(t)).permutation(
    [k for k in range(TOKENS) if k != t * LEVELS]).tolist()] for t in range(TREES)]


def minwise(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens of each set, 32 bits each; all sets must have members."""
    out = np.empty((len(at) - 1, TOKENS), np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat((values * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32), at[:-1])
    return out


def set_digests(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever its order."""
    one, two = mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.stack([np.add.reduceat(x, at[:-1]) for x in (one, two)], axis=1)
    return [row.tobytes() for row in sums]


def described(rows: DataFrame, size: int, tokens: bool) -> DataFrame:
    """Each document with its set's size and digest ``v``, and its minwise tokens or its text."""
    schema = pa.schema([("doc_id", pa.int64()), *([("rid", pa.int64())] if "rid" in rows.columns else []),
                        ("n_shingles", pa.int64()), ("v", pa.binary()),
                        ("tokens", pa.list_(pa.int32())) if tokens else ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values, at = shingle_sets(part.column("text"), size)
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                digests = np.full(len(counts), None, object)
                bounds = np.concatenate([[0], np.cumsum(counts[full])])
                if len(full):
                    digests[full] = set_digests(values, bounds)
                if tokens:
                    ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, TOKENS, 0))]).astype(np.int32)
                    flat = minwise(values, bounds).view(np.int32).ravel() if len(full) else np.zeros(0, np.int32)
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                else:
                    last = part.column("text")
                own = [part.column(c) for c in schema.names if c in ("doc_id", "rid")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(digests.tolist(), pa.binary()),
                                                  last], schema=schema)

    ids = "doc_id long, " + ("rid long, " if "rid" in rows.columns else "")
    return rows.mapInArrow(run, ids + "n_shingles long, v binary, " + ("tokens array<int>" if tokens else "text string"))


class Held:
    """Rows of a part that later ones meet, and which labels the part has joined."""

    def __init__(self):
        self.names: list[bytes] = []
        self.sets: list[np.ndarray | None] = []
        self.places: dict[bytes, int] = {}
        self.parent: list[int] = []
        self.tokens, self.roots = np.empty((4, TOKENS), np.int32), np.empty(4, np.int64)

    def root(self, label: bytes) -> int:
        at = self.places.setdefault(label, len(self.parent))
        if at == len(self.parent):
            self.parent.append(at)
        while self.parent[at] != at:
            self.parent[at] = at = self.parent[self.parent[at]]
        return at

    def hold(self, v: bytes, label: bytes, tokens: np.ndarray, own: np.ndarray | None) -> None:
        n = len(self.names)
        if n == len(self.roots):
            self.tokens, self.roots = np.resize(self.tokens, (2 * n, TOKENS)), np.resize(self.roots, 2 * n)
        self.tokens[n], self.roots[n] = tokens, self.root(label)
        self.names.append(v)
        self.sets.append(own)

    def joins(self, label: bytes, tokens: np.ndarray, own: np.ndarray | None, percent: int) -> Iterator[bytes]:
        """Held rows near this one whose labels were not yet joined to its own, the most alike first."""
        n, root = len(self.names), self.root(label)
        if not n:
            return
        agree = (self.tokens[:n] == tokens).sum(axis=1)
        near = np.flatnonzero((agree >= LEAST_ESTIMATE * TOKENS) & (self.roots[:n] != root))
        near = near[np.argsort(-agree[near], kind="stable")]
        while len(near):
            best, near = near[0], near[1:]
            if own is None or linked(self.sets[best], own, percent):
                yield self.names[best]
                other = self.roots[best]
                self.parent[other] = root
                self.roots[:n][self.roots[:n] == other] = root
                near = near[self.roots[near] != root]


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    together = np.sort(np.concatenate([one, two]))
    shared = int((together[1:] == together[:-1]).sum())
    return 100 * shared >= percent * (len(together) - shared)


def joined(dealt: DataFrame, size: int | None = None, percent: int = 0) -> DataFrame:
    """Pairs ``a, b`` that join the labels of a part, fewer than its labels.

    Takes ``part, leads, v, label, tokens``, and ``text`` if sets of ``size`` words are
    compared too. Rows that lead come first and are held; each row meets those held before it.
    """
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("leads"), "v")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Held()
        for batch in batches:
            for rows in pieces(batch) if size else [batch]:
                if size:
                    values, at = shingle_sets(rows.column("text"), size)
                tokens = np.asarray(rows.column("tokens").flatten()).reshape(-1, TOKENS)
                found = []
                for k, (part, leads, v, label) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("part", "leads", "v", "label")))):
                    if key != part:
                        key, held = part, Held()
                    own = values[at[k]:at[k + 1]].copy() if size else None
                    found += [(min(v, other), max(v, other)) for other in held.joins(label, tokens[k], own, percent)]
                    if leads:
                        held.hold(v, label, tokens[k], own)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return dealt.mapInArrow(run, "a binary, b binary")


def in_parts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each row in one of the ``parts`` of its node or group, where all meet all."""
    part = F.xxhash64(*key, F.pmod(F.xxhash64("v"), F.col("parts")))
    return rows.select(part.alias("part"), F.lit(True).alias("leads"), "v", "label", *_carried(rows))


def labelled(rows: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
    """Rows whose ``label`` is their component among the pairs, with the ``main`` one of their node or group, and open rows.

    ``n_open`` rows have another label; they take ``blocks`` of bounded size. Takes ``cost``, in shingles.
    """
    low = components(pairs).withColumnRenamed("low", "label")
    rows = rows.drop("label").join(low, "v", "left").withColumn("label", F.coalesce("label", "v"))
    labels = rows.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("cost").alias("s"))
    top = F.max(F.struct("c", "label", "s"))
    open_rows, open_cost = F.sum("c") - top.getField("c"), F.sum("s") - top.getField("s")
    mains = labels.groupBy(key).agg(top.getField("label").alias("main"), open_rows.alias("n_open"),
                                    _parts(open_rows, open_cost).alias("blocks"))
    return rows.join(mains.filter("n_open > 0"), key)


def open_with_all(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows outside the main label, in ``blocks``, lead in every part of their node or group; all rows pass by each block."""
    own, block = F.pmod(F.xxhash64("v"), F.col("parts")), F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks"))
    carried = _carried(rows)
    leaders = rows.filter("label != main").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"),
                                                  block.alias("k"), F.lit(True).alias("leads"), "v", "label", *carried)
    others = rows.select(*key, own.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"),
                         F.lit(False).alias("leads"), "v", "label", *carried)
    return leaders.unionByName(others).select(F.xxhash64(*key, "p", "k").alias("part"), "leads", "v", "label", *carried)


def _carried(rows: DataFrame) -> list[str]:
    return [c for c in ("tokens", "text") if c in rows.columns]


def _parts(n, cost):
    """How many parts of bounded size so many rows of so many shingles take."""
    return F.greatest(F.lit(1), F.ceil(n / NODE_PART), F.ceil(cost / PART_SHINGLES)).cast("long")


def candidates(vertices: DataFrame) -> DataFrame | None:
    """Pairs ``a, b`` whose tokens agree often enough, as many as it takes to join all that such pairs join; None if no vertices meet."""
    key = ["tree", "node"]
    rows = vertices.select("v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                                                         lambda t: F.get("tokens", t * LEVELS))).alias("tree", "token"))
    rows = rows.select("v", "tree", F.xxhash64("tree", "token").alias("node"), F.col("v").alias("label"))
    found = None
    while True:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *([] if found is None else [(F.min("label") < F.max("label")).alias("differ")]))
        sizes = sizes.filter("n > 1" if found is None else "n > 1 AND differ").select(*key, "n")
        rows = rows.join(sizes, key)
        if found is None:
            rows = rows.join(vertices.select("v", "tokens"), "v").withColumn("depth", F.lit(0))
        rows = rows.select("v", *key, "depth", "label", _parts(F.col("n"), F.lit(0)).alias("parts"), F.lit(0).cast("long").alias("cost"), "tokens")
        rows = materialize(rows, "nodes")
        if rows.isEmpty():
            break
        pairs = materialize(joined(in_parts(rows, key)), "pairs")
        found = pairs if found is None else found.union(pairs)
        large = rows.filter("parts > 1")
        if large.isEmpty():
            break
        large = materialize(labelled(large, key, found), "large")
        # without tokens left, all open vertices meet the node, however many
        done = (F.col("n_open") <= NODE_PART) | (F.col("depth") >= MAX_DEPTH)
        found = found.union(materialize(joined(open_with_all(large.filter(done), key)), "pairs"))
        orders = F.array(*[F.array(*map(F.lit, order)) for order in _ORDERS])
        follows = F.transform(F.sequence(F.lit(1 - CHILDREN), F.lit(0)), lambda c: F.struct(
            c.alias("c"), F.get("tokens", F.get(F.get(orders, F.col("tree")), CHILDREN * F.col("depth") + c)).alias("token")))
        # both tokens of a vertex lead to nodes of their own
        nodes = F.transform(follows, lambda x: F.xxhash64("node", "depth", x["c"], x["token"]))
        rows = large.filter(~done).withColumn("depth", F.col("depth") + 1).select(
            "v", "tree", F.explode(nodes).alias("node"), "label", "depth", "tokens")
    return found


def links(source: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between vertices; all that connectivity needs."""
    key, found = ["low"], candidates(vertices)
    if found is None:
        return vertices.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    groups = components(found).join(vertices.select("v", "tokens", F.col("n_shingles").alias("cost")), "v")
    groups = materialize(groups, "groups")
    sizes = groups.groupBy(key).agg(_parts(F.count(F.lit(1)), F.sum("cost")).alias("parts"))
    every = described(source, size, False).filter("v IS NOT NULL").groupBy("v").agg(F.first("text").alias("text"))
    rows = materialize(every.join(groups.join(sizes, key), "v").withColumn("label", F.col("v")), "texts")
    found = materialize(joined(in_parts(rows, key), size, percent), "links")
    large = rows.filter("parts > 1")
    if large.isEmpty():
        return found
    return found.union(materialize(joined(open_with_all(labelled(large, key, found), key), size, percent), "links"))


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``low`` for each end of the edges ``a, b``: the least vertex it can reach.

    Large and small stars in turn, until nothing changes: every vertex then hangs
    on the least of its component.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("m"))
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter(
            "u != w").distinct()
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).union(
            least.select("u", F.col("m").alias("w"))).filter("u != w").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("w").alias("low")).union(
        edges.select(F.col("w").alias("v"), F.col("w").alias("low"))).distinct()


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
                percent: int = 75, row_column: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``group_digest``.

    ``group_digest`` names the group even where it has no id (null for an empty
    set). ``row_column`` names a column of row numbers, returned as ``rid``.
    """
    source = id_and_text(docs, id_column, text_column)
    if row_column:
        source = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{row_column}`").alias("rid"),
                             F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    rows = materialize(described(source, size, True), "described")
    vertices = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("least_id"), F.any_value("n_shingles").alias("n_shingles"),
                                                             F.any_value("tokens").alias("tokens"))
    vertices = materialize(vertices, "vertices")
    reach = materialize(components(links(source.select("doc_id", "text"), vertices, size, percent)), "components")
    named = vertices.select("v", "least_id").join(reach, "v", "left").withColumn("low", F.coalesce("low", "v"))
    ids = named.groupBy("low").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "low").select("v", "component_id", F.hex("low").alias("group_digest"))
    out = rows.drop("tokens").join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *(["rid"] if row_column else []), "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "group_digest")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
                         percent: int = 75) -> DataFrame:
    """One document of each group, the one with the smallest id; with the columns it came with."""
    own = [F.col(f"`{c}`").alias(c) for c in docs.columns]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*own).alias("row")), "documents")
    plain = rows.select("rid", F.col(f"row.`{id_column}`").alias("doc_id"), F.col(f"row.`{text_column}`").alias("text"))
    found = near_groups(plain, size=size, percent=percent, row_column="rid")
    # a document with an empty set is a group of its own
    group = F.coalesce("group_digest", F.col("rid").cast("string"))
    best = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"))
    return rows.join(best.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select("row.*")


SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r(doc_id, found) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.found)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, t.doc_id = c.low AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT doc_id, min(found) AS low FROM r GROUP BY doc_id) c ON c.doc_id = t.doc_id
"""
