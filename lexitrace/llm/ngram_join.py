"""Self-join of documents by the Jaccard similarity of their word n-gram sets.

Documents with one and the same set of n-grams form a node, numbered by one of its
rows; identifiers play no part until classes are named. MinHash values, in bands,
deal nodes into buckets; two nodes at the threshold share one with probability
1 - (1 - t^5)^32, all but three in a million at t = 0.8. Inside a bucket pairs are compared on short
sketches, sixteen values at a time, and dropped as soon as the posterior probability
(uniform prior) of reaching the threshold falls below a tolerance. A bucket reports
the clusters of the pairs that are left as one edge for each member, not as pairs.
Connected nodes form candidate components, and inside these every pair is verified
exactly on the sets themselves: that yields the number of links of each node and the
true components. Links of a large group are counted, never listed.

Buckets and components above a fixed size are dealt out in blocks, each pair of
blocks to a task of its own, so no task holds an unbounded group. Components are found
by label propagation with pointer jumping over tables in the shared folder.

Defined results, one row for each row of the input: ``class_id`` is the least
identifier of the component, ``n_links`` the number of other documents at the
threshold or above. A text with fewer than n words has one n-gram, all its words; null,
empty and blank texts link to nothing. Rows without identifier get a null class and no
links, nor do they count as links. Rows that repeat an identifier are one document with
regard to its class, which joins the classes of all their texts; as links each row counts
for itself. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, discard, materialise, table

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SKETCH, STEP = 64, 16
TOLERANCE = 1e-7
#: Nodes of a block of a bucket and of a component; n-grams of the latter.
BLOCK, VERIFY_BLOCK, VERIFY_GRAMS = 512, 256, 400_000
CHUNK_WORDS, GATHER = 200_000, 20_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_RANDOM = np.random.RandomState(7)
_FACTOR = (_RANDOM.randint(0, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RANDOM.randint(0, 1 << 32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, and how many each text has."""
    words, sizes = [], []
    for text in texts:
        found = _WORDS(text)
        words += found
        sizes.append(len(found))
    size = np.array(sizes, np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), size
    h = _mix(pd.util.hash_array(np.array(words, object), categorize=False))
    start = np.cumsum(size) - size
    windows = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), windows)
    at = np.repeat(start, windows) + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    end = np.repeat(start + size, windows)
    gram = np.zeros(len(at), np.uint64)
    for j in range(n):
        inside = at + j < end  # short texts: as many words as there are
        gram = np.where(inside, _mix(gram * np.uint64(31) + h[np.minimum(at + j, len(h) - 1)]), gram)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[new], np.bincount(doc[new], minlength=len(size))


def _sketches(gram: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and one-byte MinHash values of sets that aren't empty."""
    first = np.cumsum(size) - size
    x = (gram >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(size), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        y = x * _FACTOR[k] + _SHIFT[k]
        y ^= y >> np.uint32(15)
        least[:, k] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), first)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(size), 1))
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, j::ROWS].astype(np.uint64) + np.uint64(1))
    return key.astype(np.int64), (least[:, :SKETCH] >> np.uint32(7)).astype(np.uint8)


def describe(docs: DataFrame, n: int = N) -> DataFrame:
    """``docs``: row, id, given, mark, body, none of them null. row, id, given, mark, size, s1,
    s2 (a hash of the set), keys, sketch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, held, words = batch["body"].tolist(), 0, 0
            for k, x in enumerate(text):
                words += len(x) // 5
                if words < CHUNK_WORDS and k + 1 < len(text):
                    continue
                gram, size = gram_sets(text[held : k + 1], n)
                full = np.flatnonzero(size)
                out = batch[["row", "id", "given", "mark"]].iloc[held : k + 1].reset_index(drop=True)
                out = out.assign(size=size, s1=0, s2=0, keys=None, sketch=None)
                if len(full):
                    first = (np.cumsum(size) - size)[full]
                    keys, sketch = _sketches(gram, size[full])
                    for name, seed in (("s1", 1), ("s2", 2)):
                        sums = np.zeros(len(size), np.int64)
                        sums[full] = np.add.reduceat(_mix(gram ^ np.uint64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)), first).astype(np.int64)
                        out[name] = sums
                    listed, sketched = np.empty(len(size), object), np.empty(len(size), object)
                    listed[full], sketched[full] = list(keys), [x.tobytes() for x in sketch]
                    out["keys"], out["sketch"] = listed, sketched
                yield out
                held, words = k + 1, 0

    return docs.mapInPandas(rows, "row long, id long, given boolean, mark long, size long, s1 long, s2 long, keys array<long>, sketch binary")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): below that many the posterior probability of
    reaching the threshold, P(Binomial(n + 1, p) <= m), is under the tolerance."""
    p, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, SKETCH + 1, STEP):
        mass, m = 0.0, 0
        while (mass := mass + math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


class _Forest:
    """Union-find over node numbers; edges join a node with the least of its cluster."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        tops = np.array([self.top(x) for x in range(len(self.up))], np.int64)
        own = np.arange(len(tops))
        moved = tops != own
        return own[moved], tops[moved]


def _pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) inside each run of rows."""
    a = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(first + size, size) - a - 1
    b = np.repeat(a + 1, after) + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    return np.repeat(a, after), b


def _survivors(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs whose posterior never falls below the tolerance."""
    left, match = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in needs:
        match = match + (sketch[a[left], n - STEP : n] == sketch[b[left], n - STEP : n]).sum(axis=1)
        good = match >= least
        left, match = left[good], match[good]
    return left


def _units(batches: Iterator[pd.DataFrame], by: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole units of sorted input, of about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[by] != frame[by].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(frame: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(frame), bool)
    new[1:] = np.any([frame[c].to_numpy()[1:] != frame[c].to_numpy()[:-1] for c in by], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(frame)))


def candidate_edges(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``nodes``: id, keys, sketch. Edges (u, v) that connect all pairs which share a
    bucket and pass the Bayesian test."""
    banded = nodes.select(F.explode("keys").alias("key"), "id", "sketch")
    shared = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = among(banded, shared, "key").join(shared, "key")
    # A large bucket goes to each pair of its blocks; a bucket of one block to (0, 0).
    parts = F.ceil(F.col("n") / block)
    rows = rows.withColumn("parts", parts).withColumn("own", F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "sketch")
    needs = least_matches(threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _units(batches, ["key", "i", "j"], GATHER):
            first, size = _runs(frame, ["key", "i", "j"])
            ids, place = np.unique(frame["id"].to_numpy(), return_inverse=True)
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, SKETCH)
            forest = _Forest(len(ids))
            few = (size > 1) & (size <= 64)
            a, b = _pairs(first[few], size[few])
            good = _survivors(sketch, a, b, needs)
            forest.join(place[a[good]], place[b[good]])
            for f, s in zip(first[size > 64].tolist(), size[size > 64].tolist()):
                for x in range(f, f + s):  # rows against those after them that aren't joined yet
                    y = np.arange(x + 1, f + s)
                    top = forest.top(int(place[x]))
                    y = y[np.array([forest.up[p] != top for p in place[y].tolist()], bool)] if len(y) else y
                    if len(y):
                        y = y[_survivors(sketch, np.full(len(y), x), y, needs)]
                        forest.join(np.full(len(y), place[x]), place[y])
            u, v = forest.edges()
            yield pd.DataFrame({"u": ids[u], "v": ids[v]})

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of an edge."""
    both = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        low = materialise(labels.join(near, "node").select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")))
        if low.where("moved").isEmpty():
            discard(both, low)
            return labels
        discard(labels)
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialise(low.select("node", "label").join(jump, "label").select("node", F.least("label", "further").alias("label")))
        discard(low)


def verified(members: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``members``: comp, i, j, own, id, copies, body, one row for each unit (comp, i, j)
    of a node. u, v: a node and the least it is connected with in a unit; links: the
    documents at the threshold that the unit found for u."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["comp", "i", "j"]
        for frame in _units(batches, by, GATHER // 8):
            frame = frame.drop_duplicates([*by, "id"], ignore_index=True)
            for f, s in zip(*(x.tolist() for x in _runs(frame, by))):
                unit = frame.iloc[f : f + s]
                gram, size = gram_sets(unit["body"].tolist(), n)
                ids, own, copies = unit["id"].to_numpy(), unit["own"].to_numpy(), unit["copies"].to_numpy()
                code, doc = np.unique(gram, return_inverse=True)[1], np.repeat(np.arange(s), size)
                shared = np.zeros((s, s), np.float32)
                order = np.argsort(code, kind="stable")
                code, doc = code[order], doc[order]
                often = np.bincount(code)[code] > 1  # the others are shared by none
                code, doc = np.unique(code[often], return_inverse=True)[1], doc[often]
                for low in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
                    a, b = np.searchsorted(code, [low, low + 4096])
                    x = np.zeros((s, 4096), np.float32)
                    x[doc[a:b], code[a:b] - low] = 1
                    shared += x @ x.T
                link = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
                np.fill_diagonal(link, False)
                if unit["i"].iloc[0] != unit["j"].iloc[0]:
                    link &= own[:, None] != own[None, :]
                link &= (size[:, None] > 0) & (size[None, :] > 0)
                count = link @ copies
                forest = _Forest(s)
                order = np.argsort(ids, kind="stable")
                rank = np.empty(s, np.int64)
                rank[order] = np.arange(s)
                a, b = np.nonzero(np.triu(link))
                if len(a) > 4 * s:  # a dense group: labels spread faster than pairs join
                    label = rank.copy()
                    while True:
                        low = np.minimum(label, np.where(link, label[None, :], s).min(axis=1))
                        if (low == label).all():
                            break
                        label = low
                    top = label
                else:
                    forest.join(rank[a], rank[b])
                    top = np.array([forest.top(x) for x in rank.tolist()])
                some = count > 0
                yield pd.DataFrame({"u": ids[some], "v": ids[order][top[some]], "links": count[some]})

    return members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id").mapInPandas(rows, "u long, v long, links long")


def _same_document(known: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """Edges (u, v) between nodes that share an identifier; few, as identifiers rarely
    repeat with another text."""
    whole = F.struct(*group)
    repeated = materialise(known.groupBy("id").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a <> b").select("id"))
    rows = among(known.select("id", *group), repeated, "id").join(repeated, "id").join(nodes.select("node", *group), group)
    held = materialise(rows.select("id", "node").distinct())
    return held.join(held.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v").where("u <> v")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).withColumn("mark", F.xxhash64("id", "body"))
    # Row numbers are written once with what is read again: another scan may give others.
    given = F.col("id").isNotNull()
    described = describe(rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(0)).alias("id"), given.alias("given"), "mark", "body"), n)
    described = materialise(described.withColumn("id", F.when(F.col("given"), F.col("id"))).drop("given"))
    known = described.where("id IS NOT NULL AND size > 0")
    group = ["s1", "s2", "size"]
    nodes = materialise(known.groupBy(*group).agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    firsts = materialise(nodes.select("node", "copies").join(known.withColumnRenamed("row", "node"), "node").select("node", "id", "mark", "copies", "size", "keys", "sketch"))
    near = materialise(candidate_edges(firsts.select(F.col("node").alias("id"), "keys", "sketch"), threshold))
    rough = components(near)

    member = firsts.select("node", "id", "mark", "copies", "size").join(rough, "node").withColumnRenamed("label", "comp")
    parts = member.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK), F.ceil(F.sum("size") / VERIFY_GRAMS)).alias("parts"))
    parts = materialise(parts)
    member = materialise(member.join(parts, "comp").select("node", "id", "mark", "comp", "copies", "parts"))
    discard(near, rough, firsts, parts)
    # The text of a node is that of its first row: same identifier, same hash of the text.
    texts = among(rows, member, "mark")
    units = (
        texts.join(member, ["id", "mark"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node").alias("id"), "copies", "body")
    )
    found = materialise(verified(units, n, threshold))
    same = _same_document(known, nodes, group)
    classes = components(found.where("u <> v").select("u", "v").unionByName(same))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    told = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    told = materialise(told.select(*group, "label", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    named = told.groupBy("label").agg(F.min("least").alias("class"))
    called = materialise(told.join(named, "label").select(*group, "class", "links"))
    discard(member, found, classes, nodes, told)
    out = known.select("id", *group).join(called, group).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("links").cast("long").alias("n_links"))
    rest = described.where("id IS NULL OR size = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)


def one_of_each_class(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier is the least of its class, or null. Rows
    that the filter of dropped identifiers passes over aren't shuffled."""
    joined = jaccard_join(docs, n, threshold, id_col, text_col)
    dropped = materialise(joined.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("id")).distinct())
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    marked = among(rows, dropped, "id", keep=True)
    return marked.where(~F.col("maybe")).select("row.*").unionByName(marked.where("maybe").join(dropped, "id", "left_anti").select("row.*"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: The exact join on n-grams, which needs no candidates; fit for small tables.
SQL = f"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) < {N} THEN [w] ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: w[i:i + {N} - 1]) END)) AS gram
  FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE c >= {THRESHOLD}::DOUBLE * (a.n + b.n - c) - 1e-6),
e AS MATERIALIZED (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r AS (SELECT x AS doc_id, x AS reach FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
