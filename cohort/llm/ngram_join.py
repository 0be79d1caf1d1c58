"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct k-word shingles (k = 5); a shorter text has its whole word sequence as
its one shingle; a text without words has the empty set and links with nothing.  Two documents link when
the Jaccard similarity of their sets reaches a threshold (0.8), compared exactly in integers.

How candidates are found.  Shingles have one fixed order, rarest first, by a count sketch of all shingles of
the corpus.  A set of n shingles that overlaps any partner in at least a = ceil(0.8 n) shingles shares at
least l shingles with it among its first n - a + l, whatever l.  Each document takes its own l: it lengthens
its prefix while the estimated cost (postings met, plus the verifications that l required matches leave)
falls.  Two documents are candidates when their prefixes share min(l, l') shingles.  No link is lost: that
many shared shingles are in both prefixes for the smaller l, which is contained in the longer prefix.

How groups stay small.  Equal sets are one class, so exact copies never meet.  A star round verifies, for each
shared shingle, every class against one central class of the list and contracts what links to components.
What is left are candidates between different components.  Short lists enumerate them.  A long list is cut
into blocks of bounded size; each pair of blocks meets in one task, which gets the exact intersections of all
its sets from a matrix product and returns only links that join components.  So a group of near copies is
never expanded into all its pairs, whether or not its members link.

How texts stay where they are.  Each class has a signature, the counts of its shingles in n / 2 to n buckets, a byte each.
The sum of the smaller counts bounds the intersection of two sets from above, so pairs, and members of blocks, whose
bound is under the threshold go before any text moves; only what is left is verified on texts, exactly.

Defined cases: null, empty and blank texts have n_shingles 0 and are their own component; rows with a null
key get the smallest non-null key of their component, else null; repeated rows each give a row; other
columns are dropped, so extra columns can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.common import bounded_batches, written
from cohort.llm.text import Words

K = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
#: Counters of the corpus sketch (fixed size, 1 MB in the driver and in each task).
SKETCH = 1 << 17
#: Longest required match count.
MOST_MATCHES = 8
#: A shingle whose sketch count is so far above the others is in a list that may be huge: it is salted.
HOT_SHARE = 0.001
HOT_LEAST = 2_000
SALTS = 64
#: Classes of a list whose candidates are enumerated; a longer list is verified in blocks of BLOCK classes.
SHORT = 48
BLOCK = 512
#: Hash buckets of keys by which wanted texts are told from others before they move.
KEY_BUCKETS = 1 << 20
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 8_192


def text_mark(text: str) -> F.Column:
    return F.xxhash64(F.lit(1), F.col(f"`{text}`").cast("string"))


def needed(n: np.ndarray | int):
    """Least overlap of a set of n shingles with any partner."""
    return -(-NUM * n // DEN)


def _key(s: np.ndarray) -> bytes:
    """A set's class: 96 bits, so that among 10^12 different sets a chance match is unlikely (about 10^-5)."""
    return hashlib.blake2b(s.astype("<u8", copy=False).tobytes(), digest_size=12).digest()


def signature(s: np.ndarray) -> bytes | None:
    """Shingles counted in a power of two of buckets, half the set's size at least; None where a count needs more than a byte."""
    size = 1 << max(5, len(s).bit_length() - 1)
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _counts(sig: bytes) -> np.ndarray:
    return np.frombuffer(sig, np.uint8).astype(np.int16)


def _folded(c: np.ndarray, size: int) -> np.ndarray:
    """Counts in fewer buckets (the last axis)."""
    return c.reshape(*c.shape[:-1], -1, size).sum(-2)


def may_link(p: bytes | None, q: bytes | None) -> bool:
    """False only where the signatures show that the sets are under the threshold."""
    if p is None or q is None:
        return True
    a, b = _counts(p), _counts(q)
    size = min(len(a), len(b))
    both, n = int(np.minimum(_folded(a, size), _folded(b, size)).sum()), int(a.sum()) + int(b.sum())
    return DEN * both >= NUM * (n - both)


def facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: rows (key, mark, cls, n, sig) per document, and rows (bucket, count) of the sketch per task.
    ``mark`` is a hash of the text, which tells rows with equal keys apart."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), text_mark(text).alias("mark"))
    kind = src.schema["key"].dataType
    names = ["key", "mark", "cls", "n", "sig", "bucket", "cnt"]

    def run(batches):
        counts, seen, key_type = np.zeros(SKETCH, np.int64), set(), None
        for b in batches:
            key_type = b.column(0).type
            cls, n, sig = [], [], []
            for s in Words(b.column(1)).shingles(K):
                c = _key(s) if len(s) else None
                cls.append(c)
                n.append(len(s))
                sig.append(signature(s) if c and c not in seen else None)
                if c and c not in seen:
                    seen.add(c)
                    counts += np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) if len(s) > 4096 else 0
                    if len(s) <= 4096:
                        np.add.at(counts, (s % np.uint64(SKETCH)).astype(np.int64), 1)
            m = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)
        at = np.flatnonzero(counts)
        for a in range(0, len(at), 1 << 14):
            part = at[a:a + (1 << 14)]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, key_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                                              pa.array(part.astype(np.int32)), pa.array(counts[part])], names=names)

    return src.mapInArrow(run, f"key {kind.simpleString()}, mark long, cls binary, n long, sig binary, bucket int, cnt long")


def sketch_counts(found: DataFrame) -> np.ndarray:
    """The corpus sketch; its size is fixed, so it may be held by the driver."""
    out = np.zeros(SKETCH, np.int64)
    rows = found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("cnt").alias("cnt")).toArrow()
    out[rows["bucket"].to_numpy()] = rows["cnt"].to_numpy()
    return out


def choose_matches(excess: np.ndarray, n: int) -> int:
    """Required matches l of a set whose ordered shingles have the given estimated list lengths.

    Postings met within the prefix for l, plus verifications: a candidate takes l of these postings at
    least, and one costs about a tenth of the set's size.  The smallest cost wins, the shorter prefix at ties.
    """
    most = min(MOST_MATCHES, needed(n))
    met = np.cumsum(excess)
    ends = n - needed(n) + np.arange(1, most + 1)
    at = met[ends - 1]
    return int(np.argmin(0.3 * ends + at * (1 + n / 10 / np.arange(1, most + 1)))) + 1


def postings(df: DataFrame, text: str, sketch: np.ndarray) -> DataFrame:
    """(tok, salt, cls, n, l): the prefix of each set that is new within its task."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = sketch.astype(np.uint32 if sketch.max(initial=0) < 2**32 else np.int64)
    usual = float(np.median(sketch))
    noise = usual + 4 * np.sqrt(usual)
    hot = usual + max(HOT_LEAST, HOT_SHARE * usual, 8 * np.sqrt(usual))

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            tok, salt, cls, n_of, l_of = [], [], [], [], []
            for s in Words(b.column(0)).shingles(K):
                if not len(s) or (c := _key(s)) in seen:
                    continue
                seen.add(c)
                n = len(s)
                count = counts[(s % np.uint64(SKETCH)).astype(np.int64)].astype(np.float64)
                order = np.lexsort((s, count))
                count = count[order]
                matches = choose_matches(np.maximum(count - noise, 0) + 0.05, n)
                prefix = n - needed(n) + matches
                tok.append(s[order[:prefix]])
                salt.append(np.where(count[:prefix] > hot, 1 + c[0] % SALTS, 0))
                cls += [c] * prefix
                n_of.append(np.full(prefix, n))
                l_of.append(np.full(prefix, matches))
            if cls:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(salt).astype(np.int32)), pa.array(cls, pa.binary()),
                    pa.array(np.concatenate(n_of).astype(np.int32)), pa.array(np.concatenate(l_of).astype(np.int32))],
                    names=["tok", "salt", "cls", "n", "l"])

    return src.mapInArrow(run, "tok long, salt int, cls binary, n int, l int")


def shared_postings(rows: DataFrame) -> DataFrame:
    """Postings whose shingle is in the prefix of another class too.  A hot shingle's list is spread by salt
    and kept as it is; any other list is short."""
    same = Window.partitionBy("tok", "salt")
    return (rows.repartition("tok", "salt").withColumn("lo", F.min("cls").over(same)).withColumn("hi", F.max("cls").over(same))
            .where("salt > 0 OR lo < hi").select("tok", "cls", "n", "l").dropDuplicates(["tok", "cls"]))


def _fits(a: str, b: str) -> F.Column:
    return F.expr(f"{DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b})")


def numbered_classes(shared: DataFrame) -> DataFrame:
    """(cls, id, n, l, shared): a short number for every class with a shared shingle, and how many of them it has."""
    found = shared.groupBy("cls").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.count("*").cast("int").alias("shared"))
    return found.withColumn("id", F.monotonically_increasing_id())


def class_texts(df: DataFrame, found: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of each ``wanted`` class (cls, id), from one of its documents.  A text takes a third of the room of
    its shingles, so texts travel to the verification and shingles are made there.

    Repeated rows of that document are left out within a task; should a class come twice all the same, its
    pairs are verified twice, which changes nothing.
    """
    docs = found.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("key")).join(wanted, "cls")
    docs = written(docs, "wanted")
    src = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    # most texts aren't wanted: they stay behind by a hash of their key; KEY_BUCKETS numbers at most are broadcast
    some = docs.select(F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).alias("bucket")).distinct()
    src = src.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(KEY_BUCKETS))).join(F.broadcast(some), "bucket", "left_semi").drop("bucket")
    texts = src.join(docs, F.col("k").eqNullSafe(F.col("key"))).select("id", "text", "cls")

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for i, (s, c) in enumerate(zip(Words(b.column(1)).shingles(K), b.column(2).to_pylist())):
                if len(s) and c not in seen and _key(s) == c:
                    seen.add(c)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select([0, 1])

    return texts.mapInArrow(run, "id long, text string")


def class_signatures(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, sig) of each numbered class; copies collapse where they are."""
    sigs = found.where("cls IS NOT NULL").groupBy("cls").agg(F.max("sig").alias("sig"))
    return sigs.join(classes.select("cls", "id"), "cls").select("id", "sig")


def possible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a link possible."""
    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            keep = [may_link(p, q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return rows.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            keep = []
            for p, q in zip(Words(b.column(2)).shingles(K), Words(b.column(3)).shingles(K)):
                if len(p) > len(q):
                    p, q = q, p
                i = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[i] == p).sum())
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of undirected links (a, b): the smallest vertex reachable.

    Minimum labels travel over links and then jump to their label's label, so the rounds grow with the
    logarithm of the longest path.  Each round is written, none is held by the driver.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("v").alias("comp"), F.col("comp").alias("up"))
        step = written(step.join(up, "comp").select("v", "old", F.least("comp", "up").alias("comp")), "labels")
        labels = step.select("v", "comp")
        if step.where("old <> comp").isEmpty():
            return labels


def _spanning(members: DataFrame) -> DataFrame:
    """(tok, k, same) of the lists that hold more than one component: their length, and a hash of their classes."""
    same = F.struct(*[F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"h{i}") for i in range(2)])
    found = members.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), same.alias("same"))
    return found.where("lo < hi").select("tok", "k", "same")


def _numbers(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _star_pairs(members: DataFrame) -> DataFrame:
    """Every class with the pivot of each of its lists, where they could link.  The pivot is the class with the
    most shared shingles in its prefix: in a group of near copies, the one with the fewest changes."""
    pivot = members.groupBy("tok").agg(F.min(F.struct((-F.col("shared")).alias("o"), "id", "n")).alias("p"))
    met = members.join(pivot, "tok").where((F.col("id") != F.col("p.id")) & _fits("n", "p.n"))
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _cross_pairs(members: DataFrame) -> DataFrame:
    """Candidates between components in short lists: a pair comes once for each shingle it shares there.

    Its matches are counted over all short lists; a pair with a match in a long list is verified there."""
    lists = members.groupBy("tok").agg(F.array_sort(F.collect_list(F.struct("id", "n", "l", "comp", "long"))).alias("m"))  # SHORT at most

    def later(x: F.Column, i: F.Column) -> F.Column:
        rest = F.slice("m", i + 2, F.lit(SHORT))
        met = F.filter(rest, lambda y: (y["comp"] != x["comp"]) & (DEN * F.least(x["n"], y["n"]) >= NUM * F.greatest(x["n"], y["n"])))
        # matches in long lists aren't counted here, so as many may be missing as either class has long lists
        return F.transform(met, lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), (F.least(x["l"], y["l"]) - F.least(x["long"], y["long"])).alias("l")))

    met = lists.select(F.inline(F.flatten(F.transform("m", later))))
    return met.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("l").alias("l")).where("m >= l").select("a", "b")


def _joined(sets: list[np.ndarray], comps: list, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Links between ``first`` and ``second`` (places in ``sets``) that join different components: a forest."""
    size = np.array([len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    row, column = row[keep], shared[inverse[keep]]
    both = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, int(shared[-1]) + 1, COLUMNS):
        part = (column >= low) & (column < low + COLUMNS)
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[part], column[part] - low] = 1
        both += dense[first] @ dense[second].T
    both = both.astype(np.int64)  # whole numbers below 2**24 are exact
    linked = DEN * both >= NUM * (size[first][:, None] + size[second][None, :] - both)
    parent = {c: c for c in comps}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for x, y in zip(*np.nonzero(linked)):
        i, j = int(first[x]), int(second[y])
        p, q = find(comps[i]), find(comps[j])
        if p != q:
            parent[p] = q
            out.append((i, j))
    return out


def may_join(sigs: list[bytes | None], comps: list, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in ``first`` and ``second`` of sets that may link with a set of another component on the other side."""
    sizes = np.array([len(s) if s else 0 for s in sigs])
    kept = np.zeros(len(sigs), bool)
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    counts = {i: _counts(s) for i, s in enumerate(sigs) if s}
    n = np.array([int(counts[i].sum()) if i in counts else 0 for i in range(len(sigs))])
    for size in np.unique(sizes[second]).tolist():
        right = second[sizes[second] == size]
        stack = np.stack([counts[i] for i in right.tolist()]) if size else None
        for i in first.tolist():
            other = comp[right] != comp[i]
            if not other.any():
                continue
            if size and sizes[i]:  # else nothing is known: a link is possible
                small = min(size, int(sizes[i]))
                both = np.minimum(_folded(counts[i], small), _folded(stack[other], small)).sum(1)
                other[other] = DEN * both >= NUM * (n[i] + n[right][other] - both)
            kept[right[other]] = True
            kept[i] |= other.any()
    return np.flatnonzero(kept)


def block_members(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """(tok, x, y, block, id, comp): what is left of the pairs of blocks of the long lists once the signatures have spoken.
    ``members`` holds the lists' members with the length ``k`` of their list."""
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("tok", "id", "comp", "block", other.alias("other"))
    rows = rows.select("tok", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "comp").join(sigs, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, second = _sides(table)
        kept = may_join(table["sig"].to_pylist(), table["comp"].to_pylist(), first, second) if len(first) and len(second) else []
        return table.take(pa.array(kept, pa.int64())).select(["tok", "x", "y", "block", "id", "comp"])

    return rows.groupBy("tok", "x", "y").applyInArrow(run, "tok long, x int, y int, block int, id long, comp long")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks of a pair; the same places for a block with itself."""
    block, x = table["block"].to_numpy(), table["x"][0].as_py()
    first = np.flatnonzero(block == x)
    return first, first if table["y"][0].as_py() == x else np.flatnonzero(block != x)


def block_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join components, between the members left in each pair of blocks."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_pylist()
        sets = [s for c in table["text"].chunks for s in Words(c).shingles(K)]
        first, second = _sides(table)
        found = _joined(sets, table["comp"].to_pylist(), first, second) if len(first) and len(second) else []
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return rows.join(texts, "id").groupBy("tok", "x", "y").applyInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles long, component_id, cls binary, mark long, group binary): ``component_id`` is the smallest key
    reachable by links; ``cls`` is the same for equal sets, ``group`` for a component's documents, null without words;
    ``mark`` is a hash of the text."""
    found = written(facts(df, key, text), "facts")
    sketch = sketch_counts(found)
    docs = found.where("bucket IS NULL").select("key", "mark", "cls", "n", "sig")
    shared = written(shared_postings(postings(df, text, sketch)), "postings")
    classes = written(numbered_classes(shared), "classes")
    members = written(shared.select("tok", "cls").join(classes, "cls").select("tok", "id", "n", "l", "shared"), "members")
    sigs = written(class_signatures(docs, classes), "signatures")

    def texts_of(ids: DataFrame) -> DataFrame:
        return written(class_texts(df, docs, classes.select("cls", "id").join(ids, "id", "left_semi"), key, text), "texts")

    pairs = written(possible(_star_pairs(members), sigs), "pairs")
    stars = written(verify(pairs, texts_of(_numbers(pairs))), "links")
    comp = components(stars)  # class -> component, for classes that link so far
    members = members.join(comp, members.id == comp.v, "left").select("tok", "id", "n", "l", F.coalesce("comp", "id").alias("comp"))
    lists = written(_spanning(members), "lists")
    members = written(members.join(lists, "tok"), "spanning")
    in_long = members.where(F.col("k") > SHORT).groupBy("id").agg(F.count("*").cast("int").alias("long"))
    short = members.where(F.col("k") <= SHORT).join(in_long, "id", "left").withColumn("long", F.coalesce("long", F.lit(0)))
    pairs = written(possible(_cross_pairs(short), sigs), "pairs")
    # the shingles of one passage often have the same classes: one of such lists stands for all
    each = lists.where(F.col("k") > SHORT).groupBy("k", "same").agg(F.min("tok").alias("tok")).select("tok")
    blocks = written(block_members(members.where(F.col("k") > SHORT).join(each, "tok", "left_semi"), sigs), "blocks")
    texts = texts_of(_numbers(pairs).union(blocks.select("id")).distinct())
    links = written(verify(pairs, texts).unionByName(block_links(blocks, texts)), "links")
    if not links.isEmpty():  # the known components are links to their smallest class
        comp = components(links.unionByName(comp.where("v <> comp").select(F.col("v").alias("a"), F.col("comp").alias("b"))))
    linked = classes.select("cls", F.col("id").alias("v")).join(comp, "v").select("cls", "comp")
    each = docs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("least")).join(linked, "cls", "left")
    whole = each.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("all"), F.min("cls").alias("group"))
    of = each.join(whole, "comp", "left").select("cls", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("all")).alias("component_id"),
                                                 F.coalesce("group", "cls").alias("group"))
    empty = docs.where("cls IS NULL").select("key", "n", F.col("key").alias("component_id"), "cls", "mark", F.col("cls").alias("group"))
    full = docs.where("cls IS NOT NULL").join(of, "cls").select("key", "n", "component_id", "cls", "mark", "group")
    return full.unionByName(empty).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "cls", "mark", "group")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the document with the smallest key (a null key comes last),
    and of equal keys the one with the smallest text hash, so rows that share a key but not a text are told apart.

    Documents without words stay.  Of repeated rows, with the kept key and text, one stays (the smallest by all columns).
    """
    rows = jaccard_components(df, key, text).select(F.col(f"`{key}`").alias("__key"), "mark", "group").where("group IS NOT NULL")
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("__key").isNull().alias("last"), F.col("__key").alias("k"), "mark")).alias("b"))
    times = rows.groupBy("group", "__key", "mark").agg(F.count("*").alias("__times"))
    kept = best.join(times.select(F.col("group").alias("g"), F.col("__key").alias("k"), F.col("mark").alias("m"), "__times"),
                     (F.col("group") == F.col("g")) & F.col("b.k").eqNullSafe(F.col("k")) & (F.col("b.mark") == F.col("m")))
    kept = written(kept.select(F.col("k").alias("__key"), F.col("m").alias("__mark"), "__times"), "kept")
    marked = df.withColumn("__text", text_mark(text))
    blank = ~F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__mark"))
    empty, worded = df.where(blank), marked.where(~blank)
    if kept.where("__times > 1").isEmpty():  # every kept document is one row: the texts travel once
        return empty.unionByName(worded.join(kept.select("__key", "__mark"), same, "left_semi").drop("__text"))
    rows = worded.join(kept, same).drop("__key", "__mark")
    once, again = rows.where("__times = 1").drop("__times", "__text"), rows.where("__times > 1")
    rank = Window.partitionBy(F.col(f"`{key}`"), "__text").orderBy(*[F.col(f"`{c}`") for c in df.columns if c != key])
    again = again.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank", "__times", "__text")
    return empty.unionByName(once).unionByName(again)
