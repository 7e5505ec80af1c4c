"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Words are runs of bytes other than ASCII white space, lower-cased in A-Z; shingles are four words joined by one space (a
shorter text is one shingle); their XXH64 with seed 42 vote on 64 bits. Distinct fingerprints are self-joined over a
binary trie: pairs of nodes descend together, differing bits are added up, and a pair of nodes is dropped
when its budget is exceeded. To distribute the trie, it is rooted at each of budget + 1 bit blocks in turn: two fingerprints within the budget
agree on one block at least, so each task holds whole subtrees below such a root. Subtrees with over HOT fingerprints
are rooted again, at a block of the remaining bits. Every task reports a spanning forest, never all pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; copies share a fingerprint and
are one node; rows with a null id get a null component; ids are integers; repeated rows stay; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, parts_for, released, spread, starts_of, text_batches, whole_groups, written
from .components import Forest, components

SHINGLE = 4
SEED = 42
BUDGET = 4
HOT = 200_000
#: Pairs of nodes with at most so many leaf pairs are compared leaf by leaf.
LEAVES = 256
PAIRS_AT_ONCE = 1 << 21


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of lower-cased words."""
    n = len(words)
    if not n:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return digest(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - size + 1].tolist()
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, data, offs in text_batches(batches):
            raw = data.tobytes().lower()
            fps = np.array([fingerprint(raw[a:b].split(), size) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, fp long")


def blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of budget + 1 blocks that cover `bits` bits."""
    cuts = [bits * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def rooted(fp: np.ndarray, low: int, width: int, bits: int = 64) -> np.ndarray:
    """The low `bits` bits with the block at `low` moved to their top; the order of the others is kept in a circle."""
    fp = fp.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    up = (bits - low - width) % bits
    if not up:
        return fp
    inside = fp & mask
    turned = ((inside << np.uint64(up)) | (inside >> np.uint64(bits - up))) & mask
    return (fp & ~mask) | turned


def trie_pairs(keys: np.ndarray, group: np.ndarray, depth: np.ndarray, budget: int):
    """Index pairs of rows of one group whose keys differ in at most `budget` bits.

    keys are sorted within their group; depth: bits from the top that all keys of the row's group share.
    """
    n = len(keys)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    for d0 in np.unique(depth[starts]).tolist():
        own = (depth[starts] == d0) & (ends - starts > 1)
        a0 = starts[own]
        node = np.stack([a0, ends[own], a0, ends[own], np.zeros(len(a0), np.int64)])
        level = int(d0)
        while node.shape[1]:
            small = (node[1] - node[0]) * (node[3] - node[2]) <= LEAVES
            if level == 64:
                small[:] = True
            yield from _leaves(keys, node[:, small], budget)
            node = node[:, ~small]
            if not node.shape[1]:
                break
            ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1)))).astype(np.int64)
            alo, ahi, blo, bhi, diff = node
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            same = alo == blo
            pick = lambda *x: np.stack(x)
            children = [pick(alo, amid, blo, bmid, diff), pick(amid, ahi, bmid, bhi, diff), pick(alo, amid, bmid, bhi, diff + 1), pick(amid, ahi, blo, bmid, diff + 1)[:, ~same]]
            node = np.concatenate(children, axis=1)
            full = (node[0] < node[1]) & (node[2] < node[3]) & (node[4] <= budget) & ~((node[0] == node[2]) & (node[1] - node[0] < 2))
            node = node[:, full]
            level += 1


def _leaves(keys: np.ndarray, node: np.ndarray, budget: int):
    """Pairs of leaves below pairs of nodes, a bounded number at a time."""
    wide = node[3] - node[2]
    count = (node[1] - node[0]) * wide
    at = 0
    ends = np.cumsum(count)
    while at < len(count):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        c = count[at:stop]
        which = np.repeat(np.arange(at, stop), c)
        k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        i, j = node[0][which] + k // wide[which], node[2][which] + k % wide[which]
        apart = np.bitwise_count(keys[i] ^ keys[j])
        ok = (apart <= budget) & ((node[0][which] != node[2][which]) | (i < j))
        yield i[ok], j[ok]
        at = stop


def near_links(reps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect the fingerprints within the budget; reps: distinct fp with rep, its least document."""
    roots = blocks(64, budget)
    root_cols = F.array(*[F.struct(F.lit(i).alias("root"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).cast("long").alias("block")) for i, (low, width) in enumerate(roots)])
    rows = written(reps.where("rep IS NOT NULL").select("fp", "rep", F.explode(root_cols).alias("r")).select("fp", "rep", "r.root", "r.block"))
    # Only few roots can be over `hot`: at most (budget + 1) x fingerprints / hot.
    busy = rows.groupBy("root", "block").count().where(F.col("count") > hot).select("root", "block", F.lit(True).alias("busy"))
    split = written(busy)
    if split.isEmpty():
        placed = rows.withColumn("sub", F.lit(-1))
    else:
        marked = rows.join(split, ["root", "block"], "left")
        placed = marked.withColumn("sub", F.explode(F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(budget))).otherwise(F.array(F.lit(-1))))).drop("busy")
    under = F.lit(-1).cast("long")
    for i, (low, width) in enumerate(roots):
        rest = 64 - width
        up = (64 - low - width) % 64
        turned = F.col("fp") if not up else F.expr(f"shiftleft(fp, {up}) | shiftrightunsigned(fp, {64 - up})")
        for s, (slow, swidth) in enumerate(blocks(rest, budget)):
            part = F.shiftrightunsigned(turned, slow).bitwiseAND(F.lit((1 << swidth) - 1))
            under = F.when((F.col("root") == i) & (F.col("sub") == s), part.cast("long")).otherwise(under)
    placed = placed.withColumn("under", F.lit(-1).cast("long") if split.isEmpty() else under)
    if not split.isEmpty():
        placed = written(placed)  # read twice by in_parts
    keys = ["root", "block", "sub", "under"]
    dealt = in_parts(placed, keys, "fp", hot).select(*keys, "lo", "hi", "fp", "rep")
    keys += ["lo", "hi"]
    dealt = dealt.repartition(parts_for(reps.sparkSession, rows.count(), ROWS_A_TASK), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for table in whole_groups(batches, keys):
            root, block, sub, below, lo, hi, fp, rep = (table.column(i).to_numpy() for i in range(8))
            fp = fp.astype(np.int64).view(np.uint64)
            turned, depth = np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.int64)
            for i, (low, width) in enumerate(roots):
                for s in (-1, *range(budget + 1)):
                    own = (root == i) & (sub == s)
                    if not own.any():
                        continue
                    key, deep = rooted(fp[own], low, width), width
                    if s >= 0:
                        slow, swidth = blocks(64 - width, budget)[s]
                        key, deep = rooted(key, slow, swidth, 64 - width), width + swidth
                    turned[own], depth[own] = key, deep
            new = np.zeros(len(fp), np.int64)
            new[starts_of(table, keys)] = 1
            group = np.cumsum(new) - 1
            order = np.lexsort((turned, group))
            forest = Forest(len(fp))
            for i, j in trie_pairs(turned[order], group, depth[order], budget):
                forest.join(i, j)
            a, b = forest.links(rep[order])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable)."""
    marked = written(fingerprints(docs, id_col, text_col, size))
    reps = written(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")))
    roots = components(near_links(reps, budget, hot))
    home = written(reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "rep").alias("component_id")))
    joined = marked.join(home, F.col("fp") == F.col("fp2"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Deduplication links texts whose sets of five-word shingles have a Jaccard similarity of ALIKE or more. Candidates are found by
#: fingerprints of 256 bits. At that similarity a share of 0.151 of the bits differs on average, and 0.19 where a set of four lies in one of
#: five; the budgets lie about four standard deviations above (small sets, others). Roots look at ROOT_BITS bits or, so that few texts meet
#: at a root by chance, at as many as the texts' number has, less PER_ROOT bits; there are so many roots that two texts at the limit agree on all bits
#: of one with probability RECALL or more, and the more the more alike they are.
WIDE_SHINGLE = 5
WIDE_WORDS = 4
WIDE_BUDGET, SMALL_BUDGET, SMALL_SET = 62, 72, 16
ROOT_BITS, PER_ROOT = 12, 5
DIFFERING = 0.151
RECALL = 0.9995
#: Budget of the first 64 bits below a root.
FIRST_BUDGET = 24
#: (numerator, denominator) of the least similarity.
ALIKE = (4, 5)
#: Candidate groups, and texts at one root, of more texts are dealt as pairs of parts of about so many.
GROUP = 2048
ROWS_A_TASK = 1_000_000
#: Bytes of shingle hashes that a task compares at a time, and that meet in a task.
SETS_AT_ONCE = 32 << 20


def roots_for(texts: int) -> tuple[int, int]:
    """(roots, bits of each) for so many distinct texts."""
    bits = max(ROOT_BITS, max(texts, 1).bit_length() - PER_ROOT)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFERING) ** bits)), bits


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 independent bits of every hash."""
    if not word:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(words: list[bytes], size: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a wordless one has none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(text, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - size + 1].tolist()
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray, wide: int = WIDE_WORDS) -> bytes:
    """Each of the 64 x wide bits votes over the distinct shingles; 8 x wide bytes. Wordless texts are all zero."""
    votes = np.zeros((wide, 64), np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        for w in range(wide):
            votes[w] += np.unpackbits(_mixed(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), axis=1, bitorder="little").tobytes()


def _root_bits(roots: int, width: int, wide: int) -> np.ndarray:
    """Which bits each root looks at: every bit is used about equally often."""
    rng, out = np.random.default_rng(3), []
    pool = np.zeros(0, np.int64)
    for _ in range(roots):
        if len(pool) < width:
            pool = rng.permutation(64 * wide)
        out.append(np.sort(pool[:width]))
        pool = pool[width:]
    return np.array(out)


def wide_links(reps: DataFrame, texts: int, wide: int = WIDE_WORDS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the candidates, texts of alike fingerprints and sizes; reps: fp (binary), size (of the set), rep."""
    roots, width = roots_for(texts)
    bits = _root_bits(roots, width, wide)
    num, den = ALIKE

    def place(batches):
        for batch in batches:
            fp = batch.column("fp")
            raw = np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(-1, 8 * wide)
            ones = np.unpackbits(raw, axis=1, bitorder="little")
            for r in range(roots):
                block = ones[:, bits[r]].astype(np.int64) @ (1 << np.arange(width))
                yield pa.RecordBatch.from_arrays([pa.array(block + (r << width), pa.int64()), fp, batch.column("size"), batch.column("rep")], ["block", "fp", "size", "rep"])

    placed = reps.where("rep IS NOT NULL").select("fp", "size", "rep").mapInArrow(place, "block long, fp binary, size long, rep long")
    keys = ["block", "lo", "hi"]
    dealt = in_parts(placed, ["block"], "rep", group).select(*keys, "fp", "size", "rep")
    dealt = dealt.repartition(parts_for(reps.sparkSession, texts * roots, ROWS_A_TASK), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for t in whole_groups(batches, keys):
            block, size, rep = (t.column(n).to_numpy() for n in ("block", "size", "rep"))
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, wide)
            new = np.zeros(len(rep), np.int64)
            new[starts_of(t, keys)] = 1
            own = np.cumsum(new) - 1
            # Below its root a trie begins with another word for each root.
            first = fp[np.arange(len(fp)), (block >> width) % wide]
            order = np.lexsort((first, own))
            size, rep, fp, first = size[order], rep[order], fp[order], first[order]
            forest = Forest(len(rep))
            for i, j in trie_pairs(first, own, np.zeros(len(rep), np.int64), FIRST_BUDGET):
                less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                fit = (den * less >= num * more) & (size[i] > 0) & (size[j] > 0)
                i, j, less = i[fit], j[fit], less[fit]
                near = np.zeros(len(i), np.int64)
                for w in range(wide):
                    near += np.bitwise_count(fp[i, w] ^ fp[j, w])
                ok = near <= np.where(less < SMALL_SET, SMALL_BUDGET, WIDE_BUDGET)
                forest.join(i[ok], j[ok])
            a, b = forest.links(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def alike_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the sets with a similarity of ALIKE or more.

    Each set that a tree has reached is compared with all sets of a fitting size that none has reached.
    """
    num, den = ALIKE
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    items = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(size)
    start = ends - size
    mark = np.zeros(int(items.max()) + 1 if len(items) else 1, bool)
    left, one, other = np.arange(len(order)), [], []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            lo, hi = np.searchsorted(size[left], [-(-num * size[i] // den), den * size[i] // num + 1])
            own = left[lo:hi]
            if not len(own):
                continue
            mark[items[start[i] : ends[i]]] = True
            at = spread(start[own], size[own])
            both = np.bincount(np.repeat(np.arange(len(own)), size[own])[mark[items[at]]], minlength=len(own))
            mark[items[start[i] : ends[i]]] = False
            near = den * both >= num * (size[i] + size[own] - both)
            if near.any():
                found = own[near]
                one.append(np.full(len(found), i))
                other.append(found)
                reached += found.tolist()
                left = np.concatenate((left[:lo], own[~near], left[hi:]))
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *one])], order[np.concatenate([none, *other])]


def alike_links(sets: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the texts of a candidate group by exact similarity; sets: grp, rep, hashes (binary), written."""
    keys = ["grp", "lo", "hi"]
    dealt = in_parts(sets, ["grp"], "rep", group).select(*keys, "rep", "hashes")
    held = sets.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0)).alias("n")).first()["n"]
    dealt = dealt.repartition(parts_for(sets.sparkSession, held, SETS_AT_ONCE), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for t in whole_groups(batches, keys, SETS_AT_ONCE):
            rep, hashes = t.column("rep").to_numpy(), t.column("hashes")
            starts = starts_of(t, keys)
            one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(rep)).tolist(), strict=True):
                if b - a > 1:
                    i, j = alike_pairs([np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in range(a, b)])
                    one.append(rep[a + i])
                    other.append(rep[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one), pa.int64()), pa.array(np.concatenate(other), pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, kind: str, fingerprinted: bool) -> DataFrame:
    """doc_id with the key of its set of shingles, and the set's fingerprint and size, or the set; texts: doc_id, text without nulls."""

    def run(batches):
        for batch, data, offs in text_batches(batches):
            raw = data.tobytes().lower()
            sets = [shingle_set(raw[a:b].split()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            packed = [s.tobytes() for s in sets]
            columns = [batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in packed], pa.binary())]
            if fingerprinted:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([wide_fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "fp", "size"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["doc_id", "key", "hashes"])

    return texts.mapInArrow(run, f"doc_id {kind}, key binary, " + ("fp binary, size long" if fingerprinted else "hashes binary"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, component_id) of the documents that aren't the least of their group."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    marked = written(shingle_sets(texts, kind, True))
    reps = written(marked.groupBy("key").agg(F.min("doc_id").cast("long").alias("rep"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    found = components(wide_links(reps, reps.count(), group=group))
    # The least text of a group has no row of its own in `found`.
    grouped = found.select("node", F.col("component").alias("grp")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("grp")).distinct())
    wanted = written(reps.join(grouped, F.col("rep") == F.col("node")).select(F.col("key").alias("key2"), "rep", "grp"))
    # Only the candidates' texts are turned into sets again; repeated rows of a representative have equal ones.
    asked = texts.join(wanted.select("rep").distinct(), F.col("doc_id").cast("long") == F.col("rep"), "left_semi")
    sets = shingle_sets(asked, kind, False).join(wanted, (F.col("key") == F.col("key2")) & (F.col("doc_id").cast("long") == F.col("rep")))
    sets = written(sets.select("grp", "rep", "key", "hashes").dropDuplicates(["rep", "key"]).drop("key"))
    roots = components(alike_links(sets, group))
    home = written(reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("key2"), F.coalesce("component", "rep").alias("component_id")))
    joined = marked.select("doc_id", "key").join(home, F.col("key") == F.col("key2"))
    gone = written(joined.where("doc_id != component_id").select("doc_id", "component_id").distinct())
    released(marked, reps, wanted, sets, home)
    return gone


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the least of its group; rows without an id stay, rows of one id stay together."""
    gone = duplicate_groups(docs, id_col, text_col).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
