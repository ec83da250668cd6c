"""Near-duplicate classes by HyperMinHash, confirmed on the texts themselves.

1. Every whole text becomes its set of word shingles and a HyperMinHash sketch
   of it: the set's hashes fall into buckets, and a bucket stores of its
   smallest hash the number of leading zeros and the next mantissa bits.
   Empty buckets borrow from the first full one of their own probe sequence,
   so that a register agrees with probability J however small the sets are.
2. Documents with one and the same set are one class and go on as one.
3. Runs of registers are bands.  A set of few shingles adds its smallest
   hashes as bands of its own, enough of them that no pair at the threshold
   can differ in all (``prefix``).  Only ids go through the bands' buckets.
   Buckets with one class are done; of buckets with the same classes one stays.
4. In each bucket every class is compared with the smallest one, by the
   collision-corrected estimate.  What may reach the threshold, five deviations
   off, is tied.  Buckets that are one component by then are done; in the
   others, whoever is not in the main component meets all of the bucket.
5. Within a cluster, pairs are confirmed on the shingles of their texts.
   Clusters (and buckets) beyond a block's size are dealt as pairs of blocks
   over many tasks; see ``tied``.
6. Confirmed links make components; the smallest id of each stays.

Tasks return spanning links only, never all pairs of a group, and components
do not need more.  Hashes propose links; each one that is returned has been
confirmed on the words themselves.  Equal sets are told by 128 bits out of
two independent hashes of every shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.graph import components
from factloom.llm.words import LOWER, SPACES, U, gram_hashes, mix, slices, spans, word_hashes
from factloom.llm.work import Workspace, partitions, spare_name

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Classes, and bytes of their texts, that one task compares with one another; larger groups are dealt as pairs of such blocks.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Sets of up to this many shingles find their partners by shared shingles as well, and are not judged by the estimate.
FEW = 16
#: Deviations of the estimate below the threshold at which a pair is given up.
SLACK = 5.3


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, n: int, lane: int = 0) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; a text of fewer than ``n`` words has one, of all its words."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, bounds, SPACES)
    words = word_hashes(buf, starts, ends, lane)
    grams = gram_hashes(words, n, lane)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield mix(gram_hashes(words[lo:hi], int(hi - lo), lane) + U(int(hi - lo)))
        else:
            yield np.zeros(0, U)


def shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """A text's shingles themselves."""
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """So many of a small set's smallest hashes that sets at the threshold share one; none of a set beyond ``FEW`` and its partners."""
    if len(s) * percent > FEW * 100:
        return s[:0]
    return s[: len(s) - -(-len(s) * percent // 100) + 1]


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each register the buckets it borrows from, one after the other."""
    t, j = np.meshgrid(np.arange(4096, dtype=U), np.arange(REGISTERS, dtype=U), indexing="ij")
    return ((mix(t * U(REGISTERS) + j + U(1)) >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty ascending sets: 6 bits of leading zeros, 10 of mantissa."""
    out, full = np.zeros((len(sets), REGISTERS), np.uint16), np.zeros((len(sets), REGISTERS), bool)
    for row, s in enumerate(sets):
        at = ((mix(s ^ U(0x5851F42D4C957F2D)) >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)[::-1]
        part, exp = np.frexp(s.astype(np.float64) + 1.0)
        code = ((64 - np.minimum(exp, 64)).astype(np.uint16) << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
        out[row, at] = code[::-1]  # the smallest is written last
        full[row, at] = True
    row, reg = np.nonzero(~full)
    for probe in _probes():
        if not len(row):
            break
        src = probe[reg]
        ok = full[row, src]
        out[row[ok], reg[ok]] = out[row[ok], src[ok]]
        row, reg = row[~ok], reg[~ok]
    for r, j in zip(row, reg):
        out[r, j] = out[r, np.flatnonzero(full[r])[0]]
    return out


def corrected(agree: np.ndarray) -> np.ndarray:
    """Jaccard out of the share of registers that agree, less those that agree by chance."""
    chance = 2.0**-MANTISSA / 3
    return (agree - chance) / (1 - chance)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard of one sketch's registers with those of many."""
    return corrected((many == one).mean(axis=1))


#: A sketch that travels: the registers and, in the place of four more, the size of the set.
_WIDTH = REGISTERS + 4


def _sketch(n: int, percent: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, buf, bounds in slices(b.column(1)):
                sets = list(shingle_sets(buf, bounds, n))
                full = [k for k, s in enumerate(sets) if len(s)]
                regs = registers([sets[k] for k in full])
                digests: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                few: list = [None] * len(sets)
                for k, r in zip(full, regs):
                    sigs[k] = r.tobytes() + len(sets[k]).to_bytes(8, "little")
                    few[k] = prefix(sets[k], percent).tobytes()
                for k, (s, t) in enumerate(zip(sets, shingle_sets(buf, bounds, n, 1))):
                    if len(s):
                        digests[k] = hashlib.blake2b(s.tobytes() + t.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(few, pa.binary())],
                    names=["doc_id", "n_shingles", "n_bytes", "digest", "sig", "few"],
                )

    return sketch


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, _WIDTH)[:, :REGISTERS].reshape(-1, BANDS, ROWS).astype(U)
            key = np.zeros(sig.shape[:2], U) + np.arange(BANDS, dtype=U)
            for r in range(ROWS):
                key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, :, r] + U(1))
            ids, few = part.column(0).to_numpy(), part.column(2).to_pylist()
            more = mix(np.frombuffer(b"".join(few), U) + U(1))
            ids = np.concatenate([np.repeat(ids, BANDS), np.repeat(ids, [len(x) // 8 for x in few])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key.reshape(-1), more]).view(np.int64)), pa.array(ids)], names=["bk", "cid"])


def _like(one: np.ndarray, many: np.ndarray, least: float, percent: int) -> np.ndarray:
    """Which of ``many`` sketches may be linked with ``one`` (or each with its own): by estimate, or small sets of fitting size."""
    a, b = (x[..., REGISTERS:].copy().view(np.int64)[..., 0] for x in (one, many))
    small, large = np.minimum(a, b), np.maximum(a, b)
    agree = (many[..., :REGISTERS] == one[..., :REGISTERS]).mean(axis=-1)
    return (corrected(agree) >= least) | ((small <= FEW) & (100 * small >= percent * large))


def _stars(least: float, percent: int):
    """Rows (a, b, one, many), many the other's sketch, to those whose sketches may be linked."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, many = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, _WIDTH) for k in (2, 3))
            ok = pa.array(_like(one, many, least, percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return stars


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


@dataclass
class Pairs:
    """How the items of a group are compared: ``propose`` yields (k, items after k that look linked with it), ``sure`` confirms one pair."""

    propose: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray]]]
    sure: Callable[[bytes, bytes], bool] = lambda one, two: True


def alike(least: float, percent: int) -> Pairs:
    """Pairs of sketches that may be linked."""

    def propose(items: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        regs = np.frombuffer(b"".join(items), np.uint16).reshape(len(items), -1)
        for k in range(len(items) - 1):
            yield k, np.flatnonzero(_like(regs[k], regs[k + 1 :], least, percent)) + k + 1

    return Pairs(propose)


def linked(n: int, percent: int) -> Pairs:
    """Pairs of texts with 100 * intersection >= percent * union of their shingles."""

    def propose(items: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        buf = np.frombuffer(b"".join(items), np.uint8)
        sets = list(shingle_sets(buf, np.cumsum([0, *map(len, items)]), n))
        size = np.array([len(s) for s in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        run = np.diff(np.append(new, len(values)))
        distinct = values[new]
        for k, s in enumerate(sets):
            at = np.searchsorted(distinct, s)
            at = at[run[at] > 1]
            n_at = run[at]
            if not len(n_at):
                continue
            where = np.repeat(new[at] - np.concatenate([[0], np.cumsum(n_at)[:-1]]), n_at) + np.arange(int(n_at.sum()))
            both = np.bincount(owner[where], minlength=len(sets))
            hit = np.flatnonzero(100 * both >= percent * (size + size[k] - both))
            yield k, hit[hit > k]

    def sure(one: bytes, two: bytes) -> bool:
        a, b = shingles(one, n), shingles(two, n)
        both = len(a & b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    return Pairs(propose, sure)


def _compare(pairs: Pairs):
    """Streams rows (g, lo, hi, block, label, cid, item), sorted by group, and returns each group's spanning links.

    Rows with one label are known to be tied.  A group with a negative ``lo``
    holds rows of block ``lo`` to be compared with those of block ``hi``, which
    are not compared with each other.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, blocks, known, items = None, [], [], [], []
        out: list[tuple[int, int]] = []
        task: dict[int, int] = {}  # the task's own forest: what one group has tied, the next need not report

        def root(x: int) -> int:
            while (up := task.setdefault(x, x)) != x:
                task[x] = x = task[up]
            return x

        def close() -> None:
            if len(ids) < 2:
                return
            order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
            who, block, what = [ids[k] for k in order], [blocks[k] for k in order], [items[k] for k in order]
            forest, cross, told, first = _Forest(len(who)), [], [], {}
            for k, at in enumerate(order):
                forest.join(k, first.setdefault(known[at], k))

            def tie(k: int, h: int) -> bool:
                new = forest.root(k) != forest.root(h) and pairs.sure(what[k], what[h])
                if new:
                    forest.join(k, h)
                return new

            for k, hits in pairs.propose(what):
                for h in hits.tolist():
                    if block[k] != block[h]:
                        cross.append((k, h))
                    elif now[1] >= 0:
                        tie(k, h)
            if now[1] == now[2]:
                told = [(who[k], who[forest.root(k)]) for k in range(len(who))]
            else:
                # Ties within a settled block are told by the block's own group; here only what ties the two.
                told = [(who[k], who[h]) for k, h in cross if tie(k, h)]
            for x, y in told:
                x, y = root(x), root(y)
                if x != y:
                    task[max(x, y)] = min(x, y)
                    out.append((max(x, y), min(x, y)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out.clear()
            return made

        for b in batches:
            for g, lo, hi, block, label, cid, item in zip(*(c.to_pylist() for c in b.columns)):
                if (g, lo, hi) != now:
                    close()
                    now, ids, blocks, known, items = (g, lo, hi), [], [], [], []
                ids.append(cid)
                blocks.append(block)
                known.append(label)
                items.append(item)
            if len(out) > 50_000:
                yield batch()
        close()
        yield batch()

    return compare


_KEY = ["g", "lo", "hi"]


def _ties(rows: DataFrame, pairs: Pairs) -> DataFrame:
    """(a, b) of what is tied within the groups of ``rows``, a table's, dealt by ranges so that each task has its share."""
    rows = rows.select(*_KEY, "block", "label", "cid", "item")
    return rows.repartitionByRange(partitions(rows.sparkSession, rows), *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compare(pairs), "a long, b long")


def blocks_of(n, size) -> Column:
    """How many blocks a group of ``n`` items of ``size`` bytes makes."""
    return F.ceil(F.greatest(n / F.lit(BLOCK), size / F.lit(BLOCK_BYTES), F.lit(1))).cast("int")


def tied(rows: DataFrame, pairs: Pairs, ws: Workspace, name: str) -> DataFrame:
    """(a, b), edges that span all ties within the groups of ``rows``, a table (g, nb, cid, item), nb being the group's blocks.

    A group of up to two blocks compares all.  A larger one first compares
    each block with itself and with its first block, a sample of the group by
    hash: in a group of copies this ties nearly all.  Whoever is not in the
    group's main component then meets all of the group, so no tie between
    different components is missed; ties within one need no looking for.
    """
    rows = rows.withColumn("block", _block()).withColumn("label", F.col("cid"))
    others = F.when((F.col("nb") <= 2) | (F.col("block") == 0), _every()).otherwise(F.array(F.lit(0), F.col("block")))
    first = rows.withColumn("other", F.explode(others)).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    found = ws.table(_ties(first, pairs), f"{name}-ties")
    large = rows.where("nb > 2")
    if large.select("g").limit(1).isEmpty():
        return found
    labels = components(found, ws, f"{name}-first")
    ours = large.drop("label").join(labels, F.col("cid") == F.col("node"), "left").select("g", "nb", "cid", F.length("item").cast("long").alias("size"), F.coalesce("label", "cid").alias("label"))
    return _edges(labels).union(outsiders(ours, large.select("g", "cid", "item"), pairs, ws, name))


def _block() -> Column:
    return F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")


def _every() -> Column:
    return F.sequence(F.lit(0), F.col("nb") - 1)


def outsiders(ours: DataFrame, items: DataFrame, pairs: Pairs, ws: Workspace, name: str) -> DataFrame:
    """(a, b), the ties of whoever is not in the main component of its group with all of the group.

    ``ours`` is (g, nb, cid, size, label), the label being the component, and
    ``items`` has each cid's item (or that of each g and cid).  Of a group that
    is but for a few one component, every member goes on once for each block of
    those few, not once for each block of the group.
    """
    ours = ws.table(ours, f"{name}-ours")
    main = ours.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    apart = ours.join(main, "g").where("label <> main").drop("main")
    parts = apart.groupBy("g").agg(blocks_of(F.count("*"), F.sum("size")).alias("parts"))
    part = (-1 - F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts"))).cast("int")
    one = apart.join(parts, "g").select("g", "cid", "label", part.alias("lo"), F.explode(_every()).alias("hi")).withColumn("block", F.col("lo"))
    two = ours.join(parts, "g").select("g", "cid", "label", F.explode(F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: -k)).alias("lo"), _block().alias("hi")).withColumn("block", F.col("hi"))
    on = [c for c in ("g", "cid") if c in items.columns]
    meet = ws.table(one.unionByName(two).join(items.hint("merge"), on), f"{name}-meet")
    more = ws.table(_ties(meet, pairs), f"{name}-more")
    ws.drop(f"{name}-ours", f"{name}-meet")
    return more


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def clusters(classes: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """(node, label) of classes (cid, sig, few) whose sketches may be linked, over one another."""
    deviation = (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    least = percent / 100 - SLACK * deviation
    bands = classes.select("cid", "sig", "few").mapInArrow(_bands, "bk long, cid long")
    shape = bands.groupBy("bk").agg(F.count("*").alias("n"), F.min("cid").alias("m"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("bit_xor(xxhash64(cid, 7))").alias("y"))
    once = shape.where("n > 1").groupBy("n", "m", "x", "y").agg(F.min("bk").alias("bk")).select("bk", "n", "m")
    once = ws.table(once, "buckets")
    entries = ws.table(bands.join(once.hint("merge"), "bk"), "entries")  # as many buckets as the data have; never a broadcast

    star = entries.where("cid <> m").select("m", "cid").distinct()
    star = star.join(classes.select("cid", F.col("sig").alias("one")), "cid").join(classes.select(F.col("cid").alias("m"), F.col("sig").alias("many")), "m")
    ties = ws.table(star.select("cid", "m", "one", "many").mapInArrow(_stars(least, percent), "a long, b long"), "star-ties")
    labels = components(ties, ws, "stars")

    entries = entries.join(labels, F.col("cid") == F.col("node"), "left").select("bk", "n", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = entries.groupBy("bk").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bk")
    rest = entries.join(mixed.hint("merge"), "bk").select(F.col("bk").alias("g"), blocks_of(F.col("n"), F.lit(0)).alias("nb"), "cid", F.lit(0).alias("size"), "label")
    more = outsiders(rest, classes.select("cid", F.col("sig").alias("item")), alike(least, percent), ws, "rest")
    ws.drop("buckets", "entries")
    return components(_edges(labels).union(more), ws, "clusters")


def near_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Defined results: texts without words have no shingles and link with
    nothing.  Documents with equal sets are linked, so repeated rows are one
    class and each is reported.  A row with a null id links with nothing, has
    a null component and is kept.  An empty input gives an empty result.  Other
    columns are not read.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, n_shingles long, n_bytes long, digest binary, sig binary, few binary"
    sketches = ws.table(slim.mapInArrow(_sketch(shingle, percent), shape), "sketches")
    known = sketches.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig"), F.first("few").alias("few"), F.max("n_bytes").alias("size"))
    classes = ws.table(classes, "classes")
    found = clusters(classes, percent, ws)

    own = found.join(classes.select("cid", "size", "digest"), F.col("node") == F.col("cid"))
    sizes = own.groupBy("label").agg(blocks_of(F.count("*"), F.sum("size")).alias("nb"))
    members = own.join(sizes, "label").select("cid", "label", "nb", F.col("digest").alias("own_digest"))
    # A class is read from one of the rows with its smallest id that have its set.
    # Both sides are dealt by id at every size: the members are no table of a bounded size to broadcast.
    texts = slim.join(members.hint("merge"), F.col("doc_id") == F.col("cid")).select("cid", "label", "nb", F.col("text").cast("binary").alias("item"), "own_digest")
    if _repeats(sketches):
        texts = texts.mapInArrow(_with_digest(shingle), "cid long, label long, nb int, item binary, own_digest binary, digest binary").where("digest = own_digest").dropDuplicates(["cid", "digest"])
    sets = ws.table(texts.select(F.col("label").alias("g"), "nb", "cid", "item"), "sets")
    links = components(tied(sets, linked(shingle, percent), ws, "links"), ws, "links")
    ws.drop("sets")

    of_class = classes.join(links, F.col("cid") == F.col("node"), "left").select("digest", F.coalesce("label", "cid").alias("class_id"))
    with_set = known.select("doc_id", "n_shingles", "digest").join(of_class, "digest").select("doc_id", "n_shingles", F.col("class_id").alias("component_id"))
    without = sketches.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.union(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeats(sketches: DataFrame) -> bool:
    """Whether an id has several rows (then one id may name several classes)."""
    return not sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _with_digest(n: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, bounds in slices(b.column(3).cast(pa.string())):
                both = zip(shingle_sets(buf, bounds, n), shingle_sets(buf, bounds, n, 1))
                digests = [hashlib.blake2b(s.tobytes() + t.tobytes(), digest_size=16).digest() for s, t in both]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(digests, pa.binary())], names=[*b.schema.names, "digest"])

    return add


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: those of each component's smallest id."""
    gone_id = spare_name("gone_id", docs.columns)
    gone = near_classes(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col(gone_id), "left_anti")
