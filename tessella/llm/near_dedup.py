"""Near-duplicate detection by HyperMinHash signatures, banding and exact confirmation.

A document's set holds its distinct shingles: runs of ``width`` words, lower-cased A-Z, words being runs of anything but
ASCII white space. A text with fewer words has its whole sequence as the one shingle; a null or wordless text has the
empty set and links with nothing. Two documents link where ``100 * intersection >= percent * union``.

Stages, all of them distributed:

1. One pass over the texts makes a row per document: set size, a 128-bit digest of the set, and the registers.
   A shingle's hash picks a register; the register keeps the smallest of the rest of the hash, compressed to the count
   of its leading zeros and its next mantissa bits. Registers that no shingle picked are filled with the smallest of a
   second hash family over all shingles, marked as such, so small sets have full signatures and each register of two
   sets still agrees with the probability of their similarity.
2. Documents with equal digests form a class, numbered in the order of its smallest doc_id. Digests are dealt over SALTS
   parts each before anything is joined on them, so a group of copies of any size is spread; the rest works on classes,
   where such a group is one row.
3. Bands of registers are hashed; each bucket's smallest class is its hub, and each member pairs with the hub.
   Candidate pairs must pass a size bound and the collision-corrected estimate of their similarity, and are then
   confirmed on the full sets. Connected components follow from alternating star contractions.
4. Members of a bucket that are still in different components are compared with each other (members outside the bucket's
   largest component against all of it), so no link between components is missed for lack of a common hub. Small buckets
   give pairs by a join. Large ones are cut into blocks by a hash of the id; a task takes a block of each side with
   signatures and sets, and gives out nothing but confirmed links, each pair in the first band that it shares.

Pairs inside one component are never needed, so a bucket of n near copies costs about n comparisons and not n squared.
With 32 bands of 5 registers, a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**32, 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, removed, small, written

#: Parts over which the rows of one digest, or of one component, are dealt for joins.
SALTS = 64
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Bits of mantissa in a register; six bits hold the leading zeros (0 to 63), one marks a register filled by the second family.
MANTISSA = 9
#: Registers that agree by accident are expected from their count of states; the estimate must reach this.
LEAST_ESTIMATE = 0.62
#: Four bits of each register screen pairs inside the join of a bucket with itself: at least so many of the REGISTERS must
#: agree. At similarity 0.8, 130 do on average, and under 103 in 2 of a hundred million pairs.
WORDS, SCREEN = REGISTERS // 16, 103
#: Members of a bucket from which on it is compared in blocks, and members of a block.
LARGE, BLOCK = 32, 256

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of ``x``."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = len(words) if len(words) < width else width
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, _U(n))
        for i in range(n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set's sorted hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


with np.errstate(over="ignore"):
    _SALTS = mix(np.arange(1, REGISTERS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def _compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros and the mantissa bits that follow the leading one, of 64-bit values."""
    # frexp rounds to 53 bits; dropping the low 12 first keeps the exponent right
    _, e = np.frexp((values >> _U(12)).astype(np.float64))
    zeros = (52 - e).astype(_U)
    body = np.where(zeros < 52, (values << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA), _U(0))
    return (zeros << _U(MANTISSA) | body).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The signature of a set: REGISTERS unsigned 16-bit values. Zeroes for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    with np.errstate(over="ignore"):
        slot = (mix(hashes ^ _U(0xA24BAED4963EE407)) % _U(REGISTERS)).astype(np.int64)
        value = mix(hashes + _U(0x9FB21C651E98DF25))
        least = np.full(REGISTERS, ~_U(0))
        np.minimum.at(least, slot, value)
        filled = np.zeros(REGISTERS, bool)
        filled[slot] = True
        out = _compress(least)
        if not filled.all():
            empty = np.flatnonzero(~filled)
            low = np.full(len(empty), ~_U(0))
            for at in range(0, len(hashes), 4096):  # bounded memory for long texts
                part = hashes[at : at + 4096]
                low = np.minimum(low, mix(part[:, None] * _SALTS[empty] + _SALTS[empty]).min(axis=0))
            out[empty] = _compress(low) | np.uint16(0x8000)
    return out


_SHIFTS = np.arange(0, 64, 4, dtype=_U)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sigs, bits = [], [], [], []
            for text in b.column(2):
                h = shingle_hashes(text.as_py(), width)
                sizes.append(len(h))
                digests.append(digest(h))
                r = registers(h)
                sigs.append(r.astype("<u2").tobytes())
                bits.append(((r & 15).astype(_U).reshape(WORDS, 16) << _SHIFTS).sum(axis=1, dtype=_U).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "digest", "sig", "bits"])

    return run


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which finds a row's text again) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, mark, n (set size), digest (of the set), sig (registers) and bits (four of each register) of every document, in one pass over the texts."""
    return in_arrow(_plain(docs), _signatures(width), "doc_id long, mark long, n long, digest binary, sig binary, bits array<long>")


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers of sets of n and m elements that agree although their smallest hashes differ: the sum
    over all register states of the product of their probabilities. A minimum over k hashes lies in [x, y) with
    probability (1-x)**k - (1-y)**k."""
    top = 2.0 ** -np.arange(0, 40)
    steps = 1 << min(MANTISSA, 5)  # states within one leading-zero count differ little; their product is spread evenly
    lo = (top[:, None] / 2 * (1 + np.arange(steps) / steps)).ravel()
    hi = (top[:, None] / 2 * (1 + np.arange(1, steps + 1) / steps)).ravel()
    out = np.zeros(len(n))
    for i, (a, b) in enumerate(zip(np.maximum(n / REGISTERS, 1.0), np.maximum(m / REGISTERS, 1.0))):
        pa_, pb = ((np.power(1 - lo, k) - np.power(1 - hi, k)) for k in (a, b))
        out[i] = (pa_ * pb).sum() * steps / (1 << MANTISSA)
    return out


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose collision-corrected estimate is not clearly under the threshold."""
    seen: dict[tuple[int, int], float] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
        agree = (x == y).mean(axis=1)
        sizes = np.stack([b.column("n_a").to_numpy(), b.column("n_b").to_numpy()], axis=1)
        grade = np.ceil(np.log2(np.maximum(sizes, 1)) * 2).astype(int)  # half powers of two are close enough
        for g in map(tuple, np.unique(grade, axis=0)):
            if g not in seen:
                seen[g] = float(accidental(np.array([2 ** (g[0] / 2)]), np.array([2 ** (g[1] / 2)]))[0])
        chance = np.array([seen[tuple(g)] for g in grade])
        keep = pa.array((agree - chance) / (1 - chance) >= LEAST_ESTIMATE)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def _unpack(b: bytes) -> np.ndarray:
    """A set's sorted hashes, all 64 bits of each."""
    return np.frombuffer(b, "<u8")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in found], pa.binary()), pa.array([h.astype("<u8").tobytes() for h in found], pa.binary())], names=["digest", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, _U))
        for b in batches:
            keep = []
            for s, t in zip(b.column("items_a"), b.column("items_b")):
                if (s := s.as_py()) != last[0]:
                    last = (s, _unpack(s))
                x, y = last[1], _unpack(t.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def _alike(x: str, y: str):
    """At least SCREEN registers agree in their four bits; columns x0, x1, ... and y0, y1, ..."""
    differ = F.lit(0)
    for i in range(WORDS):
        z = F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(z)
    return differ <= REGISTERS - SCREEN


def _blocks(percent: int):
    """Confirmed links (a, b) between the two sides of a block pair: side 0 has members outside the bucket's largest
    component, side 1 all members."""

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        t, k = t.take(pa.array(order)), int((side == 0).sum())
        ids, n, comp, minor = (t.column(c).to_numpy() for c in ("id", "n", "component", "minor"))
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, REGISTERS)
        band = t.column("band")[0].as_py()
        items = t.column("items")
        sets: dict[int, np.ndarray] = {}
        joined: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _unpack(items[i].as_py())
            return sets[i]

        for i in range(k):
            ok = (comp[k:] != comp[i]) & (~minor[k:] | (ids[k:] > ids[i]))
            ok &= 100 * np.minimum(n[k:], n[i]) >= percent * np.maximum(n[k:], n[i])
            rows = k + np.flatnonzero(ok)
            same = sigs[rows] == sigs[i]
            agree = same.mean(axis=1)
            near = agree >= LEAST_ESTIMATE  # accidental agreement only adds
            for j, eq in zip(rows[near], same[near]):
                pair = (comp[i], comp[j])
                if pair in joined or int(eq.reshape(BANDS, ROWS).all(axis=1).argmax()) != band:
                    continue
                x, y = of(i), of(j)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    joined.add(pair)
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component), a stored table: the smallest id reachable over the undirected edges (a, b), for every id of an edge.

    Alternates large-star and small-star contractions until the edges no longer change. Each round is two aggregations
    and joins on the edges, written to the shared folder. Ids without an edge are left out; equal ends are ignored."""
    spark = edges.sparkSession
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour of a node points to the smallest node seen there
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, point to the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = written(nxt, "edges")
        mark = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        removed(spark, now)
        now = nxt
        if mark == before:
            break
        before = mark
    out = written(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), "components")
    removed(spark, now)
    return out


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def links(docs: DataFrame, sigs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between classes, enough of them that the classes' components are those of all links.

    ``sigs`` has the signatures of ``docs`` by row, ``classes`` an id and one row of each class; both are stored tables."""
    spark = docs.sparkSession
    reps = written(sigs.join(classes.select("id", "row"), "row").select("id", "doc_id", "mark", "digest", "n", "sig", "bits"), "reps")
    bands = reps.select("id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").select("bucket", "hub")
    buckets = written(bands.join(hubs, "bucket"), "buckets")  # only buckets of two and more

    involved = written(reps.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "mark", "digest"), "involved")
    picked = _plain(docs).join(small(involved.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi").select("text")
    hashed = in_arrow(picked, _sets(width), "digest binary, items binary").groupBy("digest").agg(F.first("items").alias("items"))  # rows may be repeated
    sets = written(hashed.join(involved.select("id", "digest"), "digest").select("id", "items"), "sets")
    sizes, close = reps.select("id", "n", "sig"), f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that pass the size bound, the estimate and the full sets."""
        p = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        p = written(in_arrow(p.where(close).select("a", "b", "n_a", "n_b", "sig_a", "sig_b"), _estimates, "a long, b long"), "likely")
        q = p.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
        out = written(in_arrow(q.select("a", "b", "items_a", "items_b"), _confirm(percent), "a long, b long"), "links")
        removed(spark, p)
        return out

    to_hubs = confirmed(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    first = components(to_hubs)
    # Members of a bucket in other components than most of the bucket, against the bucket.
    placed = buckets.join(first, "id", "left").select("bucket", "band", "id", "n", "hub", F.coalesce("component", "id").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k"), F.sum("c").alias("members")).where("k > 1").select("bucket", F.col("m.component").alias("main"), (F.col("members") - F.col("m.c")).alias("minors"), "members")
    several = written(placed.join(main, "bucket").withColumn("minor", F.col("component") != F.col("main")), "mixed")
    screens = reps.select("id", *[F.col("bits")[i].alias(f"s{i}") for i in range(WORDS)])
    mixed = several.where(f"members <= {LARGE}").join(screens, "id")
    x = mixed.where("minor").select("bucket", F.col("id").alias("xi"), F.col("n").alias("xn"), F.col("component").alias("xc"), "hub", *[F.col(f"s{i}").alias(f"x{i}") for i in range(WORDS)])
    y = mixed.select(F.col("bucket").alias("_b"), F.col("id").alias("yi"), F.col("n").alias("yn"), F.col("component").alias("yc"), *[F.col(f"s{i}").alias(f"y{i}") for i in range(WORDS)])
    unlike = F.expr(f"xc <> yc and xi <> hub and yi <> hub and 100 * least(xn, yn) >= {percent} * greatest(xn, yn)")
    more = x.join(y, (F.col("bucket") == F.col("_b")) & unlike & _alike("x", "y"))
    more = confirmed(more.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct())
    large = several.where(f"members > {LARGE}").join(reps.select("id", "sig"), "id").join(sets, "id").select("bucket", "band", "id", "n", "component", "minor", "sig", "items", F.ceil(F.col("minors") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("members") / BLOCK).cast("int").alias("ny"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = large.where("minor").withColumns({"side": F.lit(0), "bx": part("nx"), "by": every("ny")}).union(large.withColumns({"side": F.lit(1), "bx": every("nx"), "by": part("ny")}))
    within = sides.drop("nx", "ny").groupBy("bucket", "bx", "by").applyInArrow(_blocks(percent), "a long, b long")
    out = written(to_hubs.union(more).union(within), "links")
    removed(spark, reps, buckets, involved, sets, to_hubs, first, several, more)
    return out


def _of_one_id(full: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(a, b): the first class of each of the ``repeated`` doc_ids with its other classes."""
    of = full.select("doc_id", "digest").join(repeated, "doc_id").distinct().join(classes.select("digest", "id"), "digest").select("doc_id", "id", _salt("id"))
    least = of.groupBy("doc_id").agg(F.min("id").alias("a")).select("doc_id", "a", _every_salt())
    return of.join(least, ["doc_id", "salt"]).where("id <> a").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Null and wordless texts: n_shingles 0, a component of their own, kept. Repeated rows of a doc_id give a row each; where
    their texts differ, the doc_id links them: it and all that any of its texts links with are one component. A null
    doc_id gives a row with a null component, kept. Columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, width).withColumn("row", F.monotonically_increasing_id()), "sigs")
    full = sigs.where("n > 0 and doc_id is not null")
    # rows of a digest meet in SALTS parts, then the parts
    parts = full.groupBy("digest", _salt("row")).agg(F.min(F.struct("doc_id", "row", "mark")).alias("m"), F.count("*").alias("c"))
    groups = parts.groupBy("digest").agg(F.min("m").alias("m"), F.sum("c").alias("c")).select("digest", "m.doc_id", "m.row", "c")
    # ids in the order of doc_ids, so that the smallest class of a component has its smallest doc_id
    classes = written(groups.orderBy("doc_id", "row").withColumn("id", F.monotonically_increasing_id()), "classes")
    found = links(docs, sigs, classes, width, percent)
    mark = F.xxhash64("digest")
    repeated = written(full.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    edges = found if repeated.isEmpty() else found.union(_of_one_id(full, classes, repeated))
    placed = components(edges)
    roots = classes.join(placed.select("component").distinct(), F.col("id") == F.col("component")).select("component", F.col("doc_id").alias("root"), _every_salt())
    named = placed.select("id", "component", _salt("id")).join(roots, ["component", "salt"]).select("id", "root")
    labels = classes.join(named, "id", "left").where("c > 1 or root is not null").select("digest", F.coalesce("root", "doc_id").alias("component_id"))
    salted = written(parts.select("digest", "salt").join(labels, "digest"), "labels")
    removed(spark, classes, found, repeated, placed)
    out = sigs.select("doc_id", "n", "digest", _salt("row")).join(salted, ["digest", "salt"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which one per component of texts stays, all their columns unchanged: that with the smallest doc_id, rows
    without one last. A row counts by its text, not by its doc_id, and goes only where its own text, or one that links with
    it, stays: repeated rows are copies, whatever their doc_id, and different texts under one doc_id are documents of their
    own. Rows without a word count as copies only under one doc_id."""
    names = docs.columns
    # rows get their numbers once, in a table: they would change if the scan were planned anew
    rows = written(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("_row")), "rows")
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), text.alias("text")), width, percent).select(F.col("doc_id").alias("_r"), "n_shingles", "component_id")
    placed = found.join(rows.select("_row", doc_id.cast("long").alias("_id")), F.col("_r") == F.col("_row"))
    group = F.when((F.col("n_shingles") > 0) | F.col("_id").isNull(), F.col("component_id"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    placed = placed.select("_row", "_id", group.alias("g"), F.when(group.isNull(), F.col("_id")).alias("h"))
    best = placed.groupBy("g", "h").agg(first.alias("m")).select(F.col("m._row").alias("_best"))
    gone = written(placed.join(best, F.col("_row") == F.col("_best"), "left_anti").select(F.col("_row").alias("_gone")), "gone")
    kept = rows.join(small(gone), F.col("_row") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
