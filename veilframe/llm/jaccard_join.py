"""N-gram Jaccard self-join: size-aware, heavy and light.

A document's set holds its distinct five-word shingles, as 64-bit hashes.
Documents of equal sets form a class; classes link when their Jaccard
similarity is 0.75 or more, decided exactly on whole sets of those hashes.

1. Shingles are counted over all documents.  Each text block sends its distinct
   shingles, cut into ranges, and gets back a frequency class for each; no
   shingle leaves as a row.  Rarest first is the global order.
2. A set of s needs an overlap of o = ceil(0.75 s), so two linked sets share a
   shingle among their first s - o + 1, and two among their first s - o + 2.
   Shingles that occur once come first in the order and match nothing; most
   documents end here.  One document of each class that is left goes on, in
   blocks of such sets, which stay where they are.
3. Light sets (few shingles left) enumerate their 2-subsets and meet light
   sets by equal subsets; heavy sets scan the inverted lists of single
   shingles, which hold all sets.  The boundary is the one of least cost:
   subsets enumerated plus list entries written and read.  Lists are met the
   way frequencies are: a block sends its keys and learns what it must know.
4. A list isn't expanded into pairs.  Each member is first compared with the
   list's oldest member (of the smallest id, often the original of the others), and what that links forms components.  Then only
   members of different components whose sizes are near enough can still
   matter: size levels (a factor 0.75 apart) cut the lists, blocks learn which
   of their entries meet another component at such a level, and those are
   compared block by block: bitmaps bound the overlap, whole sets decide.

Defined cases: a text of fewer than five words has its whole sequence as one
shingle; without words (or null) the set is empty and linked with nothing;
null ids join classes like any row but never name a component unless the
component has no other id; repeated rows, and rows that share an id, are rows
of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency, shared
from . import textvec as tv
from .components import components

BITMAP = 2048
CHUNK = 1024
#: A class's number is its block's number and its place there.
PLACE = 20
SETS_BYTES = 4 << 20
CAND = "block_id long, cls binary, age binary, n binary, most binary, norm binary, size binary, toks binary, sets binary"
NONE = np.uint64((1 << 64) - 1)
LAST = (1 << 63) - 1
#: Turns signed numbers into unsigned ones of the same order.
SIGN = np.uint64(1 << 63)
#: Pairs that are compared at once.
PAIRS = 1 << 15


def sets_of_block(row: dict):
    ids, known, data, offs = shared.open_block(row)
    u, at = tv.distinct_per_text(*tv.shingles(*tv.word_hashes(data, offs)))
    return ids, known, u, at


def prefixes(row: dict, answers: str):
    """For each text of a block: its id, class, set size, shared shingles, and the rest of its prefix with the length of the first part (None if it can't link)."""
    ids, known, u, at = sets_of_block(row)
    q = frequency.read(u, answers, row["block_id"])
    m1, m2 = tv.mix(u), tv.mix(u * tv.U(0xD6E8FEB86659FD93) + tv.U(1))
    for i in range(len(ids)):
        a, b = at[i], at[i + 1]
        s = int(b - a)
        doc = int(ids[i]) if known[i] else None
        if not s:
            yield doc, None, 0, None, None
            continue
        cls = np.array([m1[a:b].sum(), m2[a:b].sum() + tv.U(s)], "<u8").tobytes()
        p = s - (3 * s + 3) // 4 + 1
        x, y = u[a:b], q[a:b]
        single = int(np.count_nonzero(y == 0))
        if s < 2 or single > p:
            yield doc, cls, s, None, None
            continue
        rest = np.flatnonzero(y)
        often = x[rest]
        rest = rest[np.lexsort((x[rest], y[rest]))][: p + 1 - single]
        yield doc, cls, s, often, (x[rest], max(0, min(p - single, len(rest))))


def bitmap(x: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(x >> tv.U(53)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def level_of(n: np.ndarray) -> np.ndarray:
    """Sizes that can link are at most one level apart."""
    return (1 + np.floor(np.log(n) / (np.log(4 / 3) * (1 + 1e-6)))).astype(np.uint8)


class Sets:
    """A block of classes: sizes, prefixes and shared shingles of each."""

    def __init__(self, row: dict):
        self.age = np.frombuffer(row["age"], "<i8")
        self.n = np.frombuffer(row["n"], "<i4").astype(np.int64)
        self.most, self.norm = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("most", "norm"))
        self.toks, self.sets = np.frombuffer(row["toks"], "<u8"), np.frombuffer(row["sets"], "<u8")
        self.cut, self.at = np.concatenate([[0], np.cumsum(self.most)]), np.concatenate([[0], np.cumsum(np.frombuffer(row["size"], "<i4").astype(np.int64))])
        self.number = np.int64(row["block_id"] << PLACE) + np.arange(len(self.n))

    def set(self, i: int) -> np.ndarray:
        return self.sets[self.at[i] : self.at[i + 1]]

    def keys(self, light: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in ascending order, whose they are, and whether they count by themselves: a shingle of a light set doesn't."""
        is_light = self.most <= light
        who = np.repeat(np.arange(len(self.n)), self.norm)
        spot = np.arange(len(who)) - np.repeat(np.cumsum(self.norm) - self.norm, self.norm) + np.repeat(self.cut[:-1], self.norm)
        key, own, counts = [self.toks[spot]], [who], [~is_light[who]]
        for i in np.flatnonzero(is_light & (self.most > 1)).tolist():
            s = np.sort(self.toks[self.cut[i] : self.cut[i + 1]])
            pairs = np.array(list(itertools.combinations(range(len(s)), 2)))
            key.append(tv.mix(s[pairs[:, 0]] * tv.U(0x9E3779B97F4A7C15) + tv.mix(s[pairs[:, 1]])))
            own.append(np.full(len(pairs), i))
            counts.append(np.ones(len(pairs), bool))
        key, own, counts = np.concatenate(key), np.concatenate(own), np.concatenate(counts)
        order = np.lexsort((self.age[own], key))
        return key[order], own[order], counts[order]


def mark(docs: DataFrame, rest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The text blocks; every row with its class, set size and place; and blocks of one set of each class that may link."""
    n = shared.parts(docs.sparkSession)
    staged = shared.stage_blocks(docs, "jaccard-blocks", rest=rest)
    blocks = staged.select("block_id", "ids", "known", "lens", "payload")
    answers = frequency.replies(blocks, n, lambda r: sets_of_block(r)[2], "replies")

    def label(batches):
        for r in shared.block_rows(batches):
            rows, first = [], {}
            for i, (doc, cls, s, often, prefix) in enumerate(prefixes(r, answers)):
                rows.append([doc, cls, s, i, None, None, None])
                if prefix and (LAST if doc is None else doc, i) < first.get(cls, ((LAST, i + 1),))[0]:
                    first[cls] = (LAST if doc is None else doc, i), often, prefix
            for (_, i), often, (toks, norm) in first.values():  # of the block's copies one goes on
                rows[i][4:] = norm, toks.astype("<u8").tobytes(), often.astype("<u8").tobytes()
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r["block_id"]] * len(rows), pa.int64())], ["doc_id", "cls", "n", "nth", "norm", "toks", "own", "block_id"])

    marked = shared.staged(blocks.mapInArrow(shared.task(label), "doc_id long, cls binary, n long, nth int, norm int, toks binary, own binary, block_id long"), "jaccard-marked")
    open_ = marked.filter("norm is not null")
    one = open_.groupBy("cls").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)), "block_id", "nth")).alias("at"))
    chosen = frequency.filed(one.groupBy(F.col("at.block_id").alias("block_id")).agg(F.collect_list("at.nth").alias("value")), "jaccard-chosen")

    def gather(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 22, [], 0

        def flush():
            nonlocal block, held, size
            cls, age, s, toks, norm, own = zip(*held, strict=True)
            small = [np.array(x, "<i4").tobytes() for x in (s, [len(t) // 8 for t in toks], norm, [len(x) // 8 for x in own])]
            fields = [b"".join(cls), np.array(age, "<i8").tobytes(), *small, b"".join(toks), b"".join(own)]
            out = pa.record_batch([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in fields)], [c.split()[0] for c in CAND.split(", ")])
            block, held, size = block + 1, [], 0
            return out

        at = wanted = None
        for r in shared.block_rows(batches):
            if r["block_id"] != at:
                at, wanted = r["block_id"], set(frequency.fetch(chosen, r["block_id"]))
            if r["nth"] in wanted:
                held.append((r["cls"], LAST if r["doc_id"] is None else r["doc_id"], r["n"], r["toks"], r["norm"], r["own"]))
                size += len(r["own"])
                if size >= SETS_BYTES or len(held) >> PLACE:
                    yield flush()
        if held:
            yield flush()

    cands = shared.staged(open_.mapInArrow(shared.task(gather), CAND), "jaccard-sets")
    for folder in (answers, chosen):
        shared.remove(docs.sparkSession, folder)
    return staged, marked, cands


def boundary(cands: DataFrame) -> int:
    """The largest number of prefix shingles up to which enumerating 2-subsets costs less than scanning lists.

    A list is compared with its first member, so a scan costs an entry
    written and one read, not the list's length for each member.
    """

    def sizes(batches):
        count, scan = np.zeros(513, np.int64), np.zeros(513, np.int64)
        for r in shared.block_rows(batches):
            s = Sets(r)
            np.add.at(count, np.minimum(s.most, 512), 1)
            np.add.at(scan, np.minimum(s.most, 512), 2 * s.norm)
        m = np.flatnonzero(count)
        yield pa.record_batch([pa.array(m), pa.array(count[m]), pa.array(scan[m])], ["m", "c", "s"])

    found = cands.mapInArrow(shared.task(sizes), "m long, c long, s long").groupBy("m").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    rows = {r.m: (r.c, r.s) for r in found.collect()}  # 513 at most
    best, cost = 0, float(sum(s for _, s in rows.values()))
    least = cost
    for m in sorted(rows):
        if m >= 512:
            break
        cost += rows[m][0] * m * (m - 1) / 2 - rows[m][1]
        if cost < least:
            best, least = m, cost
    return best


def verify(pairs: DataFrame, cands: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets have a similarity of 0.75 or more.

    The set of a goes to the block of b, once for all its partners there.
    """
    spark = cands.sparkSession
    place = (1 << PLACE) - 1
    asked = shared.staged(pairs.groupBy("a", F.shiftright("b", PLACE).alias("to")).agg(F.collect_list(F.col("b").bitwiseAND(F.lit(place)).cast("int")).alias("b")), "jaccard-asked")
    wanted = asked.select("a").distinct().groupBy(F.shiftright("a", PLACE).alias("block_id")).agg(F.collect_list(F.col("a").bitwiseAND(F.lit(place)).cast("int")).alias("value"))
    lists = frequency.filed(wanted, "jaccard-wanted")

    def emit(batches):
        for r in shared.block_rows(batches):
            i = sorted(frequency.fetch(lists, r["block_id"]))
            if i:
                s = Sets(r)
                yield pa.record_batch([pa.array(s.number[i]), pa.array(s.n[i]), pa.array([s.set(j).tobytes() for j in i], pa.binary())], ["a", "n", "set"])

    sets = cands.mapInArrow(shared.task(emit), "a long, n long, set binary")
    sent = asked.join(sets, "a").groupBy(F.col("to").alias("block_id")).agg(F.collect_list(F.struct("a", "n", "set", "b")).alias("value"))
    folder = frequency.filed(sent, "jaccard-sent")

    def each(batches):
        for r in shared.block_rows(batches):
            a, b = [], []
            visits = frequency.fetch(folder, r["block_id"])
            s = Sets(r) if visits else None
            for x in visits:
                p = np.frombuffer(x["set"], "<u8")
                for j in x["b"]:
                    both = np.concatenate([p, s.set(j)])
                    both.sort()
                    inter = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * inter >= 75 * (x["n"] + int(s.n[j]) - inter):
                        a.append(x["a"])
                        b.append(int(s.number[j]))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = shared.staged(cands.mapInArrow(shared.task(each), "a long, b long"), "jaccard-links")
    shared.drop(asked)
    for x in (lists, folder):
        shared.remove(spark, x)
    return out


def links(cands: DataFrame) -> DataFrame:
    """Enough links to connect whatever is connected, each decided exactly."""
    spark = cands.sparkSession
    n, light = shared.parts(spark), boundary(cands)

    def entries(row):
        s = Sets(row)
        key, own, counts = s.keys(light)
        return s, key, own, counts, frequency.starts(key)

    def list_heads(row):
        s, key, own, counts, first = entries(row)
        members = np.minimum(np.diff(first, append=len(key)), 2).astype(np.uint8)
        if len(first):
            members |= np.logical_or.reduceat(counts, first).astype(np.uint8) << np.uint8(2)
        head = own[first]
        return key[first], [s.age[head].view(np.uint64) ^ SIGN, s.number[head].view(np.uint64), s.n[head].astype(np.uint32), members]

    def head(low, cols):
        order = np.lexsort((cols[1], cols[0], low))
        first = frequency.starts(low[order])
        size = np.diff(first, append=len(low))
        some = (np.add.reduceat((cols[3][order] & 3).astype(np.int64), first) > 1) & (np.bitwise_or.reduceat(cols[3][order], first) >= 4)
        number, own_n = np.empty(len(low), np.uint64), np.empty(len(low), np.uint32)
        number[order] = np.repeat(np.where(some, cols[1][order][first], NONE), size)
        own_n[order] = np.repeat(np.where(some, cols[2][order][first], 0).astype(np.uint32), size)
        return [number, own_n]

    heads = frequency.swap(cands, n, list_heads, head, "jaccard-heads")

    def star(batches):
        for r in shared.block_rows(batches):
            s, key, own, _, first = entries(r)
            got = frequency.answers(heads, r["block_id"])
            if not got:
                continue
            size = np.diff(first, append=len(key))
            a, a_n, b = np.repeat(got[0], size), np.repeat(got[1], size).astype(np.int64), s.number[own]
            ok = (a != NONE) & (a.astype(np.int64) != b) & (100 * np.minimum(a_n, s.n[own]) >= 75 * np.maximum(a_n, s.n[own]))
            both = np.unique(np.stack([a[ok].astype(np.int64), b[ok]], axis=1), axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    pairs = shared.staged(cands.mapInArrow(shared.task(star), "a long, b long"), "jaccard-pairs")  # a block's are distinct, and b is its own
    first_links = verify(pairs, cands)
    shared.drop(pairs)

    labels = components(first_links)
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    mates = frequency.filed(sized.groupBy(F.shiftright("node", PLACE).alias("block_id")).agg(F.collect_list(F.struct("node", "label", "size")).alias("value")), "jaccard-mates")

    def parted(row):
        """Entries by key, level and component, distinct, with the members of each."""
        s, key, own, counts, first = entries(row)
        got = frequency.answers(heads, row["block_id"])
        comp, size = s.number.copy(), np.ones(len(s.n), np.int64)
        for x in frequency.fetch(mates, row["block_id"]):
            i = x["node"] & ((1 << PLACE) - 1)
            comp[i], size[i] = x["label"], x["size"]
        ok = np.repeat(got[0] != NONE, np.diff(first, append=len(key))) if got else np.zeros(0, bool)
        key, own = key[ok], own[ok]
        level = level_of(s.n)[own]
        order = np.lexsort((comp[own], level, key))
        key, own, level = key[order], own[order], level[order]
        c = comp[own]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1]) | (c[1:] != c[:-1])
        return s, comp, size, key, own, level, new

    def parts_of_lists(row):
        _, comp, _, key, own, level, new = parted(row)
        return key[new], [comp[own[new]].astype(np.uint64), level[new]]

    def meets(low, cols):
        """Whether a key's entry meets another component within a level."""
        comp, spot = cols[0], low.astype(np.uint64) << tv.U(8) | cols[1]
        order = np.lexsort((comp, spot))
        first = frequency.starts(spot[order])
        last = np.append(first[1:], len(low)) - 1
        at, lo, hi = spot[order][first], comp[order][first], comp[order][last]
        out = np.zeros(len(low), bool)
        for d in (-1, 0, 1):
            there = spot + tv.U(d & ((1 << 64) - 1))
            i = np.minimum(np.searchsorted(at, there), len(at) - 1)
            out |= (at[i] == there) & ((lo[i] != comp) | (hi[i] != comp))
        return [out.astype(np.uint8)]

    mixed = frequency.swap(cands, n, parts_of_lists, meets, "jaccard-mixed")

    def still_open(batches):
        for r in shared.block_rows(batches):
            s, comp, size, key, own, level, new = parted(r)
            got = frequency.answers(mixed, r["block_id"])
            if not got or not got[0].any():
                continue
            ok = got[0][np.cumsum(new) - 1] > 0
            key, own, level = key[ok], own[ok], level[ok]
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(level.astype(np.int32)), pa.array(s.number[own]), pa.array(comp[own]), pa.array(size[own])], ["key", "level", "c", "comp", "size"])

    own = shared.staged(cands.mapInArrow(shared.task(still_open), "key long, level int, c long, comp long, size long"), "jaccard-open")
    who = frequency.filed(own.select("c").distinct().groupBy(F.shiftright("c", PLACE).alias("block_id")).agg(F.collect_list("c").alias("value")), "jaccard-who")

    def maps(batches):
        for r in shared.block_rows(batches):
            i = np.array(sorted(frequency.fetch(who, r["block_id"])), np.int64) & ((1 << PLACE) - 1)
            if len(i):
                s = Sets(r)
                yield pa.record_batch([pa.array(s.number[i]), pa.array(s.n[i]), pa.array(np.diff(s.at)[i]), pa.array([bitmap(s.set(j)) for j in i.tolist()], pa.binary())], ["c", "n", "m", "bitmap"])

    bits = shared.staged(cands.mapInArrow(shared.task(maps), "c long, n long, m long, bitmap binary"), "jaccard-bits")
    pairs = _apart(own, bits)
    out = first_links.unionByName(verify(pairs, cands))
    shared.drop(own, bits, pairs)
    for x in (heads, mates, mixed, who):
        shared.remove(spark, x)
    return out


def _apart(own: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of members of different components that share a list and that sizes and bitmaps leave open."""
    # members against the larger components of their lists; a component's other members share no list with them
    large = own.filter("size > 1").select("key", F.col("comp").alias("to"), F.col("size").alias("to_size"), F.col("level").alias("at")).distinct()
    goes = own.join(large, "key").filter("comp != to and abs(level - at) <= 1 and (size < to_size or size = to_size and comp < to)").select("c", "level", "to").distinct()
    goes = shared.staged(goes, "jaccard-goes")
    crowd = shared.staged(goes.groupBy("to", "level").agg(F.count("*").alias("many")), "jaccard-crowd")
    member = own.filter("size > 1").select("c", "level", F.col("comp").alias("to")).distinct().join(crowd.select("to").distinct(), "to", "left_semi")
    member = shared.staged(member, "jaccard-members")
    host = shared.staged(member.groupBy("to", "level").agg(F.count("*").alias("many")), "jaccard-hosts")

    def chunked(df, sizes):
        part = F.pmod(F.xxhash64("c"), F.ceil(F.col("many") / CHUNK))
        df = df.join(sizes, ["to", "level"]).join(bits, "c")
        return df.groupBy("to", "level", part.alias("part")).agg(F.collect_list(F.struct("c", "n", "m", "bitmap")).alias("rows")).drop("part")

    visitors = shared.staged(chunked(goes, crowd).withColumn("at", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))).drop("level"), "jaccard-visitors")
    members = shared.staged(chunked(member, host).withColumnRenamed("level", "at").withColumnRenamed("rows", "others"), "jaccard-chunks")
    far = shared.staged(visitors.join(members, ["to", "at"]).select("rows", "others").mapInArrow(shared.task(_compare), "a long, b long"), "jaccard-far")

    # single sets against single sets of their lists: those of a level with each other and with those of the next
    alone = own.filter("size = 1").select("key", "c", "level")
    up = alone.withColumn("level", F.col("level") + 1).withColumn("side", F.lit(0))
    both = alone.withColumn("side", F.lit(1)).unionByName(up)
    many = both.groupBy("key", "level").agg(F.count("*").alias("many"), F.sum("side").alias("own")).filter("many > 1 and own > 0")
    both = both.join(shared.staged(many, "jaccard-alone"), ["key", "level"]).join(bits, "c")
    parts = F.ceil(F.col("many") / CHUNK)
    both = both.withColumn("x", F.pmod(F.xxhash64("c"), parts)).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    # of two parts each one's own level meets the other's members of both; within a part all is met once
    met = both.groupBy("key", "level", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    some = lambda end, also: F.collect_list(F.when((F.col("x") == end("x", "y")) & also, F.struct("c", "n", "m", "bitmap")))
    own_level, below = F.col("side") == 1, (F.col("side") == 0) & (F.col("x") != F.col("y"))
    met = met.agg(some(F.least, own_level).alias("rows"), some(F.greatest, F.lit(True)).alias("others"), some(F.least, below).alias("below"), some(F.greatest, own_level & (F.col("x") != F.col("y"))).alias("above"))
    near = met.select(F.explode(F.array(F.struct("rows", "others"), F.struct(F.col("below").alias("rows"), F.col("above").alias("others")))).alias("p")).select("p.rows", "p.others").filter("size(rows) > 0 and size(others) > 0")
    near = shared.staged(near.mapInArrow(shared.task(_compare), "a long, b long"), "jaccard-near")
    out = shared.staged(far.unionByName(near).distinct(), "jaccard-pairs")
    shared.drop(goes, crowd, member, host, visitors, members, far, near)
    return out


def _compare(batches):
    """Pairs between the two lists of each row that sizes and bitmaps leave open, as (smaller, larger)."""
    for t in batches:
        sides = []
        for col in (t.column(0), t.column(1)):
            size, flat = pc.list_value_length(col).to_numpy().astype(np.int64), col.flatten()
            c, n, m = (flat.field(f).to_numpy() for f in ("c", "n", "m"))
            sides.append((size, np.cumsum(size) - size, c, n, m, tv.text_buffers(flat.field("bitmap"))[0].reshape(-1, BITMAP // 8).view(np.uint64)))
        (x_size, x_at, x_c, x_n, x_m, x_bits), (y_size, y_at, y_c, y_n, y_m, y_bits) = sides
        # a step takes whole members of the first list against all of the second
        row = np.repeat(np.arange(t.num_rows), x_size)
        many = y_size[row]
        step = (np.cumsum(many) - many) // PAIRS
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(*(np.searchsorted(step, np.unique(step), side=s) for s in ("left", "right")), strict=True):
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi]) + np.repeat(y_at[row[lo:hi]], many[lo:hi])
            ok = (100 * np.minimum(x_n[i], y_n[j]) >= 75 * np.maximum(x_n[i], y_n[j])) & (x_c[i] != y_c[j])
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(x_bits[i] ^ y_bits[j]).sum(axis=1, dtype=np.int64)
            inter = (x_m[i] + y_m[j] - differ) // 2  # of the m shared shingles of each; the rest of n meet nothing
            ok = 100 * inter >= 75 * (x_n[i] + y_n[j] - inter)
            found.append(np.sort(np.stack([x_c[i[ok]], y_c[j[ok]]], axis=1), axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _grouped(docs: DataFrame, rest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The text blocks, every row marked, and the first row (smallest id, nulls last) of the component of each class."""
    staged, marked, cands = mark(docs, rest)
    label = components(links(cands))

    def named(batches):
        for r in shared.block_rows(batches):
            s, cls = Sets(r), r["cls"]
            yield pa.record_batch([pa.array(s.number), pa.array([cls[16 * i : 16 * i + 16] for i in range(len(s.n))], pa.binary())], ["node", "cls"])

    names = cands.mapInArrow(shared.task(named), "node long, cls binary")
    label = shared.staged(names.join(label, "node").select("cls", "label"), "jaccard-labels")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "block_id", "nth")
    classes = marked.filter("cls is not null").groupBy("cls").agg(F.min(row).alias("first"))
    classes = shared.staged(classes.join(label, "cls", "left"), "jaccard-classes")
    least = shared.staged(classes.filter("label is not null").groupBy("label").agg(F.min("first").alias("least")), "jaccard-least")
    final = shared.staged(classes.join(least, "label", "left").select("cls", F.coalesce("least", "first").alias("first")), "jaccard-firsts")
    shared.drop(cands, label, classes, least)
    return staged, marked, final


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    staged, marked, final = _grouped(docs)
    shared.drop(staged)
    return marked.select("doc_id", "cls", "n").join(final, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest id, null ids last, the first staged of equals.

    Rows without words are linked with nothing and stay.  Rows count by
    themselves: of rows that share an id, those of other components stay.
    """
    blocks, marked, final = _grouped(docs, rest=True)
    kept = final.select(F.col("first.block_id").alias("block_id"), F.col("first.nth").alias("nth")).distinct().unionByName(marked.filter("cls is null").select("block_id", "nth"))
    lists = frequency.filed(kept.groupBy("block_id").agg(F.collect_list("nth").alias("value")), "jaccard-kept")
    shared.drop(marked, final)
    schema = docs.schema

    def each(batches):
        for r in shared.block_rows(batches):
            i = pa.array(sorted(frequency.fetch(lists, r["block_id"])), pa.int64())
            if len(i):
                yield from shared.block_table(r, schema, text_col).take(i).to_batches()

    return blocks.mapInArrow(shared.task(each), schema)
