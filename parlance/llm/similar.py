"""Groups of near copies: SimHash values and Golay keys find candidates, the true Jaccard similarity of shingles decides.

At a similarity of 0.8 some 15 % of the bits of two SimHash values differ, too many for the keys of ``golay.fuzzy_keys``,
which take each bit for as sure as any other. But a bit is a majority, and those that differ are those that were nearly
even. So a set has a SimHash of 576 bits with their margins, and Golay keys are decoded softly: of each of 12 tables of
two segments of 23 bits, the six pairs of code words that agree best with the margins are keys. ``SIZE`` classes narrow
buckets and lose nothing, since at 0.8 the larger of two sets is at most 1.25 times the smaller. Measured shares of
pairs at 0.8 that meet are in the README and in the tests.

Pairs are looked at closely only where their SimHash values differ in at most a quarter of the bits: four deviations
beyond what is expected at 0.8, even for the smallest sets (0.19 at four and five shingles, 0.15 for large ones). In
crowded buckets, sketches of the 512 least shingle hashes come next. They are the whole set of nearly all texts, whose
similarity they give; of longer texts they estimate it, with four deviations. Texts decide about the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import golay
from parlance.llm._common import HOT_TEXTS, materialise, spread_join
from parlance.llm.components import connected_components
from parlance.llm.simhash import least_ids

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 31
#: Tables of two segments, keys of a table, and 64-bit words of a SimHash value that holds all segments.
TABLES, KEYS, WORDS = 12, 6, 9
#: Most bits in which the values of a pair worth comparing differ.
FAR = WORDS * 64 // 4
#: Sets of fewer shingles are not similar to any other set, as 4 of 5 are the fewest at 0.8.
LEAST = 4
#: Shingle hashes of a sketch.
SKETCH = 512
#: Members of a bucket's leading part from which on the distance to that part tells who may be near whom.
CROWD = 32
#: Rows of a block in which signatures meet each other, and of a block of those that are in the leading part.
BLOCK, LED = 1024, 4096
_CHUNK = 1 << 12
#: Texts whose keys are decoded at once, 98,304 scores of 4 bytes each.
_DECODED = 32


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``n`` words; a shorter text is one run, one without a word has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = (ends - np.diff(ends, prepend=0)).tolist(), (ends[n - 1 :] - 1).tolist()
    return np.unique(np.array([h(line[i:j], SEED) for i, j in zip(starts, stops, strict=False)] if stops else [h(line, SEED)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` independent 64-bit words of each hash (the finaliser of SplitMix64)."""
    z = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit of a SimHash value, how many more of the hashes have it set than not."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_mixed(hashes[at : at + _CHUNK]).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 fit in a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def value(found: np.ndarray) -> bytes:
    """The SimHash value of margins."""
    return np.packbits(found > 0, bitorder="little").tobytes()


def table_keys(found: np.ndarray) -> np.ndarray:
    """``TABLES * KEYS`` Golay keys of 24 bits of each row of margins, table by table."""
    cut = found[:, : TABLES * 2 * golay.BITS].reshape(-1, 2, golay.BITS)
    return golay.soft_keys(cut, KEYS).reshape(len(found), TABLES * KEYS).astype(np.int32)


def bucket_keys(reps: DataFrame) -> DataFrame:
    """(s, key) of every set: its size's class, the table and the table's key. A set is also in the class that sets 1.25
    times as large begin to be in, so that of two similar sets the smaller is in the larger one's class."""
    classes = F.expr("array_distinct(array(cast(length(bin(size)) as bigint), cast(length(bin(size * 5L div 4)) as bigint)))")
    rows = reps.where(F.col("size") >= LEAST).select("s", "keys", F.explode(classes).alias("class"))
    rows = rows.select("s", "class", F.posexplode("keys").alias("i", "code"))
    return rows.select("s", F.expr(f"shiftleft(class, 28) | shiftleft(i div {KEYS}, 24) | code").alias("key"))


_TABLE = np.repeat(np.arange(TABLES, dtype=np.int64), KEYS) << 24


def first_shared(keys_a: np.ndarray, keys_b: np.ndarray, size_a: int, size_b: int) -> int:
    """The least of the bucket keys that two similar sets share, -1 if none."""
    both = np.intersect1d(keys_a | _TABLE, keys_b | _TABLE)
    return max(size_a, size_b).bit_length() << 28 | int(both[0]) if len(both) else -1


def first_here(key: int, keys_a: np.ndarray, keys_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair of rows of keys, is ``key`` what ``first_shared`` gives? ``sizes`` are those of the larger sets."""
    table, code = key >> 24 & 15, key & 0xFFFFFF
    good = np.flatnonzero(np.frexp(sizes)[1] == key >> 28)
    for k in range(table + 1):
        x, y = (v[good, k * KEYS : (k + 1) * KEYS] for v in (keys_a, keys_b))
        least = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, 1 << 24).min(axis=1, initial=1 << 24)
        good = good[least == (code if k == table else 1 << 24)]
    return good


def sketch(hashes: np.ndarray) -> bytes:
    """The least ``SKETCH`` of the low halves of hashes, sorted."""
    return np.unique(hashes.astype(np.uint32))[:SKETCH].tobytes()


def sketched(x: np.ndarray, y: np.ndarray) -> tuple[float, bool]:
    """(similarity of two sketched sets, is it that of the whole sets?)."""
    both = np.sort(np.concatenate([x, y]))
    same = both[1:][both[1:] == both[:-1]]
    if len(x) < SKETCH and len(y) < SKETCH:
        return len(same) / max(1, len(both) - len(same)), True
    least = np.unique(both)[:SKETCH]
    return np.searchsorted(same, least[-1], "right") / len(least), False


def texts_in(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few at a time as Python strings."""
    for at in range(0, len(column), 128):
        yield from column.slice(at, 128).to_pylist()


def sketches(texts: DataFrame) -> DataFrame:
    """(s, sk: sketch) of (s, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(shingles(text)) for text in texts_in(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["s", "sk"])

    return texts.select("s", "text").mapInArrow(run, "s long, sk binary")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, s: hash of its shingle set, size, keys of all tables, sig: SimHash value) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, _DECODED):
                batch = whole.slice(at, _DECODED)
                sets, sizes, found = [], [], []
                for hashes in map(shingles, texts_in(batch.column(2))):
                    sets.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    sizes.append(len(hashes))
                    found.append(margins(hashes))
                flat = pa.array(table_keys(np.array(found)).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * TABLES * KEYS), flat)
                made = [pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(map(value, found), pa.binary())]
                yield pa.record_batch([batch.column(0), batch.column(1), *made], ["doc_id", "t", "s", "size", "keys", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, t long, s long, size int, keys array<int>, sig binary")


def _words(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(-1, WORDS)


def measured(pairs: DataFrame) -> DataFrame:
    """(a, b, apart: bits in which the SimHash values sig_a and sig_b differ) of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_words(c.to_pylist()) for c in batch.columns[2:])
            apart = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), apart], ["a", "b", "apart"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, apart int")


def across(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) that look similar enough and join what nothing joined before, of rows (key, rows, i, j).

    ``rows`` has s, part, blk, size, keys, sig and sk. Blocks i and j of a group meet, a block with itself if they are
    one. A pair counts in the first bucket that it shares. Pairs told by whole sets join their parts here at once, so of a
    group of near copies no more pairs are given than it has parts; pairs told by estimates are all given.
    """

    def meet(key: int, rows: dict[str, list], i: int, j: int) -> Iterator[tuple[int, int]]:
        s, blk = np.array(rows["s"], np.int64), np.array(rows["blk"], np.int64)
        sig, keys, size = _words(rows["sig"]), np.array(rows["keys"], np.int32), np.array(rows["size"], np.int64)
        up = {p: p for p in rows["part"]}
        part, parts = rows["part"], np.array(rows["part"], np.int64)

        def top(p: int) -> int:
            while up[p] != p:
                up[p] = p = up[up[p]]
            return p

        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        for at in range(0, len(left), 8):
            r = left[at : at + 8]
            apart = np.zeros((len(r), len(right)), np.uint16)
            for w in range(WORDS):
                apart += np.bitwise_count(sig[r, w][:, None] ^ sig[right, w][None, :])
            x, y = np.nonzero(apart <= FAR)
            x, y = r[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            apart_yet = parts[x] != parts[y]
            x, y = x[apart_yet], y[apart_yet]
            here = first_here(key, keys[x], keys[y], np.maximum(size[x], size[y]))
            for a, b in zip(x[here].tolist(), y[here].tolist(), strict=True):
                p, q = top(part[a]), top(part[b])
                if p == q:
                    continue
                near, whole = sketched(np.frombuffer(rows["sk"][a], np.uint32), np.frombuffer(rows["sk"][b], np.uint32))
                if near >= (SIMILARITY if whole else SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / SKETCH) ** 0.5):
                    if whole:
                        up[p] = q
                    yield min(s[a], s[b]), max(s[a], s[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].values if c == "rows" else batch.column(c)[n].as_py() for c in ("key", "rows", "i", "j")}
                rows = {f.name: row["rows"].field(f.name).to_pylist() for f in row["rows"].type}
                found += meet(row["key"], rows, row["i"], row["j"])
            a, b = (np.array(v, np.int64) for v in (zip(*found, strict=True) if found else ((), ())))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def leaders(members: DataFrame) -> DataFrame:
    """The distinct pairs (s, lead) of members (s, n, lead) of buckets that are looked at one by one: of each set the
    leader of its most crowded bucket, and the other one of each bucket of two. In larger buckets all meet later."""
    two = F.collect_set(F.when(F.col("n") == 2, F.col("lead")))
    led = members.where("s <> lead").groupBy("s").agg(F.max(F.struct("n", "lead")).alias("most"), two.alias("two"))
    return led.select("s", F.explode(F.array_union(F.array("most.lead"), "two")).alias("lead"))


def led_by_most(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members (key, s, part) of buckets with led: are they in the part that has most members in the bucket, and, if these
    are ``CROWD`` or more, apart: their distance to a member of that part, the same one in all buckets that it leads."""
    held = materialise(members.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("s").alias("ref")), "bucket-part-sizes")
    refs = materialise(held.where(F.col("n") >= CROWD).groupBy("part").agg(F.min("ref").alias("ref")), "part-refs")
    most = held.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    most = materialise(most.where("parts > 1").select("key", F.col("most.part").alias("main"), F.col("most.n").alias("own"), "n"), "bucket-most")
    most = spread_join(most, refs.toDF("main", "ref"), "main", how="left")
    most = materialise(most.withColumn("ref", F.when(F.col("own") >= CROWD, F.col("ref"))).drop("own"), "bucket-most")
    named = materialise(spread_join(members, most.drop("n"), "key", most.select("key", "n")), "bucket-members")
    pairs = materialise(named.where("s <> ref").select("s", "ref").distinct().join(sigs, "s"), "stars")
    pairs = spread_join(pairs.toDF("b", "a", "sig_b"), sigs.toDF("a", "sig_a"), "a")
    apart = measured(pairs).toDF("ref", "s", "apart")
    named = named.join(apart, ["ref", "s"], "left").withColumn("apart", F.when(F.col("s") == F.col("ref"), 0).otherwise(F.col("apart")))
    return named.select("key", "s", "part", (F.col("part") == F.col("main")).alias("led"), "apart")


def in_reach(members: DataFrame) -> DataFrame:
    """Those members (key, s, part, led, apart) of buckets that could be near one that is not in the leading part.

    ``apart`` is the distance to a member of that part. By the triangle inequality two members are at least as far apart as these
    distances differ, so a stranger that chance put in a bucket meets none of a large group of near copies. Buckets without
    such distances stay whole.
    """
    other = lambda c: F.when(~F.col("led"), F.col(c))
    told, rest = members.where("apart is not null"), members.where("apart is null")
    ranges = told.groupBy("key").agg(F.min(other("apart")).alias("low"), F.max(other("apart")).alias("high"), F.count("*").alias("n"))
    ranges = materialise(ranges.where("low is not null"), "bucket-ranges")
    found = spread_join(told, ranges.drop("n"), "key", ranges.select("key", "n"))
    found = found.where(f"not led or apart between low - {FAR} and high + {FAR}").drop("low", "high", "apart")
    return found.unionByName(rest.drop("apart"))


def blocks(members: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups of bounded size in which all members (key, s, part, led) of a bucket meet that could be joined.

    Members in the leading part need not meet each other. The others are dealt into blocks by hash; each two blocks
    meet, and each block meets the leading part a block at a time. What a member is compared by joins it last.
    """
    sizes = members.groupBy("key").agg(F.count_if(~F.col("led")).alias("others"), F.count_if("led").alias("leds")).where("others > 1 or others = 1 and leds > 0")
    sizes = materialise(sizes.select("key", F.ceil(F.col("others") / BLOCK).cast("int").alias("bo"), F.ceil(F.col("leds") / LED).cast("int").alias("bl"), (F.col("others") + F.col("leds")).alias("n")), "bucket-sizes")
    dealt = spread_join(members, sizes.drop("n"), "key", sizes.select("key", "n"))
    dealt = dealt.withColumn("blk", F.when(F.col("led"), -1 - F.pmod(F.xxhash64("s"), "bl")).otherwise(F.pmod(F.xxhash64("s"), "bo")).cast("int"))
    met = """if(led, transform(sequence(0, bo - 1), i -> named_struct('i', i, 'j', blk)),
        concat(transform(sequence(0, bo - 1), j -> named_struct('i', least(blk, j), 'j', greatest(blk, j))), transform(filter(sequence(1, greatest(bl, 1)), j -> j <= bl), j -> named_struct('i', blk, 'j', -j))))"""
    dealt = dealt.select("key", "s", "part", "blk", F.explode(F.expr(met)).alias("at"))
    needed = materialise(dealt.select("s").distinct(), "block-sets")
    shown = materialise(sketches(texts.join(needed, "s", "left_semi")).join(reps.select("s", "size", "keys", "sig"), "s"), "sketches")
    full = dealt.join(shown, "s")
    lists = full.groupBy("key", "at").agg(F.collect_list(F.struct("s", "part", "blk", "size", "keys", "sig", "sk")).alias("rows"))
    return lists.select("key", "rows", "at.i", "at.j")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of shingle sets whose Jaccard similarity is high enough; texts are (s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=256)(shingles)
        for batch in batches:
            both = zip(texts_in(batch.column(2)), texts_in(batch.column(3)), strict=True)
            good = pa.array([jaccard(known(x), known(y)) >= SIMILARITY for x, y in both], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    rows = pairs.join(texts.toDF("b", "text_b"), "b")
    rows = spread_join(rows, texts.toDF("a", "text_a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), hot_keys=HOT_TEXTS)
    return materialise(rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-copies")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that links of similarity 0.8 or more reach.

    Texts with one shingle set (copies, other case or white space, all texts without a word) are one node. Nodes that
    share a key meet in its bucket: first each with the leader of its most crowded bucket, so that a large group of near
    copies gets few parts by as many comparisons as it has members, not that many in each bucket that they share; buckets
    of two are done then. In the others those outside the part that leads by then meet, in blocks, all that may be near
    them.
    """
    prints = materialise(signatures(docs), "signatures")
    columns = [F.first(c).alias(c) for c in ("size", "keys", "sig")]
    reps = materialise(prints.groupBy("s").agg(F.min("doc_id").alias("first_id"), F.min("t").alias("t"), *columns, F.count("*").alias("n")), "shingle-sets")
    keyed = bucket_keys(reps)
    buckets = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("s").alias("lead")).where("n > 1"), "golay-buckets")
    members = materialise(spread_join(keyed, buckets, "key", buckets.select("key", "n")), "golay-shared")
    sigs = reps.select("s", "sig")
    star = materialise(leaders(members).join(sigs, "s"), "stars")
    star = spread_join(star.toDF("b", "a", "sig_b"), sigs.toDF("a", "sig_a"), "a")
    nodes = reps.select("s", "t").join(members.select("s").distinct(), "s", "left_semi")
    nodes = materialise(nodes, "candidate-sets")
    texts = docs.select(F.xxhash64("text").alias("t"), "text").join(nodes, "t").dropDuplicates(["s"]).select("s", "text")
    texts = materialise(texts, "candidate-texts")
    near = materialise(measured(star).where(F.col("apart") <= FAR).select("a", "b"), "candidates")
    links = verified(near, texts)
    parts = materialise(connected_components(links), "components")
    named = spread_join(members.where("n > 2").select("key", "s"), parts.toDF("s", "part"), "s", how="left")
    named = materialise(named.withColumn("part", F.coalesce("part", "s")), "bucket-parts")
    named = materialise(led_by_most(named, sigs), "bucket-leaders")
    named = materialise(in_reach(named), "bucket-meetings")
    met = materialise(across(blocks(named, reps, texts)).distinct(), "candidates")
    links = links.unionByName(verified(met, texts))
    parts = materialise(connected_components(links), "components")
    ids = materialise(least_ids(reps.select(F.col("s").alias("node"), "first_id"), parts), "component-ids").withColumnRenamed("node", "s")
    return spread_join(prints.select("doc_id", "s"), ids, "s", reps.select("s", "n")).select("doc_id", "component_id")
