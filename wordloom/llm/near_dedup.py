"""5. Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of 3-word shingles. The first permutation (sigma) places a shingle on a circle of 2**32
positions; the second (pi) orders the positions. Shifting pi circularly by k = 0, 1, 2, ... gives every further
signature coordinate: coordinate k is the least pi(position + k mod 2**32) in the set. Documents that agree on all
coordinates of a band are candidates, and a candidate pair is linked if its full sets confirm
100 * |A and B| >= percent * |A or B|.

Copies with one shingle set are one class and only the class goes on. In a band bucket each class is compared
with the bucket's leader; classes that are joined need no further comparison, so a group of copies costs a star,
not its pairs. After STAR_ROUNDS such rounds with other leaders, what is left are pairs of a bucket in different
components, and every one of them is compared: no candidate link between different texts is lost. Only DataFrame
functions are used.

Defined results: null text, empty text and text without words have no shingles, are linked with nothing and are
their own component; a null doc_id never is a component's id unless it is alone; rows with the same doc_id are
separate documents. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import discard, lower_ascii, table, without, words, written

#: 18 bands of 5: a pair at Jaccard 0.85 shares none with probability 2.6e-5. 90 coordinates keep the aggregation
#: within the 100 fields that are compiled.
BANDS, ROWS, PERCENT, SHINGLE = 18, 5, 85, 3
CIRCLE = 1 << 32
STAR_ROUNDS, BLOCK = 3, 512


def shingled(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, h (the text's hash) and the distinct 64-bit hashes of the n-word shingles; of the whole sequence if it has
    fewer words.

    Each step is a column of its own, so that no lambda evaluates an earlier step again for each element."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), words(lower_ascii(F.col("text"))).alias("ws")).select("doc_id", "h", F.transform("ws", lambda w: F.xxhash64(w)).alias("ws"))
    count = F.greatest(F.size("ws") - (n - 1), F.least(F.size("ws"), F.lit(1)))
    each = F.transform(F.slice("ws", 1, count), lambda w, i: F.xxhash64(w, *(F.get("ws", i + k) for k in range(1, n))))
    return hashed.select("doc_id", "h", F.array_distinct(each).alias("shingles"))


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h, shingles, n and the set's 128-bit fingerprint (h1, h2)."""
    sets = shingled(docs).select("doc_id", "h", F.sort_array("shingles").alias("shingles"))
    return sets.select("doc_id", "h", "shingles", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit(1), "shingles").alias("h2"))


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per doc_id and text: h, n, h1, h2, copies (rows that have both) and the band keys k0, k1, ... of the circulant
    MinHash signature (null for the empty set)."""
    spread = with_sets(docs).select("doc_id", "h", "n", "h1", "h2", F.explode_outer("shingles").alias("s"))
    spread = spread.withColumn("p", F.col("s").bitwiseAND(F.lit(CIRCLE - 1)))
    coordinate = lambda k: F.min(F.xxhash64((F.col("p") + F.lit(k)).bitwiseAND(F.lit(CIRCLE - 1)))).alias(f"c{k}")
    signed = spread.groupBy("doc_id", "h", "n", "h1", "h2").agg(F.count(F.lit(1)).alias("elements"), *(coordinate(k) for k in range(bands * rows)))
    key = lambda b: F.when(F.col("n") > 0, F.xxhash64(F.lit(b), *(F.col(f"c{b * rows + r}") for r in range(rows)))).alias(f"k{b}")
    return signed.select("doc_id", "h", "n", "h1", "h2", (F.col("elements") / F.greatest("n", F.lit(1))).cast("long").alias("copies"), *map(key, range(bands)))


def classes_of(t: DataFrame, bands: int = BANDS) -> DataFrame:
    """One row per distinct set: cls, h1, h2, n, lead (its least doc_id) and band keys."""
    c = t.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("lead"), *(F.min(f"k{b}").alias(f"k{b}") for b in range(bands)))
    return c.select(F.monotonically_increasing_id().alias("cls"), "*")


def _similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def star_pairs(buckets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's leader of this turn and each other class, of another component, in it."""
    mask = (turn * 0x5DEECE66D) & ((1 << 40) - 1)
    first = buckets.groupBy("key").agg(F.min(F.col("cls").bitwiseXOR(F.lit(mask))).alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    leader = buckets.select("key", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    leader = leader.join(first.select("key", F.col("first").bitwiseXOR(F.lit(mask)).alias("a")), ["key", "a"])
    pairs = buckets.join(leader, "key").where((F.col("comp") != F.col("comp_a")) & _similar_size("n", "n_a", percent))
    return pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def cross_pairs(buckets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) of a bucket that lie in different components.

    A bucket of many classes is cut into blocks of about ``block``, and each pair of blocks is a join key of its own, so
    that no task meets a whole hot bucket."""
    sizes = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = buckets.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    low = rows.select("key", F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"), *(F.col(c).alias(f"{c}_a") for c in ("cls", "n", "comp")))
    high = rows.select("key", F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"), *(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "comp")))
    once = (F.col("lo") < F.col("hi")) | (F.col("cls_a") < F.col("cls_b"))
    pairs = low.join(high, ["key", "lo", "hi"]).where(once & (F.col("comp_a") != F.col("comp_b")) & _similar_size("n_a", "n_b", percent))
    return pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def open_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold classes of more than one component."""
    keys = buckets.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return buckets.join(keys, "key", "left_semi")


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(a, b) -> (cls, root) for every node of an edge: alternating large-star and small-star steps, each linear in the
    edges, until nothing changes."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small)
        gone = edges.join(new, ["u", "v"], "left_anti").limit(1).count() + new.join(edges, ["u", "v"], "left_anti").limit(1).count()
        discard(edges)
        edges = new
        if not gone:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("cls"), "root")
    return roots.union(edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).join(edges.select(F.col("u").alias("cls")), "cls", "left_anti").distinct())


def relabelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots, "cls", "left").select("key", "cls", "n", F.coalesce("root", "comp").alias("comp"))


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per doc_id and text hash h: n (set size), copies (rows alike in both), root (of its component; null for the
    empty set) and component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    t = written(banded(docs, bands, rows))
    c = written(classes_of(t, bands))
    keys = F.explode(F.array(*(f"k{b}" for b in range(bands)))).alias("key")
    buckets = written(open_buckets(c.select(keys, "cls", "n", F.col("cls").alias("comp"))))
    candidates = c.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "h1", "h2", "lead")
    chosen = docs.join(candidates.select("lead"), docs["doc_id"].eqNullSafe(F.col("lead")), "left_semi")
    sets = written(with_sets(chosen).join(candidates.select("cls", "h1", "h2"), ["h1", "h2"]).select("cls", "shingles").dropDuplicates(["cls"]))
    edges = None
    for turn in range(star_rounds + 1):
        last = turn == star_rounds
        pairs = cross_pairs(buckets, percent) if last else star_pairs(buckets, turn, percent)
        found = written(verified(pairs, sets, percent))
        edges = found if edges is None else edges.union(found)
        if last or found.isEmpty():
            continue
        roots = components(edges, spark)
        new = written(open_buckets(relabelled(buckets, roots)))
        discard(buckets)
        buckets = new
    roots = components(edges, spark)
    named = c.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "root", "component_id")
    linked = t.where("n > 0").join(named, ["h1", "h2"]).select("doc_id", "h", "n", "copies", "root", "component_id")
    return linked.union(t.where("n = 0").select("doc_id", "h", "n", "copies", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    each = groups(docs, **options).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: the one of least doc_id (null last) and text hash. Rows without words stay."""
    found = written(groups(docs, **options).where("n > 0"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    member = found.join(first, "root").withColumn("own", rank.eqNullSafe(F.col("first")))
    rest = without(docs, member.where(~F.col("own")), {"doc_id": F.col("doc_id"), "h": F.xxhash64("text")})
    repeated = written(member.where("own and copies > 1"))
    if repeated.isEmpty():
        return rest
    single = without(rest, repeated, {"doc_id": F.col("doc_id"), "h": F.xxhash64("text")})
    several = rest.withColumn("__h", F.xxhash64("text")).join(repeated.select(F.col("doc_id").alias("__id"), F.col("h").alias("__k")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k")), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "__h"]).drop("__h"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT rid AS a, rid AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN least_id USING (rid)
"""
