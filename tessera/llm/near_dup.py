"""Near-duplicates by ProbMinHash on weighted word shingles, banding, and exact verification.

1. Every text becomes a bag of shingles of five words with their counts. Each shingle starts a Poisson process whose
   rate is its count; every arrival hits a random slot of the signature, a slot keeps its first arrival, and a shingle
   stops once its time is past the latest slot. Two signatures agree in a slot with the probability Jaccard
   similarity J_P = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i) of the two bags.
2. Equal word sequences are one class; only its least id goes on.
3. Signatures are cut into bands; documents that share a band are candidates. Within a bucket, members are compared
   with its hub (whose buckets are the largest: the original of a group of copies), so a large group costs one
   comparison a member. Where that leaves more than one component in a bucket, links between components are looked
   for too: in small buckets among all pairs of members, in larger ones by an exact filter on the shingles in which
   members differ from the core of their group (see _family_pairs), which passes over no pair that reaches the threshold.
4. A candidate pair passes if its signatures agree in at least `prune` of the slots (five standard deviations below the
   threshold) and J_P of the two whole texts, computed exactly, gets to the threshold.
5. Links make components: a bounded number of them in one task of an executor, more by alternating large-star and
   small-star steps, each written to the shared folder.

With 24 bands of 4 slots a pair of J_P 0.8 shares none with probability 3e-6.

Nulls and edge cases: a null text counts as empty; texts without words are copies of each other; a text of 1 to 4
words is one shingle; a row without doc_id is a class of its own (class_id null) and stays; of rows with the same
doc_id, equal word sequences count as one document and others as documents of their own, whose classes are told apart by
class_digest where class_id is the same; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, word_bytes

SHINGLE, BANDS, ROWS, THRESHOLD, PRUNE = 5, 24, 4, 0.8, 0.6
SLOTS = BANDS * ROWS
RHO = 1 / THRESHOLD - 1
EPS = 1e-6  # for rounding, on the side of more candidates
SMALL = 12  # buckets up to this size compare all members of different components; larger ones give the same links by their families
SENT = 1_000_000  # ids that a broadcast may hold (24 MB with digests)
FEW = 500_000  # links that one task may follow
_U = np.uint64
_STEP = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and their counts."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(words) - n + 1 + k] * _STEP[k]
    return np.unique(mix(total), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` 32-bit marks for each bag, by waves of arrivals of all bags; a bag without shingles has zeros."""
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    out = np.zeros((len(bags), slots), np.uint32)
    if not len(owner):
        return out
    h = np.concatenate([b[0] for b in bags])
    rate = np.concatenate([b[1] for b in bags]).astype(float)
    when = np.full(len(bags) * slots, np.inf)
    marks = out.reshape(-1)
    time, wave = np.zeros(len(h)), 0
    while len(h):
        wave += 1
        r = mix(h + _U(wave * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((r >> _U(11)).astype(float) + 0.5) / 2**53) / rate
        slot = owner * slots + (mix(r ^ _STEP[1]) % _U(slots)).astype(np.int64)
        better = np.flatnonzero(time < when[slot])
        order = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        when[slot[order]] = time[order]
        marks[slot[order]] = (h[order] >> _U(32)).astype(np.uint32)
        live = time < when.reshape(-1, slots).max(1)[owner]  # early termination
        h, rate, time, owner = h[live], rate[live], time[live], owner[live]
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two bags, in n log n: sorted by the ratio of counts, both inner sums are running sums."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.maximum(y, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    y_before = np.concatenate([[0], np.cumsum(y)])
    x_after = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    both = (x > 0) & (y > 0)
    at = np.searchsorted(ratio, ratio[both], "left")
    return float((1 / (x_after[at] / x[both] + y_before[at] / y[both])).sum())


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


SIGNED = "doc_id long, digest binary, shingled boolean, marks binary"


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the word sequence, signature. One narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                words = [word_bytes(t) for t in b.column(1).slice(at, 256).to_pylist()]
                marks = signatures([shingle_bag(w) for w in words])
                yield pa.record_batch(
                    [b.column(0).slice(at, 256), pa.array([digest(w) for w in words], pa.binary()), pa.array([bool(w) for w in words]), pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc_id", "digest", "shingled", "marks"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def _similar(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) whose signatures agree in enough slots, with both digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SLOTS) for i in (4, 5))
            near = (x == y).mean(1) >= PRUNE
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in range(4)], names=["a", "b", "digest_a", "digest_b"])

    one = lambda c: reps.select(F.col("rep").alias(c), F.col("digest").alias(f"digest_{c}"), F.col("marks").alias(f"marks_{c}"))
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "digest_a", "digest_b", "marks_a", "marks_b").mapInArrow(run, "a long, b long, digest_a binary, digest_b binary")


def _small(ids: DataFrame) -> DataFrame:
    """A saved table of ids (and digests), to be broadcast if there are at most SENT of them; else joins shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _texts(used: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """digest, text of the digests in `used`, each once (rows of other texts may have the same doc_id)."""
    used = save(used.distinct().join(reps.select("digest", F.col("doc").alias("doc_id")), "digest"), "near-ids")
    used = _small(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([digest(word_bytes(t)) for t in b.column(1).to_pylist()], pa.binary()), b.column(1)], ["doc_id", "digest", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(used.select("doc_id"), "doc_id", "left_semi")
    return save(rows.mapInArrow(run, "doc_id long, digest binary, text string").join(used, ["doc_id", "digest"], "left_semi").dropDuplicates(["digest"]).select("digest", "text"), "near-texts")


def _verified(near: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among `near` whose whole texts reach the threshold."""
    near = save(near, "near-pairs")
    texts = _texts(near.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")), reps, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, tuple] = OrderedDict()

        def bag(key: bytes, text: str) -> tuple:
            if key in kept:
                kept.move_to_end(key)
            else:
                kept[key] = shingle_bag(word_bytes(text))
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for batch in batches:
            out = []
            for a, b, da, db, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if probability_jaccard(bag(da, ta), bag(db, tb)) >= THRESHOLD - 1e-12:
                    out.append((a, b))
            yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    with_b = near.join(texts.select(F.col("digest").alias("digest_b"), F.col("text").alias("text_b")), "digest_b")
    with_a = with_b.join(texts.select(F.col("digest").alias("digest_a"), F.col("text").alias("text_a")), "digest_a")
    return save(with_a.select("a", "b", "digest_a", "digest_b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node of its component. Roots themselves are left out.

    Up to FEW links (8 MB of ids, counted first) one task follows them; more are handled by star steps.
    """
    links = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    n = links.count()
    return _united(links) if n <= FEW else _starred(links) if n else links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _united(links: DataFrame) -> DataFrame:
    """A bounded number of links, by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root.get(x, x)
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(u), find(v)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = sorted(root)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long").filter("node <> root")


def _starred(links: DataFrame) -> DataFrame:
    """Any number of links, by alternating large-star and small-star steps."""
    edges = save(links.distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        # large star: larger neighbours of a node go to the least node around it
        around = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
        least = save(around.groupBy("node").agg(F.min("other").alias("least")), "least").select(F.col("node").alias("v"), F.least("least", "node").alias("m"))
        edges = save(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "edges")
        # small star: smaller neighbours of a node, and itself, go to the least of them
        least = save(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = edges.join(least, "u")
        edges = save(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _buckets(bands: DataFrame) -> DataFrame:
    """key, band, rep, n, weight of buckets with more than one member. bands: key, band, rep.

    weight: the sizes of all buckets that a document is in; the original of a group of copies has the largest.
    """
    sizes = save(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = save(bands.join(sizes, "key").select("key", "band", "rep", "n"), "members")
    weights = save(members.groupBy("rep").agg(F.sum("n").alias("weight")), "weights")
    return save(members.join(weights, "rep").select("key", "band", "rep", "n", "weight"), "members")


def _hubs(members: DataFrame) -> DataFrame:
    """key, centre, centre_weight: each bucket's member of the largest weight; of equals the one with the least id."""
    most = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("m"))
    return save(most.select("key", (-F.col("m.r")).alias("centre"), F.col("m.weight").alias("centre_weight")), "hubs")


def _split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of buckets that hold several components."""
    marked = save(members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "band", "rep", "n", "weight", F.coalesce("root", "rep").alias("root")), "marked")
    several = save(marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "several")
    return save(marked.join(several, "key"), "split")


def _small_pairs(split: DataFrame) -> DataFrame:
    """All pairs of different components in small buckets: fewer than SMALL a member."""
    a, b = (split.filter(F.col("n") <= SMALL).select("key", F.col("rep").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return a.join(b, "key").filter("a < b and root_a <> root_b").select("a", "b")


def _bags(used: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, n, u, v, full, light, most of the texts `used` (rep), from x = count / scale of their n distinct shingles.

    The scale, which J_P doesn't depend on, is the count that most of the text has. u and v are sums of min(1, x) and
    max(0, x - 1); full and light are the shingles of x >= 1 and of x < 1, whose largest x is `most`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in range(6)]
                for text in b.column(1).slice(at, 256).to_pylist():
                    h, counts = shingle_bag(word_bytes(text))
                    values, often = np.unique(counts, return_counts=True)
                    x = counts / values[np.argmax(values * often)]
                    h = h.view(np.int64)
                    for c, value in enumerate((len(h), float(np.minimum(1, x).sum()), float(np.maximum(0, x - 1).sum()), h[x >= 1], h[x < 1], float(x[x < 1].max(initial=0)))):
                        out[c].append(value)
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]
                yield pa.record_batch([b.column(0).slice(at, 256), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["rep", "n", "u", "v", "full", "light", "most"])

    named = reps.join(used.select("rep").distinct(), "rep", "left_semi").select("rep", "digest")
    texts = _texts(named.select("digest"), reps, docs)
    return named.join(texts, "digest").select("rep", "text").mapInArrow(run, "rep long, n long, u double, v double, full array<long>, light array<long>, most double")


def _families(large: DataFrame, hubs: DataFrame) -> DataFrame:
    """family, rep, root: any two members of a bucket are in a family together.

    A family is named after a hub: a text is at home with the hub of the largest weight among those of its buckets, and a
    family holds all buckets with a text that is at home there. So a group of copies is one family, not one a band.
    """
    placed = save(large.select("key", "rep").join(hubs, "key"), "placed")
    home = placed.groupBy("rep").agg((-F.max(F.struct("centre_weight", (-F.col("centre")).alias("r")))["r"]).alias("family"))
    of = save(placed.select("key", "rep").join(home, "rep").select("key", "family").distinct(), "homes")
    several = large.select("key", "rep", "root").join(of, "key").select("family", "rep", "root").distinct()
    return save(several, "families")


def _family_pairs(families: DataFrame, bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) of different components among the members of each family, and the members' distances from their
    family's core: family, rep, w, centre (the member of least w).

    The core are the shingles that more than half of a family holds. A member differs from it by what it has besides
    (own) and what it lacks: its delta, of d elements. With r = 1 / THRESHOLD - 1, c shingles in the core, h of them
    in the member, and u, v as in _bags(),

        w = u - r v - (2 + r) h + (1 + r / 2) c        (for sets: own + (1 + r) lacking - r c / 2)

    (shingles count min(1, x)).
    J_P is at most 1 / (1 + outside(a) / inside(a) + outside(b) / inside(b)), the masses of each bag outside and inside the
    shingles that both hold (its terms are concave). So J_P >= THRESHOLD needs common elements of the deltas whose shares,
    (1 + r) x in each bag that has one and 1 + r / 2 in each that lacks it, sum to w_a + w_b; and at least
    (w_a + w_b) / (2 + r) of them. Hence, without comparing all members with all:

    * if w_a + w_b > 0, the pair has a first common element, from the rarest on, and all that it shares comes from there on
      (prefix filter): an equi-join on elements gives only pairs for which what either has from that place on, of elements
      that other components have too, suffices in number and shares. An element is left out if that is too little with
      its other holder of least w, and elements with the same holders are one with their shares together, so that a pair
      with a line in common meets once;
    * else, sets are both linked to the member of least w, which every such member is compared with.

    Bags with repeated shingles may fail the second point; _irregular() finds those.
    """
    whole = save(families.join(bags, "rep"), "family-bags")
    size = whole.groupBy("family").agg(F.count("*").alias("members"))
    held = whole.select("family", F.explode(F.concat("full", "light")).alias("token")).groupBy("family", "token").agg(F.count("*").alias("df"))
    core = save(held.join(size, "family").filter(F.col("df") * 2 > F.col("members")).groupBy("family").agg(F.collect_list("token").alias("core")), "cores")
    none = F.array().cast("array<long>")
    both = whole.join(core, "family", "left").withColumn("core", F.coalesce("core", none))
    lacking = F.array_except("core", F.concat("full", "light"))
    sized = both.select("family", "rep", "root", "n", "u", "v", "most", F.size("core").alias("c"), F.array_except("full", "core").alias("own"), F.array_except("light", "core").alias("light"), lacking.alias("lacking"))
    w = F.col("u") - RHO * F.col("v") - (2 + RHO) * (F.col("c") - F.size("lacking")) + (1 + RHO / 2) * F.col("c")
    weighed = sized.select("family", "rep", "root", "c", "own", "light", "most", "lacking", w.alias("w"), (F.size("own") + F.size("light") + F.size("lacking")).alias("d"))
    deltas = save(weighed.withColumn("loose", F.greatest(F.lit(0.0), F.col("d") - RHO / 2 * F.col("c") - F.col("w"))), "deltas")

    roots = deltas.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    least = deltas.groupBy("family").agg(F.min(F.struct("w", "rep", "root")).alias("m"), F.max("loose").alias("loosest"))
    about = save(least.join(roots, "family").select("family", "main", "loosest", F.col("m.w").alias("least_w"), F.col("m.rep").alias("centre"), F.col("m.root").alias("centre_root")), "family-centres")
    known = deltas.join(about, "family")
    star = known.filter((F.col("root") != F.col("centre_root")) & (F.col("w") + F.col("least_w") <= EPS)).select(F.col("rep").alias("a"), F.col("centre").alias("b"))

    partner = F.greatest(F.col("least_w"), (F.col("w") - (2 + RHO) * (RHO / 2 * F.col("c") + F.col("loosest"))) / (1 + RHO))
    k = F.greatest(F.lit(1), F.ceil((F.col("w") + partner) / (2 + RHO) - EPS))
    element = lambda gone, share: lambda t: F.struct(t.alias("token"), F.lit(gone).alias("gone"), share.alias("share"))
    kinds = (("own", False, F.lit(1 + RHO)), ("light", False, (1 + RHO) * F.col("most")), ("lacking", True, F.lit(1 + RHO / 2)))
    elements = F.explode(F.concat(*[F.transform(c, element(gone, share)) for c, gone, share in kinds]))
    spread = save(known.filter(k <= F.col("d")).select("family", "rep", "root", "main", "w", partner.alias("partner"), elements.alias("e")).select("*", "e.token", "e.gone", "e.share").drop("e"), "elements")
    often = spread.groupBy("family", "token", "gone").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("rep")).alias("holders"), F.min("root").alias("low"), F.max("root").alias("high"))
    # elements of one member or one component are in no pair; those that the same members hold (an edit's, a line's) go as one
    on = ["family", "gone", "df", "holders"]
    useful = spread.join(often.filter("df > 1 and low <> high").drop("low", "high"), ["family", "token", "gone"])
    together = useful.groupBy("rep", "root", "main", "w", "partner", *on).agg(F.count("*").alias("times"), F.sum("share").alias("share"))
    # what a pair whose first common element this is can share at most: `left` elements, of shares `rest` in this member
    onwards = Window.partitionBy("family", "rep").orderBy("df", "holders", "gone").rowsBetween(0, Window.unboundedFollowing)
    ranked = together.withColumns({"left": F.sum("times").over(onwards), "rest": F.sum("share").over(onwards)})
    # so that of the other w <= reach and z <= EPS - z
    bounded = ranked.withColumns({"reach": (F.col("left") + EPS) * (2 + RHO) - F.col("w"), "z": F.col("w") - F.col("rest")}).filter("reach >= partner")
    apart = F.col("root") != F.col("main")
    others = lambda c: F.when(apart, F.min(c).over(Window.partitionBy(*on))).otherwise(F.min(F.when(apart, F.col(c))).over(Window.partitionBy(*on)))
    met_by = bounded.withColumns({"least_z": others("z"), "low_w": others("w")})
    prefixes = save(met_by.filter((F.col("z") + F.col("least_z") <= EPS) & (F.col("low_w") <= F.col("reach"))).select(*on, "rep", "root", "main", "w", "times", "share", "left", "rest", "reach", "z"), "prefixes")

    # one of a pair has z <= EPS / 2: 0 is for two of these, 1 and 2 for one as a and as b
    side = lambda x, alone, other: prefixes.select(
        *on, *(F.col(c).alias(f"{c}_{x}") for c in prefixes.columns if c not in on), F.explode(F.when(F.col("z") <= EPS / 2, F.array(F.lit(0), F.lit(alone))).otherwise(F.array(F.lit(other)))).alias("meet")
    )
    met = side("a", 1, 2).filter("root_a <> main_a").join(side("b", 2, 1), [*on, "meet"]).filter("root_a <> root_b and (root_b = main_b or rep_a < rep_b)")
    met = met.filter((F.col("w_b") <= F.col("reach_a")) & (F.col("w_a") <= F.col("reach_b")) & (F.col("z_a") + F.col("z_b") <= EPS))
    # those of a pair's common elements that are left here are its first ones
    after = F.min(F.least(F.col("left_a") - F.col("times_a"), F.col("left_b") - F.col("times_b"))).alias("after")
    later = F.min(F.col("rest_a") - F.col("share_a")) + F.min(F.col("rest_b") - F.col("share_b"))
    shared = met.groupBy("family", "rep_a", "rep_b", "w_a", "w_b").agg(F.sum(F.greatest("times_a", "times_b")).alias("n"), after, (F.sum(F.col("share_a") + F.col("share_b")) + later).alias("shares"))
    found = shared.filter((F.col("n") + F.col("after") >= (F.col("w_a") + F.col("w_b")) / (2 + RHO) - EPS) & (F.col("shares") >= F.col("w_a") + F.col("w_b") - EPS)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    pairs = star.unionByName(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, known.select("family", "rep", "w", "centre", "least_w")


def _irregular(weights: DataFrame, roots: DataFrame) -> DataFrame:
    """rep of bags with repeated shingles that are near their family's core without being linked to its centre."""
    now = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    near = weights.filter(F.col("w") + F.col("least_w") <= EPS).select("rep", "centre").join(now("rep"), "rep", "left").join(now("centre"), "centre", "left")
    return save(near.filter(F.coalesce("root_rep", "rep") != F.coalesce("root_centre", "centre")).select("rep").distinct(), "irregular")


def _irregular_pairs(left: DataFrame, large: DataFrame) -> DataFrame:
    """Candidates (a, b): each of `left` with the members of its buckets that are in other components."""
    keys = large.join(left, "rep", "left_semi").select("key", F.col("rep").alias("x"), F.col("root").alias("root_x"))
    met = keys.join(large.select("key", "rep", "root"), "key").filter("root <> root_x")
    return met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), class_digest (of the words of the text that stands for it), keep
    (whether it stands for its class), copy (its words equal another's)."""
    return _classes(docs).drop("digest")


def _classes(docs: DataFrame) -> DataFrame:
    """classes(), and the digest of every row's words. Nodes (rep) are texts: the least doc_id, or a hash if another text has it."""
    signed = save(sign(docs), "signed")
    named = signed.filter(F.col("doc_id").isNotNull())
    first = save(named.groupBy("digest").agg(F.min("doc_id").alias("doc")), "digests")
    shared = save(first.groupBy("doc").agg(F.min("digest").alias("own"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-ids")
    texts = named.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("shingled").alias("shingled"), F.first("marks").alias("marks")).join(shared, "doc", "left")
    rep = F.when(F.col("own") != F.col("digest"), F.xxhash64("doc", "digest")).otherwise(F.col("doc"))
    reps = save(texts.select("digest", "doc", rep.alias("rep"), "shingled", "marks"), "reps")
    keys = [F.xxhash64(F.lit(i), F.substring("marks", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    members = _buckets(reps.filter("shingled").select("rep", F.posexplode(F.array(*keys)).alias("band", "key")))

    # every bucket's members with its hub
    hubs = _hubs(members)
    pairs = members.join(hubs, "key").filter("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    links = _verified(_similar(pairs, reps), reps, docs)
    roots = save(components(links), "roots")

    def follow(more: DataFrame) -> None:
        nonlocal links, roots
        if not more.isEmpty():
            links = save(links.unionByName(more), "links")
            roots = save(components(links), "roots")

    # buckets that hold several components still
    split = _split(members, roots)
    if not split.isEmpty():
        pairs = _small_pairs(split)
        large = split.filter(F.col("n") > SMALL)
        weights = None
        if not large.isEmpty():
            families = _families(large, hubs)
            more, weights = _family_pairs(families, save(_bags(families, reps, docs), "bags"))
            pairs = pairs.unionByName(more)
        follow(_verified(_similar(pairs.distinct(), reps), reps, docs))
        if weights is not None and not (left := _irregular(weights, roots)).isEmpty():
            follow(_verified(_similar(_irregular_pairs(left, _split(members.filter(F.col("n") > SMALL), roots)), reps), reps, docs))

    by_root = save(reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", "doc", F.coalesce("root", "rep").alias("root")), "classes")
    least = save(by_root.groupBy("root").agg(F.min(F.struct("doc", "digest")).alias("least")), "least").select("root", F.col("least.doc").alias("class_id"), F.col("least.digest").alias("class_digest"))
    by_class = save(by_root.join(least, "root").drop("root"), "classes")
    joined = named.select("doc_id", "digest").join(by_class, "digest")
    keep = (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    result = joined.select("doc_id", "class_id", "class_digest", keep.alias("keep"), (F.col("doc_id") != F.col("doc")).alias("copy"), "digest")
    alone = signed.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.col("digest").alias("class_digest"), F.lit(True).alias("keep"), F.lit(False).alias("copy"), "digest")
    return result.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their own columns, of one document of each class: the one of the least id, and of several
    texts with that id the one whose digest is the class's. Rows without doc_id stay."""
    found = save(_classes(docs).filter("doc_id is not null").select(F.col("doc_id").alias("__tessera_id"), F.col("digest").alias("__tessera_digest"), "keep"), "found")
    several = save(found.groupBy("__tessera_id").count().filter("count > 1").select("__tessera_id"), "several")
    kept = save(found.filter("keep").select("__tessera_id", "__tessera_digest").distinct(), "kept")
    words_of = F.pandas_udf(lambda texts: texts.map(lambda t: digest(word_bytes(t))), "binary")
    alone = kept.join(several, "__tessera_id", "left_anti").select("__tessera_id")
    named = docs.withColumn("__tessera_id", F.col("doc_id").cast("long"))
    once = named.join(_small(save(alone, "kept-once")), "__tessera_id", "left_semi").select(docs.columns)
    if not several.isEmpty():
        again = named.join(_small(several), "__tessera_id", "left_semi").withColumn("__tessera_digest", words_of(F.col("text").cast("string")))
        again = again.join(kept, ["__tessera_id", "__tessera_digest"], "left_semi").dropDuplicates(["__tessera_id", "__tessera_digest"])
        once = once.unionByName(again.select(docs.columns))
    return once.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))
