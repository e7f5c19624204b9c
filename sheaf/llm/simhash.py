"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Distinct fingerprints carry a table of
their Hamming distances to many reference fingerprints (pivots). By the triangle inequality two fingerprints
within r bits differ by at most r in every coordinate of the table, so a pair is discarded by its largest
coordinate difference and only survivors are verified bit by bit.

Pairs are brought together in blocks. ``link`` (small radii) blocks by bit groups: 64 bits in r + 2 groups, and two
fingerprints within r bits agree on two whole groups at least, so nothing is lost. Blocks too full to be
paired are searched another exact way: every fingerprint in them is filed under itself and its 64 neighbours at
one bit, and two fingerprints within two bits meet in one of these; each is linked to the smallest it meets.
``near_copies`` (similarity of shingle sets) joins what is easily joined in blocks by minima of independent permutations of the shingle
hashes; then all sets meet in prefixes of their shingles, which lose nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.functions.skew import top_k

from .common import components, lower_ascii, saved, shingle_hashes, text_of, words

SEED = 42
BITS = 64
#: Number of pivots. Their bits come from a rule, see ``pivots``.
PIVOTS = 16
#: Blocks with more members are not paired off but searched by neighbours at one bit (``link``) or by prefixes (``near_copies``).
FULL = 64
#: Turns over full blocks in ``near_copies`` that join what is easily joined before the prefixes, and leaders in each.
TURNS, LEADERS = 3, 8
#: Hashes kept behind a prefix, in parts of it and in number, for what the prefix gives up to the end of the order.
SPARE, SPARE_ROWS = 0.5, 16
#: Keeps products of whole numbers and a similarity from passing the next whole number.
GUARD = 1e-9
#: Members of a full block that one task meets its leaders with.
SALTED = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of 0, 1, 2, ..., as signed 64-bit integers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED)).astype(np.int64)) for i in range(n)]


def shingles_of(text: str, width: int) -> np.ndarray:
    """XXH64 of each window of ``width`` lower-cased words joined by blanks; shorter texts are one window, blank ones none."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, "<u8")
    joined = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= width:
        return np.array([h(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - width + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], "<u8")


def fingerprint(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; counted in chunks, so a long text needs no more memory."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at:at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, width: int, minima: int = 0, key: str = "doc_id", text: str = "text", share: float = 0.0) -> DataFrame:
    """(doc_id, fp, n_shingles, minima, digest) per row; ``minima`` smallest values under as many odd multipliers.

    With ``minima``, all of it is taken from the distinct shingles, and digest is that of their set; without, a shingle counts as often
    as it occurs and digest is null. With ``minima`` and ``share``, also least: that share of the set and ``SPARE_ROWS`` more hashes, smallest first.
    """
    factors = np.array([(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) | 1) for i in range(minima)], np.uint64)

    def run(batches):
        for batch in batches:
            fps, sizes, keys, digests, least = [], [], [], [], [np.zeros(0, "<u8")]
            for x in batch.column(1):
                h = shingles_of(x.as_py() or "", width)
                if minima:
                    h = np.unique(h)
                    digests.append(xxhash.xxh3_128_digest(h))
                    with np.errstate(over="ignore"):
                        keys.append([int((h * f).min().astype(np.int64)) for f in factors] if len(h) else [])
                    if share:
                        least.append(h[:int(share * len(h)) + SPARE_ROWS])
                fps.append(fingerprint(h))
                sizes.append(len(h))
            columns = {"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
                       "minima": pa.array(keys if minima else [[]] * len(fps), pa.list_(pa.int64())),
                       "digest": pa.array(digests if minima else [None] * len(fps), pa.binary())}
            if share:
                ends = np.cumsum([len(x) for x in least], dtype=np.int32)
                columns["least"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least).view(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, n_shingles long, minima array<long>, digest binary" + (", least array<long>" if share else ""))


def pivot_table(fp: Column, n: int = PIVOTS) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))) for p in pivots(n)])


def pivot_gap(a: Column, b: Column, n: int = PIVOTS) -> Column:
    """Largest coordinate difference of two rows of the table."""
    return F.greatest(*[F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(n)])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_groups(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 groups that cover all bits."""
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct values of ``fps(fp)``, all within ``radius`` bits, that connect all that are.

    ``radius`` up to 2: beyond it, full blocks would need more neighbours than one bit.
    """
    if not 0 <= radius <= 2:
        raise ValueError("link() is exact for radii 0 to 2; near_copies() searches further")
    part = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    groups = bit_groups(radius)
    keys = [F.struct(F.lit(i).alias("t"), (F.shiftleft(part(*g1), g2[1]).bitwiseOR(part(*g2))).alias("k"))
            for i, (g1, g2) in enumerate(combinations(groups, 2))]
    blocks = fps.select("fp", F.explode(F.array(*keys)).alias("block")).select("block.t", "block.k", "fp")
    sizes = blocks.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(blocks.join(sizes, ["t", "k"]))
    side = shared.filter(F.col("n") <= FULL).select("t", "k", "fp", pivot_table(F.col("fp")).alias("table"))
    a, b = (side.select("t", "k", F.col("fp").alias(x), F.col("table").alias(f"table_{x}")) for x in "ab")
    close = (a.join(b, ["t", "k"]).filter("a < b")
             .filter(pivot_gap(F.col("table_a"), F.col("table_b")) <= radius)
             .filter(distance(F.col("a"), F.col("b")) <= radius).select("a", "b"))
    full = shared.filter(F.col("n") > FULL).select("fp").distinct()
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    meet = full.select("fp", F.explode(one_bit).alias("at"))
    least = meet.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = (meet.join(least, "at").filter("fp <> b").select(F.col("fp").alias("a"), "b")
           .filter(distance(F.col("a"), F.col("b")) <= radius))
    return close.union(met).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def classes(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fp, n_shingles, component_id.

    component_id is the smallest doc_id among rows whose fingerprints are reachable over links of at most ``radius``
    bits; rows without a word have fingerprint 0 and take part like any other. Repeated rows stay repeated; rows with a
    null id get the component of their fingerprint; extra columns are ignored; no rows give none.
    """
    rows = saved(fingerprints(documents, width).drop("minima", "digest"))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = saved(components(link(nodes.select("fp"), radius)))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "n_shingles", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_copies(documents: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 20, minima: int = 8) -> DataFrame:
    """(doc_id, keeper): rows whose shingle set is reachable over links of Jaccard similarity >= ``similarity``; keeper is
    the smallest id of the group. Rows alone are left out; rows without a word and rows with a null id link to nothing.

    Texts with equal shingle sets meet by a digest of the set. The rest meet in two steps, and every pair is verified on its whole shingle sets
    if their sizes allow the similarity. The first step joins nearly all that is similar at little cost: texts meet where one of ``minima`` minima
    agrees. Its blocks with over ``FULL`` members are not paired off, as a group of n near copies has up to n * n / 2 links; ``TURNS`` turns try every
    member against ``LEADERS`` members of its block (first those with most copies and in most full blocks, then by hash) whose fingerprints
    are within ``radius`` bits. The second step loses nothing, whatever the first has found: all sets meet in prefixes of their shingles
    (``_in_prefixes``) where no link joins them yet, and sets in prefix blocks of over ``FULL`` members by ``_prefix_pairs``.
    """
    share = (1 + SPARE) * (1 - similarity)
    rows = saved(fingerprints(documents, width, minima, share=share).filter("doc_id is not null and n_shingles > 0"))
    # Keep one of each set and tie the others to it.
    firsts = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("fp").alias("fp"),
                                              F.first("n_shingles").alias("n"), F.first("minima").alias("minima")))
    copies = rows.join(firsts.select("digest", "first"), "digest").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    unique = firsts.select(F.col("first").alias("id"), "copies", "fp", "n",
                           F.explode(F.transform("minima", lambda m, i: F.struct(i.alias("t"), m.alias("k")))).alias("block"))
    blocks = unique.select("block.t", "block.k", "id", "copies", "fp", "n")
    sizes = blocks.groupBy("t", "k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = saved(blocks.join(sizes, ["t", "k"]))
    # One row per member of full blocks, with its blocks beside it.
    full = saved(shared.filter(f"size > {FULL}").groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("copies", "fp", "n")], F.collect_list(F.struct("t", "k", "size")).alias("blocks"), F.count(F.lit(1)).alias("n_full")))
    nodes = rows.select(F.col("doc_id").alias("id"), "digest", F.col("n_shingles").alias("n"), "least")
    edges = _verified(documents, nodes, _paired(shared.filter(f"size <= {FULL}"), similarity), width, similarity)
    if not full.isEmpty():
        # The text that others were copied from often has whole copies too, and shares more blocks with them than they do with each
        # other: such members lead first.
        for turn in range(TURNS):
            edges = saved(_star(edges))
            placed = _rooted(full, edges).select("id", "copies", "fp", "n", "n_full", "root", F.explode("blocks").alias("block"))
            salts = F.ceil(F.col("block.size") / SALTED).cast("int")
            placed = saved(placed.select("block.t", "block.k", salts.alias("salts"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"),
                                         *placed.columns[:-1]))
            lead = [F.col("copies").desc(), F.col("n_full").desc()] if turn == 0 else []
            order = [*lead, F.xxhash64("id", F.lit(turn)), F.col("id")]
            # A block's leaders are chosen salt by salt first, and given to each salt.
            heads = top_k(top_k(placed, ["t", "k", "salt"], order, LEADERS).drop("rank"), ["t", "k"], order, LEADERS)
            heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            edges = edges.union(_verified(documents, nodes, _led(placed, heads, radius, similarity), width, similarity))
    edges = saved(_star(edges))
    # Ids alone: what goes to the hashes is small, and they stay where they are.
    kept = saved(firsts.select(F.col("first").alias("id")).distinct())
    placed = saved(_in_prefixes(documents, _rooted(nodes.join(kept, "id", "left_semi"), edges), width, similarity))
    links = _verified(documents, nodes, _met(placed.filter(f"size <= {FULL}"), similarity), width, similarity)
    crowded = saved(placed.filter(f"size > {FULL}").select(F.col("id").alias("doc_id")).distinct())
    if not crowded.isEmpty():
        sets = saved(_sets(documents, crowded, width))
        links = links.union(_agreeing(sets, saved(_prefix_pairs(sets, edges, similarity)), similarity))
    edges = edges.union(links)
    groups = components(edges.union(copies))
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("keeper"))


def _star(edges: DataFrame) -> DataFrame:
    """The same groups with every node tied to its group's smallest."""
    return components(edges).filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rooted(members: DataFrame, star: DataFrame) -> DataFrame:
    """Adds the smallest id of its group to each id; ``star`` ties a node to it once."""
    return members.join(star.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _sizes_fit(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity


def _paired(blocks: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a block's members whose sizes allow the similarity; each once."""
    a, b = (blocks.select("t", "k", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, ["t", "k"]).filter("a > b").filter(_sizes_fit(similarity)).select("a", "b").distinct()


def _led(members: DataFrame, heads: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs of members and leaders of their blocks that groups, sizes, pivot table and fingerprints leave; each once.

    A block's leaders are one row, so a member meets them in one row a block; it keeps what may be similar, and what leads several of
    its blocks once, before any pair is made.
    """
    leaders = heads.groupBy("t", "k", "salt").agg(F.collect_list(F.struct("id", "fp", "n", "root")).alias("leaders"))
    fits = lambda h: (  # noqa: E731  what is in one group already is not tried again
        (h["root"] != F.col("root")) & (F.least(h["n"], F.col("n")) >= F.greatest(h["n"], F.col("n")) * similarity)
        & (distance(h["fp"], F.col("fp")) <= radius))
    met = members.join(leaders, ["t", "k", "salt"]).select("id", "fp", F.filter("leaders", fits).alias("leaders")).filter(F.size("leaders") > 0)
    close = lambda h: pivot_gap(pivot_table(h["fp"]), pivot_table(F.col("fp"))) <= radius
    once = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("leaders"))).alias("leaders"), F.first("fp").alias("fp"))
    pairs = once.select("id", F.explode(F.transform(F.filter("leaders", close), lambda h: h["id"])).alias("leader"))
    return pairs.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()


def _last(similarity: float) -> Column:
    """Place of the last shingle in the prefix of a set of n, from 0, by which it meets smaller sets; see ``_prefix_pairs``."""
    return F.col("n") - F.ceil(F.col("n") * similarity - GUARD)


def _is_short(similarity: float) -> Column:
    """Whether a place is in the shorter prefix, by which a set of n meets larger ones."""
    return F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * similarity / (1 + similarity) - GUARD)


def _in_prefixes(documents: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """(k, id, n, root, at, short, size): shingles k that ``size`` > 1 prefixes of ``nodes(id, digest, n, root, least)`` hold, and their places.

    Any one order of all shingles makes prefixes that lose nothing (``_prefix_pairs``). This one needs no counts of all shingles: it goes by hash,
    but shingles that over ``FULL`` prefixes by hash alone would hold come last. A set gives those up for its next hashes; one whose ``least``
    hold too few is read again as a whole.
    """
    prefix = (_last(similarity) + 1).cast("int")
    common = saved(nodes.select(F.explode(F.slice("least", F.lit(1), prefix)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("df"))
                   .filter(f"df > {FULL}").select("k"))

    def ordered(sets: DataFrame) -> DataFrame:
        held = saved(sets.select("id", F.explode("least").alias("k")).join(common, "k", "left_semi").groupBy("id").agg(F.collect_set("k").alias("held")))
        both = sets.join(held, "id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))
        return both.withColumn("rare", F.array_except("least", "held")).withColumn("least", F.concat("rare", F.array_intersect("least", "held")))

    whole = (F.size("rare") >= prefix) | (F.size("least") >= F.col("n"))
    near = ordered(nodes)
    lacking = saved(near.filter(~whole).select("id", "digest", "n", "root"))
    sets = near.filter(whole).select("id", "n", "root", "least")
    if not lacking.isEmpty():
        texts = documents.join(lacking.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        again = fingerprints(texts, width, 1, share=1.0).select(F.col("doc_id").alias("id"), "digest", "least")
        sets = sets.union(ordered(saved(lacking.join(again, ["id", "digest"]))).select("id", "n", "root", "least"))
    places = sets.select("id", F.posexplode(F.slice("least", F.lit(1), prefix)).alias("at", "k"))
    # Most shingles are in one prefix only and go before anything is added to them.
    sized = places.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("k"))).filter("size > 1").join(nodes.select("id", "n", "root"), "id")
    return sized.select("k", "id", "n", "root", "at", _is_short(similarity).alias("short"), "size")


def _met(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) in the blocks of ``prefixes(k, id, n, root, at, short)`` that may have the similarity and are in different groups; each once."""
    a, b = (prefixes.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "root", "at", "short")]) for x in "ab")
    met = a.join(b.filter("short_b"), "k").filter(_may_agree(similarity))
    return met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _may_agree(similarity: float) -> Column:
    """What groups, sizes and places of a shared shingle leave of pairs of a larger set a and a smaller set b."""
    return (F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "id_a") > F.struct("n_b", "id_b")) & _sizes_fit(similarity) & (
        F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        >= F.ceil((F.col("n_a") + F.col("n_b")) * similarity / (1 + similarity) - GUARD))


def _prefix_pairs(sets: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``sets(doc_id, s)`` that may have the similarity t and are not in one group of the star ``edges``; lossless.

    Shingles are put in one order, rarest first. Two sets of n >= m shingles with Jaccard similarity t share o = t / (1 + t) * (n + m)
    or more, so their first shared shingle is among the first n - t * n + 1 of the larger and the first m - 2 t / (1 + t) * m + 1 of
    the smaller, and at least o - 1 shingles are behind it in both. Members that are joined already are not tried against
    each other: in each prefix block, the members outside its largest group are tried against all, the group's own only against these.
    """
    sized = _rooted(sets.select(F.col("doc_id").alias("id"), F.size("s").alias("n"), "s"), edges)
    words_ = saved(sized.select("id", "n", "root", F.explode("s").alias("k")))
    # A shingle of one set only brings no pair, but takes its place in the order.
    counts = words_.groupBy("k").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = words_.join(counts, "k")
    at_id = W.partitionBy("id")
    placed = known.withColumn("at", F.row_number().over(at_id.orderBy("df", "k")) - 1 + F.col("n") - F.count(F.lit(1)).over(at_id))
    prefix = saved(placed.filter(F.col("at") <= _last(similarity)).select("k", "id", "n", "root", "at", _is_short(similarity).alias("short")))
    groups = prefix.groupBy("k", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = (groups.groupBy("k").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count(F.lit(1)).alias("groups"))
               .filter("groups > 1").drop("groups"))
    split = saved(prefix.join(largest, "k").withColumn("inside", F.col("root") == F.col("major")).drop("major"))
    a, b = (split.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "root", "at", "short", "inside")]) for x in "ab")
    b = b.filter("short_b").drop("short_b")
    fit = _may_agree(similarity)
    met = a.filter("not inside_a").join(b, "k").filter(fit).unionByName(a.filter("inside_a").join(b.filter("not inside_b"), "k").filter(fit))
    return met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _sets(documents: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): distinct shingle hashes of the texts of ``asked(doc_id)``."""
    texts = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.min(text_of("text")).alias("text"))
             .select("doc_id", words(lower_ascii(F.col("text"))).alias("w")))
    return texts.select("doc_id", F.array_distinct(shingle_hashes(F.col("w"), width)).alias("s"))


def _asked(pairs: DataFrame) -> DataFrame:
    """(id) of either end of ``pairs(a, b)``, once."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _likely(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose smallest hashes in ``nodes(id, n, least)`` agree as far as the similarity asks; lossless.

    Two sets of n and m shingles with o shingles in common have l or more in common among the first n - o + l of the one and the first
    m - o + l of the other, in any one order. l is as large as the hashes at hand allow, and o as in ``_prefix_pairs``.
    """
    # No more hashes than a prefix and some are moved for a pair.
    kept = F.slice("least", F.lit(1), (_last(similarity) + SPARE_ROWS).cast("int"))
    hashes = saved(nodes.join(saved(_asked(pairs)), "id", "left_semi").select("id", "n", kept.alias("h")))
    a, b = (hashes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("h").alias(f"h_{x}")) for x in "ab")
    more_a, more_b = (F.col(f"n_{x}") - F.ceil((F.col("n_a") + F.col("n_b")) * similarity / (1 + similarity) - GUARD) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("l", F.least(F.size("h_a") - more_a, F.size("h_b") - more_b).cast("int"))
    first_a, first_b = (F.slice(f"h_{x}", F.lit(1), F.greatest(more + F.col("l"), F.lit(0)).cast("int")) for x, more in (("a", more_a), ("b", more_b)))
    return both.filter(F.size(F.array_intersect(first_a, first_b)) >= F.col("l")).select("a", "b").distinct()


def _verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs whose distinct shingles have the Jaccard similarity; only texts of some likely pair are read into it."""
    pairs = saved(_likely(nodes, saved(pairs), similarity))
    asked = saved(_asked(pairs).select(F.col("id").alias("doc_id")))
    return _agreeing(saved(_sets(documents, asked, width)), pairs, similarity)


def _agreeing(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("i"), (F.size("s_a") + F.size("s_b")).alias("u"))
    return saved(both.filter(F.col("i") >= (F.col("u") - F.col("i")) * similarity).select("a", "b"))
