"""Near duplicates by an LSH forest over MinHash signatures, every link confirmed on full sets.

* One pass over the texts gives each document its number of shingles, a 128-bit digest of its
  shingle set and a signature. Documents of one set are folded into the smallest id.
* Each tree sorts the signatures, turned to begin at a place of its own. A region is all documents that
  share the first values of that order; inside it the neighbours in the order, who have the longest common
  prefixes, are candidates. Rows are members x trees, whatever the size of a group. A region of more than
  SORTED members is sorted in parts by longer prefixes.
* Regions are cut by ever longer prefixes until they have at most REGION members, so the depth adapts
  to how crowded a place is. Members of such a region that are still in different components meet.
* Members of regions that were too crowded for that, and of several components, meet through the first
  quarter of their shingles in one order of all shingles, of which two sets of the wanted similarity share one.
  It is exact. The shingles of most holders come last in that order and those that one component alone
  holds make nobody meet, so a group of copies or a common passage adds little.
* Candidates whose signatures agree on less than LIKELY of the values, or whose set sizes rule the
  similarity out, are dropped (at first on 4 bits of each value, which only overestimates); inside
  regions also those whose SKETCH smallest shingle hashes put the similarity under SURE (under NEARLY
  where the sketch holds both sets whole). The others are confirmed on the shingle sets of the whole texts.

At a similarity of 0.75 a pair shares the first three values of none of the 20 trees with a
probability of 2e-5, agrees on less than LIKELY with 2e-5, and is estimated under SURE with 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diamondlake.llm import arrays
from diamondlake.llm.components import connected_components, extended_components
from diamondlake.llm.common import ship_package, text_of
from diamondlake.session import Stage

WORDS, PERCENT = 5, 75
TREES, DEPTHS = 20, (3, 4, 6, 9, 14)
VALUES = TREES * DEPTHS[0]
REGION, SORTED = 128, 20_000
ROWS = 4_096                        # members of regions that one group of tasks compares
COMMON = 16_384                     # shingles of more than REGION holders that come last, a list that tasks know
LIKELY = 0.52
SKETCH, SURE, NEARLY = 256, 0.64, 0.74
FULL = np.uint32(0xFFFFFFFF)        # ends a sketch that holds the whole set
SEED = 11


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2 ** 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, VALUES, dtype=np.uint64))


def _signature_rows(words: int):
    factors, shifts = _permutations()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, ["text"]):
            sets = arrays.shingle_sets(arrays.encoded(batch["text"]), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            high = np.zeros(len(sets), np.int64)
            low = np.zeros(len(sets), np.int64)
            signs = np.zeros((len(sets), VALUES), np.int32)
            for part in _parts(full, sizes):
                every = np.concatenate([sets[i] for i in part])
                at = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
                high[part] = np.add.reduceat(arrays.mixed(every + arrays.MIX_A), at).view(np.int64)
                low[part] = np.add.reduceat(arrays.mixed(every ^ arrays.MIX_B), at).view(np.int64)
                for k in range(VALUES):
                    least = np.minimum.reduceat((every * factors[k] + shifts[k]) >> np.uint64(32), at)
                    signs[part, k] = least.astype(np.uint32).view(np.int32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "high": high,
                                "low": low, "signature": list(signs), "brief": list(_brief(signs))})
    return rows


def _brief(signs: np.ndarray) -> np.ndarray:
    """The lowest 4 bits of each value, 16 in a long, filled up with zeros."""
    wide = np.zeros((len(signs), -(-VALUES // 16) * 16), np.uint64)
    wide[:, :VALUES] = signs & 15
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return (wide.reshape(len(signs), -1, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _alike(a: Column, b: Column) -> Column:
    """Whether two briefs agree on LIKELY of the values or more: nibbles of their XOR that are not 0 differ."""
    differ = F.lit(0)
    for k in range(-(-VALUES // 16)):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ += F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= VALUES - int(LIKELY * VALUES)


def _sketch_rows(words: int):
    """The upper halves of the SKETCH smallest shingle hashes of each text, in order."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, ["text"]):
            out = np.full((len(batch), SKETCH), FULL, np.uint32)
            for k, s in enumerate(arrays.shingle_sets(arrays.encoded(batch["text"]), words)):
                s = (s[:SKETCH] >> np.uint64(32)).astype(np.uint32)
                out[k, :len(s)] = s
            yield pd.DataFrame({"id": batch["id"], "sketch": [r.tobytes() for r in out]})
    return rows


def _estimated(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a sketch and others are like enough, by the hashes up to where both are complete."""
    upto = np.minimum(own[-1], others[:, -1])[:, None]
    below = (others <= upto) & (others < FULL)
    at = np.minimum(np.searchsorted(own, others), SKETCH - 1)
    common = (below & (own[at] == others)).sum(axis=1)
    mine = np.searchsorted(own, np.minimum(upto[:, 0], FULL - 1), side="right")
    likeness = common / np.maximum(mine + below.sum(axis=1) - common, 1)
    return likeness >= np.where(upto[:, 0] == FULL, NEARLY, SURE)


def _slices(batches: Iterator[pd.DataFrame], columns: list[str],
            most: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """The batches in slices of about `most` characters, which bounds the arrays made of them."""
    for batch in batches:
        part = sum(batch[c].str.len() for c in columns).cumsum() // most
        for _, rows in batch.groupby(part, sort=False):
            yield rows.reset_index(drop=True)


def _parts(full: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The documents in parts of about `most` shingles."""
    if len(full):
        part = np.cumsum(sizes[full]) // most
        yield from np.split(full, np.flatnonzero(np.diff(part)) + 1)


def _confirmed(words: int, percent: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, ["text_a", "text_b"]):
            texts = arrays.encoded(batch["text_a"]) + arrays.encoded(batch["text_b"])
            sets, n = arrays.shingle_sets(texts, words), len(batch)
            ok = np.zeros(n, bool)
            for i in range(n):
                common = len(np.intersect1d(sets[i], sets[n + i], assume_unique=True))
                ok[i] = 100 * common >= percent * (len(sets[i]) + len(sets[n + i]) - common)
            yield batch.loc[ok, ["a", "b"]]
    return rows


def _likely_pairs(percent: int):
    """Pairs of a region in different components with like signatures. Where a region has two sides, only
    members of different sides meet."""
    def pairs(rows):
        rows = rows.sort_values(["region", "id"])
        ids, labels = rows["id"].to_numpy(), rows["component"].to_numpy()
        sizes = rows["n_shingles"].to_numpy()
        signs = np.stack(rows["signature"].to_numpy())
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint32).reshape(-1, SKETCH)
        regions, sides = rows["region"].to_numpy(), rows["side"].to_numpy()
        cut = np.flatnonzero(np.append(True, regions[1:] != regions[:-1]))
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(rows)).tolist()):
            two = sides[lo:hi].min() != sides[lo:hi].max()
            for k in range(lo, hi - 1):
                others = np.arange(k + 1, hi)
                if two:
                    others = others[sides[others] != sides[k]]
                like = (signs[others] == signs[k]).sum(axis=1) >= int(LIKELY * VALUES)
                like &= labels[others] != labels[k]
                like &= 100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])
                others = others[like]
                met = ids[others[_estimated(sketches[k], sketches[others])]]
                out_a.append(np.minimum(met, ids[k]))
                out_b.append(np.maximum(met, ids[k]))
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()
    return pairs


def _held_twice(words: int):
    """(shingle, holders, x, y) of the shingles that two or more of the texts read in a row have, with the smallest
    and the largest component of their holders: counts are added up inside a task before they are shuffled."""
    def counted(sets: list[np.ndarray], components: list[int]) -> pd.DataFrame:
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, of = every[order], np.repeat(components, [len(s) for s in sets])[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        holders = np.diff(np.append(at, len(every)))
        out = pd.DataFrame({"shingle": every[at].view(np.int64), "holders": holders,
                            "x": np.minimum.reduceat(of, at), "y": np.maximum.reduceat(of, at)})
        return out[holders > 1]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, components, size = [], [], 0
        for batch in _slices(batches, ["text"], 1 << 18):
            sets += arrays.shingle_sets(arrays.encoded(batch["text"]), words)
            components += batch["component"].tolist()
            size += len(" ".join(batch["text"]))
            if size >= 8 << 20:
                yield counted(sets, components)
                sets, components, size = [], [], 0
        if sets:
            yield counted(sets, components)
    return rows


def _first_rows(words: int, percent: int, common: np.ndarray):
    """(id, component, shingle) of the first n - ceil(n * percent / 100) + 1 shingles of each text of n: those that are
    not `common` in the order of their hashes, then common ones as they are listed."""
    rank = np.argsort(common, kind="stable")
    known = common[rank]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, ["text"], 1 << 18):
            firsts = []
            for found in arrays.shingle_sets(arrays.encoded(batch["text"]), words):
                own, n = found.view(np.int64), len(found)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                last = known[at] == own if len(known) else np.zeros(n, bool)
                first = n + (-n * percent) // 100 + 1
                own, ends = own[~last][:first], own[last][np.argsort(rank[at[last]])]
                firsts.append(np.concatenate([own, ends[:first - len(own)]]))
            at = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "component": batch["component"].to_numpy()[at],
                                "shingle": np.concatenate([np.empty(0, np.int64), *firsts])})
    return rows


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
               percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links join documents with 100 * common >= percent * united shingles; component_id is the
    smallest id reachable over links, itself included, and kept marks it. The id is a long.

    NULL text counts as empty; texts without words have 0 shingles and no links. Rows with a NULL
    id have no links, component_id NULL and are kept. Rows that repeat an id share a component,
    the links of all of them count, and all or none are kept. Extra columns are ignored. An empty
    table gives no rows. Texts are read whole, of any length.
    """
    ship_package(docs.sparkSession)
    stage = Stage(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    signed = stage.put("signed", rows.mapInPandas(
        _signature_rows(words),
        "doc_id long, n_shingles long, high long, low long, signature array<int>, brief array<long>"))
    groups = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("high", "low").agg(
        F.min("doc_id").alias("id"))
    heads = stage.put("heads", groups.join(
        signed.select("high", "low", F.col("doc_id").alias("id"), "n_shingles", "signature", "brief"),
        ["high", "low", "id"]).dropDuplicates(["high", "low", "id"]))

    neighbours, regions, crowds = _forest(heads, stage)
    wanted = stage.put("wanted", regions.select("id").union(neighbours.select("a")).union(
        neighbours.select("b")).union(crowds.select("id")).distinct())
    texts = stage.put("texts", rows.withColumnRenamed("doc_id", "id").join(
        wanted, "id", "left_semi").distinct())

    def links(name: str, pairs: DataFrame) -> DataFrame:
        signs = heads.select("id", "n_shingles", "signature")
        left = signs.toDF("a", "n_a", "s_a")
        right = signs.toDF("b", "n_b", "s_b")
        alike = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda e: e))
        likely = pairs.distinct().join(left, "a").join(right, "b").filter(
            (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & (alike >= int(LIKELY * VALUES))).select("a", "b").distinct()
        likely = stage.put(f"{name}-likely", likely)
        met = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return stage.put(f"{name}-links", met.select("a", "b", "text_a", "text_b").mapInPandas(
            _confirmed(words, percent), "a long, b long").distinct())

    # sets that repeated rows of one id hold are linked by that id
    held = signed.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "high", "low").join(
        groups, ["high", "low"]).select("doc_id", "id")
    twice = held.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    same_id = twice.join(held, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")
    first = links("neighbours", neighbours).union(stage.put("same-id", same_id))
    settled = connected_components(first, stage, "first")
    members = stage.put("members", regions.join(settled, "id", "left").select(
        "region", "id", F.coalesce("component", "id").alias("component")))
    mixed = members.groupBy("region").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("region")
    signs = heads.select("id", "n_shingles", "signature")
    sketches = stage.put("sketches", texts.mapInPandas(_sketch_rows(words), "id long, sketch binary"))

    def likely(name: str, met: DataFrame) -> DataFrame:
        """Likely pairs of regions (region, side, id, component), whose members are some thousands at most."""
        rows = stage.put(name, met.join(signs, "id").join(sketches, "id"))
        bucket = F.pmod(F.xxhash64("region"), F.lit(max(1, rows.count() // ROWS)))
        return rows.groupBy(bucket.alias("bucket")).applyInPandas(_likely_pairs(percent), "a long, b long")

    pairs = likely("open", members.join(mixed, "region").withColumn("side", F.lit(0)))
    second = links("regions", pairs)
    linked = extended_components(settled, second, stage, "all")
    if not crowds.isEmpty():
        third = links("crowds", likely("met", _rare_regions(crowds, linked, texts, stage, words, percent)))
        linked = extended_components(linked, third, stage, "last")

    member = signed.select("doc_id", "n_shingles", "high", "low")
    named = groups.join(linked, "id", "left").select(
        "high", "low", F.coalesce("component", "id").alias("of_set"))
    grouped = member.filter("n_shingles > 0 and doc_id is not null").join(named, ["high", "low"])
    single = member.filter("n_shingles = 0 or doc_id is null").withColumn(
        "of_set", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", F.col("of_set").alias("component_id"),
               F.col("doc_id").eqNullSafe(F.col("of_set")).alias("kept")]
    return grouped.select(*columns).unionByName(single.select(*columns))


def _forest(heads: DataFrame, stage: Stage) -> tuple[DataFrame, ...]:
    """Likely pairs (a, b) of neighbours in the orders, the final (region, id), and the crowded ones of the
    first depth as (region, id)."""
    turned = F.slice(F.concat(F.slice("signature", F.col("tree") * DEPTHS[0] + 1, VALUES), F.col("signature")),
                     1, DEPTHS[-1])
    prefix = lambda depth: F.xxhash64("tree", F.slice("order", 1, depth)).alias("region")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = heads.select("id", "brief", "signature", trees).select(
        "tree", "id", "brief", turned.alias("order"), F.lit(True).alias("unsorted"))
    rows = rows.withColumn("region", prefix(DEPTHS[0]))
    pairs, final, crowds = [], [], None
    for k, depth in enumerate(DEPTHS):
        sizes = rows.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
        met = stage.put(f"depth{depth}", rows.join(sizes, "region"))
        last = k + 1 == len(DEPTHS)
        # what is still crowded at the last depth hardly differs; it is cut by id
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SORTED)) if last else F.lit(0)
        order = Window.partitionBy("region", "part").orderBy("order", "id")
        side = met.filter("unsorted" if last else f"unsorted and n <= {SORTED}").withColumn("part", part).select(
            "id", "brief", F.lag("id").over(order).alias("near"), F.lag("brief").over(order).alias("of_near"))
        pairs.append(side.filter(F.col("near").isNotNull() & _alike(F.col("brief"), F.col("of_near"))).select(
            F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct())
        final.append(met.filter(f"n <= {REGION}").select("region", "id"))
        crowded = met.filter(f"n > {REGION}")
        crowds = crowds or crowded.select("region", "id")
        if last or crowded.isEmpty():
            break
        rows = crowded.select("tree", "id", "brief", "order", F.expr(f"unsorted and n > {SORTED}").alias("unsorted"),
                              prefix(DEPTHS[k + 1]))

    def united(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    return stage.put("neighbours", united(pairs).distinct()), stage.put("regions", united(final)), crowds


def _rare_regions(crowds: DataFrame, linked: DataFrame, texts: DataFrame, stage: Stage,
                  words: int, percent: int) -> DataFrame:
    """Members of crowded regions that have one of their first shingles in common, as regions (region, side, id,
    component). A shingle of more than ROWS members is cut into blocks, and every two blocks form a region.

    All sets follow one order of shingles. Of two sets of n and m shingles with the wanted similarity, the first
    n - ceil(n * percent / 100) + 1 of the one and of the other have one in common, whatever the order is. The order
    only decides how many meet: the COMMON shingles of most holders come last, the most frequent at the very end. They
    are counted where members of a region are read together, so what a crowd shares is counted where it is; a count
    may be too low and costs time alone. Only the first quarter of each set is ever shuffled.
    """
    named = stage.put("crowd", crowds.join(linked, "id", "left").select(
        "region", "id", F.coalesce("component", "id").alias("component")))
    several = named.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    members = named.join(several.select("region"), "region", "left_semi").groupBy("id").agg(
        F.min("component").alias("component"), F.min("region").alias("region"))
    crowd = stage.put("crowd-texts", texts.join(members, "id").repartitionByRange("region", "id").select(
        "id", "component", "text"))
    counted = crowd.select("component", "text").mapInPandas(
        _held_twice(words), "shingle long, holders long, x long, y long").groupBy("shingle").agg(
        F.sum("holders").alias("holders"), F.min("x").alias("x"), F.max("y").alias("y"))
    common = counted.filter((F.col("holders") > REGION) & (F.col("x") < F.col("y"))).orderBy(
        F.desc("holders"), F.desc("shingle")).limit(COMMON).select("shingle").collect()
    rare = stage.put("rare", crowd.mapInPandas(
        _first_rows(words, percent, np.array([r["shingle"] for r in reversed(common)], np.int64)),
        "id long, component long, shingle long"))
    met = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("x"),
                                      F.max("component").alias("y")).filter("x < y")
    blocks = F.ceil(F.col("n") / ROWS).cast("int")
    dealt = rare.join(met, "shingle").select(
        "shingle", "id", "component", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("side"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return dealt.select(F.xxhash64("shingle", F.least("side", "other"), F.greatest("side", "other")).alias("region"),
                        "side", "id", "component")
