"""SimHash near-duplicates: fingerprints, BK-trees over shards of fingerprints, and components.

Two fingerprints that differ in at most ``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so all
fingerprints with the same value of a block form a shard and every link lies inside a shard. A shard over ``limit``
fingerprints is divided again by blocks of the bits it does not agree on; after the last division so few free bits are
left that its size is bounded by them. Every shard gets a BK-tree: children keyed by the integer Hamming distance to
their parent. A query follows only the edges within the radius of its own distance. The trees of many shards are built
and asked level by level in numpy. Of the links only one edge per fingerprint and shard leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import free_name, whole_text
from skirmish.session import stage

SEED = 42


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash over shingles of words (A-Z lower-cased), repeats included; unsigned; zero without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest, total = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = starts[:n].tolist()
    for at in range(0, n, 65_536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], last[at : at + 65_536])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(texts: Column) -> Column:
    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return mark(texts)


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def shard_pairs(fp: np.ndarray, shard: np.ndarray, radius: int, at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``a, b`` of all links inside shards, in portions; ``shard`` is sorted, 0, 0, 1, ..."""
    n = len(fp)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[first, n])
    root = np.repeat(first, sizes)
    # Build: every fingerprint walks down; the first at a (parent, distance) becomes that child.
    at, todo = root.copy(), np.flatnonzero(root != np.arange(n))
    keys, nodes = [], []
    while len(todo):
        edge = at[todo] * 65 + np.bitwise_count(fp[todo] ^ fp[at[todo]])
        key, where, back = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(key)
        nodes.append(todo[where])
        at[todo] = todo[where][back]
        todo = np.delete(todo, where)
    key, node = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*nodes, np.zeros(0, np.int64)])
    order = np.argsort(key)
    key, node = key[order], node[order]
    # Ask: pairs of query and node, one level of the trees at a time, some queries at once.
    asks = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if not len(asks):
        return
    slots = np.cumsum(np.repeat(sizes, sizes)[asks]) // at_once
    for chunk in np.split(asks, np.flatnonzero(np.diff(slots)) + 1):
        query, here = chunk, root[chunk]
        a, b = [], []
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[here]).astype(np.int64)
            near = (d <= radius) & (query != here)
            a.append(query[near])
            b.append(here[near])
            lo = np.searchsorted(key, here * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(key, here * 65 + np.minimum(d + radius, 64), side="right")
            count = hi - lo
            query = np.repeat(query, count)
            here = node[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        yield np.concatenate(a), np.concatenate(b)


def shard_links(fp: np.ndarray, shard: np.ndarray, radius: int, at_once: int = 2_000_000) -> np.ndarray:
    """For each fingerprint the smallest place in its shard that links reach; ``shard`` is sorted, 0, 0, 1, ..."""
    label = np.arange(len(fp))
    for a, b in shard_pairs(fp, shard, radius, at_once):
        while True:  # union: the larger of the two labels takes the smaller, then labels of labels
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
    return label


def tree_edges(distinct: DataFrame, radius: int = 3, limit: int = 8192) -> DataFrame:
    """``a, b`` with a > b (as places in a shard): enough links to connect all that Hamming distance ``radius`` connects.

    ``distinct`` has one column ``fp`` (long). A shard's size is never cut: shards over ``limit`` are divided further.
    """

    def keyed(rows: DataFrame, level: int) -> DataFrame:
        """A row for each block of the free bits; ``free`` holds the mask of bits a shard does not agree on."""

        def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                free, shard, fp = (batch[c].to_numpy() for c in ("free", "shard", "fp"))
                for mask in np.unique(free):
                    mine = free == mask
                    bits = [i for i in range(64) if int(mask) >> i & 1]
                    for k, block in enumerate(blocks(bits, radius + 1)):
                        own = np.uint64(sum(1 << i for i in block)).astype(np.int64)
                        value = fp[mine] & own
                        path = np.array([f"{s}/{k}:{v:x}" for s, v in zip(shard[mine], value)], dtype=object)
                        yield pd.DataFrame({"shard": path, "free": np.full(mine.sum(), mask & ~own), "fp": fp[mine]})

        return rows.mapInPandas(divide, "shard string, free long, fp long")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            fp = rows["fp"].to_numpy()
            label = shard_links(fp.view(np.uint64), pd.factorize(rows["shard"])[0], radius)
            moved = label != np.arange(len(fp))
            return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= 100_000:
                rows = pd.concat(held, ignore_index=True)
                tail = int((rows["shard"] == rows["shard"].iloc[-1]).to_numpy().sum())  # the open shard waits
                held = [rows.iloc[len(rows) - tail :]]
                yield solve(rows.iloc[: len(rows) - tail].reset_index(drop=True))
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    rows = distinct.select(F.lit("").alias("shard"), F.lit(-1).cast("long").alias("free"), "fp")
    edges, free_bits, level = None, 64, 0
    while True:
        rows = stage(keyed(rows, level), f"shards_{level}")
        free_bits -= free_bits // (radius + 1)
        sizes = rows.groupBy("shard").count().where(F.col("count") > limit)
        last = (1 << free_bits) <= 4 * limit
        hot = None if last else stage(sizes.select("shard"), f"hot_{level}")
        some = hot is not None and bool(hot.head(1))
        fine = rows.join(hot, "shard", "left_anti") if some else rows
        found = fine.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInPandas(link, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not some:
            return edges.distinct()
        rows, level = rows.join(hot, "shard", "left_semi"), level + 1


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: hook to the least neighbour, jump, contract, repeat."""
    pairs, whole = stage(edges.where("a <> b").select("a", "b").distinct(), "pairs"), None
    while pairs.head(1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "hooks")
        while True:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = stage(step.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            step = higher.drop("moved")
            if not higher.where("moved").head(1):
                break
        if whole is None:
            whole = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = whole.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        a, b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        pairs = stage(pairs.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "pairs")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if whole is None else whole


def near_duplicates(docs: DataFrame, radius: int = 3, limit: int = 8192, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    A null text is empty, its fingerprint zero and linked like any other; a null id keeps its row and counts for no
    smallest id (a component of null ids alone has a null id); repeated rows are kept; other columns are not read; an
    empty table gives no rows.
    """
    return classes_of(docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprints(whole_text(text_column)).alias("fp")), radius, limit)


def classes_of(marked: DataFrame, radius: int, limit: int = 8192) -> DataFrame:
    """The rows of ``near_duplicates`` from ids and fingerprints, ``marked (doc_id, fp)``."""
    marked = stage(marked, "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(tree_edges(distinct.select("fp"), radius, limit)).select(F.col("node").alias("fp"), "root")
    rooted = stage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_fp, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the set of five-word shingles (A-Z lower-cased)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    seen = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    code = np.array([seen[w] for w in words] or [0], dtype=np.uint64)
    n, mix = max(1, len(code) - 4), np.uint64(0x9E3779B97F4A7C15)
    shingle = np.zeros(n, np.uint64)
    for i in range(min(5, len(code))):
        shingle = (shingle ^ code[i : i + n]) * mix
        shingle ^= shingle >> np.uint64(29)
    return np.unique(shingle)


def bands_of(shingle: np.ndarray, rows: int = 6, bands: int = 28) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` least hashes over ``shingles``.

    Two texts share a band with probability ``similarity ** rows``; at 0.8 all 28 bands miss once in five thousand pairs.
    """
    mix = np.uint64(0x9E3779B97F4A7C15)
    factor = np.random.default_rng(SEED).integers(0, 2**64, (2, rows * bands), dtype=np.uint64, endpoint=False)
    least = np.full(rows * bands, np.iinfo(np.uint64).max)
    for at in range(0, len(shingle), 4096):
        part = shingle[at : at + 4096, None] * (factor[0] | np.uint64(1)) + factor[1]
        least = np.minimum(least, part.min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * mix
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch_of(shingle: np.ndarray, words: int = 16) -> np.ndarray:
    """A bit for each of ``64 * words`` places: odd where an odd number of ``shingles`` fall.

    A shingle of one text only changes one bit at most, so the sketches of two texts never differ in more bits than their
    shingle sets have shingles apart.
    """
    odd = np.bincount((shingle >> np.uint64(7)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signatures(texts: Column) -> Column:
    @F.pandas_udf("struct<n: long, sketch: binary, bands: array<long>>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in sets], "sketch": [sketch_of(x).tobytes() for x in sets], "bands": [bands_of(x) for x in sets]})

    return sign(texts)


def may_link(n: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """False only where the 0.8 rule cannot hold (``similarity``), from sizes of shingle sets and sketches.

    Sets of n and m shingles, d of them in one set only, have a similarity of (n + m - d) / (n + m + d). So it reaches s just
    if d is at most (n + m)(1 - s) / (1 + s), and d is no less than the bits that the sketches differ in.
    """
    bits = np.zeros(np.broadcast_shapes(n.shape, m.shape), np.int64)
    for word in range(sketch.shape[-1]):
        bits += np.bitwise_count(sketch[..., word] ^ other[..., word])
    return bits <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def words_of(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1 if len(sketches) else 0)


def block_pairs(rows: DataFrame, similarity: float, limit: int = 512) -> DataFrame:
    """``a, b`` (ids, a > b) of different ``root`` that ``may_link`` in a shard of ``rows (id, n, sketch, shard, root)``.

    A shard over ``limit`` rows is cut into parts by a hash of the id, and every two parts meet in a block of their own,
    so that no task holds a whole hot shard. No pair at ``similarity`` is left out.
    """

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            ids, root, size, part = (rows[c].to_numpy() for c in ("id", "root", "n", "part"))
            sketch = words_of(rows["sketch"])
            block = np.stack([rows[c].to_numpy() for c in ("shard", "lo", "hi")])
            starts = np.r_[0, np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1, len(rows)]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(starts[:-1], starts[1:]):
                own = slice(i, j)
                mine, its, at, where = ids[own], root[own], size[own], part[own]
                near = (mine[:, None] > mine) & (its[:, None] != its)
                if block[1, i] != block[2, i]:
                    near &= where[:, None] != where
                near &= may_link(at[:, None], sketch[own, None], at, sketch[None, own], similarity)
                x, y = np.nonzero(near)
                a.append(mine[x])
                b.append(mine[y])
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = (rows[["shard", "lo", "hi"]] == rows[["shard", "lo", "hi"]].iloc[-1]).all(axis=1).to_numpy()
            tail = int(same.sum())  # the open block waits
            if tail < len(rows):
                yield solve(rows.iloc[: len(rows) - tail])
            held = rows.iloc[len(rows) - tail :]
        if held is not None:
            yield solve(held)

    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / limit).alias("parts"), (F.min("root") < F.max("root")).alias("open")).where("open").drop("open")
    cut = rows.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    met = cut.select("shard", "id", "root", "n", "sketch", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = met.select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", "root", "n", "sketch", "part")
    return met.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi").mapInPandas(link, "a long, b long").distinct()


def bitmaps(ids: DataFrame, limit: int = 4096) -> DataFrame:
    """``block, bits``: the column ``id`` (long) of a table as bitmaps, a row for each 32,768 numbers.

    Ids, not bitmaps, are exchanged. Up to ``limit`` bitmaps (16 MB) are broadcast; more are left to the planner.
    """
    block, at = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    bits = stage(ids.select(block.alias("block"), at.alias("at")).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "bitmaps")
    return F.broadcast(bits) if bits.count() <= limit else bits


def among(rows: DataFrame, bits: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` whose ``column`` is in ``bitmaps``. Wide rows are judged where they are read: only those asked for move on."""
    at = F.bitmap_bit_position(rows[column])
    byte = F.conv(F.hex(F.substring(bits["bits"], (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    known = F.call_function("bit_get", byte, (at % 8).cast("int")) == 1
    return rows.join(bits, (F.bitmap_bucket_number(rows[column]) == bits["block"]) & known, "left_semi")


def keep_one(docs: DataFrame, similarity: float = 0.8, stars: int = 3, radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies (the first), all columns as they are.

    With a ``radius`` the classes of ``near_duplicates`` (SimHash, BK-trees, components) come first and are links as they
    stand; the verified links below join what fingerprints are too far apart for, and pairs of one class are not asked again.

    A verified link is a pair of texts whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more; every
    link is verified on the whole texts. Rows of equal text (null is empty) go down to one first, by digest. Then texts
    that share a band of least hashes form a shard, for at 0.8 fingerprints often differ by ten bits, too many to cut
    them into blocks. Pairs are left unverified only where ``may_link`` proves that they are no link. In each of
    ``stars`` rounds the texts of a shard meet one text of it, first the earliest, then the one with most links that was
    not head there yet (the base of many edited copies), so most of a large group of copies costs one candidate a member
    and shard. A shard whose members but one have all been that text has no pair left and is dropped. In the last round
    all pairs of a shard that no links connect yet meet, rows that are linked already included. Links of all rounds make
    the groups, so the number of rounds changes the work only.
    An empty table gives no rows; ties go to the earlier row.
    """
    mark = free_name(docs, "row_mark")
    marked = stage(docs.withColumn(mark, F.monotonically_increasing_id()), "marked_documents")
    texts = marked.select(F.col(mark).alias("id"), whole_text().alias("own"))
    marks = {"same": F.sha2("own", 256)} | ({} if radius is None else {"fp": fingerprints(F.col("own"))})
    signs = texts.select("id", signatures(F.col("own")).alias("s"), *[c.alias(k) for k, c in marks.items()])
    signed = stage(signs.select("id", *marks, "s.n", "s.sketch", "s.bands"), "signatures")
    first = stage(signed.groupBy("same").agg(F.min("id").alias("id")).select("id"), "first_of_equal")
    signed = among(signed, bitmaps(first))
    rows = stage(signed.select("id", F.explode("bands").alias("shard")), "shards")
    shared = rows.join(rows.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1"), "shard")
    members = stage(shared.join(signed.select("id", "n", "sketch"), "id"), "members")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        asked = among(texts, bitmaps(pairs.select(F.explode(F.array("a", "b")).alias("id"))))
        both = pairs.join(asked.select(F.col("id").alias("a"), F.col("own").alias("text_a")), "a")
        both = both.join(asked.select(F.col("id").alias("b"), F.col("own").alias("text_b")), "b")
        return stage(both.where(alike("text_a", "text_b") >= similarity).select("a", "b"), f"links_{label}")

    def rooted(links: DataFrame) -> DataFrame:
        """``id, root, degree`` of linked rows."""
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        found = components(links).join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node")
        return stage(found.select(F.col("node").alias("id"), "root", "degree"), "roots")

    def joined(links: DataFrame) -> DataFrame:
        return members.join(rooted(links), "id", "left").select("id", "n", "sketch", "shard", "size", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))

    @F.pandas_udf("boolean")
    def near(n: pd.Series, sketch: pd.Series, m: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series(may_link(n.to_numpy(), words_of(sketch), m.to_numpy(), words_of(other), similarity))

    now = members.withColumns({"root": F.col("id"), "degree": F.lit(0).cast("long")})
    links = tested = heads = None
    if radius is not None:
        classes = classes_of(signed.select(F.col("id").alias("doc_id"), "fp"), radius)
        links = stage(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "links_of_classes")
        now = joined(links)
    for n in range(stars):
        now = now.where(F.col("size") > n + 1)
        free = now if heads is None else now.join(heads.select("shard", F.col("head.id").alias("id")), ["shard", "id"], "left_anti")
        head = F.min_by(F.struct("id", "n", "sketch", "root"), F.struct(-F.col("degree"), "id")).alias("head")
        new = stage(free.groupBy("shard").agg(head), f"heads_{n}")
        star = now.join(new, "shard").where(F.col("root") != F.col("head.root")).where(near("n", "sketch", "head.n", "head.sketch"))
        star = star.select(F.greatest("id", "head.id").alias("a"), F.least("id", "head.id").alias("b")).distinct()
        star = stage(star if tested is None else star.join(tested, ["a", "b"], "left_anti"), f"candidates_{n}")
        found = verified(star, str(n))
        some = bool(found.head(1))
        heads, tested = (new, star) if heads is None else (heads.unionByName(new), tested.unionByName(star))
        links = found if links is None else links.unionByName(found)
        if not some:
            break
        now = joined(links)
    left = now.where(F.col("size") > n + 2).drop("size", "degree")
    rest = stage(block_pairs(left, similarity).join(tested, ["a", "b"], "left_anti"), "candidates_rest")
    gone = components(links.unionByName(verified(rest, "rest"))).where("node <> root").select(F.col("node").alias("id"))
    kept = first.join(stage(gone, "copies"), "id", "left_anti")
    return among(marked, bitmaps(kept), mark).select(*docs.columns)


def five_words(text: str) -> set:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[i:] for i in range(5)))) if len(words) > 5 else {tuple(words)}


def jaccard(x: str, y: str) -> float:
    if x == y:
        return 1.0
    a, b = five_words(x), five_words(y)
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)
