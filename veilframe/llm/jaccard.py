"""N-gram Jaccard join: sets in one global order, rare shingles first; prefixes propose pairs, tries verify them.

Two sets that are similar enough share a shingle of their prefixes (their rarest quarter). Documents with equal sets
are one class. Pairs of classes are verified by a walk through a trie of the partners' ordered sets, which shares the
overlap of common beginnings and leaves a branch as soon as what remains can't reach the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import connected_components, pack, parts, ranks, runs, slices, small, stored, unpack
from veilframe.llm.katz import END, START, STEP, mix, tokens

#: Counts of shingles, hashed into so many cells, give the global order; SLICES rows of them are sent by each task.
CELLS, SLICES = 1 << 20, 64
#: Leaders of each shingle's group in the first round; groups with one class more at most are done by then.
SMALL = 2
#: Partners in one trie.
TRIE = 256
#: Prefix shingles are dealt out to parts, one for so many bytes of text.
PART_BYTES = 16_000_000
#: Texts are cut into shingles in groups of about so many bytes.
GROUP = 1 << 22


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct digests of each text's runs of `width` words; of all its words if it has fewer."""
    h, w, d = tokens(texts)
    keep = w != END
    w, d = w[keep], d[keep]
    edges = np.searchsorted(d, np.arange(len(texts) + 1))
    x = np.full(max(0, len(w) - width + 1), START)
    for k in range(width):
        x = mix(x * STEP + w[k : len(w) - width + 1 + k]) if len(x) else x
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(x[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for t in w[a:b]:
                one = mix(one * STEP + t)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(n: int, threshold: int) -> int:
    """Shingles that a set of n has in common with any similar one, at least."""
    return -(-threshold * n // 100)


def _class_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _survey(width: int, seed: int):
    """A row for each document (id, class, second digest, size), and each task's counts of shingles by cell."""

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for b in (part for whole in batches for part in parts(whole, "__text", GROUP)):
            texts, ids, size = b.column("__text").to_pylist(), [], []
            for a, z in slices(texts, GROUP):
                sets = shingles(texts[a:z], width)
                np.add(counts, np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32), out=counts)
                ids += [_class_of(s, seed) if len(s) else (None, None) for s in sets]
                size += map(len, sets)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), b.column("__id"), pa.array([c for c, _ in ids], pa.int64()), pa.array([c for _, c in ids], pa.int64()), pa.array(size, pa.int64())],
                names=["slice", "counts", "id", "cls", "twin", "n"],
            )
        each = CELLS // SLICES
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([counts[k * each : (k + 1) * each].tobytes() for k in range(SLICES)], pa.binary()), none, none, none, none], names=["slice", "counts", "id", "cls", "twin", "n"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in t.column("counts"))
    return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, counts[(s >> np.uint64(44)).astype(np.int64)]))]


def _prefixes(width: int, seed: int, threshold: int, n_parts: int, shipped):
    """Prefix shingles of each class of a group of texts: a cell for each part, classes numbered in the cell."""

    def run(batches):
        counts = np.frombuffer(shipped.value, np.uint32)
        for b in (part for whole in batches for part in parts(whole, "__text", GROUP)):
            texts, seen = b.column("__text").to_pylist(), set()
            for a, z in slices(texts, GROUP):
                known, sizes, tokens_of, own, place = [], [], [], [], []
                for s in shingles(texts[a:z], width):
                    c = _class_of(s, seed)[0] if len(s) else None
                    if c is None or c in seen:
                        continue
                    seen.add(c)
                    p = len(s) - least_overlap(len(s), threshold) + 1
                    tokens_of.append(_ordered(s, counts)[:p])
                    own.append(np.full(p, len(known), np.uint32))
                    place.append(np.arange(p, dtype=np.uint32))
                    known.append(c)
                    sizes.append(len(s))
                if not known:
                    continue
                token, own, place = (np.concatenate(x) for x in (tokens_of, own, place))
                part = ((mix(token) >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
                order = np.lexsort((own, part))
                token, own, place, part = token[order], own[order], place[order], part[order]
                cut = np.append(runs(part), len(part))
                cells = []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    there, at = np.unique(own[x:y], return_inverse=True)
                    cells.append(pack(token[x:y], small(at), small(place[x:y]), np.array(known, np.int64)[there], small(np.array(sizes)[there])))
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(cells, pa.binary())], names=["part", "body"])

    return run


def _shared(threshold: int):
    """The shingles of a part that at least two classes have that can be similar, and who has them where."""
    return lambda cells: _sharers(cells, threshold)


def _sharers(cells: pa.Table, threshold: int) -> pa.Table:
    token, cls, place, n = [], [], [], []
    for body in cells.column("body").to_pylist():
        t, at, i, known, sizes = unpack(body)
        token.append(t)
        cls.append(known[at])
        place.append(i.astype(np.int32))
        n.append(sizes[at].astype(np.int32))
    token, cls, place, n = (np.concatenate(x) for x in (token, cls, place, n))
    order = np.lexsort((cls, token))
    token, cls, place, n = token[order], cls[order], place[order], n[order]
    first = runs(token, cls)
    token, cls, at, n = token[first], cls[first], place[first], n[first]
    # a class stays if another one of the group has a size that it can be similar to
    key, size = ranks(token) << 32, n.astype(np.int64)
    order = np.argsort(key | size)
    key, size, place = key[order], size[order], at[order].astype(np.int64)
    low = -(-threshold * size // 100)
    high = np.minimum(100 * size // threshold, (100 + threshold) * (size - place) // threshold - size)
    others = np.searchsorted(key | size, key | np.maximum(high, 0), "right") - np.searchsorted(key | size, key | low) - (size <= high)
    keep = order[others > 0]
    return pa.table({"token": token[keep].view(np.int64), "cls": cls[keep], "n": n[keep], "i": at[keep]})


def _texts(width: int, seed: int):
    """The class and the compressed text of each document; equal classes of a group of texts once."""

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, "__text", GROUP)):
            texts = b.column("__text").to_pylist()
            for a, z in slices(texts, GROUP):
                own = {_class_of(s, seed)[0]: t for s, t in zip(shingles(texts[a:z], width), texts[a:z], strict=True) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([zstandard.compress(t, 3) for t in own.values()], pa.binary())], names=["cls", "body"])

    return run


def trie_links(probe: np.ndarray, partners: list[tuple[int, np.ndarray]], rank, threshold: int) -> list[int]:
    """Ids of the partners whose sets are similar to the probe's.

    The trie is kept as the sorted list of its paths: what a path shares with the one before it is their common
    beginning in the trie, whose overlap is taken over. rank: array of sort keys of a set in the global order.
    """
    keyed = sorted(((rank(s), i, s) for i, s in partners), key=lambda x: (x[0].tobytes(), x[1]))
    inside = np.sort(probe)
    links, before, overlaps = [], np.empty(0, np.int64), np.zeros(1, np.int64)
    for _, i, s in keyed:
        n = len(s)
        need = -(-threshold * (len(probe) + n) // (100 + threshold))
        m = min(n, len(before), len(overlaps) - 1)
        differ = np.flatnonzero(s[:m] != before[:m])
        at = int(differ[0]) if len(differ) else m
        path = [overlaps[: at + 1]]
        got = int(path[0][-1])
        while at < n and got + min(n - at, len(probe) - got) >= need:
            step = s[at : at + 64]
            place = np.minimum(np.searchsorted(inside, step), len(inside) - 1)
            path.append(got + np.cumsum(inside[place] == step))
            got, at = int(path[-1][-1]), at + len(step)
        before, overlaps = s, np.concatenate(path)
        if at == n and 100 * got >= threshold * (len(probe) + n - got):
            links.append(i)
    return links


def _verify(width: int, threshold: int, shipped):
    """Streams groups (a, blk): the probe's row first, then its partners; texts are cut into ordered sets on arrival."""

    def run(batches):
        counts = np.frombuffer(shipped.value, np.uint32)
        key, probe, partners = None, None, []
        out_a, out_b = [], []

        def done():
            if probe is not None and partners:
                hits = trie_links(probe, partners, lambda s: s.astype(">i8"), threshold)
                out_a.extend([key[0]] * len(hits))
                out_b.extend(hits)

        for b in (part for whole in batches for part in parts(whole, "body", GROUP)):
            cols = [b.column(c).to_pylist() for c in ("a", "blk", "b")]
            texts = [zstandard.decompress(t) for t in b.column("body").to_pylist()]
            sets = (_ordered(s, counts).view(np.int64) for x, z in slices(texts, GROUP) for s in shingles(texts[x:z], width))
            for a, blk, other, s in zip(*cols, sets, strict=True):
                if (a, blk) != key:
                    done()
                    key, probe, partners = (a, blk), None, []
                if other is None:
                    probe = s
                else:
                    partners.append((other, s))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a.clear()
            out_b.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, verify) -> DataFrame:
    """The similar ones of the pairs (a, b) of classes. texts: (cls, body), each class once."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIE).alias("blocks"))
    pairs = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("blk"))
    probes = pairs.select(F.col("a").alias("cls"), "a", "blk", F.lit(None).cast("long").alias("b")).distinct()
    want = stored(pairs.select(F.col("b").alias("cls"), "a", "blk", "b").unionByName(probes))
    rows = texts.join(want, "cls").select("a", "blk", "b", "body")
    return rows.repartition("a", "blk").sortWithinPartitions("a", "blk", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long")


def _alike(n_a: str, i_a: str, n_b: str, i_b: str, threshold: int):
    """Whether sets of these sizes can be similar if the shingle at these places is the first that they share."""
    return F.expr(f"100L * least({n_a}, {n_b}) >= {threshold} * greatest({n_a}, {n_b}) and {100 + threshold}L * least({n_a} - {i_a}, {n_b} - {i_b}) >= {threshold} * ({n_a} + {n_b})")


def _round(groups: DataFrame, lo: int, hi: int, threshold: int) -> DataFrame:
    """Pairs (a, b) to verify: the leaders of each group, its classes of rank lo ... hi - 1, with the classes that are not
    yet in the component of the group's first class.

    A leader outside of that component leaves the classes inside to their own turns as leaders, so that most pairs of a
    large group of near copies never come up, and yet each pair does unless it is in one component by then.
    """
    main = groups.where("rank = 0").select("token", F.col("comp").alias("main"))
    apart = groups.join(main, "token").where("comp <> main")
    lead = groups.where(F.col("rank").between(lo, hi - 1)).select("token", *[F.col(c).alias(f"l_{c}") for c in ("cls", "n", "i", "comp", "rank")])
    pairs = apart.join(lead, "token").where("l_comp <> comp and (l_comp = main or rank > l_rank)").where(_alike("n", "i", "l_n", "l_i", threshold))
    return pairs.select(F.col("l_cls").alias("a"), F.col("cls").alias("b")).distinct()


def similar_documents(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 5, threshold: int = 75, seed: int = 0) -> DataFrame:
    """Groups of documents linked by similar sets of word n-grams.

    Returns id_col, n_shingles (size of the set), class_id (digest of the set; null if empty), component_id (smallest id
    reachable by links). Two sets are linked when 100 * intersection >= threshold * union. Words are runs of other
    characters than space and \\t-\\r, A-Z folded; a text of fewer than `width` words is one n-gram.

    No link between components is missed: every pair of classes that shares a prefix shingle is either verified or found
    to be in one component already. The classes of a shingle's group take turns as leaders, twice as many in each round,
    so that a large group of near copies takes a few rounds, not all pairs. Equal sets are one class from the start. The driver gets the counts of CELLS cells (4 MB at any size) and no row of the corpus.

    Null and empty texts have no shingles and are linked with nothing. Rows with equal sets share their class, whatever
    their ids; texts that share an id are linked each for itself. Null ids are linked like others, but never are the
    smallest unless alone. Empty tables give empty results. Digests of sets have 64 bits; a second
    digest tells if two sets ever share one, and an error then asks for another seed.
    """
    spark = docs.sparkSession
    work = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"))
    survey = stored(work.mapInArrow(_survey(width, seed), "slice int, counts binary, id long, cls long, twin long, n long"))
    sums = survey.where("slice is not null").groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()
    cells = {r.slice: bytes(r.counts) for r in sums}
    zero = bytes(4 * (CELLS // SLICES))
    shipped = spark.sparkContext.broadcast(b"".join(cells.get(k, zero) for k in range(SLICES)))
    rows = survey.where("slice is null").select("id", "cls", "twin", "n")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"), F.min("twin").alias("t0"), F.max("twin").alias("t1"))
    if not classes.where("t0 <> t1").isEmpty():
        raise ValueError("two different sets have the same digest: choose another seed")

    # prefix shingles that at least two classes have; the classes of each in one order for all groups
    n_bytes = work.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n_parts = max(1, -(-n_bytes // PART_BYTES))
    cells = work.select("__text").mapInArrow(_prefixes(width, seed, threshold, n_parts, shipped), "part int, body binary")
    active = stored(cells.groupBy("part").applyInArrow(_shared(threshold), "token long, cls long, n int, i int"))
    turn = Window.partitionBy("token").orderBy(F.xxhash64("cls"), "cls")
    groups = stored(active.select("*", (F.row_number().over(turn) - 1).alias("rank"), F.col("cls").alias("comp")))
    comp = None

    def texts_of(classes_asked):
        # ids only narrow down the texts: several may have one id, or none; each text's class tells if it is asked for
        reps = classes_asked.join(classes.select("cls", "first"), "cls").select(F.col("first").alias("__id"))
        texts = work.join(reps, "__id", "left_semi").select("__text").unionByName(work.where("__id is null").select("__text"))
        return texts.mapInArrow(_texts(width, seed), "cls long, body binary").groupBy("cls").agg(F.first("body").alias("body"))

    verify, texts = _verify(width, threshold, shipped), None
    lo, hi = 0, SMALL
    while not groups.isEmpty():
        pairs = stored(_round(groups, lo, hi, threshold))
        if texts is None:  # the first round asks for most of them, once
            now = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        else:
            now = texts
        links = stored(_links(pairs, now, verify))
        if comp is not None:
            links = links.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b", "left")
            links = stored(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"))
        if not links.isEmpty():
            merged = connected_components(links)
            if comp is None:
                comp = merged.select(F.col("node").alias("cls"), F.col("component").alias("comp"))
            else:
                old = comp.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("cls", F.coalesce("component", "comp").alias("comp"))
                new = merged.select(F.col("node").alias("cls"), F.col("component").alias("comp")).join(comp.select("cls"), "cls", "left_anti")
                comp = stored(old.unionByName(new))
            groups = groups.drop("comp").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        lo, hi = hi, 3 * hi - 2 * lo
        # groups with a component besides the first class's, and with leaders to come
        left = groups.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rank").alias("last")).where(F.col("lo") < F.col("hi")).where(F.col("last") >= lo)
        groups = stored(groups.join(left.select("token"), "token").select("token", "cls", "n", "i", "rank", "comp"))
        if texts is None and not groups.isEmpty():
            texts = stored(texts_of(groups.select("cls").distinct()))
    if comp is None:
        comp = spark.createDataFrame([], "cls long, comp long")
    labelled = stored(rows.select("id", "cls", "n").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    least = labelled.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    return labelled.join(least, "comp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("least", "id").alias("component_id"))
