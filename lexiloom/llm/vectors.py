"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Each class keeps a list of its nearest ones, begun with its neighbours in a few orders by
random hyperplanes. In every round, the members of each list and of its reverse meet (neighbours of neighbours), on
vectors of 8-bit components; a class keeps the best that it met. A list whose entries all reach the threshold is
enlarged, up to LARGEST. A sample of all vectors and one of those with links are compared with all rows by brute force;
rounds go on until the neighbour graph joins TARGET of the samples' links and grows no more, or ROUNDS is reached. A
graph that then joins less than FLOOR of them is an error.

Edges near the threshold are verified in double precision, and the verified ones of all rounds give components. A full
list may leave out links to other components, so after each round the components that hold full lists are compared
with each other, all members with all, in blocks; those of which a link exists are one. Inside a component links are
then counted by comparing its members in blocks of BLOCK, so lists longer than LARGEST lose none and no pairs are
emitted. Reverse lists of hubs are dealt out in parts.

Vectors that are null, zero, or hold null or non-finite components link with nothing, and so do rows with a null vec_id
(component_id null, not kept). Vectors of different lengths don't link; those of each length have a graph of their own,
one after the other. Rows with equal vectors link with each other, also if they repeat a vec_id. A row is judged by its
own vector: rows that repeat a vec_id with other vectors may lie in several components, each named by its smallest
vec_id. Empty tables give empty results; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

#: Cosine of a link; length of lists, also when saturated; most rounds.
THRESHOLD, LIST, LARGEST, ROUNDS = 0.95, 10, 48, 10
#: Orders by hyperplanes, signs of each, and followers that a vector meets in them; what a member may propose in one meeting.
ORDERS, SIGNS, NEXT, PROPOSE = 6, 20, 5, 4
#: Members of a hub's reverse list in one part; vectors of a block; vectors of the audit, the part of their links to reach, and the least part.
PART, BLOCK, AUDIT, TARGET, FLOOR = 128, 4096, 256, 0.995, 0.9
#: Rows of a block that are compared with all others of one at once.
ROWS = 512
#: How far 8-bit cosines may be off.
SLACK = 0.02


def _matrix(cells, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def classes(rows: DataFrame) -> DataFrame:
    """(id, low, w, embedding, v, q): a number, the smallest vec_id and the number of rows of each usable vector, itself, and scaled to length one, in doubles and in 8 bits.

    The numbers are only the same once the result is written.
    """
    full = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(np.asarray(lists.offsets))
            cells = np.asarray(lists.flatten()).astype(np.float64)
            first = np.concatenate(([0], np.cumsum(sizes)))
            vs, qs = [b""] * len(sizes), [b""] * len(sizes)
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                v = cells[first[own][:, None] + np.arange(n)]
                # Scaling by the largest component first keeps tiny and huge vectors exact.
                v = v / np.abs(v).max(1, initial=0, keepdims=True)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                q = np.rint(v / np.abs(v).max(1, keepdims=True) * 127).astype(np.int8)
                for k, x, y in zip(own.tolist(), v, q, strict=True):
                    vs[k], qs[k] = x.tobytes(), y.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "low", "w", "embedding")), pa.array(vs, pa.binary()), pa.array(qs, pa.binary())], names=["id", "low", "w", "embedding", "v", "q"])

    same = full.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id())
    return same.mapInArrow(common.task(run), f"id long, low long, w long, embedding {kind}, v binary, q binary")


def _unit(cells) -> np.ndarray:
    q = _matrix(cells, np.int8).astype(np.float32)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def first_lists(made: DataFrame) -> DataFrame:
    """(u, v, s): pairs of vectors that follow each other in orders by random hyperplanes, both ways."""

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _unit(batch.column(1).to_pylist())
            n = len(q)
            planes = np.random.default_rng(97).standard_normal((q.shape[1], ORDERS * SIGNS)).astype(np.float32)
            bits = ((q @ planes) > 0).reshape(n, ORDERS, SIGNS).astype(np.int64)
            # Gray order: keys that follow each other differ in one sign.
            bits = np.bitwise_xor.accumulate(bits, axis=2)
            key = (bits << np.arange(SIGNS - 1, -1, -1)).sum(2)
            rows = pa.array(np.repeat(np.arange(n), ORDERS))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(ORDERS), n), pa.int32()), pa.array(key.ravel()), batch.column(0).take(rows), batch.column(1).take(rows)], names=["o", "key", "id", "q"])

    def pairs(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            old = 0 if held is None else held.num_rows
            if not table.num_rows:
                continue
            o, ids = table.column("o").to_numpy(), table.column("id").to_numpy()
            q = _unit(table.column("q").to_pylist())
            out = []
            for step in range(1, NEXT + 1):
                a = np.arange(max(0, old - step), len(o) - step) if old else np.arange(0, max(0, len(o) - step))
                a = a[(o[a] == o[a + step]) & (ids[a] != ids[a + step])]
                s = (q[a] * q[a + step]).sum(1)
                out += [(ids[a], ids[a + step], s), (ids[a + step], ids[a], s)]
            held = table.slice(max(0, table.num_rows - NEXT))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out]), pa.int64()), pa.array(np.concatenate([x[1] for x in out]), pa.int64()), pa.array(np.concatenate([x[2] for x in out]), pa.float32())], names=["u", "v", "s"])

    keyed = made.select("id", "q").mapInArrow(common.task(keys), "o int, key long, id long, q binary")
    return keyed.repartitionByRange("o", "key", "id").sortWithinPartitions("o", "key", "id").mapInArrow(common.task(pairs), "u long, v long, s float")


def _best(found: DataFrame) -> DataFrame:
    """Lists (u, v, s, last) from pairs: the LIST best of each u, or all that reach the threshold, up to LARGEST; last is the least s that may still enter."""
    once = found.groupBy("u", "v").agg(F.max("s").alias("s"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    ranked = once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= LARGEST).where((F.col("at") <= LIST) | (F.col("s") >= THRESHOLD - SLACK))
    own = Window.partitionBy("u")
    # A saturated list takes whatever reaches the threshold, until it is full.
    return ranked.withColumn("size", F.count("*").over(own)).withColumn("low", F.min("s").over(own)).select(
        "u", "v", "s", F.when(F.col("size") < LIST, F.lit(-2.0)).when(F.col("size") < LARGEST, F.least("low", F.lit(THRESHOLD - SLACK))).otherwise(F.col("low")).cast("float").alias("last")
    )


def _meet(lists: DataFrame, made: DataFrame) -> DataFrame:
    """(u, v, s): what neighbours of a common neighbour propose to each other."""
    parts = lists.groupBy(F.col("v").alias("mid")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    last = lists.groupBy(F.col("u").alias("id")).agg(F.first("last").alias("last"))
    members = made.select("id", "q").join(last, "id").select(F.col("id").alias("m"), "q", "last")
    forth = lists.select(F.col("u").alias("mid"), F.col("v").alias("m")).join(parts, "mid", "left").select("mid", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "m", F.lit(True).alias("out"))
    back = lists.select(F.col("v").alias("mid"), F.col("u").alias("m")).join(parts, "mid").select("mid", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("part"), "m", F.lit(False).alias("out"))
    groups = forth.union(back).join(members, "m").groupBy("mid", "part").agg(F.collect_list(F.struct("m", "q", "last", "out")).alias("all"))

    def run(batches):
        for batch in batches:
            us, vs, ss = [], [], []
            lists = batch.column("all")
            flat = lists.flatten()
            if not len(flat):
                continue
            off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            m, out, last = flat.field("m").to_numpy(), np.asarray(flat.field("out")), flat.field("last").to_numpy()
            q = _unit(flat.field("q").to_pylist())
            for a, b in zip(off, off[1:], strict=False):
                far = np.flatnonzero(out[a:b]) + a
                if not len(far) or b - a < 2:
                    continue
                s = q[a:b] @ q[far].T
                s[m[a:b, None] == m[None, far]] = -3
                for who, whom, sims in ((np.arange(a, b), far, s), (far, np.arange(a, b), s.T)):
                    k = min(PROPOSE, sims.shape[1])
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
                    best = np.take_along_axis(sims, top, 1)
                    i, j = np.nonzero((best > last[who][:, None]) & (best > -2))
                    us.append(m[who[i]])
                    vs.append(m[whom[top[i, j]]])
                    ss.append(best[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64()), pa.array(np.concatenate(ss), pa.float32())], names=["u", "v", "s"])

    return groups.select("all").mapInArrow(common.task(run), "u long, v long, s float")


def _verified(lists: DataFrame, made: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("s") >= THRESHOLD - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    whole = near.join(made.select(F.col("id").alias("u"), F.col("v").alias("a")), "u").join(made.select(F.col("id").alias("v"), F.col("v").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = (_matrix(batch.column("a").to_pylist()) * _matrix(batch.column("b").to_pylist())).sum(1)
                yield batch.select(["u", "v"]).filter(pa.array(s >= THRESHOLD))

    return whole.mapInArrow(common.task(run), "u long, v long")


def true_links(made: DataFrame, count: int = AUDIT, among: DataFrame | None = None) -> DataFrame:
    """(u, v): all links of a sample of vectors, of those with an id in among, by comparing it with all rows; the sample is broadcast."""
    chosen = made if among is None else made.join(among, "id", "left_semi")
    sample = chosen.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(count).collect()
    ids, mine = np.array([r.id for r in sample], np.int64), [bytes(r.v) for r in sample]

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(ids):
                i, j = np.nonzero(_matrix(batch.column(1).to_pylist()) @ _matrix(mine).T >= THRESHOLD)
                u, v = ids[j], batch.column(0).to_numpy()[i]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return made.select("id", "v").mapInArrow(common.task(run), "u long, v long")


def _recall(truth: DataFrame, parts: DataFrame) -> float:
    a, b = parts.select(F.col("node").alias("u"), F.col("component").alias("p")), parts.select(F.col("node").alias("v"), F.col("component").alias("q"))
    row = truth.join(a, "u", "left").join(b, "v", "left").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("k")).first()
    return row.k / row.n if row.n else 1.0


def _balls(made: DataFrame, lists: DataFrame, parts: DataFrame) -> DataFrame:
    """(c, b, k, r, all): members of the components that hold a full list, in blocks, with each block's middle and angle."""
    full = lists.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LARGEST).select("u")
    placed = made.select("id", "v").join(parts, F.col("id") == F.col("node"), "left").select("id", "v", F.coalesce("component", "id").alias("c"))
    crowded = placed.join(full, placed["id"] == full["u"], "left_semi").select("c").distinct()
    members = placed.join(crowded, "c", "left_semi")
    sizes = members.groupBy("c").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    groups = members.join(sizes, "c").groupBy("c", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b")).agg(F.collect_list("v").alias("all"))

    def run(batches):
        for batch in batches:
            middles, angles, cells = [], [], []
            for one in batch.column("all").to_pylist():
                v = _matrix(one)
                middle = v.mean(0)
                middle /= np.sqrt((middle * middle).sum()) or 1
                middles.append(middle.tobytes())
                angles.append(float(np.arccos(np.clip(v @ middle, -1, 1)).max()))
                cells.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("b"), pa.array(middles, pa.binary()), pa.array(angles, pa.float64()), pa.array(cells, pa.binary())], names=["c", "b", "k", "r", "all"])

    return groups.mapInArrow(common.task(run), "c long, b int, k binary, r double, all binary")


def crossing(made: DataFrame, lists: DataFrame, parts: DataFrame) -> DataFrame:
    """(u, v): the components, of those that hold a full list, that some link joins, by comparing all their members.

    A full list may have no room for links to other components. Blocks of members are compared unless the angle of
    their middles rules out any link.
    """
    balls = common.cut(_balls(made, lists, parts))
    number = -(-balls.count() // BLOCK)
    mine = balls.select("c", "b", "k", "r").withColumn("block", F.pmod(F.xxhash64("c", "b"), F.lit(max(1, number))).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(1, number) - 1))))
    groups = dealt.groupBy(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("c", "b", "k", "r", "block")).alias("all"))

    def close(batches):
        for batch in batches:
            for i, j, cell in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("all"), strict=True):
                flat = cell.values
                c, b, r, block = (flat.field(x).to_numpy() for x in ("c", "b", "r", "block"))
                k = _matrix(flat.field("k").to_pylist())
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                angle = np.arccos(np.clip(k[left] @ k[right].T, -1, 1))
                near = (angle <= np.arccos(THRESHOLD) + r[left][:, None] + r[right] + 1e-6) & ((c[left][:, None] < c[right]) if i == j else (c[left][:, None] != c[right]))
                x, y = np.nonzero(near)
                x, y = left[x], right[y]
                yield pa.RecordBatch.from_arrays([pa.array(c[x]), pa.array(b[x]), pa.array(c[y]), pa.array(b[y])], names=["u", "x", "v", "y"])

    near = groups.mapInArrow(common.task(close), "u long, x int, v long, y int")
    mine, other = (balls.select(F.col("c").alias(c), F.col("b").alias(b), F.col("all").alias(name)) for c, b, name in (("u", "x", "a"), ("v", "y", "z")))
    pairs = near.join(mine, ["u", "x"]).join(other, ["v", "y"]).select("u", "v", "a", "z")

    first = made.select(F.octet_length("v").alias("n")).head(1)
    width = first[0].n // 8 if first else 1

    def linked(batches):
        for batch in batches:
            hit = []
            for a, z in zip(batch.column("a"), batch.column("z"), strict=True):
                a, z = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width) for x in (a, z))
                hit.append(bool((a @ z.T >= THRESHOLD).any()))
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    joined = common.cut(pairs.mapInArrow(common.task(linked), "u long, v long").distinct())
    common.release(balls)
    return joined


def graph(made: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Components of the links verified in all rounds and of those between crowded components, the last edges, and the audited recall."""
    truth = drawn = common.cut(true_links(made))
    lists = common.cut(_best(first_lists(made)))
    linked = None
    before, held = None, None
    for number in range(ROUNDS + 1):
        edges = common.cut(_verified(lists, made))
        have = edges.count()
        # What an earlier round has joined stays joined, even if full lists have no room for its edges now.
        held = edges.select("u", "v") if held is None else held.union(edges.select("u", "v"))
        if number >= 2:
            parts = common.components(held)
            found = crossing(made, lists, parts)
            held = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found)
            if found.head(1):
                parts = common.components(held)
                held = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
            if linked is None:
                # A sample of all vectors may have no links; one of those with a link has some.
                linked = common.cut(true_links(made, among=parts.select(F.col("node").alias("id"))))
                truth = drawn.union(linked).distinct()
            recall = _recall(truth, parts)
            if recall >= TARGET and (before is None or have <= 1.02 * before) or number == ROUNDS:
                break
        before = have
        new = common.cut(_best(lists.select("u", "v", "s").union(_meet(lists, made))))
        common.release(lists)
        lists = new
    common.release(drawn, linked, lists)
    if recall < FLOOR:
        raise RuntimeError(f"neighbour lists reach {recall:.3f} of the audited links after {ROUNDS} rounds")
    return parts, edges, recall


def counted(made: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, component, links): for each class in a component, the rows of other classes that it links with."""
    placed = made.join(parts, F.col("id") == F.col("node")).select("id", "w", "v", "component")
    sizes = common.cut(placed.groupBy("component").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")))
    mine = common.spread(placed, sizes, "component", "k").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("id", "w", "v", "block")).alias("all"))

    def run(batches):
        for batch in batches:
            ids, comps, sums = [], [], []
            lists = batch.column("all")
            flat = lists.flatten()
            if not len(flat):
                continue
            off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            name, weight, block = flat.field("id").to_numpy(), flat.field("w").to_numpy().astype(np.float64), flat.field("block").to_numpy()
            cells = flat.field("v")
            for c, i, j, a, b in zip(batch.column("component").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), off.tolist(), off[1:].tolist(), strict=False):
                v = _matrix(cells[a:b].to_pylist())
                left, right = np.flatnonzero(block[a:b] == i), np.flatnonzero(block[a:b] == j)
                other, backward = v[right], np.zeros(len(right))
                for at in range(0, len(left), ROWS):
                    some = left[at : at + ROWS]
                    near = v[some] @ other.T >= THRESHOLD
                    near &= name[a + some][:, None] != name[a + right][None, :]
                    ids.append(name[a + some])
                    sums.append(near @ weight[a + right])
                    comps.append(np.full(len(some), c))
                    if i != j:
                        backward += weight[a + some] @ near
                if i != j:
                    ids.append(name[a + right])
                    sums.append(backward)
                    comps.append(np.full(len(right), c))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(comps), pa.int64()), pa.array(np.concatenate(sums).astype(np.int64))], names=["id", "component", "links"])

    return groups.mapInArrow(common.task(run), "id long, component long, links long").groupBy("id", "component").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    common.prepare(rows.sparkSession)
    rows = common.own(rows, "vec_id", "embedding")
    made = common.cut(classes(rows))
    links = None
    # A graph for each length of vectors; a table has few, most often one.
    lengths = [r.n for r in made.groupBy(F.octet_length("q").alias("n")).agg(F.count("*").alias("k")).where("k > 1").orderBy("n").collect()]
    for n in lengths:
        own = made.where(F.octet_length("q") == n)
        parts, _, _ = graph(own)
        found = common.cut(counted(own, parts))
        links = found if links is None else links.union(found)
    by = made.select("embedding", "id", "low", "w")
    if links is None:
        by = by.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    else:
        by = by.join(links, "id", "left")
    by = common.cut(by.select("embedding", "low", "w", F.coalesce("component", "id").alias("part"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    # Components are named by their smallest vec_id, and rows find their class by the vector itself.
    lowest = common.cut(by.groupBy("part").agg(F.min("low").alias("component"), F.count("*").alias("k")))
    of = common.cut(common.spread(by, lowest, "part", "k").select("embedding", "links", "component", "w"))
    common.release(made, by, lowest)
    found = common.spread(rows.where("vec_id is not null"), of, "embedding", "w", "left").union(rows.where("vec_id is null").select("vec_id", "embedding", F.lit(0).cast("long"), F.lit(None).cast("long")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS d FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.d * b.d) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.v FROM reach JOIN l ON reach.b = l.u),
g AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v LEFT JOIN g ON vec_id = a LEFT JOIN n ON vec_id = u
"""
