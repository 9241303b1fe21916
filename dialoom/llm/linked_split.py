"""Splits that keep linked records together.

Records hang together through entities (here the item number and the picture number), also
by way of others. Each entity ties its keys to the least of them, which leaves a graph of
keys alone, without those that share nothing. Its connected components are found by
alternating large-star and small-star steps; each halves long chains, works on distinct
edges, pre-aggregates minima before its shuffle and spreads the edges of hot nodes over
several tasks. Intermediate edges are written tables in the shared folder. Keys and entities
may be of any type that can be ordered.

Allocation. Components of identical size and label profile (how many records of each label)
form a bundle; only the table of bundles is solved on the driver. Sizes are dealt from the
largest: each bundle in proportion to what the splits still lack of its labels, and what doesn't
divide by an integral min-cost flow whose costs are the deviations from the quotas of each split
and of each label within it. Members of a bundle take their places in the order of a hash. One
flow over all sizes is no network flow, since a unit would weigh differently on each arc; for
one size it is, and it is solved exactly, given what larger components took.

Bounds. A size has at most ``PROFILES`` bundles: its commonest profiles, and one of the others
with their mean profile; sizes stay exact. Different sizes can't be more than the square root of
twice the records. Labels beyond the ``LABELS`` commonest are one label.

Nulls: a null entity links nothing; a record without a group key goes with the others of its
entity, and one without either is a component of its own, named by its row key. Repeated rows
link to themselves. An empty table gives an empty result. Extra columns, whatever their names,
play no part. Building a query runs the steps.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.ranking import with_global_index
from dialoom.operators.skew import lookup
from dialoom.session import forget, materialize

#: Edges of one node that one task joins at most.
HOT = 200_000
#: Profiles that one size keeps apart, and labels that a profile does.
PROFILES, LABELS = 200, 32


def item_number(c: Column | str = "id") -> Column:
    """Everything before the last underscore, as a number; null if it isn't one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^\s*(.*)_[^_]*$", 1).try_cast("bigint")


def item_key(c: Column | str = "id") -> Column:
    """The item number as a string; where it isn't a number, whatever stands before the last underscore."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(item_number(c).cast("string"), F.nullif(F.trim(F.regexp_extract(col, r"^\s*(.*)_[^_]*$", 1)), F.lit("")))


def picture_number(c: Column | str = "image") -> Column:
    """The number that follows the word image in the file name, however the rest is written."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(F.lower(c), r"image[^0-9a-z/\\]*([0-9]+)[^/\\]*$", 1), F.lit("")).try_cast("bigint")


def _minima(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u; hot u are spread by v."""
    degree = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = degree.where(F.col("n") > HOT).select("u", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    spread = F.broadcast(hot)  # at most edges / HOT rows
    left = edges.join(spread, "u", "left").withColumn("_s", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")
    right = degree.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT, F.ceil(F.col("n") / HOT).cast("int") - 1).otherwise(0))).alias("_s"))
    return left.join(right, ["u", "_s"]).drop("_s")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple:
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    r = edges.agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).first()
    return r.n, r.a, r.b


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node it reaches."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(most):
        # large star: neighbours above u go to the least of u and its neighbours
        large = _minima(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: the neighbours below u, and u, go to the least of them
        small = _minima(large)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(after, "edges")
        forget(now)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def links(records: DataFrame, key: str, entity: str) -> DataFrame:
    """(k, component): the keys that hang together with a lesser one, and the least they reach."""
    pairs = records.select(F.col(key).alias("v"), F.col(entity).alias("u")).where("u is not null and v is not null").distinct()
    tied = _minima(materialize(pairs, "links")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return components(tied).select(F.col("node").alias("k"), F.col("root").alias("component"))


def groups(records: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, component): distinct keys, with the least key of what each hangs together with.

    Two keys hang together if they share a value of ``entity``, also by way of others. Null keys
    are left out.
    """
    keys = records.select(F.col(key).alias("k")).where("k is not null").distinct()
    return keys.join(links(records, key, entity), "k", "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("component"))


def linked_pairs(members: DataFrame, key: str, part: int = 4096) -> DataFrame:
    """(a, b): all pairs of different keys of one component, smaller first.

    A component of more than ``part`` keys is cut into parts, and each pair of parts is a task of its own.
    """
    sized = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    m = lookup(members.select("component", F.col(key).alias("k")), sized, ["component"]).withColumn("p", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = m.select("component", F.col("k").alias("a"), F.col("p").alias("pa"), other.alias("pb"))
    b = m.select("component", F.col("k").alias("b"), F.col("p").alias("pb"), other.alias("pa"))
    return a.join(b, ["component", "pa", "pb"]).where("a < b").select("a", "b")


# ---------------------------------------------------------------- allocation


class Flow:
    """Integral min-cost flow by successive shortest paths (small graphs, costs may be negative)."""

    def __init__(self, nodes: int):
        self.adj: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.adj[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> float:
        total = 0.0
        while True:
            dist, via = [math.inf] * len(self.adj), [-1] * len(self.adj)
            dist[s], queue, inside = 0.0, [s], {s}
            while queue:
                x = queue.pop(0)
                inside.discard(x)
                for e in self.adj[x]:
                    y = self.to[e]
                    if self.cap[e] and dist[x] + self.cost[e] < dist[y] - 1e-9:
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in inside:
                            queue.append(y)
                            inside.add(y)
            if via[t] < 0:
                return total
            path, y = [], t
            while y != s:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push * dist[t]


Profile = str | Mapping[str, float]


def allocate(bundles: Sequence[tuple[int, Profile, int]], shares: Sequence[float], weight: float = 4.0) -> list[list[int]]:
    """How many components of each bundle (size, profile, number) go to each split.

    A profile says how many records of a component have each label; a string is one label of all.
    ``weight``: how much more a record's deviation from a split's quota costs than one from
    the quota of its label within the split.
    """
    k = len(shares)
    profiles = [{p: s} if isinstance(p, str) else dict(p) for s, p, _ in bundles]
    whole = [[0] * k for _ in bundles]
    total = sum(s * n for s, _, n in bundles)
    rest: dict[str, float] = defaultdict(float)
    for (_, _, n), profile in zip(bundles, profiles):
        for label, c in profile.items():
            rest[label] += c * n
    lack = [total * p for p in shares]
    lack_label = {label: [v * p for p in shares] for label, v in rest.items()}
    sizes: dict[int, list[int]] = defaultdict(list)
    for b, (s, _, _) in enumerate(bundles):
        sizes[s].append(b)

    def take(b: int, j: int, n: int) -> None:
        whole[b][j] += n
        lack[j] -= bundles[b][0] * n
        for label, c in profiles[b].items():
            lack_label[label][j] -= c * n

    for s in sorted(sizes, reverse=True):
        wanted = _wanted(lack, lack_label, rest)
        left = []
        for b in sizes[s]:
            n = bundles[b][2]
            mix = [sum(c * wanted[label][j] for label, c in profiles[b].items()) / s for j in range(k)]
            for j in range(k):
                take(b, j, math.floor(n * mix[j] + 1e-9))
            for label, c in profiles[b].items():
                rest[label] -= c * n
            if n > sum(whole[b]):
                left.append((b, n - sum(whole[b])))
        # nodes: source, sink, bundles, splits; the costs of both kinds of deviation are convex in the units sent
        g = Flow(2 + len(left) + k)
        units, arcs = sum(r for _, r in left), []
        for x, (b, r) in enumerate(left):
            g.arc(0, 2 + x, r, 0.0)
            for j in range(k):
                for u in range(r):
                    cost = sum(abs(lack_label[label][j] - (u + 1) * c) - abs(lack_label[label][j] - u * c) for label, c in profiles[b].items())
                    arcs.append((b, j, g.arc(2 + x, 2 + len(left) + j, 1, cost)))
        for j in range(k):
            for u in range(units):
                g.arc(2 + len(left) + j, 1, 1, weight * (abs(lack[j] - (u + 1) * s) - abs(lack[j] - u * s)))
        g.run(0, 1)
        for b, j, e in arcs:
            if g.cap[e ^ 1]:
                take(b, j, g.cap[e ^ 1])
    return whole


def _wanted(lack: Sequence[float], lack_label: dict[str, list[float]], rest: Mapping[str, float], rounds: int = 10) -> dict[str, list[float]]:
    """Per label, the shares of what is left of it that go to each split: what the labels lack, fitted
    to what the splits lack."""
    k = len(lack)
    room = [max(0.0, x) for x in lack]
    scale = sum(rest.values()) / (sum(room) or 1.0)
    table = {x: [max(0.0, v) + 1e-9 * max(1, n) * (room[j] > 0) for j, v in enumerate(lack_label[x])] for x, n in rest.items() if n > 1e-6}
    for _ in range(rounds):
        for j in range(k):
            have = sum(row[j] for row in table.values())
            for row in table.values():
                row[j] *= room[j] * scale / have if have else 0.0
        for x, row in table.items():
            have = sum(row)
            table[x] = [v * rest[x] / have for v in row] if have else row
    return {x: [v / rest[x] for v in row] for x, row in table.items()}


def components_of(records: DataFrame, row_key: str, key: str, entity: str) -> DataFrame:
    """(row_key, key, entity, component) of every record, the component as a string.

    Records without a key go with their entity; those without either stand alone, under a name no
    key has.
    """
    name = lambda c, of: F.concat(F.lit(c), F.col(of).cast("string"))
    linked = lookup(records.where(F.col(key).isNotNull()), links(records, key, entity).withColumnRenamed("k", key), [key], "left")
    linked = linked.withColumn("component", F.concat(F.lit("k"), F.coalesce("component", key).cast("string")))
    keyless = records.where(F.col(key).isNull() & F.col(entity).isNotNull()).select(entity).distinct()
    of_entity = linked.join(keyless, entity, "left_semi").groupBy(entity).agg(F.min("component").alias("component"))
    alone = lookup(records.where(F.col(key).isNull()), of_entity, [entity], "left").withColumn("component", F.coalesce("component", name("e", entity), name("r", row_key)))
    return linked.unionByName(alone)


def assign(records: DataFrame, row_key: str, key: str, entity: str, label: str, shares: dict[str, float] | None = None, seed: int = 42, profiles: int = PROFILES, labels: int = LABELS) -> DataFrame:
    """(row_key, split) for every record; all that hang together share a split.

    ``label`` is the column whose values should be spread evenly, too.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = records.select(F.col(row_key).alias("_row"), F.col(key).alias("_k"), F.col(entity).alias("_e"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"))
    placed = materialize(components_of(rows, "_row", "_k", "_e").select("_row", "_label", "component"), "placed")
    common = [r._label for r in placed.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(labels).collect()]
    counts = placed.groupBy("component", F.when(F.col("_label").isin(common), F.col("_label")).otherwise(F.lit("\0")).alias("label")).agg(F.count("*").alias("n"))
    sized = counts.groupBy("component").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("profile"))
    sized = materialize(sized.withColumn("_h", F.xxhash64(F.lit(seed), "component")), "sized")
    table = sized.groupBy("size", "profile").agg(F.count("*").alias("n"))
    kept = table.withColumn("_r", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "profile"))).where(F.col("_r") <= profiles).select("size", "profile", F.lit(True).alias("own"))
    bundled = sized.join(kept, ["size", "profile"], "left").withColumn("bundle", F.when(F.col("own"), F.col("profile"))).drop("own")
    ranked = with_global_index(bundled.select("component", "size", "bundle", "_h", "profile"), ["size", "bundle", "_h", "component"], "_at")
    each = ranked.select("size", "bundle", F.explode("profile").alias("x")).groupBy("size", "bundle", "x.label").agg(F.sum("x.n").alias("n")).groupBy("size", "bundle").agg(F.collect_list(F.struct("label", "n")).alias("labels"))
    of = lambda c: [F.col("size").alias(f"{c}s"), F.col("bundle").alias(f"{c}b")]
    n = ranked.groupBy("size", "bundle").agg(F.count("*").alias("n")).select(*of("n"), "n")
    bundles = each.join(n, (F.col("size") == F.col("ns")) & F.col("bundle").eqNullSafe(F.col("nb"))).orderBy("size", "bundle").select("size", "labels", n["n"]).collect()
    names = list(shares)
    dealt = allocate([(r["size"], {x.label: x.n / r["n"] for x in r["labels"]}, r["n"]) for r in bundles], [shares[x] for x in names])
    cuts, start = [], 0
    for r, parts in zip(bundles, dealt):
        for name, m in zip(names, parts):
            if m:
                cuts.append((r["size"], start, start + m, name))
                start += m
    if not cuts:
        return placed.select(F.col("_row").alias(row_key), F.lit(None).cast("string").alias("split"))
    # splits x bundles rows; positions of a size are consecutive
    cut = records.sparkSession.createDataFrame(cuts, "size bigint, _from bigint, _to bigint, split string")
    chosen = ranked.select("component", "size", "_at").join(cut, "size").where("_at >= _from and _at < _to").select("component", "split")
    hot = sized.where(F.col("size") > HOT).select("component", F.ceil(F.col("size") / HOT).alias("parts"))  # at most records / HOT rows
    return lookup(placed, chosen, ["component"], hot=hot).select(F.col("_row").alias(row_key), "split")
