"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm.common import WS, materialize, whole_row

#: Copies that the mix may take of one document.
MAX_COPIES = 3
#: Sources, and patterns of sources, that the driver may gather; more is an error, never a silent cut.
MAX_SOURCES, MAX_PATTERNS = 10_000, 100_000
#: Rows that a bin of the seeded order is to hold at most, on average; one bin of a pattern is looked at row by row.
BLOCK_ROWS = 4096
#: Hexadecimal digits of the order that are looked at in the first step; bins of more digits are then made inside one bin.
STEP_DIGITS = 4
#: Rows beyond the cut that may be taken to come nearer to a target, for each pattern.
EXTRA = 16


@dataclass
class FlowNetwork:
    """Min-cost flow by successive shortest paths (Dijkstra with potentials); integer capacities and costs."""

    n: int
    arcs: list[list[int]] = field(default_factory=list)  # to, capacity left, cost
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.out = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        k = len(self.arcs)
        self.arcs += [[b, capacity, cost], [a, 0, -cost]]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def flow(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, s: int, t: int) -> int:
        """Send all that can be sent, at least cost; returns how much."""
        potential, sent, far = [0] * self.n, 0, 1 << 62
        while True:
            dist, via = [far] * self.n, [-1] * self.n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for k in self.out[a]:
                    b, left, cost = self.arcs[k]
                    if left > 0 and (e := d + cost + potential[a] - potential[b]) < dist[b]:
                        dist[b], via[b] = e, k
                        heapq.heappush(heap, (e, b))
            if dist[t] == far:
                return sent
            potential = [p + min(d, dist[t]) for p, d in zip(potential, dist, strict=True)]
            push, b = far, t
            while b != s:
                push, b = min(push, self.arcs[via[b]][1]), self.arcs[via[b] ^ 1][0]
            b = t
            while b != s:
                self.arcs[via[b]][1] -= push
                self.arcs[via[b] ^ 1][1] += push
                b = self.arcs[via[b] ^ 1][0]
            sent += push


def fill_targets(sizes: Sequence[int], weights: Sequence[float], cap: int = MAX_COPIES) -> list[float]:
    """Shares of the total size by weight; what lies above ``cap`` times a source's size is shared again by weight."""
    total, n = sum(sizes), len(sizes)
    targets, full, left = [0.0] * n, [False] * n, float(total)
    while True:
        weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        over = [i for i in range(n) if not full[i] and left * weights[i] / weight > cap * sizes[i]] if weight else []
        if not over:
            for i in range(n):
                if not full[i]:
                    targets[i] = left * weights[i] / weight
            return targets
        for i in over:
            full[i], targets[i] = True, float(cap * sizes[i])
        left = total - sum(t for t, f in zip(targets, full, strict=True) if f)


def overlapping(patterns: Sequence[tuple]) -> list[list[tuple]]:
    """The patterns in groups: two are in one group if a chain of patterns that share sources joins them."""
    first: dict[object, int] = {}
    up = list(range(len(patterns)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, p in enumerate(patterns):
        for s in p:
            a, b = root(i), root(first.setdefault(s, i))
            up[max(a, b)] = min(a, b)
    groups: dict[int, list[tuple]] = {}
    for i, p in enumerate(patterns):
        groups.setdefault(root(i), []).append(p)
    return list(groups.values())


def route(patterns: dict[tuple, int], quotas: dict[object, int], copies: int = MAX_COPIES) -> dict[tuple, dict[object, int]]:
    """Tokens of each membership pattern that go to each of its sources.

    patterns: tokens by tuple of sources. Network: start, pattern (one arc a copy, the k-th costs k squared, so
    repetition is convex and spread before it deepens), source (free), end (quota of the source). Patterns that share no
    source, nor are joined over others, cannot take flow from each other, so each such group is a network of its own.
    """
    routed: dict[tuple, dict[object, int]] = {}
    for names in overlapping(list(patterns)):
        sources = list(dict.fromkeys(s for p in names for s in p))
        net = FlowNetwork(2 + len(names) + len(sources))
        place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
        for s in sources:
            net.add(place[s], 1, quotas[s], 0)
        arcs: dict[tuple, dict[object, int]] = {}
        for i, p in enumerate(names):
            for k in range(copies):
                net.add(0, 2 + i, patterns[p], k * k)
            arcs[p] = {s: net.add(2 + i, place[s], copies * patterns[p], 0) for s in p}
        net.solve(0, 1)
        routed |= {p: {s: net.flow(a) for s, a in x.items()} for p, x in arcs.items()}
    return routed


def n_words(text) -> F.Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WS))).cast("long")


def bin_digits(n: int) -> int:
    """Digits that leave about BLOCK_ROWS rows in a bin, of n."""
    return sum(n > BLOCK_ROWS * 16**k for k in range(8))


def _key(pattern: str):
    return F.to_json(pattern, {"ignoreNullFields": "false"})


def _cut(rows: DataFrame, state: DataFrame, digits) -> DataFrame:
    """State with the bin, of so many digits, in which the rest of a pattern is spent, and what stands before it.

    rows: p, o (the order), size; state: p, rest, before, cut, digits. Only rows below the cut so far are looked at.
    """
    near = rows.join(F.broadcast(state.withColumnRenamed("p", "__p")), F.col("p") == F.col("__p")).where(F.startswith("o", F.col("cut")))
    bins = near.groupBy("p", F.substr("o", F.lit(1), digits).alias("bin")).agg(F.sum("size").alias("t"), F.first("before").alias("base"), F.first("rest").alias("rest"))
    w = Window.partitionBy("p").orderBy("bin")  # at most 16 ** STEP_DIGITS rows, as many bins as a step makes
    found = bins.withColumn("upto", F.col("base") + F.sum("t").over(w)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    found = found.select("p", F.col("bin").alias("__bin"), (F.col("upto") - F.col("t")).alias("__before"))
    return materialize(state.drop("cut", "before").join(found, "p").withColumnsRenamed({"__bin": "cut", "__before": "before"}), "mix-cut")


def _fill(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(p, stop, picks): the first key that no longer fits, and keys after it that are taken all the same, largest first.

    The rows of one bin are one array a pattern, about BLOCK_ROWS long. Rows of equal key are one: all or none.
    """
    near = rows.join(F.broadcast(state.withColumnRenamed("p", "__p")), F.col("p") == F.col("__p")).where(F.startswith("o", F.col("cut")))
    each = near.groupBy("p", "o").agg(F.sum("size").alias("t"), F.first(F.col("rest") - F.col("before")).alias("gap"))
    block = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("block"), F.first("gap").alias("gap"))
    none = F.lit(None).cast("string")
    first = F.aggregate("block", F.struct(F.col("gap").alias("gap"), none.alias("stop")), lambda acc, x: F.when(acc["stop"].isNotNull(), acc).when(
        x["t"] <= acc["gap"], F.struct((acc["gap"] - x["t"]).alias("gap"), none.alias("stop"))
    ).otherwise(F.struct(acc["gap"].alias("gap"), x["o"].alias("stop"))))
    block = block.withColumn("first", first)
    later = F.filter("block", lambda x: (x["o"] > F.col("first.stop")) & (x["t"] > 0) & (x["t"] <= F.col("first.gap")))
    largest = F.array_sort(F.transform(later, lambda x: F.struct((-x["t"]).alias("t"), x["o"].alias("o"))))
    picks = F.aggregate(largest, F.struct(F.col("first.gap").alias("gap"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("picks")), lambda acc, x: F.when(
        (-x["t"] <= acc["gap"]) & (F.size(acc["picks"]) < EXTRA), F.struct((acc["gap"] + x["t"]).alias("gap"), F.concat(acc["picks"], F.array(x["o"])).alias("picks"))
    ).otherwise(acc))
    return block.select("p", F.col("first.stop").alias("stop"), picks["picks"].alias("picks"))


def mix(docs: DataFrame, sources, key, size, weights=None, targets=None, seed: str = "mix", copies: int = MAX_COPIES):
    """Choose documents and copies so that each source comes near its target.

    docs: any table. sources: column with the array of sources a row belongs to. key: column that orders a pattern's
    rows under the seed. size: column with the tokens of a row. weights: function of the sorted list of sources,
    giving a weight for each; targets: function of (sources, sizes), by default :func:`fill_targets` over weights.

    Returns (rows, report): docs with ``pattern`` (sorted distinct sources), ``size``, ``copies`` (0 to ``copies``),
    ``taken`` (size times copies); and a list of (source, size, target, routed). A null array, or none, is the
    pattern of the null source. Null sizes count as 0. Rows of size 0 count as any other and get what is open at
    their place in the order. Sources sort by code point, null last. Rows of equal key have one place, and past whole
    copies are taken all or none; give distinct keys to spread them. An empty table gives an empty result.

    Only per-pattern sums reach the driver, within MAX_PATTERNS. A pattern with flow f and t tokens gets f // t whole
    copies; for the rest, rows are taken in seeded order up to the first that no longer fits, then up to EXTRA further rows of that
    row's bin, the largest that fits each time. The cut is found from sums by bin of the order, and rows are looked at
    one by one in a single bin only, so a hot source is never in one task; wide rows are not shuffled.
    """
    spark = docs.sparkSession
    null_last = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("z"), s.alias("s")))))
    pattern = F.transform(null_last, lambda s: s["s"])
    lone = F.array(F.lit(None).cast("string"))
    rows = docs.withColumns({
        "pattern": F.when(sources.isNull() | (F.size(sources) == 0), lone).otherwise(pattern),
        "size": F.coalesce(size, F.lit(0)).cast("long"),
        "__order": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))),
    })
    slim = materialize(rows.select("pattern", _key("pattern").alias("p"), F.col("__order").alias("o"), "size"), "mix-rows")
    sums = slim.groupBy("pattern").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    sums.sort(key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    patterns = {tuple(r["pattern"]): r["t"] for r in sums}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {s: sum(t for p, t in patterns.items() if s in p) for s in names}
    if targets is None:
        want = fill_targets([sizes[s] for s in names], (weights or (lambda x: [1.0] * len(x)))(names), copies)
    else:
        want = targets(names, [sizes[s] for s in names])
    quotas = {s: round(w) for s, w in zip(names, want, strict=True)}
    flows = route(patterns, quotas, copies)
    plan = []
    for r in sums:
        t, f = r["t"], sum(flows[tuple(r["pattern"])].values())
        whole = min(copies, f // t) if t else 0
        plan.append((r["pattern"], whole, f - t * whole if t else 0, t, bin_digits(r["n"])))
    schema = T.StructType([
        T.StructField("pattern", T.ArrayType(T.StringType())), *[T.StructField(c, T.LongType()) for c in ("whole", "rest", "t")], T.StructField("digits", T.IntegerType()),
    ])
    per_pattern = spark.createDataFrame(plan, schema).select(_key("pattern").alias("p"), "whole", "rest", "t", "digits")  # at most MAX_PATTERNS rows
    open_ = per_pattern.where("rest > 0 AND rest < t").select("p", "rest", "digits", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    state = materialize(open_, "mix-cut")
    most = max((p[4] for p in plan), default=0)
    for step in range(STEP_DIGITS, most + STEP_DIGITS, STEP_DIGITS):
        state = _cut(slim, state, F.least("digits", F.lit(step)))
    known = per_pattern.join(state.select("p", "cut"), "p", "left").join(_fill(slim, state), "p", "left")
    known = materialize(known.withColumnRenamed("p", "__p"), "mix-plan")  # at most EXTRA keys and a few numbers a pattern
    marked = rows.join(F.broadcast(known), _key("pattern") == F.col("__p"), "left")
    place = F.substr("__order", F.lit(1), F.col("digits"))
    more = (F.col("rest") > 0) & (F.col("cut").isNull() | (place < F.col("cut")) | ((place == F.col("cut")) & ((F.col("__order") < F.col("stop")) | F.array_contains("picks", F.col("__order")))))
    done = marked.withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    report = [
        {"source": s, "size": sizes[s], "target": t, "routed": sum(x.get(s, 0) for x in flows.values())}
        for s, t in zip(names, want, strict=True)
    ]
    return done.select(*docs.drop("pattern", "size").columns, "pattern", "size", "copies", "taken"), report


def cycle_weights(names: list) -> list[float]:
    """1, 2, 3 and again, in the order of the sources."""
    return [float(1 + i % 3) for i in range(len(names))]


def row_key() -> F.Column:
    """What orders documents: the id, and the text of those without one."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    base = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), row_key().alias("key")), "mix-sizes")  # texts are read once
    rows, report = mix(base, F.array("source"), F.col("key"), F.col("words"), cycle_weights)
    facts = spark.createDataFrame(
        [(r["source"], r["size"], r["target"]) for r in report], "s string, source_size long, target double"
    )  # at most MAX_SOURCES rows
    return rows.join(F.broadcast(facts), rows["source"].eqNullSafe(facts["s"]), "left").select("doc_id", "size", "source_size", "target", "taken")


def remix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns it came with."""
    base = docs.select(whole_row(docs), "source", n_words(F.col("text")).alias("words"), row_key().alias("key"))
    rows, _ = mix(base, F.array("source"), F.col("key"), F.col("words"), cycle_weights)
    return rows.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


#: Water level over sources sorted by size per weight; then seeded order within each source up to the first row that no longer fits,
#: and at most 16 rows after it in the same bin, the largest that fits each time.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'))
    - (regexp_matches(coalesce(text, ''), '^[\x20\x09-\x0D]'))::INT - (regexp_matches(coalesce(text, ''), '[\x20\x09-\x0D]$'))::INT
    - (coalesce(text, '') = '')::INT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s
), lev AS (
  SELECT *, (total - coalesce(3 * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN k < coalesce((SELECT min(k) FROM lev WHERE level * w <= 3 * source_size), 1 << 30) THEN 3.0 * source_size
    ELSE w * (SELECT level FROM lev WHERE level * w <= 3 * source_size ORDER BY k LIMIT 1) END::DOUBLE AS target FROM lev
), q AS (
  SELECT *, round_even(target, 0)::BIGINT AS quota FROM t
), p AS (
  SELECT d.doc_id, d.size, q.*, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole, md5('mix:' || d.doc_id::VARCHAR) AS o,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id::VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto,
    list_sum(list_transform(range(0, 8), lambda k: (count(*) OVER (PARTITION BY d.source) > 4096 * 16::BIGINT ** k)::INT))::INT AS digits
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), c AS (
  SELECT *, quota - whole * source_size AS rest, min(o) FILTER (upto > quota - whole * source_size) OVER (PARTITION BY source) AS stop FROM p
), g AS (
  SELECT source, any_value(stop) AS stop, any_value(digits) AS digits, any_value(rest) - coalesce(sum(size) FILTER (o < stop), 0) AS gap FROM c WHERE rest > 0 GROUP BY source
), f(source, stop, digits, gap, size, o, n) AS (
  SELECT source, stop, digits, gap::BIGINT, (1::BIGINT << 60), '', 0 FROM g
  UNION ALL
  SELECT f.source, any_value(f.stop), any_value(f.digits), any_value(f.gap) - arg_min(c.size, {'s': -c.size, 'o': c.o}), arg_min(c.size, {'s': -c.size, 'o': c.o}), arg_min(c.o, {'s': -c.size, 'o': c.o}), any_value(f.n) + 1
  FROM f JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.o > f.stop AND left(c.o, f.digits) = left(f.stop, f.digits) AND c.size > 0 AND c.size <= f.gap AND (c.size < f.size OR (c.size = f.size AND c.o > f.o))
  WHERE f.n < 16 GROUP BY f.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (stop IS NULL OR o < stop OR o IN (SELECT f.o FROM f WHERE f.source IS NOT DISTINCT FROM c.source)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
