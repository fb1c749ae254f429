"""Operators that follow links to any depth: components, chains, ancestors and personalised PageRank.

Each is a loop of joins over DataFrames. Every round is written to the shared folder, so neither lineage nor the plan
grows with depth; only counts reach the driver.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..plans.datasets import MERGED
from ..plans.pairs import LINKS, REPLACES, judged
from ..sources.relations import facts, said

_own: dict[str, str] = {}
#: Links up to which a bank is joined in one task, links that a task of joins gets, and rows that it hands on at a time.
BANK, PART, HELD = 250_000, 2_000_000, 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(spark.sparkContext.applicationId) or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="chronofold-"))
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete what ``_written`` wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of banks that follow each other -> ``bank, name, component``; one bank's names are held at a time."""
    parent: dict = {}
    at, kinds, out = None, None, []

    def root(name):
        while (up := parent.setdefault(name, name)) != name:
            parent[name] = name = parent[up]
        return name

    def told() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
        out.clear()
        return pa.record_batch(columns, names=["bank", "name", "component"])

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in ("bank", "a", "a")]
        for bank, a, b in zip(*(batch.column(c).to_pylist() for c in ("bank", "a", "b"))):
            if bank != at:
                out += [(at, name, root(name)) for name in list(parent)]
                at = bank
                parent.clear()
                if len(out) >= HELD:
                    yield told()
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out += [(at, name, root(name)) for name in list(parent)]
    if out:
        yield told()


def components(links: DataFrame) -> DataFrame:
    """``links(bank, a, b)`` -> ``bank, name, component``: the least name reachable inside the bank, itself included.

    Links are dealt by bank once, and a task joins the names of one bank after another. A bank of more than ``BANK`` links does not gather in a
    task: its links go through rounds of joins. Of banks only their sizes are written.
    """
    links = links.select("bank", "a", "b").where("bank is not null and a is not null and b is not null")
    sizes = cut(links.groupBy("bank").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > BANK).select("bank")
    all_links = sizes.agg(F.sum("n")).first()[0] or 0
    some_large = not large.isEmpty()
    small = links.join(large, "bank", "left_anti") if some_large else links
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(all_links / PART))
    name = links.schema["a"].dataType.simpleString()
    found = small.repartition(parts, "bank").sortWithinPartitions("bank").mapInArrow(_joined, f"bank {links.schema['bank'].dataType.simpleString()}, name {name}, component {name}")
    return found.unionByName(_by_rounds(links.join(large, "bank", "left_semi"))) if some_large else found


def _by_rounds(links: DataFrame) -> DataFrame:
    """``components`` by joins alone. Each round takes the least label of all neighbours and then that label's own label, so chains halve. On disk are
    the links and one round, at the end the last round alone."""
    both, links_at = _written(links.unionByName(links.select("bank", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, labels_at = _written(both.groupBy("bank", F.col("a").alias("name")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("name", "b"), ["bank", "b"]).groupBy("bank", F.col("a").alias("name")).agg(F.min("label").alias("near"))
        own = labels.join(near, ["bank", "name"]).select("bank", "name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select("bank", F.col("name").alias("label"), F.col("label").alias("further"))
        moved, moved_at = _written(own.join(jump, ["bank", "label"], "left").select("bank", "name", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        _remove(links.sparkSession, labels_at)  # a round is read by the next one alone
        labels, labels_at = moved.drop("old"), moved_at
        if moved.where("label <> old").isEmpty():
            _remove(links.sparkSession, links_at)
            return labels.withColumnRenamed("label", "component")


def chain_ends(steps: DataFrame) -> DataFrame:
    """``steps(bank, folder, into_folder)`` -> ``bank, folder, canon``: the end of each chain; a chain that runs into a cycle has
    none, so its folders keep their own name. Each round doubles the length looked ahead."""
    steps = cut(steps.groupBy("bank", "folder").agg(F.min("into_folder").alias("at")))
    ahead = steps
    for _ in range(math.ceil(math.log2(max(2, steps.count()))) + 1):
        jump = ahead.select("bank", F.col("folder").alias("at"), F.col("at").alias("further"))
        ahead = cut(ahead.join(jump, ["bank", "at"], "left").select("bank", "folder", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    runs = steps.select("bank", F.col("folder").alias("at"), F.lit(True).alias("runs"))
    return ahead.join(runs, ["bank", "at"], "left").select("bank", "folder", F.when(F.col("runs"), F.col("folder")).otherwise(F.col("at")).alias("canon"))


def ancestors(edges: DataFrame) -> DataFrame:
    """``edges(bank, ord, old)`` -> all ``bank, ord, ancestor, depth`` with the least depth; ends on cycles too."""
    edges = cut(edges.distinct())
    found = cut(edges.select("bank", "ord", F.col("old").alias("ancestor"), F.lit(1).cast("long").alias("depth")))
    fresh, depth = found, 1
    while not fresh.isEmpty():
        depth += 1
        step = fresh.select("bank", "ord", F.col("ancestor").alias("via")).join(edges.select("bank", F.col("ord").alias("via"), F.col("old").alias("ancestor")), ["bank", "via"]).select("bank", "ord", "ancestor").distinct()
        fresh = cut(step.join(found, ["bank", "ord", "ancestor"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        found = cut(found.unionByName(fresh))
    return found


def pagerank(bridge: DataFrame, seeds: DataFrame, rounds: int = 20, alpha: float = 0.5) -> DataFrame:
    """Personalised PageRank over ``bridge(fact, node)``, restarting at ``seeds(fact, mass)`` with share ``alpha``.

    A fact's mass goes to its nodes by their weights ln(1 + N / df), a node's mass to its facts equally. Returns
    ``fact, score`` of every fact, those out of reach with 0; the rounds read the part of the bridge that the seeds reach.
    """
    bridge = bridge.distinct()
    n = bridge.select("fact").distinct().count()
    df = bridge.groupBy("node").agg(F.count("*").alias("df"))
    edges = bridge.join(df, "node").withColumn("w", F.log(1 + F.lit(float(n)) / F.col("df")))
    total = edges.groupBy("fact").agg(F.sum("w").alias("total"))
    edges = cut(edges.join(total, "fact").select("fact", "node", (F.col("w") / F.col("total")).alias("out"), (1.0 / F.col("df")).alias("back")))
    all_mass = seeds.agg(F.sum("mass")).first()[0] or 1.0
    start = cut(edges.select("fact").distinct().join(seeds.groupBy("fact").agg((F.sum("mass") / all_mass).alias("s")), "fact", "left").select("fact", F.coalesce("s", F.lit(0.0)).alias("s")))
    # mass walks over what the seeds reach in as many rounds; no other fact ever has any
    reached, size = cut(start.where("s <> 0").select("fact")), -1
    for _ in range(rounds):
        before, size = size, reached.count()
        if before == size:
            break
        reached = cut(edges.join(edges.join(reached, "fact", "left_semi").select("node").distinct(), "node", "left_semi").select("fact").unionByName(reached).distinct())
    walk, seeded = cut(edges.join(reached, "fact", "left_semi")), cut(start.join(reached, "fact", "left_semi"))
    mass = seeded.withColumnRenamed("s", "m")
    for _ in range(rounds):
        nodes = walk.join(mass, "fact").groupBy("node").agg(F.sum(F.col("m") * F.col("out")).alias("nm"))
        walked = walk.join(nodes, "node").groupBy("fact").agg(F.sum(F.col("nm") * F.col("back")).alias("fm"))
        mass = cut(seeded.join(walked, "fact").select("fact", (alpha * F.col("s") + (1 - alpha) * F.col("fm")).alias("m")))
    return start.join(mass, "fact", "left").select("fact", F.coalesce("m", F.lit(0.0)).alias("score"))


def _links(d) -> str:
    """Names that mean one thing: the inline ones, and a supplier's parts and the orders that hold them."""
    return f"""{LINKS}, all_links AS (SELECT CAST(bank AS BIGINT) AS bank, a, b FROM links
      {d.of('UNION ALL', 'UNION')} SELECT l_suppkey + 1000, concat('part ', {d.text('l_partkey')}), concat('order ', {d.text('l_orderkey')}) FROM lineitem)"""


def _merges(d) -> str:
    """Folders merged into others: the inline ones, and facts into what replaced them."""
    return f"""{MERGED}, {facts(d)}, all_merged AS (SELECT CAST(bank AS BIGINT) AS bank, folder, into_folder FROM merged
      UNION ALL SELECT bank + 1000, concat('f', {d.text('id')}), concat('f', {d.text('superseded_by')}) FROM facts WHERE superseded_by IS NOT NULL)"""


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(dialect.run(spark, sf_dir, lambda d: f"WITH {_links(d)} SELECT bank, a, b FROM all_links"))


def canonical_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_ends(dialect.run(spark, sf_dir, lambda d: f"WITH {_merges(d)} SELECT bank, folder, into_folder FROM all_merged"))


def _edges(d) -> str:
    return f"{said(d)}, {judged(d)}, e AS (SELECT DISTINCT bank, new_ord AS ord, old_ord AS old FROM verdicts WHERE reason IN {REPLACES})"


def replaces_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a statement replaced, directly or through others; the pairs that may replace are met by joins, not all of a bank with all."""
    from .rules import prepared  # which writes by way of this module

    return ancestors(dialect.run(spark, sf_dir, lambda d: f"WITH {_edges(d)} SELECT bank, ord, old FROM e", prepared(spark, sf_dir)))


def personalised_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their closeness to the orders of the customer with the most of them, over shared parts."""
    items = dialect.run(spark, sf_dir, lambda d: "SELECT DISTINCT l_orderkey AS fact, l_partkey AS node FROM lineitem")
    seeds = dialect.run(spark, sf_dir, lambda d: """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM n ORDER BY n DESC, o_custkey LIMIT 1)
      SELECT o.o_orderkey AS fact, 1e0 AS mass FROM orders o JOIN top ON top.o_custkey = o.o_custkey""")
    return pagerank(items, seeds)


def queries() -> dict:
    return {f.__name__: f for f in (alias_components, canonical_folders, replaces_ancestors, personalised_pagerank)}


def oracle_sql() -> dict[str, str]:
    """Closures by recursion over sets, which the loops above do not use; PageRank is tested against brute force."""
    d = dialect.DUCK
    return {
        "alias_components": f"""WITH RECURSIVE {_links(d)}, e AS (SELECT bank, a, b FROM all_links UNION SELECT bank, b, a FROM all_links),
          r(bank, a, b) AS (SELECT bank, a, a FROM e UNION SELECT r.bank, r.a, e.b FROM r JOIN e ON e.bank = r.bank AND e.a = r.b)
          SELECT bank, a AS name, min(b) AS component FROM r GROUP BY bank, a""",
        "canonical_folders": f"""WITH RECURSIVE {_merges(d)}, r(bank, folder, at_folder) AS (SELECT bank, folder, into_folder FROM all_merged UNION SELECT r.bank, r.folder, m.into_folder FROM r JOIN all_merged m ON m.bank = r.bank AND m.folder = r.at_folder),
          ends AS (SELECT r.bank, r.folder, r.at_folder FROM r LEFT JOIN all_merged m ON m.bank = r.bank AND m.folder = r.at_folder WHERE m.folder IS NULL)
          SELECT DISTINCT a.bank, a.folder, coalesce(ends.at_folder, a.folder) AS canon FROM all_merged a LEFT JOIN ends ON ends.bank = a.bank AND ends.folder = a.folder""",
        "replaces_ancestors": f"""WITH RECURSIVE {_edges(d)}, r(bank, ord, ancestor, depth) AS (SELECT bank, ord, old, CAST(1 AS BIGINT) FROM e UNION SELECT r.bank, r.ord, e.old, r.depth + 1 FROM r JOIN e ON e.bank = r.bank AND e.ord = r.ancestor)
          SELECT bank, ord, ancestor, min(depth) AS depth FROM r GROUP BY bank, ord, ancestor""",
    }
