"""A Merkle manifest of a dataset, held in an external-memory node store.

Leaves are dealt to sorted runs by (tree, key) and numbered; the store is Parquet with a
partition for each level.  A row of the store is a page: the digests of up to ``PAGE``
consecutive nodes of one tree and level.  A level is made by one sequential pass over the
pages of the level below it, and each run of ``FAN_OUT`` digests becomes its parent inside
its page.  Every ``STEP`` levels, when pages are down to one node, they are put together
into new ones.  Proofs come from a merge of the levels by (tree, page).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialize, scratch_path

FAN_OUT = 3
#: Levels between two regroupings, and so the nodes of a page.
STEP = 6
PAGE = FAN_OUT**STEP
#: The low bits in which Spark's increasing ids count the rows of a partition.
_ROW_BITS = 33


def digest(said: Column) -> Column:
    return F.sha2(said.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and itself."""
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (f.cast("string") for f in fields)]
    return digest(F.concat(*said))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, side: digest(F.concat(side["left"], node, side["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    sizes = F.array(*[F.lit(FAN_OUT**k) for k in range(40)])  # up to the largest long
    return F.size(F.filter(sizes, lambda most: most < n))


@dataclass(frozen=True)
class NodeStore:
    """Pages (tree, n, page, hashes, entries) under ``level=0`` to ``level=height``; only leaves have entries."""

    spark: SparkSession
    path: str
    schema: str
    height: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={k}")

    def levels(self, first: int, last: int) -> DataFrame:
        """The pages of some levels, with the level as a column."""
        return self.spark.read.schema(f"{self.schema}, level int").parquet(self.path).where(F.col("level").between(first, last))

    def roots(self) -> DataFrame:
        """(tree, root), the topmost node of every tree."""
        return self.levels(0, self.height).where(F.col("level") == _height(F.col("n"))).select("tree", F.col("hashes")[0].alias("root"))


def _numbered(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves with ``pos`` in their tree from 0 and its size ``n``.

    Ranges of (tree, key, digest) are sorted and written as runs; positions are a run's own
    row numbers and the counts of the runs before, so no task sees a tree.
    """
    order = [F.col("tree").asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    at = F.monotonically_increasing_id()
    runs = materialize(ranged.withColumn("_run", F.shiftright(at, _ROW_BITS)).withColumn("_at", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), "leaf-runs")
    counts = runs.groupBy(F.col("_run").alias("_r"), F.col("tree").alias("_t")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    tree = Window.partitionBy("_t")
    counts = counts.withColumn("_before", F.sum("_n").over(tree.orderBy("_r")) - F.col("_n")).withColumn("n", F.sum("_n").over(tree))
    met = runs.join(counts, (F.col("_run") == F.col("_r")) & F.col("tree").eqNullSafe(F.col("_t")))
    return met.withColumn("pos", F.col("_at") - F.col("_from") + F.col("_before")).select(*leaves.columns, "pos", "n")


def _parents(hashes: Column) -> Column:
    """The digests of consecutive runs of an array; the last run may be shorter."""
    starts = F.sequence(F.lit(1), F.size(hashes), F.lit(FAN_OUT))
    return F.transform(starts, lambda at: digest(F.array_join(F.slice(hashes, at, FAN_OUT), "")))


def build(leaves: DataFrame, key: str) -> NodeStore:
    """The node store over leaves (tree, ``key``, leaf, further columns), a tree for each ``tree``, leaves by ascending key.

    NULL is a tree like others and comes first among keys; equal keys follow their digests.
    """
    spark = leaves.sparkSession
    path = scratch_path(spark, "nodes")
    carried = [c for c in leaves.columns if c not in ("tree", "leaf")]
    numbered = _numbered(leaves, key)
    page = F.expr(f"pos div {PAGE}").alias("page")
    held = F.array_sort(F.collect_list(F.struct("pos", "leaf", F.struct(*carried).alias("entry")))).alias("held")
    pages = numbered.groupBy("tree", "n", page).agg(held).select("tree", "n", "page", F.col("held.leaf").alias("hashes"), F.col("held.entry").alias("entries"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema)
    pages.write.option("compression", "zstd").parquet(f"{path}/level=0")
    base = NodeStore(spark, path, schema, 0)
    height = base.level(0).agg(F.max(_height(F.col("n")))).first()[0] or 0
    for k in range(height):
        up = base.level(k).where(_height(F.col("n")) > k).withColumn("hashes", _parents(F.col("hashes")))
        if (k + 1) % STEP == 0:  # a page is one node now
            nodes = F.array_sort(F.collect_list(F.struct("page", F.col("hashes")[0].alias("hash"))))
            up = up.groupBy("tree", "n", F.expr(f"page div {PAGE}").alias("page")).agg(nodes.alias("nodes")).withColumn("hashes", F.col("nodes.hash"))
        up.select("tree", "n", "page", "hashes").write.option("compression", "zstd").parquet(f"{path}/level={k + 1}")
    return NodeStore(spark, path, schema, height)


def _side(levels: Column, at: Column, k: Column) -> Column:
    """The siblings of a node ``k`` levels above the page's node ``at``: what stands left of it in its run, what right."""
    size = F.pow(F.lit(float(FAN_OUT)), k).cast("long")
    node = F.floor(at / size).cast("int")
    run = F.slice(F.get(levels, k), node - node % FAN_OUT + 1, FAN_OUT)
    own = node % FAN_OUT
    left, right = F.slice(run, F.lit(1), own), F.slice(run, own + 2, F.lit(FAN_OUT))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def proofs(store: NodeStore) -> DataFrame:
    """(tree, leaf, path, entry): of each leaf the siblings on the way up, an array of (left, right)."""
    above = None
    for first in range(store.height // STEP * STEP, -1, -STEP):
        last = min(first + STEP - 1, max(store.height - 1, first))
        merged = F.array_sort(F.collect_list(F.struct("level", "hashes")))["hashes"]
        entries = [F.first("entries", ignorenulls=True).alias("entries")] if first == 0 else []
        met = store.levels(first, last).groupBy("tree", "n", "page").agg(merged.alias("levels"), *entries)
        if above is not None:
            met = met.join(above, met["tree"].eqNullSafe(above["_tree"]) & (met["page"] == above["_page"]), "left")
        further = F.coalesce(F.col("_above"), F.array().cast("array<struct<left:string,right:string>>")) if above is not None else F.array().cast("array<struct<left:string,right:string>>")
        steps = F.greatest(F.least(F.lit(STEP), _height(F.col("n")) - first), F.lit(0))
        numbers = F.filter(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda k: k < steps)
        path = lambda at: F.concat(F.transform(numbers, lambda k: _side(F.col("levels"), at, k)), further)  # noqa: B023, E731
        if first:
            found = F.transform(F.get("levels", F.lit(0)), lambda x, at: F.struct((F.col("page") * PAGE + at).alias("_page"), path(at).alias("_above")))  # noqa: B023
            above = met.select(F.col("tree").alias("_tree"), F.inline(found))
        else:
            found = F.transform(F.get("levels", F.lit(0)), lambda x, at: F.struct(x.alias("leaf"), path(at).alias("path"), F.get("entries", at).alias("entry")))  # noqa: B023
            return met.select("tree", F.inline(found))
    raise AssertionError("level 0 ends the loop")


#: The fields of a document's leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def prove_documents(docs: DataFrame, checked_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    A tree for each source, whose roots are the leaves of one tree more.  ``checked_text``
    stands for the text where the root is folded from the leaf anew; any change shows in
    ``verified``.  NULL is a value of its own in every field (``-``) and comes first in every
    order; empty texts differ from NULL.  Documents that repeat an id are leaves of their
    own, by their digests; repeated rows are equal leaves side by side.  No rows give none.
    Columns but the five of ``FIELDS`` are left out.
    """
    fields = [F.col(c) for c in FIELDS]
    checked = leaf_digest(*fields[:-1], checked_text) if checked_text is not None else leaf_digest(*fields)
    leaves = docs.select(F.col("source").cast("string").alias("tree"), "doc_id", leaf_digest(*fields).alias("leaf"), checked.alias("checked"))
    store = build(leaves, "doc_id")
    subroots = store.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf"))
    top = build(subroots, "source")
    root = top.roots().first()  # one row, none without documents
    of_source = proofs(top).select(F.col("entry.source").alias("_source"), F.col("leaf").alias("subroot"), F.col("path").alias("_upper"))
    found = proofs(store).select("tree", "leaf", "path", "entry.doc_id", "entry.checked")
    whole = found.join(of_source, found["tree"].eqNullSafe(of_source["_source"])).withColumn("path", F.concat("path", "_upper"))
    out = whole.select("doc_id", "leaf", "subroot", F.lit(root.root if root else None).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("checked"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
